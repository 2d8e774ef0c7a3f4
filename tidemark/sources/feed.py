"""Reading a commit-ordered feed: slices, first rows, forward windows, intervals.

A feed is any DataFrame with ``commit_time_ms`` and an id column. All time and
id ranges are half-open, ``[from, to)``; a null bound is open. That is this
library's choice where the data model leaves it free: the last row seen is read
again and removed as a duplicate, so the lower bound has to be inclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import NONE_SENTINEL, feed_order

#: Page caps, first-row id range, scan steps in milliseconds.
PAGE_CAP = 2000
FIRST_ID_RANGE = (0, 2000)
HOUR_MS = 3_600_000
MAX_STEP_MS = 32 * 24 * HOUR_MS

Bound = int | Column | None


def scan_feed(
    feed: DataFrame,
    id_col: str,
    from_time: Bound = None,
    to_time: Bound = None,
    from_id: Bound = None,
    to_id: Bound = None,
    max_results: int | None = None,
) -> DataFrame:
    """A slice of the feed in feed order, capped at ``max_results`` rows if given."""
    bounds = [
        (from_time, "commit_time_ms", Column.__ge__),
        (to_time, "commit_time_ms", Column.__lt__),
        (from_id, id_col, Column.__ge__),
        (to_id, id_col, Column.__lt__),
    ]
    for bound, column, compare in bounds:
        if bound is not None:
            feed = feed.filter(compare(F.col(column), bound))
    if max_results is None:
        return feed
    return feed.orderBy("commit_time_ms", id_col).limit(max_results)


def scan_transactions(feed: DataFrame, **bounds) -> DataFrame:
    return scan_feed(feed, "tx_id", **bounds)


def scan_change_sets(feed: DataFrame, **bounds) -> DataFrame:
    return scan_feed(feed, "change_set_id", **bounds)


def first_row(feed: DataFrame, id_col: str, id_range: tuple[int, int] = FIRST_ID_RANGE) -> DataFrame:
    """The first row in feed order within an id range; none is a legal answer."""
    return scan_feed(feed, id_col, from_id=id_range[0], to_id=id_range[1], max_results=1)


def first_transaction(feed: DataFrame, id_range: tuple[int, int] = FIRST_ID_RANGE) -> DataFrame:
    return first_row(feed, "tx_id", id_range)


def first_change_set(feed: DataFrame, id_range: tuple[int, int] = FIRST_ID_RANGE) -> DataFrame:
    return first_row(feed, "change_set_id", id_range)


def next_commit_time(feed: DataFrame, at_or_after: Bound) -> DataFrame:
    """Smallest commit time at or after a point, -1 if there is none."""
    later = feed.filter(F.col("commit_time_ms") >= at_or_after)
    return later.agg(F.coalesce(F.min("commit_time_ms"), F.lit(NONE_SENTINEL)).alias("next_commit_ms"))


def _first_new_window(
    feed: DataFrame,
    seen: DataFrame,
    id_col: str,
    window_of: Callable[[int], int],
    window_start: Callable[[int], int],
    end_ms: int,
    max_results: int,
) -> DataFrame:
    """First page of the forward windows that holds something new.

    Only rows of the memory, at most its fixed size, can come before the first new row. So that row is among the first
    (memory + 1) rows in feed order, a top-k with literal bounds; how far the feed goes on behind them is not looked at.
    If a page cap hides the new row behind known ones of its window, the next probe begins at the next window; each such
    probe has used up a page of the memory, so there are few. Windows that are empty or wholly seen are passed over;
    after an empty one the next is tried only if it starts before ``end_ms``.

    The memory and the rows of the probes come to the driver, as many as the memory holds. The page itself is then read
    with literal bounds.
    """
    memory = seen.select(id_col, "arrival").collect()
    known = {row[id_col] for row in memory}
    last_seen = max(memory, key=lambda row: row["arrival"])[id_col] if memory else None
    at, passed, size = 0, -1, len(known) + 1
    while True:
        probe = scan_feed(feed, id_col, from_time=window_start(at), max_results=size)
        rows = probe.select("commit_time_ms", id_col).collect()
        whole = len(rows) < size
        if not whole and all(row[id_col] in known for row in rows):
            # Only a feed that repeats known rows fills a probe with them.
            size *= 2
            continue
        by_window: dict[int, list] = {}
        for row in rows:
            by_window.setdefault(window_of(row["commit_time_ms"]), []).append(row[id_col])
        for window, ids in by_window.items():
            if window - passed > 1 and window_start(window) >= end_ms:
                return feed.limit(0)
            # Only the last window of a probe may go on behind it; with one row there, that row is new.
            if last_seen is None or _is_new(ids, known, last_seen, max_results):
                return scan_feed(feed, id_col, window_start(window), window_start(window + 1), max_results=max_results)
            passed = window
        if whole:
            return feed.limit(0)
        at = passed + 1


def _is_new(ids: list, known: set, last_seen, max_results: int) -> bool:
    """Whether a window's page is worth reading: a single row if it is not the last one seen, more if one is not known."""
    page = ids[:max_results]
    if len(page) == 1:
        return page[0] != last_seen
    return any(i not in known for i in page)


def next_page(
    feed: DataFrame,
    seen: DataFrame,
    id_col: str,
    from_ms: int | None,
    end_ms: int,
    step_ms: int = HOUR_MS,
    max_results: int = PAGE_CAP,
) -> DataFrame:
    """Next page when reading forward in windows of equal width.

    From the beginning of time exactly one window is read, whatever it holds.
    ``seen`` is the bounded memory of the rows read last (``remember``).
    """
    start = from_ms or 0
    if start == 0:
        return scan_feed(feed, id_col, 0, step_ms, max_results=max_results)
    later = scan_feed(feed, id_col, from_time=start)
    return _first_new_window(
        later, seen, id_col, lambda ms: (ms - start) // step_ms, lambda n: start + n * step_ms, end_ms, max_results
    )


def next_commit_page(
    feed: DataFrame, id_col: str, after_ms: int, step_ms: int = HOUR_MS, max_results: int = PAGE_CAP
) -> DataFrame:
    """The window that begins at the next commit time, used to jump over an empty stretch."""
    begin = next_commit_time(feed, after_ms).first()["next_commit_ms"]
    if begin == NONE_SENTINEL:
        return feed.limit(0)
    return scan_feed(feed, id_col, begin, begin + step_ms, max_results=max_results)


def _doublings(step_ms: int, max_step_ms: int) -> int:
    """How many windows are as wide as a doubling of the first step, before the cap holds."""
    n = 0
    while step_ms << n <= max_step_ms:
        n += 1
    return n


def adaptive_windows(
    feed: DataFrame,
    seen: DataFrame,
    id_col: str,
    from_ms: int | None,
    end_ms: int,
    step_ms: int = HOUR_MS,
    max_step_ms: int = MAX_STEP_MS,
    max_results: int = PAGE_CAP,
) -> DataFrame:
    """Next page when each window is twice as wide as the one before, up to a cap.

    The window of a commit time has a closed form (the bit length of the number
    of steps since the start while the widths double), so no range join against
    a schedule is needed.
    """
    start = from_ms or 0
    doubling = _doublings(step_ms, max_step_ms)
    grown = (1 << doubling) - 1  # steps covered by the doubling windows

    def window_of(ms: int) -> int:
        steps = (ms - start) // step_ms
        if steps < grown:
            return (steps + 1).bit_length() - 1
        return doubling + (ms - start - grown * step_ms) // max_step_ms

    def window_start(n: int) -> int:
        if n <= doubling:
            return start + ((1 << n) - 1) * step_ms
        return start + grown * step_ms + (n - doubling) * max_step_ms

    later = scan_feed(feed, id_col, from_time=start)
    return _first_new_window(later, seen, id_col, window_of, window_start, end_ms, max_results)


def commit_interval(nodes: DataFrame, feed: DataFrame, start_id: Bound, end_id: Bound) -> DataFrame:
    """First and last commit time of transactions touching node ids in ``[start, end)``; -1 if none.

    A semi join: a transaction touching very many of the nodes counts once.
    """
    touching = nodes.filter((F.col("node_id") >= start_id) & (F.col("node_id") < end_id)).select("tx_id")
    nothing = F.lit(NONE_SENTINEL)
    return feed.join(touching, "tx_id", "left_semi").agg(
        F.coalesce(F.min("commit_time_ms"), nothing).alias("min_commit_ms"),
        F.coalesce(F.max("commit_time_ms"), nothing).alias("max_commit_ms"),
    )


def nodes_by_id_range(nodes: DataFrame, from_id: Bound, to_id: Bound) -> DataFrame:
    """Nodes with an id in the range, both ends included."""
    return nodes.filter(F.col("node_id").between(from_id, to_id))
