"""Forward reading against a step-by-step simulation of its rules."""

import random

import pytest

from tidemark.operators import pending
from tidemark.sources import feed
from tests.conftest import rows

HOUR = feed.HOUR_MS
SCHEMA = "tx_id long, commit_time_ms long"


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def memory(spark, data):
    return spark.createDataFrame(
        [(i, t, n + 1) for n, (i, t) in enumerate(data)], "tx_id long, commit_time_ms long, arrival long"
    )


def simulate(data, seen, start, end, widths, cap):
    """The rules as a loop: widths yields the width of each window."""
    ids = {i for i, _ in seen}
    while True:
        width = next(widths)
        page = sorted(((t, i) for i, t in data if start <= t < start + width))[:cap]
        start += width
        if page:
            if not seen:
                known = False
            elif len(page) == 1:
                known = page[0][1] == seen[-1][0]
            else:
                known = all(i in ids for _, i in page)
            if not known:
                return sorted(((i, t) for t, i in page), key=repr)
        elif start >= end:
            return []
        if start > 10**15:
            return []


def equal(width):
    while True:
        yield width


def doubling(step, top):
    while True:
        yield step
        step = min(step * 2, top)


@pytest.mark.parametrize("seed", range(6))
def test_next_page_follows_the_rules(spark, seed):
    dice = random.Random(seed)
    data = sorted(((i, 10 * HOUR + dice.randrange(0, 40) * HOUR // 2) for i in range(30)), key=lambda r: (r[1], r[0]))
    seen = data[: dice.randrange(0, 12)]
    start = data[0][1] if not seen else seen[-1][1] - dice.randrange(0, 3) * HOUR
    end = start + dice.randrange(1, 30) * HOUR
    for cap in (1, 3, 2000):
        got = feed.next_page(frame(spark, data), memory(spark, seen), "tx_id", start, end, HOUR, cap)
        assert rows(got) == simulate(data, seen, start, end, equal(HOUR), cap)


@pytest.mark.parametrize("seed", range(4))
def test_adaptive_windows_follow_the_rules(spark, seed):
    dice = random.Random(seed)
    data = sorted(((i, 5 * HOUR + dice.randrange(0, 4000) * HOUR) for i in range(12)), key=lambda r: (r[1], r[0]))
    seen = data[: dice.randrange(0, 4)]
    start = 5 * HOUR if not seen else seen[-1][1]
    for end in (start + 50 * HOUR, start + 9000 * HOUR):
        got = feed.adaptive_windows(frame(spark, data), memory(spark, seen), "tx_id", start, end)
        assert rows(got) == simulate(data, seen, start, end, doubling(HOUR, feed.MAX_STEP_MS), feed.PAGE_CAP)


def test_window_widths(spark):
    """Start, end and middle of every window of the doubling schedule."""
    start, number, points = 1000, 0, []
    for width in [HOUR << n for n in range(10)] + [feed.MAX_STEP_MS] * 3:
        points += [(number, start), (number, start + width - 1), (number, start + width // 2)]
        start, number = start + width, number + 1
    for want, at in points:
        page = feed.adaptive_windows(
            frame(spark, [(1, at)]), memory(spark, []), "tx_id", 1000, 2**60
        )
        assert rows(page) == [(1, at)], want


def test_from_the_beginning_only_one_window_is_read(spark):
    data = frame(spark, [(1, 5 * HOUR)])
    assert rows(feed.next_page(data, memory(spark, []), "tx_id", None, 10**15)) == []
    assert rows(feed.next_page(data, memory(spark, []), "tx_id", 0, 10**15, step_ms=6 * HOUR)) == [(1, 5 * HOUR)]


def test_more_rows_at_one_time_than_the_memory_holds(spark):
    data = [(i, 7 * HOUR) for i in range(101)]
    seen = pending.remember(frame(spark, data), "tx_id")
    page = feed.next_page(frame(spark, data), seen, "tx_id", 7 * HOUR, 10**9)
    assert page.count() == 101
    assert rows(pending.already_seen(frame(spark, data), seen, "tx_id")) == [(101, False)]


def test_already_seen_rules(spark):
    page = frame(spark, [(1, 5)])
    empty = memory(spark, [])
    assert rows(pending.already_seen(page, empty, "tx_id")) == [(1, False)]
    assert rows(pending.already_seen(page, memory(spark, [(1, 5), (2, 6)]), "tx_id")) == [(1, False)]
    assert rows(pending.already_seen(page, memory(spark, [(2, 6), (1, 5)]), "tx_id")) == [(1, True)]
    two = frame(spark, [(1, 5), (2, 6)])
    assert rows(pending.already_seen(two, memory(spark, [(2, 6), (1, 5)]), "tx_id")) == [(2, True)]


def test_stop_guard_is_all_or_nothing(spark):
    page = frame(spark, [(1, 5), (2, 6)])
    assert pending.stop_guard(page, 6).count() == 2
    assert pending.stop_guard(page, 5).count() == 0
    assert pending.stop_guard(page.filter("false"), 5).count() == 0


def test_watermark_never_moves_back(spark):
    page = frame(spark, [(9, 5), (2, 6)])
    assert rows(pending.high_watermark(page, "tx_id", 3, 50)) == [(6, 2)]
    assert rows(pending.high_watermark(page, "tx_id", 6, 50)) == [(6, 50)]
    assert rows(pending.high_watermark(page.filter("false"), "tx_id", 6, 50)) == [(6, 50)]


def test_empty_shard_interval(spark):
    nodes = spark.createDataFrame([(1, 1)], "node_id long, tx_id long")
    tx = frame(spark, [(1, 5)])
    assert rows(feed.commit_interval(nodes, tx, 5, 9)) == [(-1, -1)]
    assert rows(feed.commit_interval(nodes, tx, 1, 2)) == [(5, 5)]


def test_probes_read_no_more_than_the_memory_and_one(spark, monkeypatch):
    data = [(i, 7 * HOUR + i * 1000) for i in range(5000)]
    seen = data[:90]
    limits, scan = [], feed.scan_feed

    def watched(rows, *bounds, **named):
        limits.append(named.get("max_results"))
        return scan(rows, *bounds, **named)

    monkeypatch.setattr(feed, "scan_feed", watched)
    page = feed.next_page(frame(spark, data), memory(spark, seen), "tx_id", 7 * HOUR, 10**15, max_results=200)
    assert limits == [None, 91, 200]
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in text and "Join" not in text
    # A page smaller than the memory hides the new row: the next window is probed, not the whole feed.
    assert rows(feed.next_page(frame(spark, data), memory(spark, seen), "tx_id", 7 * HOUR, 10**15, max_results=50)) == data[3600:3650]


def test_a_feed_that_repeats_known_rows(spark):
    data = [(1, 7 * HOUR)] * 300 + [(2, 7 * HOUR + 1)]
    got = feed.next_page(frame(spark, data), memory(spark, [(1, 7 * HOUR)]), "tx_id", 7 * HOUR, 10**15, max_results=2000)
    assert len(rows(got)) == 301
    assert rows(feed.next_page(frame(spark, data[:-1]), memory(spark, [(1, 7 * HOUR)]), "tx_id", 7 * HOUR, 10**15)) == []
