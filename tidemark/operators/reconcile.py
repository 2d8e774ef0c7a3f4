"""Comparing the index with its source, row by row and in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import NONE_SENTINEL, feed_order
from tidemark.operators.bitsets import counted_on_both, differing_counts
from tidemark.operators.ids import present
from tidemark.operators.ordered import with_runs
from tidemark.operators.route import UNKNOWN
from tidemark.sources.feed import FIRST_ID_RANGE, first_row

OK, MISSING, EXTRA, DUPLICATE, OUTSIDE = "ok", "missing", "extra", "duplicate", "outside"


def repo_vs_index(source: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Every id of either side with its count on both and a status.

    Both sides are counted before they meet, so an id that is repeated very
    often costs one row per task.
    """
    left = source.groupBy(id_col).agg(F.count("*").alias("in_source"))
    right = index.groupBy(id_col).agg(F.count("*").alias("in_index"))
    n_source, n_index = F.coalesce("in_source", F.lit(0)), F.coalesce("in_index", F.lit(0))
    status = (
        F.when(n_source == 0, EXTRA).when(n_index == 0, MISSING).when(n_index > 1, DUPLICATE).otherwise(OK)
    )
    return left.join(right, id_col, "full_outer").select(
        id_col, n_source.alias("in_source"), n_index.alias("in_index"), status.alias("status")
    )


def repo_vs_index_differences(source: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Ids that one side has more often than the other, with both counts and a status.

    Found by digests of ranges of ids, so sides that are mostly alike are read and summed up but not shuffled. An id
    that both have equally often does not differ, however often that is.
    """
    status = F.when(F.col("in_source") == 0, EXTRA).when(F.col("in_index") == 0, MISSING)
    found = differing_counts(source, index, id_col)
    return found.withColumn("status", status.when(F.col("in_index") > F.col("in_source"), DUPLICATE).otherwise(MISSING))


def covered_by(
    feed: DataFrame,
    id_col: str,
    to_id: int | None = None,
    from_ms: int | None = None,
    to_ms: int | None = None,
    id_range: tuple[int, int] | None = None,
) -> Column:
    """Whether a check covers a feed row: a prefix in feed order, by default from the first commit on.

    With ``id_range`` the prefix begins at the first row whose id is in it. The first row behind either limit ends the
    prefix; what comes after it is out even if its own id is small. Start and cut are one-row aggregates read by the
    driver, so that the rows are scanned with literal bounds.
    """
    if from_ms is None and id_range is not None:
        first = first_row(feed, id_col, id_range).first()
        from_ms = first["commit_time_ms"] if first else 0
    begun = F.lit(True) if from_ms is None else F.col("commit_time_ms") >= from_ms
    behind = F.lit(False)
    if to_ms is not None:
        behind = behind | (F.col("commit_time_ms") > to_ms)
    if to_id is not None:
        behind = behind | (F.col(id_col) > to_id)
    cut = feed.filter(begun & behind).agg(F.min(feed_order(id_col)).alias("cut")).first()["cut"]
    if cut is None:
        return begun
    at, before = F.col("commit_time_ms") == cut["commit_time_ms"], F.col("commit_time_ms") < cut["commit_time_ms"]
    return begun & (before | (at & (F.col(id_col) < cut[id_col])))


def checked_rows(feed: DataFrame, id_col: str, **limits) -> DataFrame:
    """Feed rows a check covers."""
    return feed.filter(covered_by(feed, id_col, **limits))


def check_bounds(rows: DataFrame, id_col: str) -> DataFrame:
    """Id of the first row in feed order (not the smallest) and the largest id, 0 for none."""
    return rows.agg(
        F.min_by(id_col, feed_order(id_col)).alias("min_id"),
        F.coalesce(F.max(id_col), F.lit(0)).alias("max_id"),
    )


def check_index(feed: DataFrame, index: DataFrame, id_col: str, id_range: tuple[int, int] | None = None, **limits) -> DataFrame:
    """Compare the covered source rows with the markers; what the check does not cover is reported as outside.

    With ``id_range``, ids below that of the first row in feed order, or above the largest covered one, are outside on
    either side; without it, markers are compared up to the largest covered id. Every row of both sides counts in
    exactly one row of the report. Bitmaps of ids are compared first; ids are joined only where those differ.
    """
    covered = covered_by(feed, id_col, id_range=id_range, **limits)
    low, high = check_bounds(feed.filter(covered), id_col).first()
    within = F.lit(False)
    if low is not None:
        within = F.col(id_col).between(low, high) if id_range else F.col(id_col) <= high
    inside = F.coalesce(covered & within, F.lit(False)).alias("_inside")
    counts = counted_on_both(
        feed.select(id_col, inside), index.select(id_col, F.coalesce(within, F.lit(False)).alias("_inside")), id_col, ["_inside"]
    )
    status = (
        F.when(~F.col("_inside"), OUTSIDE)
        .when(F.col("in_source") == 0, EXTRA)
        .when(F.col("in_index") == 0, MISSING)
        .when(F.col("in_index") > 1, DUPLICATE)
        .otherwise(OK)
    )
    return counts.select(id_col, "in_source", "in_index", status.alias("status"))


def check_index_tx(feed: DataFrame, index_tx: DataFrame, **limits) -> DataFrame:
    return check_index(feed, index_tx, "tx_id", **limits)


def check_index_acl(feed: DataFrame, index_change_sets: DataFrame, **limits) -> DataFrame:
    return check_index(feed, index_change_sets, "change_set_id", **limits)


def health_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(
        F.count("*").alias("ids"), F.sum("in_source").alias("in_source"), F.sum("in_index").alias("in_index")
    )


def check_node(ids: DataFrame, source: DataFrame, index_nodes: DataFrame) -> DataFrame:
    """Status and transaction the source has for each node, and its rows in the index.

    Anything but exactly one source row counts as unknown, transaction -1.
    """
    known = source.join(ids.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(
        F.count("*").alias("_n"), F.max("status").alias("_status"), F.max("tx_id").alias("_tx")
    )
    wanted = index_nodes.join(ids.select("node_id"), "node_id", "left_semi")
    held = wanted.groupBy("node_id").agg(F.count("*").alias("in_index"), F.max("tx_id").alias("index_tx"))
    single = F.coalesce(F.col("_n") == 1, F.lit(False))
    return (
        ids.select("node_id")
        .join(known, "node_id", "left")
        .join(held, "node_id", "left")
        .select(
            "node_id",
            F.when(single, F.col("_status")).otherwise(UNKNOWN).alias("db_status"),
            F.when(single, F.col("_tx")).otherwise(F.lit(NONE_SENTINEL).cast("long")).alias("db_tx"),
            F.coalesce("in_index", F.lit(0)).alias("in_index"),
            "index_tx",
        )
    )


def check_acl(ids: DataFrame, readers: DataFrame, index_acls: DataFrame) -> DataFrame:
    """Whether the source has readers for each ACL, and how many reader rows the index holds."""
    known = present(ids, readers, "acl_id").distinct().withColumn("_known", F.lit(True))
    held = present(ids, index_acls, "acl_id").groupBy("acl_id").agg(F.count("*").alias("in_index"))
    return (
        ids.select("acl_id")
        .join(known, "acl_id", "left")
        .join(held, "acl_id", "left")
        .select(
            "acl_id",
            F.coalesce("_known", F.lit(False)).alias("exists_in_db"),
            F.coalesce("in_index", F.lit(0)).alias("in_index"),
        )
    )


def check_first(
    feed: DataFrame,
    index: DataFrame,
    id_col: str,
    state_ms: int,
    floor_ms: int = 0,
    id_range: tuple[int, int] = FIRST_ID_RANGE,
) -> DataFrame:
    """Is the first row of the feed in the index, with its commit time?

    ``floor_ms`` is where an id-range shard's nodes begin (-1: it has none, so
    there is nothing to check). A state of 0 has nothing to verify and adopts
    the first commit time.
    """
    rows = feed.filter(F.col("commit_time_ms") >= floor_ms) if state_ms else feed
    first = first_row(rows, id_col, id_range).first()
    first_id, first_ms = (first[id_col], first["commit_time_ms"]) if first else (None, None)
    same = F.lit(False) if first is None else (F.col(id_col) == first_id) & (F.col("commit_time_ms") == first_ms)
    if not state_ms:
        status, state_ms = F.lit("nothing to verify"), first_ms or 0
    elif floor_ms == NONE_SENTINEL:
        status = F.lit("skipped")
    elif first is None:
        status = F.lit("no first row")
    else:
        status = F.when(F.col("matches") == 0, "not in index").when(F.col("matches") == 1, "verified").otherwise("duplicate")
    return (
        index.filter(same)
        .agg(F.count("*").alias("matches"))
        .select(
            F.lit(first_id).cast("long").alias("first_id"),
            F.lit(first_ms).cast("long").alias("first_commit_ms"),
            "matches",
            status.alias("status"),
            F.lit(state_ms).cast("long").alias("state_ms"),
        )
    )


def check_last(feed: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Is the index's last commit time no later than the source's?"""
    source = feed.agg(F.max("commit_time_ms").alias("source_ms"), F.max(id_col).alias("source_id"))
    last = index.agg(F.coalesce(F.max("commit_time_ms"), F.lit(0)).alias("index_ms")).scalar()
    status = (
        F.when(F.col("source_ms").isNull(), "undecided")
        .when(F.col("index_ms") > F.col("source_ms"), "index ahead of source")
        .otherwise("verified")
    )
    return source.withColumn("index_ms", last).withColumn("status", status)


def settled_at(samples: DataFrame, hold_ms: int = 10_000, parts: int | None = None) -> DataFrame:
    """When each core's document count has come to rest.

    A sample is still if its count is positive and equal to the sample before
    it; a core is settled at the first sample that ends a stretch of still
    samples at least ``hold_ms`` long. Stretches are numbered by a running sum
    over (core, time) on one split of the rows, so a core's series is never
    handled as a whole.
    """
    still = (F.col("docs") > 0) & F.col("prev_core").eqNullSafe(F.col("core")) & (F.col("docs") == F.col("prev_docs"))
    moved = ~F.coalesce(still, F.lit(False))
    rows = samples.select("core", "sample_ms", "docs")
    seen = with_runs(rows, ["core", "sample_ms"], ["core", "docs"], moved, "stretch", parts=parts)
    breaks = seen.where(~moved)
    begun = breaks.groupBy("core", "stretch").agg(
        F.min("sample_ms").alias("begin_ms"), F.max("sample_ms").alias("end_ms")
    )
    held = begun.filter(F.col("end_ms") - F.col("begin_ms") >= hold_ms)
    first = held.groupBy("core").agg(F.min("begin_ms").alias("begin_ms"))
    return (
        breaks.join(first, "core")
        .filter(F.col("sample_ms") >= F.col("begin_ms") + hold_ms)
        .groupBy("core")
        .agg(F.min("sample_ms").alias("settled_ms"), F.min_by("docs", "sample_ms").alias("docs"))
    )


def readiness(probes: DataFrame, core_docs: DataFrame, hits: DataFrame, min_docs: int = 50) -> DataFrame:
    """One row: is the service ready?

    Every probe must have answered 200 with the expected text, every shard must
    hold more than ``min_docs`` documents, and the search must have hits.
    ``probes`` has (probe, status, body, expected), ``hits`` one row ``total_items``.
    """
    served = (F.col("status") == 200) & F.col("body").contains(F.col("expected"))
    serving = probes.agg(F.coalesce(F.bool_and(F.coalesce(served, F.lit(False))), F.lit(True)).alias("ok"))
    filled = core_docs.agg(F.coalesce(F.bool_and(F.col("docs") > min_docs), F.lit(True)).alias("ok"))
    found = hits.agg((F.coalesce(F.max("total_items"), F.lit(0)) > 0).alias("has_hits"))
    flags = found.withColumn("probes_ok", serving.scalar()).withColumn("shards_ok", filled.scalar())
    return flags.withColumn("ready", F.col("has_hits") & F.col("probes_ok") & F.col("shards_ok"))
