"""Which rows of a feed are still to be indexed, and from where to read on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.order import NONE_SENTINEL, feed_order
from tidemark.operators.ids import present

SEEN_MEMORY = 100  # fixed size of the tracker's memory


def remember(rows: DataFrame, id_col: str, memory: int = SEEN_MEMORY) -> DataFrame:
    """The last ``memory`` rows of a feed with their arrival number (at most ``memory`` rows)."""
    newest = rows.orderBy(F.desc("commit_time_ms"), F.desc(id_col)).limit(memory)
    arrival = F.row_number().over(Window.orderBy("commit_time_ms", id_col))
    return newest.withColumn("arrival", arrival.cast("long"))


def pending(feed: DataFrame, indexed: DataFrame, id_col: str, last_indexed_ms: int) -> DataFrame:
    """Rows not indexed yet: newer than the state, or older but absent from the index.

    The time test is part of the anti join, so rows newer than the state are
    kept even if the index knows them. Only the older rows (in a regular run
    those of the hole) are looked up in the index.
    """
    older = feed.filter(F.col("commit_time_ms") <= last_indexed_ms)
    known = present(older, indexed, id_col).withColumnRenamed(id_col, "_known")
    match = (F.col(id_col) == F.col("_known")) & (F.col("commit_time_ms") <= last_indexed_ms)
    return feed.join(known, match, "left_anti")


def pending_transactions(feed: DataFrame, index_tx: DataFrame, last_indexed_ms: int) -> DataFrame:
    return pending(feed, index_tx, "tx_id", last_indexed_ms)


def pending_change_sets(feed: DataFrame, index_change_sets: DataFrame, last_indexed_ms: int) -> DataFrame:
    return pending(feed, index_change_sets, "change_set_id", last_indexed_ms)


def already_seen(page: DataFrame, seen: DataFrame, id_col: str) -> DataFrame:
    """One row saying whether the page holds nothing new.

    ``seen`` is the bounded memory of ``remember``. An empty memory has seen
    nothing; a page of one row is compared with the last arrival only.
    """
    last = seen.agg(F.max_by(id_col, "arrival").alias("_last")).scalar()
    memory = seen.select(F.col(id_col).alias("_seen_id"))
    shape = page.join(memory, F.col(id_col) == F.col("_seen_id"), "left").agg(
        F.count("*").alias("page_rows"), F.count_if(F.col("_seen_id").isNull()).alias("_unseen"), F.min(id_col).alias("_only")
    )
    verdict = (
        F.when(F.col("_last").isNull(), False)
        .when(F.col("page_rows") == 1, F.col("_only") == F.col("_last"))
        .otherwise(F.col("_unseen") == 0)
    )
    return shape.withColumn("_last", last).select("page_rows", verdict.alias("already_seen"))


def stop_guard(page: DataFrame, stop_ms: int) -> DataFrame:
    """The whole page, or nothing if any of its rows lies behind the stop time."""
    late = page.agg(F.coalesce(F.max("commit_time_ms") > stop_ms, F.lit(False)).alias("late"))
    return page.filter(~late.scalar())


def nonempty_transactions(feed: DataFrame) -> DataFrame:
    return feed.filter((F.col("updates") > 0) | (F.col("deletes") > 0))


def nonempty_change_sets(feed: DataFrame) -> DataFrame:
    return feed.filter(F.col("acl_count") > 0)


def resume_point(seen: DataFrame, last_good_ms: int) -> DataFrame:
    """Commit time to read on from: that of the last row seen, else the state's."""
    last = F.max_by("commit_time_ms", "arrival")
    return seen.agg(F.coalesce(last, F.lit(last_good_ms)).alias("from_commit_ms"))


def hole_rescan(feed: DataFrame, indexed: DataFrame, id_col: str, last_good_ms: int, hole_ms: int) -> DataFrame:
    """What a new run reads again behind the last good commit to catch late commits."""
    window = feed.filter(F.col("commit_time_ms") >= last_good_ms - hole_ms)
    return pending(window, indexed, id_col, last_good_ms)


def clamp_to_shard_range(
    feed: DataFrame,
    interval: DataFrame,
    index_tx: DataFrame,
    from_ms: int,
    last_indexed_ms: int,
) -> DataFrame:
    """Feed rows an id-range shard has to read, given its commit interval.

    Reading starts no earlier than the interval. If the shard holds no nodes or
    is read past its end, only the newest commit of the server remains, as a
    synthetic row (largest time and largest id, taken independently, no counts)
    and only if it is still pending.
    """
    low, high = interval.select("min_commit_ms", "max_commit_ms").first()
    columns = ["tx_id", "commit_time_ms", "updates", "deletes"]
    if low != NONE_SENTINEL and from_ms <= high:
        return feed.filter(F.col("commit_time_ms") >= max(from_ms, low)).select(*columns)
    nothing = F.lit(None).cast("long")
    newest = feed.agg(
        F.max("tx_id").alias("tx_id"),
        F.max("commit_time_ms").alias("commit_time_ms"),
    ).filter("tx_id IS NOT NULL")
    newest = newest.withColumn("updates", nothing).withColumn("deletes", nothing)
    return pending_transactions(newest, index_tx, last_indexed_ms)


def server_maxima(feed: DataFrame, id_col: str) -> DataFrame:
    """Largest commit time and largest id, taken independently."""
    return feed.agg(F.max("commit_time_ms").alias("max_commit_ms"), F.max(id_col).alias("max_id"))


def high_watermark(feed: DataFrame, id_col: str, state_ms: int = 0, state_id: int = 0) -> DataFrame:
    """Furthest (commit time, id) reached; never behind the state."""
    old = F.struct(F.lit(state_ms).cast("long").alias("commit_time_ms"), F.lit(state_id).cast("long").alias(id_col))
    best = feed.agg(F.greatest(F.coalesce(F.max(feed_order(id_col)), old), old).alias("mark"))
    return best.select(F.col("mark.commit_time_ms").alias("commit_time_ms"), F.col(f"mark.{id_col}").alias(id_col))


def recover_state(markers: DataFrame, id_col: str) -> DataFrame:
    """State after an invalidation: the last marker in the index, zeros if there is none."""
    return high_watermark(markers, id_col, 0, 0)


def feed_stats(batched: DataFrame) -> DataFrame:
    """Transactions and documents of each batch, and the commit times it spans."""
    return batched.groupBy("batch_no").agg(
        F.count("*").alias("transactions"),
        F.sum(F.col("updates") + F.col("deletes")).alias("docs"),
        F.min("commit_time_ms").alias("first_commit_ms"),
        F.max("commit_time_ms").alias("last_commit_ms"),
    )


def acl_feed_stats(batched: DataFrame) -> DataFrame:
    """The same for batches of change sets, counted in ACLs."""
    return batched.groupBy("batch_no").agg(
        F.count("*").alias("change_sets"),
        F.sum("acl_count").alias("acls"),
        F.min("commit_time_ms").alias("first_commit_ms"),
        F.max("commit_time_ms").alias("last_commit_ms"),
    )
