"""Continuous trackers: micro-batches of the feed through the same plans as a bulk run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.store import IndexStore
from tidemark.streaming.feeds import with_commit_ts

Source = Callable[[], DataFrame]


def stream_track(
    feed: DataFrame,
    store: IndexStore,
    nodes: Source,
    history: Source,
    checkpoint: str,
    shard_count: int = 1,
    hole_ms: int = 3_600_000,
    name: str = "nodes",
) -> StreamingQuery:
    """Apply each micro-batch of transactions to the store.

    A commit is named after its batch, so a batch that is replayed after a crash
    is applied once. Rows further back than the hole are applied like the others,
    with the last version of their nodes, and counted in the store's mark
    ``late_tx``: the index ends as a bulk run would leave it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.track_nodes(
            f"{name}-{batch_id}",
            batch.dropDuplicates(["tx_id"]),
            nodes(),
            hole_ms,
            shard_count=shard_count,
            history=history(),
            late=True,
        )

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_track_acls(
    feed: DataFrame,
    store: IndexStore,
    acls: Source,
    readers: Source,
    checkpoint: str,
    hole_ms: int = 3_600_000,
    name: str = "acls",
) -> StreamingQuery:
    """Apply each micro-batch of change sets to the store, late ones too (mark ``late_sets``)."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        store.track_acls(
            f"{name}-{batch_id}",
            batch.dropDuplicates(["change_set_id"]),
            acls(),
            readers(),
            hole_ms,
            late=True,
        )

    return (
        feed.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedup(feed: DataFrame, id_col: str = "tx_id", hole: str = "1 hour") -> DataFrame:
    """Each row once, although the hole behind the last commit is read again and again.

    Ids are remembered no longer than the hole; rows from before it are dropped.
    """
    return with_commit_ts(feed).withWatermark("commit_ts", hole).dropDuplicatesWithinWatermark([id_col]).drop("commit_ts")


def late_rows(feed: DataFrame, applied: DataFrame, id_col: str = "tx_id") -> DataFrame:
    """Rows of the feed that the stream left out, for the index check to find."""
    return feed.join(applied.select(id_col), id_col, "left_anti")


def stream_high_watermark(feed: DataFrame, group: str = "core", id_col: str = "tx_id") -> DataFrame:
    """Furthest (commit time, id) and number of documents of each core so far."""
    mark = F.max(F.struct("commit_time_ms", id_col)).alias("mark")
    reached = feed.groupBy(group).agg(mark, F.count("*").alias("docs"))
    return reached.select(
        group, F.col("mark.commit_time_ms").alias("commit_time_ms"), F.col(f"mark.{id_col}").alias(id_col), "docs"
    )
