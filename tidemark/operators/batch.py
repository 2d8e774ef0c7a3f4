"""Batches, chunks, latest versions and trailing rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import with_place, with_position, with_running_sum

#: Fixed default sizes.
TX_BATCH_DOCS = 2000
CHANGE_SET_BATCH = 2000
CHANGE_SET_BATCH_CAP = 512
NODE_CHUNK = 50
ACL_CHUNK = 100
DELETE_BATCH = 1000


def weighted_batches(feed: DataFrame, size: int = TX_BATCH_DOCS, parts: int | None = None) -> DataFrame:
    """Batch number of each transaction by the documents that come before it.

    A transaction belongs to the batch in which it starts; an empty one takes
    the running batch.
    """
    weight = F.col("updates") + F.col("deletes")
    summed = with_running_sum(feed, ["commit_time_ms", "tx_id"], weight, "docs_before", parts)
    return summed.withColumn("batch_no", F.expr(f"docs_before div {size}"))


def count_batches(
    feed: DataFrame, id_col: str = "change_set_id", size: int = CHANGE_SET_BATCH, parts: int | None = None
) -> DataFrame:
    """Batches of a fixed number of rows in feed order; the size never exceeds the cap."""
    size = min(size, CHANGE_SET_BATCH_CAP)
    placed = with_position(feed, ["commit_time_ms", id_col], "position", parts)
    return placed.withColumn("batch_no", F.expr(f"position div {size}"))


def fixed_chunks(
    rows: DataFrame, batch: str, order: Sequence[str], size: int, parts: int | None = None
) -> DataFrame:
    """Chunks of ``size`` rows within each batch, the last one shorter.

    Rows are placed over (batch, order) at once, so a batch of any size is
    spread over the parts.
    """
    placed = with_place(rows, batch, order, "_place", parts)
    return placed.withColumn("chunk_no", F.expr(f"_place div {size}")).drop("_place")


def delete_batches(
    keys: DataFrame, key: str = "key", size: int = DELETE_BATCH, parts: int | None = None
) -> DataFrame:
    """Distinct keys, descending, in requests of at most ``size``."""
    placed = with_position(keys.select(key).distinct(), [key], "position", parts, descending=True)
    return placed.withColumn("batch_no", F.expr(f"position div {size}"))


def latest_per_node(
    versions: DataFrame, key: str = "node_id", order: Sequence[str] = ("commit_time_ms", "tx_id")
) -> DataFrame:
    """The last version of each node by (commit time, transaction).

    An aggregate rather than a rank: a node with very many versions shrinks to
    one row per task before the shuffle. The row itself travels in the buffer,
    which makes Spark sort each task's versions; finding the largest order first
    and joining the rows back would shuffle every version instead.
    """
    columns = [c for c in versions.columns if c != key]
    latest = versions.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_latest"))
    return latest.select(key, "_latest.*").select(*versions.columns)


def request_rates(requests: DataFrame, windows: Sequence[int] = (300, 900)) -> DataFrame:
    """Requests per second over the trailing windows, for each handler and second with requests.

    Requests are first counted per second. A slot is as long as the longest
    window and also gets the rows of the slot before it, so one (handler, slot)
    holds at most two slots' worth of seconds however busy the handler is.
    """
    slot = max(windows)
    second: Column = F.expr("ts_ms div 1000")
    counts = requests.groupBy("handler", second.alias("second")).agg(F.count("*").alias("requests"))
    own = F.expr(f"second div {slot}")
    spread = counts.select(
        "*", F.explode(F.array(own, own + 1)).alias("_slot"), own.alias("_own")
    )
    rates = []
    for width in windows:
        trailing = (
            Window.partitionBy("handler", "_slot").orderBy("second").rangeBetween(-(width - 1), Window.currentRow)
        )
        rates.append((F.sum("requests").over(trailing) / width).alias(f"rate_{width // 60}min"))
    return spread.select("handler", "second", "requests", "_slot", "_own", *rates).filter("_slot = _own").drop(
        "_slot", "_own"
    )
