"""Routing of nodes and ACLs to shards, and what each shard sees of a node.

How a node finds its shard is this library's choice: by id modulo the number of
shards (``DB_ID``), or by the half-open id range that holds it (``DB_ID_RANGE``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the data model.
DB_ID, DB_ID_RANGE = "DB_ID", "DB_ID_RANGE"
UPDATED, DELETED, UNKNOWN = "UPDATED", "DELETED", "UNKNOWN"
NON_SHARD_UPDATED, NON_SHARD_DELETED = "NON_SHARD_UPDATED", "NON_SHARD_DELETED"
NODE_STATUSES = [UPDATED, DELETED, UNKNOWN, NON_SHARD_UPDATED, NON_SHARD_DELETED]

SHARD_ROW = ["acl_id", "node_id", "node_ref", "tenant", "tx_id"]


def even_ranges(bound: int, count: int) -> list[tuple[int, int]]:
    """Equal id ranges ``[start, end)`` covering ``[0, bound)``."""
    return [(i * bound // count, (i + 1) * bound // count) for i in range(count)]


def home_shard(
    shard_count: int, method: str = DB_ID, ranges: Sequence[tuple[int, int]] = (), node_id: str = "node_id"
) -> Column:
    """Shard of a node id; null if no range holds it."""
    key = F.col(node_id)
    if method == DB_ID:
        return F.pmod(key, F.lit(shard_count)).cast("int")
    if method != DB_ID_RANGE:
        raise ValueError(f"unknown shard method {method}")
    return F.coalesce(
        F.lit(None).cast("int"),
        *[F.when((key >= start) & (key < end), F.lit(shard)) for shard, (start, end) in enumerate(ranges)],
    )


def route_nodes(
    nodes: DataFrame, shard_count: int, method: str = DB_ID, ranges: Sequence[tuple[int, int]] = ()
) -> DataFrame:
    return nodes.withColumn("shard", home_shard(shard_count, method, ranges))


def route_acls(acls: DataFrame, shard_count: int) -> DataFrame:
    """Every ACL once per shard: each shard needs them all for its permission filter."""
    return acls.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))))


def expand_shard_range(shards: DataFrame) -> DataFrame:
    """Widen a shard's id range to the cap its index reports; -1 means no cap."""
    return shards.select(
        "*",
        F.greatest("end_id", "index_cap").alias("effective_end"),
        (F.col("index_cap") > F.col("end_id")).alias("expanded"),
    )


def check_statuses(nodes: DataFrame) -> DataFrame:
    """Let a run fail on a node status outside the data model."""
    known = F.col("status").isin(NODE_STATUSES)
    return nodes.withColumn(
        "status",
        F.when(known, F.col("status")).otherwise(
            F.raise_error(F.concat(F.lit("unknown node status "), F.coalesce("status", F.lit("null"))))
        ),
    )


def shard_view(
    nodes: DataFrame,
    shard_count: int,
    cascade: bool = True,
    instance: int | None = None,
    method: str = DB_ID,
    ranges: Sequence[tuple[int, int]] = (),
) -> DataFrame:
    """What each shard (or only ``instance``) gets to see of the nodes.

    At home a node is unchanged. Elsewhere it is left out, unless changes
    cascade: then an update is seen as such and anything else as a deletion.
    Without cascade, rows are filtered and never multiplied.
    """
    routed = route_nodes(nodes, shard_count, method, ranges).withColumnRenamed("shard", "_home")
    here = F.col("shard").eqNullSafe(F.col("_home"))
    if instance is not None:
        seen = routed.withColumn("shard", F.lit(instance))
    elif cascade:
        seen = routed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shard_count - 1))))
    else:
        seen = routed.withColumn("shard", F.col("_home")).filter("_home is not null")
    if not cascade:
        seen = seen.filter(here)
    elsewhere = F.when(F.col("status") == UPDATED, NON_SHARD_UPDATED).otherwise(NON_SHARD_DELETED)
    status = F.when(here, F.col("status")).otherwise(elsewhere)
    return seen.select("shard", *SHARD_ROW, status.alias("status"))


def home_rows(
    nodes: DataFrame, shard_count: int, method: str = DB_ID, ranges: Sequence[tuple[int, int]] = ()
) -> DataFrame:
    """Each node at its own shard only."""
    return shard_view(nodes, shard_count, cascade=False, method=method, ranges=ranges)


def store_ref(node_ref: str = "node_ref") -> Column:
    """The store part of a node reference."""
    return F.regexp_extract(F.col(node_ref), "^(.*)/[^/]*$", 1)


def store_to_core(nodes: DataFrame, cores: dict[str, str], node_ref: str = "node_ref") -> DataFrame:
    """Name of the core that holds each node's store; null for an unknown store."""
    core: Column = F.lit(None).cast("string")
    for store, name in cores.items():
        core = F.when(F.col("_store") == store, name).otherwise(core)
    return nodes.withColumn("_store", store_ref(node_ref)).withColumn("core", core).drop("_store")
