"""Changes to the index tables, each as a new frame made from the old one.

A mutation is "the old rows without the touched keys, and the new rows". The
touched keys are usually few, so the anti join broadcasts them (by measured
size) and the old rows are not shuffled at all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.order import UNKNOWN_TX
from tidemark.operators.expand import acls_of_change_sets, nodes_of_transactions, readers_of_acls
from tidemark.operators.ids import absent_from, without
from tidemark.operators.route import (
    DELETED,
    NON_SHARD_DELETED,
    NON_SHARD_UPDATED,
    SHARD_ROW,
    UNKNOWN,
    home_rows,
    shard_view,
)

NODE_COLUMNS = ["node_id", "tx_id", "acl_id", "node_ref", "tenant", "status"]


class NodeIndex(NamedTuple):
    """Node rows and transaction markers, plus the requested ids the source does not know."""

    nodes: DataFrame
    markers: DataFrame
    unknown: DataFrame | None = None


class AclIndex(NamedTuple):
    """Reader rows and change-set markers, plus the requested ids the source does not know."""

    acls: DataFrame
    markers: DataFrame
    unknown: DataFrame | None = None


def upsert_nodes(index_nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace nodes by their changed rows (one per node).

    The effect of a status is this library's choice: deletions, also those
    cascaded from another shard, remove the row; an update cascaded from another
    shard leaves the node's own data alone; everything else replaces it.
    """
    touched = changes.filter(F.col("status") != NON_SHARD_UPDATED)
    alive = touched.filter(~F.col("status").isin(DELETED, NON_SHARD_DELETED))
    return without(index_nodes, touched, "node_id").unionByName(alive.select(*index_nodes.columns))


def append_nodes(index_nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """Insert nodes only where the index has none with that id."""
    alive = rows.filter(~F.col("status").isin(DELETED, NON_SHARD_DELETED))
    return index_nodes.unionByName(absent_from(alive, index_nodes, "node_id").select(*index_nodes.columns))


def delete_by_node(index_nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return without(index_nodes, ids, "node_id")


def delete_by_tx(index: NodeIndex, ids: DataFrame) -> NodeIndex:
    """Remove the nodes that carry a transaction, and its marker."""
    return NodeIndex(without(index.nodes, ids, "tx_id"), without(index.markers, ids, "tx_id"))


def delete_by_acl(index_acls: DataFrame, ids: DataFrame) -> DataFrame:
    return without(index_acls, ids, "acl_id")


def delete_by_change_set(index: AclIndex, ids: DataFrame, acls: DataFrame) -> AclIndex:
    """Remove the ACLs a change set names, and its marker."""
    named = acls_of_change_sets(ids, acls)
    return AclIndex(without(index.acls, named, "acl_id"), without(index.markers, ids, "change_set_id"))


def write_markers(markers: DataFrame, feed: DataFrame, id_col: str) -> DataFrame:
    """Set the markers of feed rows, empty ones included. Written after the data they stand for."""
    fresh = feed.select(*markers.columns)
    return without(markers, fresh, id_col).unionByName(fresh)


def reindex_transactions(
    index: NodeIndex, ids: DataFrame, feed: DataFrame, source: DataFrame, shard_count: int = 1
) -> NodeIndex:
    """Delete the documents of the transactions, then insert again what the source holds for them.

    ``source`` has each node once, in its last transaction.
    """
    known = feed.join(ids.select("tx_id"), "tx_id", "left_semi")
    cleared = delete_by_tx(index, ids)
    changes = home_rows(nodes_of_transactions(known, source), shard_count)
    return NodeIndex(
        upsert_nodes(cleared.nodes, changes),
        write_markers(cleared.markers, known, "tx_id"),
        without(ids, known, "tx_id"),
    )


def index_transactions(index: NodeIndex, ids: DataFrame, feed: DataFrame, source: DataFrame) -> NodeIndex:
    """Insert the nodes of the transactions where they are absent; nothing is routed or deleted."""
    known = feed.join(ids.select("tx_id"), "tx_id", "left_semi")
    return NodeIndex(
        append_nodes(index.nodes, nodes_of_transactions(known, source)),
        write_markers(index.markers, known, "tx_id"),
        without(ids, known, "tx_id"),
    )


def unknown_nodes(ids: DataFrame) -> DataFrame:
    """Requested node ids as rows whose state is to be looked up."""
    return ids.select("node_id").distinct().select(
        "node_id",
        F.lit(UNKNOWN_TX).alias("tx_id"),
        F.lit(None).cast("long").alias("acl_id"),
        F.lit(None).cast("string").alias("node_ref"),
        F.lit(None).cast("string").alias("tenant"),
        F.lit(UNKNOWN).alias("status"),
    )


def looked_up(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Rows of unknown state with the source's values; a node the source lost is deleted.

    Rows with another status (a cascaded deletion) keep it.
    """
    found = source.select("node_id", F.struct(*[c for c in SHARD_ROW if c != "node_id"], "status").alias("_now"))
    is_open = F.col("status") == UNKNOWN
    fresh = rows.join(found, "node_id", "left")
    columns = [
        F.when(is_open & F.col("_now").isNotNull(), F.col("_now")[c]).otherwise(F.col(c)).alias(c)
        for c in SHARD_ROW
        if c != "node_id"
    ]
    status = F.when(is_open, F.coalesce(F.col("_now.status"), F.lit(DELETED))).otherwise(F.col("status"))
    return fresh.select("node_id", *columns, status.alias("status"))


def reindex_nodes(
    index_nodes: DataFrame,
    ids: DataFrame,
    source: DataFrame,
    shard_count: int = 1,
    instance: int | None = None,
    cascade: bool = True,
) -> DataFrame:
    """Replace the requested nodes by their current state.

    Without ``instance`` the index holds all shards and only home rows count.
    With it, the index is that shard's, and a node at home elsewhere is removed
    if changes cascade and left alone if not.
    """
    asked = unknown_nodes(ids)
    if instance is None:
        rows = home_rows(asked, shard_count)
    else:
        rows = shard_view(asked, shard_count, cascade, instance)
    return upsert_nodes(index_nodes, looked_up(rows, source))


def index_nodes_by_id(index_nodes: DataFrame, ids: DataFrame, source: DataFrame) -> DataFrame:
    """Insert the requested nodes where they are absent; nothing is routed."""
    return append_nodes(index_nodes, source.join(ids.select("node_id"), "node_id", "left_semi"))


def upsert_acls(index_acls: DataFrame, ids: DataFrame, readers: DataFrame, overwrite: bool = True) -> DataFrame:
    """Set the readers of the given ACLs; without ``overwrite`` only of those the index lacks."""
    if not overwrite:
        ids = absent_from(ids.select("acl_id"), index_acls, "acl_id")
    fresh = readers_of_acls(ids, readers)
    kept = without(index_acls, ids, "acl_id") if overwrite else index_acls
    return kept.unionByName(fresh)


def reindex_change_sets(
    index: AclIndex, ids: DataFrame, feed: DataFrame, acls: DataFrame, readers: DataFrame
) -> AclIndex:
    """Delete the documents of the change sets, then index their ACLs again."""
    known = feed.join(ids.select("change_set_id"), "change_set_id", "left_semi")
    cleared = delete_by_change_set(index, ids, acls)
    return AclIndex(
        upsert_acls(cleared.acls, acls_of_change_sets(known, acls), readers),
        write_markers(cleared.markers, known, "change_set_id"),
        without(ids, known, "change_set_id"),
    )


def index_change_sets(
    index: AclIndex, ids: DataFrame, feed: DataFrame, acls: DataFrame, readers: DataFrame
) -> AclIndex:
    """Index the ACLs of the change sets where they are absent."""
    known = feed.join(ids.select("change_set_id"), "change_set_id", "left_semi")
    return AclIndex(
        upsert_acls(index.acls, acls_of_change_sets(known, acls), readers, overwrite=False),
        write_markers(index.markers, known, "change_set_id"),
        without(ids, known, "change_set_id"),
    )
