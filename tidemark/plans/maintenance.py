"""Queued maintenance: purge, reindex and index requests with the effect of their fixed order.

The order is: purge transactions, purge nodes, reindex transactions, reindex
nodes (also those a query found), index transactions, index nodes; the same for
change sets and ACLs. Applied one after the other, every step would read the
index again. Here the requests are turned into flags per id, and the index and
the source are each read with those flags at hand:

* an index row stays unless its id or transaction is purged or reindexed;
* a source row is written if it is reindexed, or if it is to be indexed and no
  row of that id stayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.expand import readers_of_acls
from tidemark.operators.ids import absent_from, without
from tidemark.operators.mutate import AclIndex, NodeIndex
from tidemark.operators.route import DELETED
from tidemark.session import freeze

PURGE, REINDEX, INDEX = "purge", "reindex", "index"
ACTIONS = (PURGE, REINDEX, INDEX)


def requested(requests: DataFrame, kind: str, action: str, id_col: str) -> DataFrame:
    wanted = requests.filter((F.col("kind") == kind) & (F.col("action") == action))
    return wanted.select(F.col("id").alias(id_col)).distinct()


def without_scheduled(requests: DataFrame) -> DataFrame:
    """Drop every queued request except queries."""
    return requests.filter(F.col("kind") == "query")


def has_maintenance(requests: DataFrame) -> bool:
    """Is anything queued?"""
    return not requests.isEmpty()


def _flags(requests: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Requested actions of each id as boolean columns."""
    return (
        requests.filter(F.col("kind") == kind)
        .groupBy(F.col("id").alias(id_col))
        .agg(*[F.bool_or(F.col("action") == a).alias(f"{kind}_{a}") for a in ACTIONS])
    )


def _is(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def _rewritten(markers: DataFrame, flags: DataFrame, known: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Markers without the purged and reindexed ones, and those of the known requests anew."""
    dropped = flags.filter(F.col(f"{kind}_{PURGE}") | F.col(f"{kind}_{REINDEX}"))
    kept = without(without(markers, dropped, id_col), known, id_col)
    return kept.unionByName(known.select(*markers.columns))


def _lost(flags: DataFrame, known: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Ids to be (re)indexed that the feed does not have, once per action."""
    asked = flags.filter(F.col(f"{kind}_{REINDEX}")).select(id_col)
    asked = asked.unionByName(flags.filter(F.col(f"{kind}_{INDEX}")).select(id_col))
    return without(asked, known, id_col)


def apply_maintenance(
    index: NodeIndex,
    requests: DataFrame,
    feed: DataFrame,
    source: DataFrame,
    queried: DataFrame | None = None,
) -> NodeIndex:
    """The node index and markers after all requests.

    ``requests`` has (kind, action, id) with kinds ``tx`` and ``node``;
    ``queried`` holds the node ids a query matched. ``source`` has each node
    once, in its last transaction. ``unknown`` lists requested transactions
    without a source row.
    """
    if queried is not None:
        again = queried.select(F.lit("node").alias("kind"), F.lit(REINDEX).alias("action"), F.col("node_id").alias("id"))
        requests = requests.select("kind", "action", "id").unionByName(again)
    # As large as the requests, and used by every part below.
    tx, node = freeze(_flags(requests, "tx", "tx_id")), freeze(_flags(requests, "node", "node_id"))

    flagged = source.join(tx, "tx_id", "left").join(node, "node_id", "left")
    reindexed = _is("tx_reindex") | _is("node_reindex")
    touched = freeze(
        flagged.select(*index.nodes.columns, reindexed.alias("_again"), (_is("tx_index") | _is("node_index")).alias("_add"))
        .filter("_again OR _add")
    )
    alive = touched.filter(F.col("status") != DELETED)

    # The index is only cut by two short lists; its other rows are left as they are.
    gone = tx.filter(_is("tx_purge") | _is("tx_reindex"))
    gone_nodes = node.filter(_is("node_purge") | _is("node_reindex")).select("node_id")
    gone_nodes = gone_nodes.unionByName(touched.filter("_again").select("node_id"))
    kept = without(without(index.nodes, gone, "tx_id"), gone_nodes, "node_id")
    absent = absent_from(alive.filter("_add AND NOT _again"), kept, "node_id")
    written = alive.filter("_again").unionByName(absent).select(*index.nodes.columns)

    known = freeze(feed.join(tx.filter("tx_reindex OR tx_index"), "tx_id", "left_semi").select(*index.markers.columns))
    return NodeIndex(
        kept.unionByName(written),
        _rewritten(index.markers, tx, known, "tx", "tx_id"),
        _lost(tx, known, "tx", "tx_id"),
    )


def apply_acl_maintenance(
    index: AclIndex, requests: DataFrame, feed: DataFrame, acls: DataFrame, readers: DataFrame
) -> AclIndex:
    """The ACL index and markers after all requests (kinds ``change_set`` and ``acl``)."""
    sets = freeze(_flags(requests, "change_set", "change_set_id"))
    known = freeze(
        feed.join(sets.filter("change_set_reindex OR change_set_index"), "change_set_id", "left_semi").select(
            *index.markers.columns
        )
    )
    in_feed = known.select("change_set_id", F.lit(True).alias("_known"))
    by_set = (
        acls.join(sets, "change_set_id")
        .join(in_feed, "change_set_id", "left")
        .select(
            "acl_id",
            (F.col("change_set_purge") | F.col("change_set_reindex")).alias("_gone"),
            (F.col("change_set_reindex") & _is("_known")).alias("_again"),
            (F.col("change_set_index") & _is("_known")).alias("_add"),
        )
    )
    by_acl = _flags(requests, "acl", "acl_id").select(
        "acl_id",
        (F.col("acl_purge") | F.col("acl_reindex")).alias("_gone"),
        F.col("acl_reindex").alias("_again"),
        F.col("acl_index").alias("_add"),
    )
    flags = freeze(
        by_set.unionByName(by_acl)
        .groupBy("acl_id")
        .agg(*[F.bool_or(c).alias(c) for c in ("_gone", "_again", "_add")])
    )
    kept = without(index.acls, flags.filter("_gone"), "acl_id")
    absent = absent_from(flags.filter("_add AND NOT _again"), kept, "acl_id").select("acl_id")
    written = flags.filter("_again").select("acl_id").unionByName(absent)
    return AclIndex(
        kept.unionByName(readers_of_acls(written, readers)),
        _rewritten(index.markers, sets, known, "change_set", "change_set_id"),
        _lost(sets, known, "change_set", "change_set_id"),
    )
