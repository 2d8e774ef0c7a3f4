"""One run of the trackers as a plan: from the pending part of a feed to the new index."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.batch import latest_per_node, weighted_batches
from tidemark.operators.expand import acls_of_change_sets, in_store, nodes_of_transactions
from tidemark.operators.mutate import upsert_acls, upsert_nodes, write_markers
from tidemark.operators.pending import (
    clamp_to_shard_range,
    high_watermark,
    nonempty_change_sets,
    nonempty_transactions,
    pending_change_sets,
    pending_transactions,
)
from tidemark.operators.route import DB_ID, DB_ID_RANGE, SHARD_ROW, check_statuses, home_rows, route_acls, route_nodes, shard_view
from tidemark.session import freeze
from tidemark.sources.feed import commit_interval, scan_change_sets, scan_transactions


@dataclass(frozen=True)
class TrackerState:
    """Scalars a run starts from."""

    last_indexed_ms: int = 0
    last_indexed_id: int = 0
    hole_ms: int = 3_600_000
    stop_ms: int = 2**62
    rollback_pending: bool = False


@dataclass(frozen=True)
class Scope:
    """Which nodes a run is for: one store, one shard property, one shard; all of them by default."""

    store: str | None = None
    shard_property: str | None = None
    method: str = DB_ID
    ranges: tuple[tuple[int, int], ...] = ()
    #: The shard the run belongs to; without one, every node goes to its home shard.
    instance: int | None = None
    cascade: bool = False
    #: What the index says its range reaches to; beyond the range's end it widens it.
    index_cap: int = -1

    def widened(self) -> tuple[tuple[int, int], ...]:
        return tuple(
            (begin, max(end, self.index_cap) if shard == self.instance else end)
            for shard, (begin, end) in enumerate(self.ranges)
        )


class RollbackPending(RuntimeError):
    """The index is about to be rolled back; a run must not start."""


class NodeRun(NamedTuple):
    todo: DataFrame  # feed rows of this run
    changes: DataFrame  # one row per touched node, at its home shard
    nodes: DataFrame  # the index afterwards
    markers: DataFrame
    state: DataFrame  # furthest (commit time, id)


class AclRun(NamedTuple):
    todo: DataFrame
    changes: DataFrame  # ACL ids to set
    acls: DataFrame
    markers: DataFrame
    state: DataFrame
    routed: DataFrame  # the ACLs of ``changes``, once for each shard


def _guard(state: TrackerState) -> None:
    if state.rollback_pending:
        raise RollbackPending("the index is to be rolled back first")


def pending_work(
    feed: DataFrame, index_tx: DataFrame, state: TrackerState, nodes: DataFrame | None = None, scope: Scope = Scope(), late: bool = False
) -> DataFrame:
    """Pending rows of the slice from the hole behind the last commit up to the stop time.

    One slice takes the place of the pages; rows behind the stop time are taken
    by a later run, so the end state is the same. With ``late`` the slice begins
    with the feed. The shard of an id range reads what lies in the commit
    interval of its nodes.
    """
    from_ms = None if late else state.last_indexed_ms - state.hole_ms
    part = scan_transactions(feed, from_time=from_ms, to_time=state.stop_ms + 1)
    if scope.method == DB_ID_RANGE and scope.instance is not None:
        interval = commit_interval(in_store(nodes, scope.store, scope.shard_property), feed, *scope.widened()[scope.instance])
        part = clamp_to_shard_range(part, interval, index_tx, from_ms or 0, state.last_indexed_ms)
    return pending_transactions(part, index_tx, state.last_indexed_ms)


def pending_by_shard_and_batch(
    feed: DataFrame, nodes: DataFrame, index_tx: DataFrame, state: TrackerState, shard_count: int
) -> DataFrame:
    """Work ahead of the next run: node rows and transactions per weighted batch and home shard."""
    batched = weighted_batches(pending_work(feed, index_tx, state)).select("tx_id", "commit_time_ms", "batch_no")
    routed = route_nodes(nodes.join(batched, "tx_id"), shard_count)
    return (
        routed.groupBy("batch_no", "shard", "tx_id")
        .agg(F.count("*").alias("n"), F.count_if(F.col("status") == "DELETED").alias("d"))
        .groupBy("batch_no", "shard")
        .agg(
            F.count("*").alias("transactions"),
            F.sum("n").alias("nodes"),
            F.sum("d").alias("deletions"),
        )
    )


def node_changes(
    todo: DataFrame, history: DataFrame, nodes: DataFrame, state: TrackerState, shard_count: int, scope: Scope = Scope()
) -> DataFrame:
    """Last version of every node the run touches.

    A transaction that turned up late may touch a node which the index already
    has in a newer version; for those nodes the older history is looked at too,
    so that a late row never takes a node back. The ids of the run bound what is
    read of the nodes.
    """
    # What a change does not carry is not joined and ranked.
    nodes = in_store(nodes, scope.store, scope.shard_property).select(*SHARD_ROW, "status")
    wanted = nonempty_transactions(todo)
    low, high = wanted.agg(F.min("tx_id"), F.max("tx_id")).first()
    touching = nodes.filter(F.col("tx_id").between(low, high)) if low is not None else nodes.limit(0)
    versions = nodes_of_transactions(wanted, touching)
    late = todo.filter(F.col("commit_time_ms") <= state.last_indexed_ms)
    low, high = late.agg(F.min("tx_id"), F.max("tx_id")).first()
    if low is not None:
        ids = nodes.filter(F.col("tx_id").between(low, high)).join(late.select("tx_id"), "tx_id", "left_semi").select("node_id")
        before = history.filter(F.col("commit_time_ms") <= state.last_indexed_ms)
        older = nodes_of_transactions(before, nodes.join(ids, "node_id", "left_semi"))
        versions = versions.unionByName(older)
    latest = check_statuses(latest_per_node(versions))
    if scope.instance is None:
        return home_rows(latest, shard_count, scope.method, scope.ranges)
    return shard_view(latest, shard_count, scope.cascade, scope.instance, scope.method, scope.widened())


def track_once(
    index_nodes: DataFrame,
    index_tx: DataFrame,
    feed: DataFrame,
    nodes: DataFrame,
    state: TrackerState,
    shard_count: int = 1,
    history: DataFrame | None = None,
    scope: Scope | None = None,
    late: bool = False,
) -> NodeRun:
    """One run of the metadata tracker.

    ``feed`` may be a part of the feed (a micro-batch); ``history`` is then all of it, and ``late`` takes rows of the
    part that come after the hole has passed them. ``scope`` limits the run to a store, a shard property or a shard.

    The run's feed rows and its changes are frozen first: both are used by
    several results, which must agree even if tasks are run again. Nothing is
    committed here (see ``tidemark.plans.store``), so a failing part leaves the
    old state in place.
    """
    _guard(state)
    scope = scope or Scope()
    whole = feed if history is None else history
    todo = freeze(pending_work(feed, index_tx, state, nodes, scope, late))
    changes = freeze(node_changes(todo, whole, nodes, state, shard_count, scope))
    return NodeRun(
        todo,
        changes,
        upsert_nodes(index_nodes, changes),
        write_markers(index_tx, todo, "tx_id"),
        high_watermark(todo, "tx_id", state.last_indexed_ms, state.last_indexed_id),
    )


def track_acls_once(
    index_acls: DataFrame,
    index_change_sets: DataFrame,
    feed: DataFrame,
    acls: DataFrame,
    readers: DataFrame,
    state: TrackerState,
    shard_count: int = 1,
    late: bool = False,
) -> AclRun:
    """One run of the ACL tracker. Every shard gets all its ACLs; ``late`` as for nodes."""
    _guard(state)
    from_ms = None if late else state.last_indexed_ms - state.hole_ms
    part = scan_change_sets(feed, from_time=from_ms, to_time=state.stop_ms + 1)
    todo = freeze(pending_change_sets(part, index_change_sets, state.last_indexed_ms))
    changes = freeze(acls_of_change_sets(nonempty_change_sets(todo), acls).select("acl_id").distinct())
    return AclRun(
        todo,
        changes,
        upsert_acls(index_acls, changes, readers),
        write_markers(index_change_sets, todo, "change_set_id"),
        high_watermark(todo, "change_set_id", state.last_indexed_ms, state.last_indexed_id),
        route_acls(changes, shard_count),
    )
