"""Runs against the versioned store: idempotence, failure, replay, late rows, snapshots."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.order import UNKNOWN_TX
from tidemark.operators import ids as ids_of
from tidemark.operators import mutate, reconcile, route
from tidemark.plans import maintenance, snapshot_files, track
from tidemark.plans.store import IndexStore, TableSpec
from tidemark.sources import tables as T
from tidemark.session import freeze
from tests.conftest import rows

NARROW = {
    "nodes": TableSpec("node_id", "node_id long, tx_id long, acl_id long, node_ref string, tenant string, status string", 40),
    "index_tx": TableSpec("tx_id", "tx_id long, commit_time_ms long", 300),
    "acls": TableSpec("acl_id", "acl_id long, authority string", 30, ("authority",)),
    "index_change_sets": TableSpec("change_set_id", "change_set_id long, commit_time_ms long", 200),
}


@pytest.fixture(scope="module")
def source(spark, folder):
    return freeze(T.transactions(spark, folder)), freeze(T.nodes(spark, folder)), freeze(T.current_nodes(spark, folder))


def tracked(spark, root, source):
    feed, nodes, _ = source
    store = IndexStore(spark, root, NARROW)
    store.track_nodes("first", feed.filter(F.col("commit_time_ms") < T.LAST_INDEXED_MS), nodes, history=feed)
    store.track_nodes("second", feed, nodes)
    return store


def test_two_runs_reach_what_the_source_holds(spark, fresh, source):
    store = tracked(spark, fresh, source)
    alive = source[2].filter("status <> 'DELETED'").select(*mutate.NODE_COLUMNS)
    assert rows(store.read("nodes")) == rows(alive)
    report = reconcile.check_index_tx(source[0], store.read("index_tx"))
    assert {r["status"] for r in report.select("status").distinct().collect()} == {"ok"}
    # Once more changes nothing, under a new name or an old one.
    before = rows(store.read("nodes")), rows(store.read("index_tx"))
    store.track_nodes("third", source[0], source[1])
    assert store.track_nodes("second", source[0], source[1]) is None
    assert (rows(store.read("nodes")), rows(store.read("index_tx"))) == before


def test_only_touched_buckets_are_written(spark, fresh, source):
    store = tracked(spark, fresh, source)
    old = {(r["table_name"], r["bucket"]): r["path"] for r in store.manifest() if r["table_name"]}
    ids = spark.createDataFrame([(3,), (5,)], "node_id long")
    store.commit("purge", {"nodes": (ids, lambda base: mutate.delete_by_node(base, ids))})
    new = {(r["table_name"], r["bucket"]): r["path"] for r in store.manifest() if r["table_name"]}
    assert {k for k in old if old[k] != new.get(k)} == {("nodes", 0)}


def test_an_emptied_bucket_disappears(spark, fresh):
    store = IndexStore(spark, fresh, NARROW)
    some = spark.createDataFrame([(1, 1), (2, 1), (900, 2)], "tx_id long, commit_time_ms long")
    store.commit("a", {"index_tx": (some, lambda base: mutate.write_markers(base, some, "tx_id"))})
    few = some.filter("tx_id < 100")
    store.commit("b", {"index_tx": (few, lambda base: ids_of.without(base, few, "tx_id"))})
    assert rows(store.read("index_tx")) == [(900, 2)]


def test_a_failed_run_is_not_seen(spark, fresh, source):
    store = tracked(spark, fresh, source)
    before = rows(store.read("nodes")), rows(store.read("index_tx")), store.marks()

    def fail(base):
        raise RuntimeError("lost")

    ids = spark.createDataFrame([(3,)], "node_id long")
    tx = spark.createDataFrame([(3,)], "tx_id long")
    with pytest.raises(RuntimeError):
        store.commit("bad", {"nodes": (ids, lambda base: mutate.delete_by_node(base, ids)), "index_tx": (tx, fail)})
    assert (rows(store.read("nodes")), rows(store.read("index_tx")), store.marks()) == before
    assert not store.has_run("bad")


def test_rollback_pending_stops_a_run(spark, source):
    state = track.TrackerState(rollback_pending=True)
    with pytest.raises(track.RollbackPending):
        track.track_once(source[2], source[0], source[0], source[1], state)


def test_an_unknown_status_fails_the_run(spark):
    data = spark.createDataFrame([(1, "LOST")], "node_id long, status string")
    with pytest.raises(Exception, match="unknown node status LOST"):
        route.check_statuses(data).collect()


NODE = "node_id long, tx_id long, acl_id long, node_ref string, tenant string, status string, store_protocol string, store_identifier string"
TX = "tx_id long, commit_time_ms long, updates long, deletes long"


def node(node_id, tx_id, status="UPDATED"):
    return (node_id, tx_id, 1, f"workspace://SpacesStore/{node_id}", "", status, "workspace", "SpacesStore")


@pytest.mark.parametrize("newer", ["UPDATED", "DELETED"])
def test_a_late_transaction_takes_no_node_back(spark, fresh, newer):
    nodes = spark.createDataFrame([node(1, 10), node(2, 10), node(1, 11, newer), node(3, 12)], NODE)
    feed = spark.createDataFrame([(10, 5_000, 2, 0), (11, 6_000, 1, 0), (12, 7_000, 1, 0)], TX)
    store = IndexStore(spark, fresh, NARROW)
    store.track_nodes("a", feed.filter("tx_id > 10"), nodes)
    store.track_nodes("b", feed, nodes)
    held = [(1, 11)] if newer == "UPDATED" else []
    assert rows(store.read("nodes"), "node_id", "tx_id") == [*held, (2, 10), (3, 12)]
    assert store.read("index_tx").count() == 3


def test_rows_behind_the_hole_are_left_to_the_check(spark, fresh):
    nodes = spark.createDataFrame([node(1, 10), node(3, 12)], NODE)
    feed = spark.createDataFrame([(10, 5_000, 1, 0), (12, 9_000_000, 1, 0)], TX)
    store = IndexStore(spark, fresh, NARROW)
    store.track_nodes("a", feed.filter("tx_id = 12"), nodes)
    store.track_nodes("b", feed, nodes)
    assert rows(store.read("nodes"), "node_id") == [(3,)]
    report = reconcile.repo_vs_index(feed, store.read("index_tx"), "tx_id")
    assert rows(report, "tx_id", "status") == [(10, "missing"), (12, "ok")]


def test_the_stop_time_only_postpones(spark, fresh, source):
    feed, nodes, current = source
    store = IndexStore(spark, fresh, NARROW)
    store.track_nodes("a", feed, nodes, stop_ms=T.LAST_INDEXED_MS)
    assert store.read("index_tx").agg(F.max("commit_time_ms")).first()[0] <= T.LAST_INDEXED_MS
    store.track_nodes("b", feed, nodes)
    alive = current.filter("status <> 'DELETED'").select(*mutate.NODE_COLUMNS)
    assert rows(store.read("nodes")) == rows(alive)


def test_acl_runs(spark, folder, fresh):
    sets, acls, readers = T.change_sets(spark, folder), T.acls(spark, folder), T.acl_readers(spark, folder)
    store = IndexStore(spark, fresh, NARROW)
    store.track_acls("a", sets, acls, readers)
    wanted = readers.join(acls.select("acl_id").distinct(), "acl_id", "left_semi")
    assert rows(store.read("acls"), "acl_id", "authority") == rows(wanted, "acl_id", "authority")
    assert store.read("index_change_sets").count() == sets.count()


def test_reindex_after_purge_gives_the_original(spark, source):
    feed, _, current = source
    index = mutate.NodeIndex(
        current.filter("status <> 'DELETED'").select(*mutate.NODE_COLUMNS), feed.select("tx_id", "commit_time_ms")
    )
    ids = feed.filter("tx_id % 10 = 3").select("tx_id")
    purged = mutate.delete_by_tx(index, ids)
    assert purged.nodes.count() < index.nodes.count()
    again = mutate.reindex_transactions(purged, ids, feed, current, 3)
    assert rows(again.nodes) == rows(index.nodes) and rows(again.markers) == rows(index.markers)


def test_maintenance_has_the_effect_of_its_steps(spark, folder, source):
    """The fused plan against the single operators in their fixed order."""
    feed, _, current = source
    index = mutate.NodeIndex(T.index_nodes(spark, folder), T.index_tx(spark, folder))
    requests = T.maintenance_requests(spark, folder)
    queried = spark.createDataFrame([(2,), (11,), (17,), (9999,)], "node_id long")

    def asked(kind, action, key):
        return maintenance.requested(requests, kind, action, key)

    step = mutate.delete_by_tx(index, asked("tx", "purge", "tx_id"))
    step = step._replace(nodes=mutate.delete_by_node(step.nodes, asked("node", "purge", "node_id")))
    step = mutate.reindex_transactions(step, asked("tx", "reindex", "tx_id"), feed, current, 3)
    step = step._replace(nodes=mutate.reindex_nodes(step.nodes, asked("node", "reindex", "node_id"), current, 3))
    step = step._replace(nodes=mutate.reindex_nodes(step.nodes, queried, current, 3))
    step = mutate.index_transactions(step, asked("tx", "index", "tx_id"), feed, current)
    nodes = mutate.index_nodes_by_id(step.nodes, asked("node", "index", "node_id"), current)

    fused = maintenance.apply_maintenance(index, requests, feed, current, queried)
    assert rows(fused.nodes) == rows(nodes)
    assert rows(fused.markers) == rows(step.markers)


def test_queue(spark):
    queue = spark.createDataFrame([("tx", "purge", 1), ("query", "reindex", 0)], "kind string, action string, id long")
    assert maintenance.has_maintenance(queue)
    assert rows(maintenance.without_scheduled(queue)) == [("query", "reindex", 0)]
    assert not maintenance.has_maintenance(queue.filter("false"))


def test_a_replayed_micro_batch_is_applied_once(spark, fresh, source):
    feed, nodes, _ = source
    store = IndexStore(spark, fresh, NARROW)
    batch = feed.filter("tx_id < 500")
    assert store.track_nodes("nodes-0", batch, nodes, history=feed) is not None
    version = store.manifest()[0]["version"]
    assert store.track_nodes("nodes-0", batch, nodes, history=feed) is None
    assert store.manifest()[0]["version"] == version


def test_reindex_of_one_shard(spark):
    base = spark.createDataFrame([node(n, 1)[:6] for n in (1, 2, 3)], ", ".join(NODE.split(", ")[:6]))
    current = spark.createDataFrame([node(1, 7), node(2, 7), node(3, 7)], NODE)
    ids = spark.createDataFrame([(1,), (2,), (4,)], "node_id long")
    asked = mutate.unknown_nodes(ids).filter("node_id = 4").first()
    assert (asked["status"], asked["tx_id"]) == ("UNKNOWN", UNKNOWN_TX)
    # Shard 1 of 3 is home to nodes 1 and 4; node 2 lives elsewhere.
    with_cascade = mutate.reindex_nodes(base, ids, current, 3, instance=1)
    assert rows(with_cascade, "node_id", "tx_id") == [(1, 7), (3, 1)]
    without = mutate.reindex_nodes(base, ids, current, 3, instance=1, cascade=False)
    assert rows(without, "node_id", "tx_id") == [(1, 7), (2, 1), (3, 1)]


def test_shard_view(spark, source):
    nodes = source[1]
    assert route.home_rows(nodes, 3).count() == nodes.count()
    cascaded = rows(
        route.shard_view(spark.createDataFrame([node(1, 1), node(1, 2, "DELETED"), node(1, 3, "UNKNOWN")], NODE), 2, instance=0),
        "tx_id", "status",
    )
    assert cascaded == [(1, "NON_SHARD_UPDATED"), (2, "NON_SHARD_DELETED"), (3, "NON_SHARD_DELETED")]
    ranges = route.even_ranges(10, 3)
    assert ranges == [(0, 3), (3, 6), (6, 10)]
    ids = spark.createDataFrame([(0,), (3,), (9,), (10,)], "node_id long")
    assert rows(route.route_nodes(ids, 3, route.DB_ID_RANGE, ranges)) == [(0, 0), (10, None), (3, 1), (9, 2)]


def test_snapshot_round_trip_and_damage(spark, fresh, source):
    store = tracked(spark, fresh + "/store", source)
    tables = {t: store.read(t) for t in ("nodes", "index_tx")}
    root = fresh + "/backup"
    snapshot_files.snapshot_write(tables, root, "one")
    status, found = snapshot_files.snapshot_restore(spark, root, "one", list(tables))
    assert rows(status) == [("one", "success", 0)]

    target = IndexStore(spark, fresh + "/target", NARROW)
    other = spark.createDataFrame([(77_777, 1)], "tx_id long, commit_time_ms long")
    target.replace("old", {"index_tx": other})
    target.replace("restore", found, {"tx_ms": 5})
    assert rows(target.read("nodes")) == rows(tables["nodes"])
    assert rows(target.read("index_tx")) == rows(tables["index_tx"])
    assert target.marks() == {"tx_ms": 5}

    victim = sorted(glob.glob(root + "/snapshot.one/nodes/*.parquet"))[0]
    with open(victim, "r+b") as file:
        file.seek(20)
        byte = file.read(1)
        file.seek(20)
        file.write(bytes([byte[0] ^ 1]))
    crc = os.path.join(os.path.dirname(victim), f".{os.path.basename(victim)}.crc")
    if os.path.exists(crc):
        os.replace(crc, crc + ".off")
    status, found = snapshot_files.snapshot_restore(spark, root, "one", list(tables))
    assert rows(status) == [("one", "failed", 1)] and found == {}


def test_two_trackers_from_one_manifest_both_count_once(spark, fresh, source):
    feed, nodes, _ = source
    store, other = IndexStore(spark, fresh, NARROW), IndexStore(spark, fresh, NARROW)
    store.commit("start", {}, {})
    sets = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "change_set_id long, commit_time_ms long, acl_count int")
    acls = spark.createDataFrame([(1, 5), (2, 6)], "change_set_id long, acl_id long")
    readers = spark.createDataFrame([(5, "A"), (6, "B")], "acl_id long, authority string")
    inner = store.commit

    def late(run, changes, marks=None, old=None):
        # The other tracker's run comes in between reading the manifest and committing.
        other.track_acls("sets", sets, acls, readers)
        inner(run, changes, marks, old)

    store.commit = late
    store.track_nodes("nodes", feed, nodes)
    expected = IndexStore(spark, f"{fresh}-alone", NARROW)
    expected.track_nodes("nodes", feed, nodes)
    assert rows(store.read("index_tx")) == rows(expected.read("index_tx"))
    assert rows(store.read("acls")) == [(5, "A"), (6, "B")]
    marks = store.marks()
    assert marks["set_ms"] == 20 and marks["tx_ms"] == expected.marks()["tx_ms"]
    assert [r["version"] for r in store.manifest()][0] == 3


def test_two_writers_of_one_bucket(spark, fresh):
    spec = {"index_tx": TableSpec("tx_id", "tx_id long, commit_time_ms long", 300)}
    one, two = IndexStore(spark, fresh, spec), IndexStore(spark, fresh, spec)
    add = lambda n: spark.createDataFrame([(n, n)], "tx_id long, commit_time_ms long")
    old = one.manifest()
    one.commit("a", {"index_tx": (add(1), lambda base: base.unionByName(add(1)))}, {"a": 1}, old)
    two.commit("b", {"index_tx": (add(2), lambda base: base.unionByName(add(2)))}, {"b": 2}, old)
    two.commit("b", {"index_tx": (add(2), lambda base: base.unionByName(add(2)))}, {"b": 2}, old)
    assert rows(one.read("index_tx")) == [(1, 1), (2, 2)]
    assert one.marks() == {"a": 1, "b": 2} and one.has_run("a") and one.has_run("b") and not one.has_run("c")


def test_sparse_ids_give_a_bounded_number_of_buckets(spark, fresh):
    spec = {"index_tx": TableSpec("tx_id", "tx_id long, commit_time_ms long", 10, buckets=4)}
    store = IndexStore(spark, fresh, spec)
    ids = spark.range(60).select(F.xxhash64("id").alias("tx_id"), F.col("id").alias("commit_time_ms"))
    store.replace("all", {"index_tx": ids})
    assert len([r for r in store.manifest() if r["table_name"]]) <= 4
    assert rows(store.read("index_tx")) == rows(ids)


def test_marks_come_back_from_the_markers(spark, fresh):
    spec = {k: v for k, v in NARROW.items() if k in ("index_tx", "index_change_sets")}
    store = IndexStore(spark, fresh, spec)
    store.replace("all", {"index_tx": spark.createDataFrame([(9, 50), (3, 70)], "tx_id long, commit_time_ms long")}, {"tx_ms": 1})
    store.recover("rollback")
    assert store.marks() == {"tx_ms": 70, "tx_id": 3, "set_ms": 0, "set_id": 0}
