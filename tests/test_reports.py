"""Checks of the index on small hand-made cases."""

import datetime as dt

import pytest

from tidemark.operators import pending, reconcile, snapshots, telemetry
from tests.conftest import rows

FEED = "tx_id long, commit_time_ms long"


def frame(spark, data, schema=FEED):
    return spark.createDataFrame(data, schema)


def test_prefix_cut_loses_later_small_ids(spark):
    source = frame(spark, [(5, 10), (9, 20), (2, 30), (3, 30)])
    assert rows(reconcile.checked_rows(source, "tx_id", to_id=8)) == [(5, 10)]
    assert rows(reconcile.checked_rows(source, "tx_id", to_ms=20)) == [(5, 10), (9, 20)]
    assert rows(reconcile.checked_rows(source, "tx_id", from_ms=20, to_id=2)) == []
    assert reconcile.checked_rows(source, "tx_id").count() == 4


def test_check_bounds_start_at_the_first_row(spark):
    source = frame(spark, [(5, 10), (9, 20), (2, 30)])
    assert rows(reconcile.check_bounds(source, "tx_id")) == [(5, 9)]
    assert rows(reconcile.check_bounds(source.filter("false"), "tx_id")) == [(None, 0)]


def test_check_index(spark):
    source = frame(spark, [(1, 10), (2, 20), (3, 30)])
    index = frame(spark, [(1, 10), (1, 10), (3, 30), (2000, 5), (0, 1)])
    got = rows(reconcile.check_index_tx(source, index), "tx_id", "status")
    assert got == [(0, "extra"), (1, "duplicate"), (2, "missing"), (2000, "outside"), (3, "ok")]
    report = reconcile.check_index_tx(source, index, id_range=(2, 10), to_ms=20)
    assert rows(report) == [(0, 0, 1, "outside"), (1, 1, 2, "outside"), (2, 1, 0, "missing"),
                            (2000, 0, 1, "outside"), (3, 1, 1, "outside")]
    assert rows(reconcile.repo_vs_index(source, index, "tx_id"), "tx_id", "status") == [
        (0, "extra"), (1, "duplicate"), (2, "missing"), (2000, "extra"), (3, "ok")]


@pytest.mark.parametrize(
    "index, state, floor, status",
    [
        ([], 5, 0, "not in index"),
        ([(1, 11)], 5, 0, "not in index"),
        ([(1, 10)], 5, 0, "verified"),
        ([(1, 10), (1, 10)], 5, 0, "duplicate"),
        ([], 5, -1, "skipped"),
        ([], 0, 0, "nothing to verify"),
        ([], 5, 99, "no first row"),
    ],
)
def test_check_first(spark, index, state, floor, status):
    got = reconcile.check_first(frame(spark, [(1, 10), (2, 20)]), frame(spark, index), "tx_id", state, floor).first()
    assert got["status"] == status
    assert got["state_ms"] == (10 if state == 0 else state)


def test_check_last(spark):
    source, index = frame(spark, [(1, 10)]), frame(spark, [(7, 10)])
    assert reconcile.check_last(source, index, "tx_id").first()["status"] == "verified"
    assert reconcile.check_last(source, frame(spark, [(1, 11)]), "tx_id").first()["status"] == "index ahead of source"
    assert reconcile.check_last(frame(spark, []), index, "tx_id").first()["status"] == "undecided"
    assert reconcile.check_last(source, frame(spark, []), "tx_id").first()["status"] == "verified"


def test_check_node_wants_exactly_one_source_row(spark):
    schema = "node_id long, tx_id long, status string"
    source = frame(spark, [(1, 4, "UPDATED"), (2, 4, "UPDATED"), (2, 5, "UPDATED")], schema)
    index = frame(spark, [(1, 4, "UPDATED")], schema)
    ids = frame(spark, [(1,), (2,), (3,)], "node_id long")
    assert rows(reconcile.check_node(ids, source, index)) == [
        (1, "UPDATED", 4, 1, 4), (2, "UNKNOWN", -1, 0, None), (3, "UNKNOWN", -1, 0, None)]


def test_clamped_feed(spark):
    feed = frame(spark, [(1, 10, 1, 0), (2, 20, 1, 0), (9, 15, 0, 1)], FEED + ", updates long, deletes long")
    none = frame(spark, [])

    def clamp(low, high, start, index=none, last=0):
        interval = frame(spark, [(low, high)], "min_commit_ms long, max_commit_ms long")
        return rows(pending.clamp_to_shard_range(feed, interval, index, start, last))

    assert clamp(12, 20, 5) == [(2, 20, 1, 0), (9, 15, 0, 1)]
    assert clamp(5, 20, 12) == [(2, 20, 1, 0), (9, 15, 0, 1)]
    assert clamp(-1, -1, 5) == [(9, 20, None, None)]
    assert clamp(5, 10, 11) == [(9, 20, None, None)]
    assert clamp(-1, -1, 5, frame(spark, [(9, 20)]), 20) == []


def test_total_docs_of_odd_statuses(spark):
    schema = "status map<string, struct<index: struct<numDocs: long>>>"
    some = [({"a": {"index": {"numDocs": 3}}, "b": {"index": None}, "c": None, "d": {"index": {"numDocs": None}}},)]
    assert rows(telemetry.total_docs(spark.createDataFrame(some, schema))) == [(3,)]
    assert rows(telemetry.total_docs(spark.createDataFrame([(None,)], schema))) == [(0,)]


def test_readiness(spark):
    probes = "probe string, status int, body string, expected string"
    good = spark.createDataFrame([("t", 200, "x nodes y", "nodes")], probes)
    bad = spark.createDataFrame([("t", 200, "x", "nodes"), ("u", 503, "UP", "UP")], probes)
    docs = spark.createDataFrame([(0, 51), (1, 99)], "shard int, docs long")
    few = spark.createDataFrame([(0, 50), (1, 99)], "shard int, docs long")
    hits = spark.createDataFrame([(2,)], "total_items long")
    assert reconcile.readiness(good, docs, hits).first()["ready"]
    assert not reconcile.readiness(bad, docs, hits).first()["ready"]
    assert not reconcile.readiness(good, few, hits).first()["ready"]
    assert not reconcile.readiness(good, docs, hits.filter("false")).first()["ready"]
    assert reconcile.readiness(good.filter("false"), docs.filter("false"), hits).first()["ready"]


def listing(spark, names):
    day = dt.datetime(2024, 1, 1)
    data = []
    for n, name in enumerate(names):
        at = day + dt.timedelta(days=n)
        data += [(f"b/snapshot.{name}/", 0, at), (f"b/snapshot.{name}/f", 10, at)]
    return spark.createDataFrame(data, "key string, size long, last_modified timestamp")


def test_retention_keeps_two(spark):
    counts, kept = [0], []
    for name in ("one", "two", "three"):
        objects = listing(spark, [*kept, name])
        decided = rows(snapshots.snapshot_retain(snapshots.snapshot_list(objects), 2))
        kept = [n for n in [*kept, name] if (n, "keep") in decided]
        counts.append(len(kept))
    assert counts == [0, 1, 2, 2] and kept == ["two", "three"]


def test_snapshot_without_marker_is_listed(spark):
    objects = listing(spark, ["one"]).filter("size > 0")
    assert snapshots.snapshot_markers(objects).count() == 0
    assert rows(snapshots.snapshot_list(objects), "snapshot", "files", "has_marker") == [("one", 1, False)]
    assert snapshots.snapshot_latest(objects).first()["snapshot"] == "one"


