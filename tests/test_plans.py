"""Shapes of physical plans that must hold whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import QUERIES
from tidemark.operators import batch, search
from tidemark.plans import track
from tidemark.sources import feed
from tidemark.sources import tables as T

SHUFFLED = [
    "already_seen", "check_node", "key_status", "nodes_of_transactions", "pending_transactions", "repo_vs_index",
    "readers_of_acls", "reindex_nodes", "stop_guard", "track_once", "visible_nodes", "write_markers",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """As if every table were too large to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", SHUFFLED)
def test_large_tables_are_neither_crossed_nor_broadcast(spark, folder, no_broadcast, name):
    text = plan(QUERIES[name](spark, folder))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange"):
        assert bad not in text


@pytest.fixture(scope="module")
def stored(spark, folder):
    T.store(spark, folder, ["transactions", "requests", "names", "index_tx"])
    yield
    T.forget_stored()


def test_bounds_and_columns_reach_the_scan(spark, folder, stored):
    page = feed.scan_transactions(T.transactions(spark, folder), from_time=5, to_time=9, max_results=10)
    text = page.select("tx_id")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(commit_time_ms,5)" in text and "LessThan(commit_time_ms,9)" in text
    assert "ReadSchema: struct<tx_id:bigint,commit_time_ms:bigint>" in text
    assert "TakeOrderedAndProject" in text


def test_the_slice_of_a_run_is_read_with_literal_bounds(spark, folder, stored):
    state = track.TrackerState(100, 0, 10, 200)
    work = track.pending_work(T.transactions(spark, folder), T.index_tx(spark, folder), state)
    text = work._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(commit_time_ms,90)" in text and "LessThan(commit_time_ms,201)" in text


def test_windows_over_rows_are_partitioned(spark, folder, stored):
    for frame in (batch.weighted_batches(T.transactions(spark, folder)), batch.request_rates(T.requests(spark, folder))):
        for partition in re.findall(r"windowspecdefinition\((\S+)", plan(frame)):
            # The only order-first window is the one over the part summaries.
            assert re.match(r"_part#|handler#", partition), partition


def test_the_rank_limit_comes_before_the_shuffle(spark, folder, stored):
    assert "WindowGroupLimit" in plan(search.facet_counts(T.names(spark, folder), ["category", "name"], top=3))


def test_latest_version_is_a_partial_aggregate(spark, folder):
    versions = T.nodes(spark, folder).withColumn("commit_time_ms", F.lit(1).cast("long"))
    assert "partial_max_by" in plan(batch.latest_per_node(versions))


def test_maintenance_reads_a_written_index(spark, folder):
    """The index is used several times, so it is not made of the lines again for each."""
    got = QUERIES["apply_maintenance"](spark, folder)
    assert not any("lineitem" in file for file in got.inputFiles())


def test_last_versions_are_ranked_without_texts(spark, folder):
    """Texts come to the last versions; what is joined and ranked are ids and flags."""
    plan = T.index_nodes(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("max_by") :]
    assert "node_ref" not in below.split("\n", 1)[1] and "SpacesStore" not in below.split("\n", 1)[1]


def test_scoped_runs_read_written_views(spark, folder, monkeypatch):
    """Five runs begin with the nodes and the feed: they are derived from the lines once, not in each run again."""
    read, freeze = [], track.freeze

    def watched(frame, *options):
        read.extend(frame.inputFiles())
        return freeze(frame, *options)

    monkeypatch.setattr(track, "freeze", watched)
    QUERIES["track_once_scoped"](spark, folder)
    assert read and not any("lineitem" in file for file in read)
