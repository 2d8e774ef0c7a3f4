"""Comparisons by bitmaps and digests, term tables, reader bitmaps and sketches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.operators import bitsets, expand, postings, reconcile, search

IDS = "id long"


def frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], IDS)


def counts(source, index):
    return sorted((i, source.count(i), index.count(i)) for i in {*source, *index})


def faulty(seed, size=3000):
    rng = random.Random(seed)
    bases = [0, 1, -40_000, 32_768, 1 << 33, -(1 << 40), (1 << 62) + 5]
    source = [b + rng.randrange(0, 50_000) for b in bases for _ in range(size // len(bases))]
    index = [i for i in source if rng.random() > 0.01] + rng.sample(source, 20) + [rng.randrange(1 << 50) for _ in range(5)]
    return source, index


@pytest.mark.parametrize("seed", range(3))
def test_bitmaps_and_digests_against_counting(spark, seed):
    source, index = faulty(seed)
    left, right = frame(spark, source), frame(spark, index)
    expected = counts(source, index)
    assert rows(bitsets.counted_on_both(left, right, "id")) == sorted(expected, key=repr)
    differing = sorted((c for c in expected if c[1] != c[2]), key=repr)
    assert rows(bitsets.differing_counts(left, right, "id")) == differing
    assert rows(bitsets.differing_counts(left, right, "id", levels=(8,))) == differing
    assert {r[3] for r in rows(reconcile.repo_vs_index_differences(left, right, "id"))} <= {"missing", "extra", "duplicate"}


def test_nulls_empty_sides_and_equal_repeats(spark):
    nothing = frame(spark, [])
    some = frame(spark, [1, 2, 2, None, None])
    assert rows(bitsets.counted_on_both(nothing, nothing, "id")) == []
    assert rows(bitsets.counted_on_both(some, nothing, "id")) == sorted([(1, 1, 0), (2, 2, 0), (None, 2, 0)], key=repr)
    both = rows(bitsets.counted_on_both(some, some, "id"))
    assert both == sorted([(1, 1, 1), (2, 2, 2), (None, 2, 0), (None, 0, 2)], key=repr)
    # Equally often on both sides is no difference; null ids never meet.
    assert rows(bitsets.differing_counts(some, some, "id")) == sorted([(None, 2, 0), (None, 0, 2)], key=repr)


def test_ids_are_joined_only_where_sets_differ(spark):
    source = spark.range(0, 500_000)
    index = source.where("id <> 77777").unionByName(spark.range(200_000, 200_001))
    buckets = bitsets.unlike_buckets(source, index, "id")
    assert sorted(r["_bucket"] for r in buckets.collect()) == [3, 7]
    assert bitsets.in_buckets(source, buckets, "id").count() == 2 * 32_768
    report = bitsets.counted_on_both(source, index, "id")
    assert report.count() == 500_000
    assert rows(report.where("in_source <> 1 or in_index <> 1")) == [(200_000, 1, 2), (77_777, 1, 0)]
    ranges = bitsets.unlike_ranges(source, index, "id", 10)
    assert bitsets.in_ranges(source, ranges, "id", 10).count() == 2 * 1024
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("FullOuter") :]
    # The index is a union, so its semi join goes down to both of its parts.
    assert joined.count("LeftSemi") == 3 and "LeftAnti" not in joined


def test_check_index_joins_by_bitmap(spark, folder):
    from checks.queries import QUERIES

    plan = QUERIES["check_index_tx"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("FullOuter") :]
    assert plan.count("FullOuter") == 1
    # The feed and the three scans that make up the markers are cut down to buckets before the join by id.
    assert joined.count("LeftSemi") == 4


NAMES = "node_id long, name string, content string"


def names(spark):
    rng = random.Random(1)
    pool = ["Red ring", "ring-finger RINGS", "Éclair ÉTÉ", "\U0001f600 x", "zz", "", None, "the the", "r", "￿ high", "Rio, 4x4"]
    return spark.createDataFrame([(i, rng.choice(pool), " ".join(p for p in rng.choices(pool, k=4) if p)) for i in range(300)], NAMES)


@pytest.mark.parametrize("prefix", ["ring", "R", "é", "\U0001f600", "z", "zz", "4", "￿", "the", "nothing"])
def test_a_range_of_terms_finds_what_a_scan_finds(spark, fresh, prefix):
    table = names(spark)
    postings.write_postings(postings.postings(table, "node_id", ["name", "content"]), f"{fresh}/p", 4)
    found = spark.read.parquet(f"{fresh}/p")
    for field in ("name", "content"):
        expected = rows(search.field_prefix_search(table, field, prefix).select("node_id"))
        assert rows(postings.search(found, field, prefix)) == expected
    for part in (table.where("node_id < 100"), table.where("node_id >= 50"), table.where("node_id >= 50 and node_id < 100")):
        sign = -1 if part.count() == 50 else 1
        postings.write_dictionary(postings.dictionary(part, ["name", "content"], sign), f"{fresh}/d", 3)
    runs = spark.read.parquet(f"{fresh}/d")
    expected = search.suggest_terms(table, prefix, 5, ["name", "content"]).collect()
    assert postings.suggest(runs, prefix, 5).collect() == expected
    postings.write_dictionary(postings.merged(runs), f"{fresh}/m")
    assert postings.suggest(spark.read.parquet(f"{fresh}/m"), prefix, 5).collect() == expected


def test_postings_travel_by_term_and_texts_are_cut_once(spark, fresh, monkeypatch):
    table = names(spark).union(names(spark).where("node_id < 20")).union(spark.createDataFrame([(None, "Red ring", "the")], NAMES))
    data = table.collect()
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    expected = sorted(
        ((f, t, r.node_id) for r in data for f in ("name", "content") for t in set(re.split(r"[\W_]+", (r[f] or "").lower())) - {""}), key=repr
    )
    made = postings.postings(table.repartition(1).mapInArrow(counted, NAMES), "node_id", ["name", "content"])
    for stretch, path in ((postings.STRETCH, f"{fresh}/one"), (1, f"{fresh}/many")):
        monkeypatch.setattr(postings, "STRETCH", stretch)
        read.value = 0
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
        try:
            postings.write_postings(made, path, 3)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert read.value == len(data)
        found = spark.read.parquet(path)
        assert rows(found.select("field", "term", F.explode("node_id"))) == expected
        terms = len({e[:2] for e in expected})
        assert found.count() == terms if stretch > 1 else terms < found.count() < len(expected)
        ends = found.groupBy(F.input_file_name()).agg(F.min(F.struct("field", "term")), F.max(F.struct("field", "term"))).collect()
        ends = sorted((tuple(low), tuple(high)) for _, low, high in ends)
        assert len(ends) > 1 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
        hits = {e[2] for e in expected if e[0] == "name" and e[1].startswith("ring")}
        assert None in hits and rows(postings.search(found, "name", "Ring")) == sorted(((h,) for h in hits), key=repr)


def test_a_prefix_reaches_the_scan_as_a_range(spark, fresh):
    postings.write_postings(postings.postings(names(spark), "node_id", ["name"]), f"{fresh}/p")
    text = postings.search(spark.read.parquet(f"{fresh}/p"), "name", "Ring")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,ring), LessThan(" in text
    postings.write_dictionary(postings.dictionary(names(spark), ["name"]), f"{fresh}/d")
    text = postings.suggest(spark.read.parquet(f"{fresh}/d"), "ri")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term,ri), LessThan(term" in text and "Generate" not in text


def test_after_prefix():
    assert postings.after_prefix("ab") == "ac" and postings.after_prefix("a\U0010ffff") == "b"
    assert postings.after_prefix("퟿") == "" and postings.after_prefix("\U0010ffff") is None and postings.after_prefix("") is None


def test_reader_bitmaps_see_what_the_readers_say(spark, monkeypatch):
    rng = random.Random(2)
    acls = [rng.choice([0, 1, -5, 63, 64, 65, 32_768, 32_769, 70_000, 1 << 40]) + rng.randrange(300) for _ in range(400)]
    readers = spark.createDataFrame([(a, f"G{rng.randrange(5)}") for a in acls] + [(None, "G1")], "acl_id long, authority string")
    nodes = spark.createDataFrame([(i, a + d) for i, (a, d) in enumerate((a, d) for a in acls for d in (0, 1, -1))] + [(-1, None)], "node_id long, acl_id long")
    stored = expand.authority_bitmaps(readers)
    for who in (["G1"], ["G0", "G3"], [], ["nobody"]):
        expected = rows(expand.visible_nodes(nodes, readers, who), *nodes.columns)
        assert rows(expand.visible_by_bitmap(nodes, stored, who)) == expected
        with monkeypatch.context() as patch:
            patch.setattr(expand, "SENT_BUCKETS", -1)
            assert rows(expand.visible_by_bitmap(nodes, stored, who)) == expected


def test_nodes_are_not_shuffled_for_reader_bitmaps(spark, folder):
    from checks.queries import QUERIES

    plan = QUERIES["visible_by_bitmap"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("BroadcastHashJoin") < plan.index("Exchange")


def test_sketches_of_hours_merge_within_their_error(spark):
    from tidemark.operators import telemetry

    rng = random.Random(4)
    data = [(rng.choice(["a", "a", "b"]), rng.randrange(0, 50 * telemetry.HOUR_MS), rng.expovariate(0.01), False, False) for _ in range(20_000)]
    data += [("none", 5, None, True, True), (None, 7, 3.0, False, True)]
    requests = spark.createDataFrame(data, "handler string, ts_ms long, elapsed_ms double, is_error boolean, is_timeout boolean")
    sketches = telemetry.handler_sketches(requests)
    for begin, end in ((None, None), (10, 20)):
        inside = [r for r in data if begin is None or begin * telemetry.HOUR_MS <= r[1] < end * telemetry.HOUR_MS]
        bounds = (None, None) if begin is None else (begin * telemetry.HOUR_MS, end * telemetry.HOUR_MS)
        found = {r["handler"]: r for r in telemetry.stats_of_sketches(sketches, *bounds).collect()}
        assert set(found) == {r[0] for r in inside}
        for handler, row in found.items():
            values = sorted(r[2] for r in inside if r[0] == handler and r[2] is not None)
            assert row["requests"] == sum(r[0] == handler for r in inside)
            for name, q in telemetry.PERCENTILES.items():
                if not values:
                    assert row[name] is None
                    continue
                below, not_above = (sum(v < row[name] for v in values), sum(v <= row[name] for v in values))
                assert below / len(values) <= q + telemetry.RANK_ERROR and not_above / len(values) >= q - telemetry.RANK_ERROR
