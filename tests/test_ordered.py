"""Split prefix sums against a plain loop, with hot keys, ties and empty input."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import batch, ordered, reconcile, telemetry
from tests.conftest import rows


def hot_rows(n=900, seed=1):
    """A third of all rows at one commit time."""
    dice = random.Random(seed)
    return [(i, 500 if i % 3 == 0 else dice.randrange(1000), dice.randrange(6), dice.randrange(2)) for i in range(n)]


SCHEMA = "tx_id long, commit_time_ms long, updates long, deletes long"


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_weighted_batches(spark, parts):
    data = hot_rows()
    got = {r["tx_id"]: (r["docs_before"], r["batch_no"]) for r in batch.weighted_batches(
        spark.createDataFrame(data, SCHEMA).repartition(7), 50, parts).collect()}
    before = 0
    for tx, _, up, down in sorted(data, key=lambda r: (r[1], r[0])):
        assert got[tx] == (before, before // 50)
        before += up + down
    assert len(got) == len(data)


def test_weight_larger_than_a_batch_and_empty_transactions(spark):
    data = [(1, 1, 99, 0), (2, 2, 0, 0), (3, 3, 1, 0), (4, 4, 250, 0), (5, 5, 0, 0), (6, 6, 1, 1)]
    got = rows(batch.weighted_batches(spark.createDataFrame(data, SCHEMA), 100), "tx_id", "batch_no")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 3), (6, 3)]


def test_count_batches_never_exceed_the_cap(spark):
    sets = spark.range(1300).select(F.col("id").alias("change_set_id"), (F.col("id") % 2).alias("commit_time_ms"))
    sizes = batch.count_batches(sets).groupBy("batch_no").count()
    assert rows(sizes) == [(0, 512), (1, 512), (2, 276)]


def test_chunks_of_a_hot_batch(spark):
    data = spark.range(700).select(F.when(F.col("id") < 600, 1).otherwise(F.col("id")).alias("batch_no"), "id")
    got = batch.fixed_chunks(data, "batch_no", ["id"], 50, parts=6)
    assert sorted(rows(got.filter("batch_no = 1").groupBy("chunk_no").count())) == [(n, 50) for n in range(12)]
    assert got.filter("batch_no <> 1 AND chunk_no <> 0").count() == 0


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert batch.weighted_batches(empty).count() == 0
    assert batch.delete_batches(spark.createDataFrame([], "key string")).count() == 0


def test_previous_row_crosses_parts(spark):
    data = spark.range(200).select((F.col("id") % 2).alias("g"), "id", (F.col("id") * 3).alias("v"))
    got = ordered.with_previous(data, ["g", "id"], ["g", "v"], parts=9).orderBy("g", "id").collect()
    for before, row in zip([None, *got[:-1]], got):
        assert (row["prev_g"], row["prev_v"]) == ((None, None) if before is None else (before["g"], before["v"]))


def test_settled_at(spark):
    series = {
        "a": [0, 0, 0, 3, 3, 3, 3, 3, 3, 3, 4],  # still from the second 3 on
        "b": [1, 2, 2, 1, 1, 1, 2, 3],  # never long enough
        "c": [5] * 8,
        "d": [0] * 20,
    }
    data = [(c, n * 2000, d) for c, docs in series.items() for n, d in enumerate(docs)]
    frame = spark.createDataFrame(data, "core string, sample_ms long, docs long")
    assert rows(reconcile.settled_at(frame, 10_000, parts=5)) == [("a", 18000, 3), ("c", 12000, 5)]


def test_exact_percentiles_of_a_hot_group(spark):
    dice = random.Random(3)
    data = [("x" if i % 10 else "y", dice.randrange(40) / 4) for i in range(1000)] + [("z", 1.5), ("w", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    got = telemetry.exact_percentiles(frame, "g", "v", telemetry.PERCENTILES, parts=7).collect()
    for row in got:
        values = sorted(v for g, v in data if g == row["g"] and v is not None)
        for name, fraction in telemetry.PERCENTILES.items():
            rank = fraction * (len(values) - 1)
            low, high = values[int(rank)], values[min(int(rank) + 1, len(values) - 1)]
            assert row[name] == pytest.approx(low + (high - low) * (rank - int(rank)))
    assert sorted(r["g"] for r in got) == ["x", "y", "z"]


def test_request_rates_over_slot_borders(spark):
    dice = random.Random(5)
    data = [(dice.choice("ab"), dice.randrange(0, 4000_000)) for _ in range(400)]
    got = batch.request_rates(spark.createDataFrame(data, "handler string, ts_ms long")).collect()
    for row in got:
        for width in (300, 900):
            n = sum(h == row["handler"] and row["second"] - width < t // 1000 <= row["second"] for h, t in data)
            assert row[f"rate_{width // 60}min"] == pytest.approx(n / width)
    assert sum(r["requests"] for r in got) == 400


def test_parts_are_cut_alike_and_no_row_leaves_the_jvm(spark):
    data = spark.createDataFrame(hot_rows(), SCHEMA).repartition(5)
    order = ["commit_time_ms", "tx_id"]
    first, n = ordered.cut(data, order, 8)
    again, _ = ordered.cut(data.repartition(3), order, 8)
    assert n == 8 and rows(first, *order, ordered.PART) == rows(again, *order, ordered.PART)
    sizes = [r["count"] for r in first.groupBy(ordered.PART).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * len(hot_rows()) / 8
    core = spark.createDataFrame([("a", 1, 1)], "core string, sample_ms long, docs long")
    for frame in (
        batch.weighted_batches(data), batch.count_batches(data, "tx_id"), batch.fixed_chunks(data, "updates", ["tx_id"], 9),
        batch.delete_batches(data.select(F.col("tx_id").cast("string").alias("key"))), reconcile.settled_at(core),
        telemetry.exact_percentiles(data, "updates", "deletes", {"p": 0.5}),
    ):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "Python" not in plan and "Window" in plan


@pytest.mark.parametrize("parts", [1, 3, 12])
def test_nulls_ties_of_the_first_column_and_reverse_order(spark, parts):
    dice = random.Random(parts)
    data = [(dice.choice([None, "a", "b", "é", "b" * 40]), None if i == 7 else i) for i in range(300)]
    frame = spark.createDataFrame(data, "k string, i long").repartition(4)
    by = lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0)
    expected = sorted(data, key=by)
    for descending in (False, True):
        got = ordered.with_position(frame, ["k", "i"], parts=parts, descending=descending).collect()
        assert [(r["k"], r["i"]) for r in sorted(got, key=lambda r: r["position"])] == expected[:: -1 if descending else 1]
    places = {(r["k"], r["i"]): r["place"] for r in ordered.with_place(frame, "k", ["i"], parts=parts).collect()}
    for k in {k for k, _ in data}:
        assert [places[r] for r in expected if r[0] == k] == list(range(sum(r[0] == k for r in data)))
