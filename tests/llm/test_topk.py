import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk


def brute(rows, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    scaled = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    out = set()
    for q, a in scaled:
        if q % 50 == 0:
            found = [(-max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, a, b)))), i) for i, b in scaled if i != q and len(a) == len(b)]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])}
    return out


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 64).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(2000, None), (2050, [None, 1.0]), (2100, [math.nan] * 64), (2150, [math.inf] * 64), (None, rows[1][1])]
    rows += [(2200, []), (2201, []), (2250, [1.0, -1.0]), (2251, [0.5, 0.25]), (2252, [-0.001, 3.0])]
    return rows + [(7, rows[7][1]), (50, rows[50][1])]


@pytest.mark.parametrize("block", [8192, 4])
def test_against_brute_force(spark, block):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(4)
    found = topk.top_k(frame, F.col("id") % 50 == 0, block=block)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert [set(map(tuple, found.collect())), found.count()] == [brute(rows), len(brute(rows))]


def test_huge_components(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, -1.0]), (2, [3.0, 5.0]), (3, [-1e15, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert set(map(tuple, topk.top_k(frame, F.col("id") % 50 == 0).collect())) == brute(rows)


def test_no_vectors(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(frame, F.col("id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.integers(-500, 500, (30, 64)).astype(float), rng.integers(-500, 500, (40, 64)).astype(float)
    before = None
    for segments in topk.LEVELS:
        bound = topk.statistics(x, segments) @ topk.statistics(y, segments).T
        assert (bound >= x @ y.T - 1e-6).all()
        assert before is None or (bound <= before + 1e-6).all()
        before = bound
