import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import EDGES, words
from tidemark.llm import mixing


def wanted(sizes, share=1.5, most=2.0):
    """Targets by sharing out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if shares[s] > most * sizes[s]}
        if not over:
            return capped | shares
        capped |= over


def documents():
    rows = [(i, " ".join(words(1 + i * 37 % 400, i)), "abcdefg"[i * i % 7]) for i in range(300)]
    rows += [(1000 + i, " ".join(words(300, i)), "hot") for i in range(150)]
    rows += [(2000, "only five words are here", None), (2001, None, "nothing"), (2002, "x", "tiny"), (2003, "x", "tiny")]
    return rows + [(a and a + 5000, b, "edges") for a, b in EDGES]


def test_targets_and_taken_words(table_of):
    rows = documents()
    plan, pieces = mixing.mix(table_of(rows), block=16, shard=64)
    got = [r.asDict() for r in plan.collect()]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = wanted(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) < 1 for s in targets)
    # Every slot holds one block at most.
    slots = pieces.select("rank", "k").distinct().count()
    assert slots >= sum(targets.values()) / 16
    again, _ = mixing.mix(table_of(rows[::-1]).repartition(5), block=16, shard=64)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, plan.collect()))


def test_mixed_texts_are_the_planned_words(table_of):
    rows = documents()
    frame = table_of(rows)
    plan, _ = mixing.mix(frame, block=16, shard=64)
    mixed = mixing.mixed_documents(frame, block=16, shard=64)
    assert mixed.columns == frame.columns
    found = mixed.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    got = sorted((str(r["doc_id"]), count(r["text"])) for r in found)
    assert got == sorted((str(r["id"]), r["taken"]) for r in plan.where("taken > 0").collect())
    own = {r[0]: set(r[1].split()) for r in rows if r[1]}
    assert all(set(r["text"].split()) <= own[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1000])
def test_permutations(size):
    key = np.full(size, 12345, np.uint64)
    sizes = np.full(size, size)
    there = mixing.permuted(np.arange(size), sizes, key)
    assert sorted(there) == list(range(size))
    assert mixing.permuted(there, sizes, key, back=True).tolist() == list(range(size))


def test_empty_tables(table_of):
    for rows in ([], [(1, None), (2, "")]):
        plan, pieces = mixing.mix(table_of(rows))
        assert plan.count() == len(rows) and pieces.count() == 0
        assert mixing.mixed_documents(table_of(rows)).count() == 0


def test_slots_of_one_source_are_made_in_many_tasks(spark):
    quota = spark.createDataFrame([(1, 50_000), (2, 300)], "rank long, slots long")
    slots = mixing.draw(spark, quota, 1000, 4).select("rank", "k", F.spark_partition_id().alias("part"))
    hot = [r for r in slots.groupBy("part", "rank").count().collect() if r["rank"] == 1]
    assert len(hot) > 4 and max(r["count"] for r in hot) < 25_000
    # Every slot up to the quota is there once.
    kept = slots.where("k < if(rank = 1, 50000, 300)")
    assert kept.count() == kept.select("rank", "k").distinct().count() == 50_300
