import collections
import random
import re

import numpy as np

from tests.llm.conftest import EDGES
from tidemark.llm import divergence

UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return [w for w in re.split(r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER)) if w]


def brute(documents, top=200):
    """``documents`` are (text, lang, source)."""
    documents = [(t or "", lang or "", source or "") for t, lang, source in documents]
    out = []
    for lang in {d[1] for d in documents}:
        own = [d for d in documents if d[1] == lang]
        held = collections.Counter(w for d in own for w in set(terms(d[0])))
        kept = sorted(w for w in held if held[w] >= 3)
        v = len(kept)
        count = {s: collections.Counter() for _, _, s in own}
        for text, _, source in own:
            count[source].update(w for w in terms(text) if held[w] >= 3)
        whole = sum(count.values(), collections.Counter())

        def shares(c):
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + v) for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        for s in count:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in count if o != s]
            marks = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, values, last in (("pair", pairs, None), ("term", marks, top)):
                values.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(values[:last])]
    return sorted(out)


def frame(table_of, documents):
    made = table_of([(i, d[0]) for i, d in enumerate(documents)]).drop("lang", "source")
    spark = made.sparkSession
    names = spark.createDataFrame([(i, d[1], d[2]) for i, d in enumerate(documents)], "doc_id long, lang string, source string")
    return made.join(names, "doc_id").withColumnRenamed("match", "term").withColumnRenamed("size", "n")


def found(made, **parameters):
    return sorted(tuple(r) for r in divergence.audit(made, **parameters).collect())


def test_against_brute_force(spark, table_of):
    rng = random.Random(5)
    pool = [f"{a}{b}" for a in ("Éa", "zo", "KA", "ñ", "\U0001f600", "re") for b in ("", "x", "yé", "ZZ", "qu", "a" * 300)]
    documents = []
    for i in range(400):
        # One source has a third of all rows and most of the words.
        source, lang = ("hot" if i % 3 == 0 else f"s{i % 7}"), rng.choice(["en", "de", None, ""])
        size = rng.choice([0, 3, 40, 400 if source == "hot" else 5])
        chosen = [rng.choice(pool[: 10 + i % 25]) for _ in range(size)]
        documents.append((rng.choice([" ", "1", "\n"]).join(chosen), lang, source))
    documents += [(t, "en", None) for _, t in EDGES] + [documents[0]] * 4 + [("", "empty", "a"), (None, "empty", "b")]
    documents += [("only twice", "rare", s) for s in "ab"]
    made = frame(table_of, documents)
    assert found(made) == brute(documents)
    assert found(made.repartition(13), top=5) == brute(documents, top=5)


def test_totals_too_many_to_send(table_of, monkeypatch):
    monkeypatch.setattr(divergence, "SENT", 0)
    documents = [(f"a b c{i % 4} d{i % 2}", "en", f"s{i % 5}") for i in range(60)]
    assert found(frame(table_of, documents)) == brute(documents)


def test_tasks_and_stretches_of_every_length(table_of, monkeypatch):
    documents = [("a bb ccc " * 50, "en", f"s{i % 3}") for i in range(9)]
    rows = [(lang, source, text) for text, lang, source in documents]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    for stretch, held in ((1, 1), (7, 2), (1 << 20, 300_000)):
        monkeypatch.setattr(divergence, "_STRETCH", stretch)
        monkeypatch.setattr(divergence, "_HELD", held)
        sums = collections.Counter()
        for out in divergence._counted([batch]):
            for r in out.to_pylist():
                sums[r["source"], r["term"], "n"] += r["n"]
                sums[r["source"], r["term"], "docs"] += r["docs"]
        assert sums["s0", "bb", "n"] == 150 and sums["s1", "ccc", "docs"] == 3 and len(sums) == 18


def test_empty_table(table_of):
    assert found(frame(table_of, [])) == []


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0, 1), (280_000_000_000_000 - 2, 280_000_000_000_000, 7), (10**12, 9 * 10**13, 10**9), (3, 10**14, 10**8)]
    made = spark.createDataFrame(cases, "n long, total long, kept long")
    got = [r[0] for r in made.select(divergence.share(F.col("n"), F.col("total"), F.col("kept"))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (total + kept) for n, total, kept in cases]


def test_band_holds_whatever_fewer_than_k_dominate():
    rng = np.random.default_rng(3)
    for k in (1, 3, 20):
        points = [(int(rng.integers(1, 30)), int(rng.integers(30, 60)), f"t{i:04d}") for i in rng.permutation(3000)]
        points.sort(key=lambda x: (-x[0], x[1], x[2]))
        for size in (7, 500, 1024):
            band, kept = divergence.Band(k), []
            for at in range(0, len(points), size):
                n, low, names = zip(*points[at : at + size], strict=True)
                kept += [points[at + int(i)] for i in np.flatnonzero(band.add(np.array(n), np.array(low), list(names)))]
            n, low, names = (np.array(x) for x in zip(*points, strict=True))
            over = [int(((n >= a) & (low <= b) & (names < c)).sum()) for a, b, c in points]
            assert kept == [p for p, o in zip(points, over, strict=True) if o < k]
