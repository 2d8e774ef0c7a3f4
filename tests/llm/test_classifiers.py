import zlib

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tidemark.llm import quality, toxicity
from tidemark.llm.shared import table


def accuracy(spark, folder, found, label, parts, rest):
    rows = found.join(table(spark, folder, "labels").select("doc_id", label), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 for r in rows)
    return np.mean([r["predicted"] == r[label] for r in held])


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored, score, predicted = quality.score_quality(documents, labels)
    assert accuracy(spark, folder, quality.digest(scored, score, predicted), "quality", 4, 2) >= 0.97


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored, score, predicted = toxicity.score_toxicity(documents, labels)
    assert accuracy(spark, folder, toxicity.digest(scored, score, predicted), "toxic", 5, 0) >= 0.93


LABELS = [(i, i % 2, (i + 1) % 2) for i in range(100, 180)] + [(4, 1, 0), (5, None, None), (None, 1, 1), (7, 2, 2), (100, 0, 1)]


@pytest.mark.parametrize("rows,labels", [(EDGES, []), ([], LABELS), (EDGES, LABELS), ([], [])])
def test_odd_rows_and_few_labels(spark, table_of, rows, labels):
    texts = [(i, ("bad!! worse!! idiot " if i % 2 == 0 else "fine words here ") * 5) for i in range(100, 180)] if rows and labels else []
    frame = table_of(rows + texts)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module, scored in ((quality, quality.score_quality(frame, known)), (toxicity, toxicity.score_toxicity(frame, known))):
        out, score, predicted = scored
        assert score not in frame.columns and set(frame.columns) <= set(out.columns)
        found = module.digest(out, score, predicted).collect()
        assert len(found) == len(rows + texts)
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in found)
        if texts:
            good = {r["doc_id"]: r["score"] for r in found}
            assert good[101 if module is quality else 100] > good[100 if module is quality else 101]
    assert quality.keep_good(frame, known).columns == frame.columns


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"a b a", b"", b"Ab! CD 12", "Éa ñ".encode(), b"x x x"]
    weights = np.random.default_rng(2).normal(size=1 << quality.BITS).astype(np.float32)
    alone = [quality.dots([t], weights)[0] for t in texts]
    assert np.allclose(quality.dots(texts, weights), alone)
    for text, expected in zip(texts, alone, strict=True):
        at, value = quality.sparse(text)
        assert np.isclose(weights[at] @ value, expected, atol=1e-5)


def test_isotonic_line_rises_and_follows_the_labels():
    rng = np.random.default_rng(1)
    margin = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    at, rate = toxicity.isotonic(margin, y)
    assert (np.diff(at) >= 0).all() and (np.diff(rate) >= 0).all()
    assert abs(np.interp(margin, at, rate).mean() - y.mean()) < 0.05


def test_trees_learn_a_product_of_features():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = toxicity.Boosted(trees=80).fit(x[:400], y[:400])
    assert ((model.margin(x[400:]) > 0) == y[400:]).mean() > 0.9
