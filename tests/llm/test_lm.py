import collections
import math
import re
import zlib

import numpy as np
import pytest

from tests.llm.conftest import EDGES
from tidemark.llm import lm


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def documents():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        own = ["the", "red", "fox", "sees"] if i % 2 else ["der", "rote", "fuchs", "sieht"]
        rows.append((1000 + i, " ".join(f"{own[rng.integers(4)]} {own[k % 4]}{',' * (k % 5 == 0)}" for k in range(int(rng.integers(1, 60)))).title()))
    return rows + EDGES + [(8, "unseen Wörter only.")]


def test_counts_and_base_against_brute_force_and_the_model_against_the_base(table_of, monkeypatch):
    rows = documents()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = collections.Counter(t for i, text in rows if i is not None and not held(i) for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    found = lm.digest(lm.score_texts(table_of(rows).repartition(3))).collect()
    assert len(found) == len(rows)
    expected = collections.Counter()
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in own)
        expected[(i, held(i), len(own), sum(counts[t] > 0 for t in own), total, round(base, 4))] += 1
    got = collections.Counter(
        (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found
    )
    assert got == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    usual = [r for r in found if r["doc_id"] is not None and r["doc_id"] >= 1000 and r["held_out"]]
    assert sum(r["score"] for r in usual) > sum(r["base_score"] for r in usual)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b")]])
def test_few_rows(table_of, rows):
    found = lm.score_texts(table_of(rows)).collect()
    assert len(found) == len(rows) and all(math.isfinite(r["score"]) for r in found)


def small():
    rng = np.random.default_rng(0)
    return lm.Network(rng.integers(1, 50, lm.WORDS).astype(float), np.ones(lm.TAILS)), rng


def test_probabilities_sum_to_one():
    network, rng = small()
    hidden = rng.normal(size=(1, lm.HIDDEN)).astype(np.float32)
    targets = np.arange(lm.WORDS + lm.TAILS)
    found, _ = network.losses(np.repeat(hidden, len(targets), axis=0), targets, None)
    assert math.isclose(np.exp(found).sum(), 1, rel_tol=1e-4)


def test_state_is_carried_over_windows_and_lanes_do_not_mix(monkeypatch):
    network, rng = small()
    lengths = [1, 5, 24, 25, 100, 2]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    ids = rng.integers(0, lm.WORDS + lm.TAILS, offsets[-1])
    together = lm.log_probabilities(network, ids, offsets)
    monkeypatch.setattr(lm, "WINDOW", 1000)
    alone = [lm.log_probabilities(network, ids[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert np.allclose(together, alone, rtol=1e-4)


def test_gradients_against_differences(monkeypatch):
    network, rng = small()
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    ids = rng.integers(0, lm.WORDS + lm.TAILS, 30)
    offsets = np.array([0, 12, 30])
    kept = {}

    class Catch:
        def apply(self, gradients, scale):
            kept.update({k: g.copy() for k, g in gradients.items()})

    monkeypatch.setattr(lm, "WINDOW", 50)
    lm.learn(network, ids, offsets, Catch())
    for name, at in (("u", (3, 20)), ("u", (5, 40)), ("c", (2, 3)), ("b", (35,)), ("x", (int(ids[0]), 10)), ("x", (int(ids[13]), 40))):
        values = []
        for step in (1e-3, -1e-3):
            network.p[name][at] += step
            values.append(-lm.log_probabilities(network, ids, offsets).sum())
            network.p[name][at] -= step
        assert math.isclose(kept[name][at], (values[0] - values[1]) / 2e-3, rel_tol=0.03, abs_tol=2e-3)


def test_known_words_are_found_and_others_are_not():
    hashes = np.unique(np.random.default_rng(4).integers(1, 2**63, 50_000).astype(np.uint64))
    known = lm.Known(hashes[::2], np.ones(len(hashes[::2])))
    found = known.find(hashes)
    assert (found[1::2] == -1).all()
    there = found[::2]
    assert (there >= 0).mean() > 0.99 and (there[there >= 0] == np.flatnonzero(there >= 0)).all()


def test_gates_lie_together_and_large_logits_stay_finite():
    network, rng = small()
    ids = rng.integers(0, lm.WORDS + lm.TAILS, 64)
    state = np.zeros((64, lm.HIDDEN), np.float32)
    out, kept = network.states(ids[None], np.array([64]), state, np.ones((1, 64), bool), True)
    # Blocks of one gate each; slices of interleaved gates were most of the time.
    assert [k.shape[-2:] for k in kept] == [(64, lm.HIDDEN)] * 4 and kept[1][0, 1].flags.c_contiguous
    plain, _ = network.losses(out[0], ids, None)
    for name in ("cb", "wb"):
        network.p[name] += np.float32(200)
    found, back = network.losses(out[0], ids, {k: np.zeros_like(v) for k, v in network.p.items()})
    assert np.isfinite(back).all() and np.allclose(found, plain, rtol=1e-3)


def test_counts_of_words_by_hash_and_tail(table_of):
    text = "b, a B a. é xé. a."
    found = {r["tail"]: r["n"] for r in lm.count_words(table_of([(1, text), (2, None)])).groupBy("tail").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert found == {0: 4, 1: 1, 2: 2, 4: 1, 6: 1}
