import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import components as own
from tidemark.llm import wordhash
from tidemark.llm.shared import utf8

TEXTS = st.lists(st.text(alphabet="ab é\n\t.\x0b", max_size=30), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_equal_words_have_equal_hashes_and_others_differ(texts):
    hashes, offsets, _ = wordhash.hashed(utf8(texts))
    expected = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert np.diff(offsets).tolist() == [len(w) for w in expected]
    flat = [w for ws in expected for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


def test_stretches_cover_all_texts(monkeypatch):
    monkeypatch.setattr(wordhash, "STRETCH", 10)
    texts = [b"x" * n for n in (3, 30, 0, 4, 5, 6, 1)]
    found = list(wordhash.stretches(texts))
    assert found[0][0] == 0 and found[-1][1] == len(texts)
    assert all(a[1] == b[0] for a, b in zip(found[:-1], found[1:], strict=True))


@pytest.mark.parametrize("per_task", [200_000, 90])
def test_components_of_chains_stars_and_repeated_links(spark, monkeypatch, per_task):
    monkeypatch.setattr(own, "PER_TASK", per_task)
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    ids = 5000 + rng.permutation(400)
    ring = [(int(ids[i]), int(ids[(i + 1) % 400])) for i in range(400)]
    links = chain + star + ring + ring[:50] + [(7, 7)]
    frame = spark.createDataFrame(links, "u long, v long").repartition(7)
    found = {r["node"]: r["root"] for r in own.components(frame).collect()}
    assert found == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(201)} | {int(i): 5000 for i in ids}


def test_no_links_no_components(spark):
    assert own.components(spark.createDataFrame([], "u long, v long")).count() == 0
