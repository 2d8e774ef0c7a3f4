import hashlib
import re

import pytest

from tests.llm.conftest import EDGES, words
from tidemark.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(documents, items, window=10):
    wanted = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(str(item))
    out = []
    for doc_id, text in documents:
        w, hit, found = split(text), set(), set()
        for size in {len(k) for k in wanted}:
            for i in range(len(w) - size + 1):
                if names := wanted.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


def cases():
    a, b = words(40), words(30, 2)
    items = [(1, " ".join(a)), (2, " ".join(a[5:25] + b[:12])), (10, "Short one."), (11, "the " * 14), (12, None), (13, "")]
    items += [(14, "!!"), (15, " ".join(a)), (2, "one"), (16, " ".join(b[::-1])), (17, "x y x y x y x y x y x y z")]
    documents = [
        (20, " ".join(a[:9])),
        (21, " ".join(a[:10]).upper()),
        (22, "lead " + ", ".join(a[3:22]) + " tail " + " ".join(b[2:12])),
        (23, "a short, one and SHORT? ONE"),
        (24, "the " * 30),
        (25, " ".join(a[5:25] + b[:12] + a[30:])),
        (26, " ".join([*a[:10], "gap", *a[10:19], "gap", *a[25:]])),
        (27, "x y " * 9 + "z"),
        *EDGES,
    ]
    return documents, items


@pytest.mark.parametrize("block_words", [400_000, 45])
def test_against_brute_force(spark, table_of, block_words):
    documents, items = cases()
    found, match = d.find_matches(table_of(documents), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert match != "match"
    got = sorted((tuple(r) for r in d.digest(found, match).collect()), key=repr)
    assert got == brute(documents, items)


def test_spans_are_cut_and_covered_documents_go(spark, table_of):
    documents, items = cases()
    clean = d.decontaminate(table_of(documents), spark.createDataFrame(items, "item_id long, text string"), max_coverage=0.95)
    assert clean.columns == table_of(documents).columns
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert 21 not in texts and 24 not in texts
    assert texts[20]["text"] == " ".join(words(40)[:9])
    assert texts[22]["text"].split() == ["lead", "tail"]
    assert texts[26]["text"].split() == ["gap", *words(40)[10:19], "gap"]
    assert texts[22]["n_chars"] == len(texts[22]["text"])
    assert texts[1]["text"] is None and texts[2]["text"] == ""
    assert clean.where("doc_id = 4").count() == 2


@pytest.mark.parametrize("items", [[], [(1, None)]])
def test_without_items_all_is_clean(spark, table_of, items):
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found, match = d.find_matches(table_of(EDGES), benchmark)
    assert d.digest(found, match).where("contaminated").count() == 0
    assert d.decontaminate(table_of(EDGES), benchmark).count() == len(EDGES)


def test_empty_table(spark, table_of):
    found, match = d.find_matches(table_of([]), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert d.digest(found, match).count() == 0


def test_items_without_an_id_and_empty_tables(spark, table_of):
    text = " ".join(words(12))
    frame = table_of([(1, f"start {text} end"), (1, f"start {text} end"), (2, None)])
    items = spark.createDataFrame([(None, text), (7, text), (None, "no such words here"), (8, None)], "item_id long, text string")
    result = d.digest(*d.find_matches(frame, items)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    seven, none = (hashlib.sha256(x).hexdigest() for x in (b"7", b""))
    assert sorted(map(tuple, result.collect())) == [(1, 14, 12, 1, seven, True)] * 2 + [(2, 0, 0, 0, none, False)]
    only = d.digest(*d.find_matches(frame, items.where("item_id is null"))).select("n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(tuple, only.collect())) == [(0, 0, none, False), (12, 0, none, True), (12, 0, none, True)]
    nothing = d.digest(*d.find_matches(frame, items.limit(0)))
    assert [r["n_hit"] for r in nothing.collect()] == [0, 0, 0]
    assert d.digest(*d.find_matches(table_of([]), items)).count() == 0
