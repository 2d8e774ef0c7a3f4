import random
import re

import numpy as np
import pytest

from tests.llm.conftest import EDGES, words
from tidemark.llm import neardup


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent=80):
    found = {}
    for doc_id, text in rows:
        found.setdefault(doc_id, []).append(sets(text, size))
    ids = sorted(i for i in found if i is not None)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in found[a]:
                for y in found[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        root[max(top(a), top(b))] = min(top(a), top(b))
    out = []
    for doc_id, text in rows:
        size_of = len(sets(text, size))
        component = None if doc_id is None else top(doc_id) if size_of else doc_id
        out.append((doc_id, size_of, component, doc_id is None or component == doc_id))
    return sorted(out, key=repr)


def near(base, edits, rng):
    w = list(base)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


def documents():
    rng = random.Random(4)
    rows = [(1000 + i, " ".join(words(60 + i % 50, i))) for i in range(120)]
    hot = words(150, 77)
    rows += [(2000 + i, near(hot, rng.randrange(0, 6), rng)) for i in range(150)]
    for k in range(25):
        base = words(40 + 10 * k, 500 + k)
        rows += [(3000 + 10 * k + j, near(base, max(1, len(base) // 25) * j, rng)) for j in range(4)]
    star = words(200, 888)
    rows.append((2500, " ".join(star)))
    for i in range(120):
        own = list(star)
        own[(i * 17) % 180 : (i * 17) % 180 + 16] = words(16, 9000 + i)
        rows.append((2501 + i, " ".join(own)))
    rows += [(4000 + i, "exact Copy of\tthis") for i in range(40)] + [(4100, "EXACT copy\nof this")]
    rows += [(5000, "single"), (5001, "Single"), (5002, "other")]
    rows += [(a and a + 6000, b) for a, b in EDGES if a != 6]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_against_all_pairs(table_of, size):
    rows = documents()
    found = neardup.near_duplicates(table_of(rows).repartition(3), similarity=0.8, shingle=size)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, size)


def test_one_of_each_group_is_kept(table_of):
    rows = [(5, "a b c d e f g"), (3, "A b c d e f g"), (9, "x"), (10, None), (11, ""), (None, "a b c d e f g")]
    kept = neardup.keep_one(table_of(rows))
    assert kept.columns == table_of(rows).columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([3, 9, 10, 11, None], key=repr)


def test_empty_table(table_of):
    assert neardup.near_duplicates(table_of([])).count() == 0


def test_neighbours_across_stretches_are_those_of_one_stretch():
    rng = np.random.default_rng(1)
    n = 60
    rows = {"node": np.arange(n), "group": rng.integers(0, 9, n), "n": rng.integers(8, 11, n), "run": np.sort(rng.integers(0, 3, n))}
    rows["sig"] = rng.integers(0, 2, (n, neardup.COMPARED)).astype(np.uint8)

    def pairs(cuts):
        state, out = neardup._Neighbours(5, 0.8, 0.5), set()
        for a, b in zip([0, *cuts], [*cuts, n], strict=True):
            found, _, _ = state.pairs({k: x[a:b] for k, x in rows.items()})
            out |= set(zip(*[found[k].tolist() for k in ("u", "v", "gu", "gv", "share")], strict=True))
        return out

    assert pairs([]) == pairs([1, 4, 5, 30, 31]) != set()


def region(n, shared, own, seed, every=15):
    """Texts of one template, just below the threshold to each other, and a few copies that are above it to one text."""
    rng = random.Random(seed)
    template = words(shared, seed)
    rows = [(10_000 + i, " ".join(template + words(own, 10_000 * seed + 31 * i))) for i in range(n)]
    for i in range(0, n, every):
        text = rows[i][1].split()
        rows.append((20_000 + i, near(text, 4, rng)))
    rng.shuffle(rows)
    return rows


def linked_groups(frame, similarity=0.8, **settings):
    """The components, as sets of ids, of the links between a table's texts."""
    nodes = neardup.signatures(frame, 2, "doc_id").withColumnRenamed("id", "node").select("node", "n", "sig")
    found = neardup.components(neardup.links(frame, nodes, similarity, 2, "doc_id", **settings))
    groups = {}
    for r in found.collect():
        groups.setdefault(r["root"], set()).add(r["node"])
    return sorted(map(sorted, groups.values()))


def test_true_pairs_in_a_crowded_region(table_of):
    rows = region(400, 80, 20, 3, every=80)
    found = linked_groups(table_of(rows), first=1, second=1, near=1, hubs=1)
    every = {}
    for doc_id, _, component, _ in brute(rows, 2):
        every.setdefault(component, set()).add(doc_id)
    assert found == sorted(sorted(g) for g in every.values() if len(g) > 1)


def test_leaves_of_more_stars_than_hubs(table_of):
    rng = random.Random(8)
    rows = []
    for k in range(4):
        star = words(200, 700 + k)
        rows.append((1000 * k, " ".join(star)))
        for i in range(1, 60):
            own = list(star)
            own[(i * 17) % 180 : (i * 17) % 180 + 18] = words(18, 9000 + 100 * k + i)
            rows.append((1000 * k + i, " ".join(own)))
    rng.shuffle(rows)
    found = linked_groups(table_of(rows), first=1, second=1, near=1, hubs=1)
    assert found == [list(range(1000 * k, 1000 * k + 60)) for k in range(4)]


def test_exact_pairs_of_linked_and_lone_members(spark, table_of):
    rows = region(60, 80, 20, 5)
    frame = table_of(rows)
    ids = spark.createDataFrame([(i,) for i, _ in rows], "node long")
    sets_of = neardup.full_sets(frame, ids, 2, "doc_id")
    # All but the copies are one group, so its texts meet copies only.
    members = spark.createDataFrame([(i, 1 if i < 20_000 else i) for i, _ in rows], "node long, group long")
    pairs = neardup.exact_pairs(sets_of, members, 0.8)
    linked = {(r["u"], r["v"]) for r in neardup.confirmed(sets_of, pairs, 0.8).collect()}
    shingles = {i: sets(t, 2) for i, t in rows}
    group = {i: 1 if i < 20_000 else i for i in shingles}
    wanted = {
        (a, b)
        for a in shingles
        for b in shingles
        if a < b and group[a] != group[b] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    }
    assert linked == wanted != set()
