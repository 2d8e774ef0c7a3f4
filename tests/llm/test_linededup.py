import collections
import hashlib

from tests.llm.conftest import EDGES
from tidemark.llm import linededup


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute(documents, least=10):
    counts = collections.Counter()
    for _, text in documents:
        counts.update({key(x) for x in (text or "").split("\n")})
    out = []
    for doc_id, text in documents:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (key(x) and counts[key(x)] >= least)]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        out.append((doc_id, len(lines), len(lines) - len(kept), digest))
    return sorted(out, key=repr)


def test_against_brute_force(table_of):
    documents = [(100 + i, f"Own {i}\n\n Shared LINE\t\n{'twice' if i % 2 else 'Éin'}\nshared line") for i in range(20)]
    documents += [(200 + i, "nine\n" * (1 + i % 3)) for i in range(9)] + [(300 + i, "ten") for i in range(10)] + EDGES
    found = linededup.dedup_lines(table_of(documents))
    assert found.columns[-2:] == ["n_lines", "n_dropped"] and "_at" in found.columns
    assert sorted((tuple(r) for r in linededup.digest(found).collect()), key=repr) == brute(documents)


def test_one_id_with_two_texts(table_of):
    documents = [(1, "x\ny"), (1, "y\nx"), *[(10 + i, "x") for i in range(10)]]
    assert sorted((tuple(r) for r in linededup.digest(linededup.dedup_lines(table_of(documents))).collect()), key=repr) == brute(documents)


def test_empty_table(table_of):
    assert linededup.dedup_lines(table_of([])).count() == 0
