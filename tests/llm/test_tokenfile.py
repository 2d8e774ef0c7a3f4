import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGES, words
from tidemark.llm import tokenfile
from tidemark.llm.queries import tokenizer_path

ODD = [
    (30, "it's we'll THEY'D 'S ''t can't,'re"),
    (31, "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>"),
    (32, " x y\x85z\x1cw İ ŉ Σς ǅ ½ ² Ⅷ 12 3a4 _a_ --- ...,,"),
    (33, "é ́e Å Å ﬁ ẞ ៾ ŸŽ"),
]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.sampled_from([50, 95, 100]))
def test_blocks_round_trip(values, percentile):
    raw = tokenfile.encode(np.array(values, np.uint32), percentile)
    assert tokenfile.decode(raw).tolist() == values
    assert tokenfile.decode(raw, 1, 3).tolist() == values[128:384]


def test_outliers_go_to_exceptions():
    values = np.arange(128, dtype=np.uint32) % 16
    values[7] = 2**31
    assert len(tokenfile.encode(values)) == 8 + 6 + 4 * 16 + 5


@pytest.mark.parametrize("memory", [100, 10_000_000])
def test_encoder_equals_the_tokenizer(memory):
    from tokenizers import Tokenizer

    texts = [t or "" for _, t in EDGES + ODD] + [" ".join(w.title() + ",." for w in words(500, k)) for k in range(3)]
    own = Tokenizer.from_file(tokenizer_path())
    encoder = tokenfile.Encoder(tokenizer_path(), memory)
    for _ in range(2):
        found = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)]
        assert found == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_files_against_the_tokenizer(table_of, monkeypatch):
    from tokenizers import Tokenizer

    rows = EDGES + ODD + [(100 - i, " ".join(words(20 + i, i))) for i in range(40)]
    found = tokenfile.digest(tokenfile.token_files(table_of(rows).repartition(6), tokenizer_path())).collect()
    own, start, expected = Tokenizer.from_file(tokenizer_path()), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_empty_table(table_of):
    assert tokenfile.token_files(table_of([]), tokenizer_path()).count() == 0


def test_memory_is_bounded_and_frequent_words_stay():
    encoder = tokenfile.Encoder(tokenizer_path(), memory=600_000)
    rng = np.random.default_rng(2)
    often = words(200, 77)
    for k in range(40):
        text = " ".join([w for w in words(400, k) for w in (w, often[rng.integers(200)])])
        list(encoder.encode([text] * 3))
        held = [encoder.steady, encoder.fresh, encoder.old]
        assert sum(180 + len(w) + len(ids) for d in held for w, ids in d.items()) < 3 * 600_000
    # Met first or last, words of every text are at hand, and few of those of one text are.
    known = encoder.steady | encoder.old
    assert sum(w in known for w in often) > 190


def test_plain_texts_are_cut_many_at_once_and_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    marks = [*" \t\n\r.,;-!?()\"0123456789", "...", " (", "), ", "'s ", "<|", "\xe9", "\xdf", "\xc0", "\xf7", "\u0142"]
    names = [w.translate({48 + i: 97 + 2 * i for i in range(10)}) * int(rng.integers(1, 5)) for w in words(300)]
    texts = ["", " ", "."] + ["".join(f"{names[rng.integers(300)].title()}{marks[rng.integers(len(marks))]}" for _ in range(60)) for _ in range(300)]
    expected = [e.ids for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]
    for memory in (100, 20_000, 10_000_000):
        encoder = tokenfile.Encoder(tokenizer_path(), memory)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == expected
        assert sum(x.nbytes for x in (encoder.units.keys, encoder.units.ids, encoder.units.count)) <= max(memory, 2000)
    # Runs of letters of plain texts need no second cut: they are found in the table.
    plain = ["Some words, some more words.", "Words again (and again)."]
    list(encoder.encode(plain))
    encoder.tokenize = encoder.tokenizer = None
    assert len(list(encoder.encode(plain))) == 2 and not any(w in encoder.steady | encoder.fresh for w in ("words", "words."))
