"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words build one automaton; documents stream through it word by word
while the length of the longest match that ends at each word is tracked. Where
that length reaches the window, the words of the match are contaminated.

Nulls and empty texts have no words. A repeated item counts by its own id; one without an id
marks its words and is no item of the count. Without items nothing is marked, and an empty table of documents
gives no rows. Rows that repeat are matched one by one. Items
are cut into blocks of bounded size, one automaton and one pass for each, so that
what is sent to executors has a fixed bound however many items there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import freed, stored, unused, utf8

#: Consecutive item words that make a match.
WINDOW = 10
#: Words of items in one automaton (about 150 bytes each on an executor).
BLOCK_WORDS = 400_000

_MATCH = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW_MATCH = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))]
)
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Bytes to lower case, everything that is no part of a word to a space.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (b in _KEEP or 65 <= b <= 90) else 32 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over words, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        short: dict[int, list[tuple[int, int]]] = {}
        for number, (_, item) in enumerate(items):
            last = 0
            for word in item:
                last = self._extend(last, word, ends)
        # The items of a state: those whose prefixes end there, handed up the suffix links.
        for number, (_, item) in enumerate(items):
            state, matched = 0, 0
            for word in item:
                state, matched = self.step(state, matched, word)
                ends[state].add(number)
            if 0 < len(item) < window:
                short.setdefault(self._up(state, len(item)), []).append((len(item), number))
        at_window: dict[int, set[int]] = {}
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            up = self.link[state]
            if self.length[up] < window <= self.length[state]:
                at_window[state] = ends[state]
            elif self.length[up] >= window:
                ends[up] |= ends[state]
        #: For a state at or beyond the window: the one that holds its last ``window`` words.
        self.anchor = list(range(len(self.length)))
        #: For a state: the short items that end its words, as (words, item).
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for state in reversed(order):
            up = self.link[state]
            if self.length[up] >= window:
                self.anchor[state] = self.anchor[up]
            self.short[state] = self.short[up] + short.get(state, [])
        self.items = {state: frozenset(found) for state, found in at_window.items()}
        self.has_short = bool(short)

    def _up(self, state: int, size: int) -> int:
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def _extend(self, last: int, word: bytes, ends: list) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, word, known, ends)
        state = self._new(length[last] + 1, {}, ends)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at < 0:
            link[state] = 0
        else:
            other = nxt[at][word]
            link[state] = other if length[other] == length[at] + 1 else self._clone(at, word, other, ends)
        return state

    def _new(self, length: int, following: dict, ends: list) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        ends.append(set())
        return len(self.next) - 1

    def _clone(self, at: int, word: bytes, other: int, ends: list) -> int:
        clone = self._new(self.length[at] + 1, dict(self.next[other]), ends)
        self.link[clone], self.link[other] = self.link[other], clone
        while at >= 0 and self.next[at].get(word) == other:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def step(self, state: int, matched: int, word: bytes) -> tuple[int, int]:
        """The state and length of the longest match that ends at ``word``."""
        following = self.next
        to = following[state].get(word)
        while to is None and state:
            state = self.link[state]
            matched = self.length[state]
            to = following[state].get(word)
        return (0, 0) if to is None else (to, matched + 1)

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[int]]:
        """Stretches [first, end) of contaminated words, and the items found."""
        following, link, length, window = self.next, self.link, self.length, self.window
        root = following[0]
        spans: list[list[int]] = []
        found: set[int] = set()
        state = matched = 0
        for i, word in enumerate(words):
            to = following[state].get(word)
            if to is None:
                if not state:
                    continue
                if word not in root:
                    state = matched = 0
                    continue
                while to is None:
                    state = link[state]
                    to = following[state].get(word)
                matched = length[state]
            state = to
            matched += 1
            if matched >= window:
                found |= self.items[self.anchor[state]]
                _cover(spans, i + 1 - matched, i + 1)
            if self.has_short:
                for size, item in self.short[state]:
                    if matched >= size:
                        found.add(item)
                        _cover(spans, i + 1 - size, i + 1)
        return spans, found


def _cover(spans: list[list[int]], begin: int, end: int) -> None:
    while spans and spans[-1][1] >= begin:
        begin = min(begin, spans.pop()[0])
    spans.append([begin, end])


def _merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(map(list, spans)):
        _cover(out, begin, end)
    return out


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items that have words, in blocks; only one block is on the driver at a time."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text").where(F.col("text").isNotNull())
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = split_words(utf8([row[1]])[0])
        if words:
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((row[0], words))
            size += len(words)
    yield block


def find_matches(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS
) -> tuple[DataFrame, str]:
    """Documents with one more column, whose name is returned too: a struct of n_words, spans and items.

    ``spans`` are the contaminated words as [first, end) pairs, merged; ``items`` the ids of the items found, sorted
    as strings. A text without words has no spans.
    """
    spark = documents.sparkSession
    name = unused("match", documents.columns)
    schema = T.StructType([*documents.schema.fields, T.StructField(name, _MATCH)])
    out, passed = documents, 0
    for block in item_blocks(benchmark, block_words):
        if passed:
            out = stored(out, "matches")
        sent = spark.sparkContext.broadcast(block)

        def matches(batches, sent=sent, first=not passed):
            automaton = Automaton(sent.value, window)
            for batch in batches:
                results = []
                before = None if first else batch[name].to_pylist()
                for i, raw in enumerate(utf8(batch["text"].to_pylist())):
                    words = split_words(raw)
                    spans, found = automaton.scan(words)
                    names = {automaton.names[k] for k in found} - {None}
                    if before is not None:
                        spans = _merged([*spans, *before[i]["spans"]])
                        names |= set(before[i]["items"])
                    results.append({"n_words": len(words), "spans": spans, "items": sorted(names)})
                columns = batch.columns if first else batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(results, _ARROW_MATCH)], schema.names)

        out = out.mapInArrow(matches, schema)
        passed += 1
    return out, name


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut(text: str, spans: list) -> str:
    """The text without the words of the spans and what stands between them."""
    if not len(spans):
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return "".join([*out, text[at:]])


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Documents without contaminated spans; those of which more than ``max_coverage`` is contaminated go.

    Same columns as ``documents`` (doc_id and text at least); ``n_chars`` follows the text. Clean rows, null texts
    and repeated rows stay as they are.
    """
    found, name = find_matches(documents, benchmark, window, block_words)
    hit = F.aggregate(f"{name}.spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    kept = found.where(hit <= F.lit(max_coverage) * F.col(f"{name}.n_words"))
    place = documents.columns.index("text")

    def cleaned(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, match in enumerate(batch[name].to_pylist()):
                if match["spans"]:
                    texts[i] = cut(texts[i], match["spans"])
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = kept.mapInArrow(freed(cleaned), documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def digest(found: DataFrame, name: str) -> DataFrame:
    """One row per document from ``find_matches``: counts, the items' ids hashed, and whether any word is hit."""
    spans = F.col(f"{name}.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    items = F.array_join(f"{name}.items", ",")
    return found.select(
        "doc_id",
        F.col(f"{name}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size(f"{name}.items").cast("long").alias("n_items"),
        F.sha2(items.cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
