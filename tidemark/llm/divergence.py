"""Source divergence audit: how far each source's terms stray from its language's.

A language keeps the terms that enough of its documents hold. Every kept term has a smoothed
share p of each source and q of the whole language, in billionths and in whole numbers alone.
Two sources are as far apart as floor((p - q)^2 / q), summed over all kept terms; a term marks
its source as strongly as the same expression against the language, where p is above q.

Terms are ranked by a dominance skyband. A term with a higher count in the group, a lower
count in the language and an earlier name ranks before, whatever the totals are; one that k
others dominate so is not among the first k. Each partition keeps the terms with fewer than k
dominators, salted partitions merge what is left, and only then values are ranked exactly.

Sums over all terms of all pairs of sources need the terms that both hold: for any other term
one side has no occurrence, and a histogram of each group's counts is enough.

Null text, language and source are empty ones. A document is a row of the table: repeated rows
count one by one, ids are not looked at, other columns neither. Groups without terms have pairs and no
terms; a language without kept terms has pairs of value 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import stored

MIN_DOCUMENTS = 3
#: Terms ranked per group.
TOP = 200
#: Tasks that share the merging of one group's skybands.
SALTS = 16
#: Rows of totals that are sent to every task, at most (about 100 bytes each).
SENT = 200_000
#: Points compared with the skyband at once.
_BLOCK = 1024
#: Bytes of a text cut into terms at once; (group, term) counts that a task holds before it hands them on.
_STRETCH, _HELD = 1 << 20, 500_000


def _term_bytes() -> bytes:
    """Every byte to itself, A-Z to a-z, and ASCII that is no letter to a space."""
    lower = {c: c + 32 for c in range(0x41, 0x5B)}
    return bytes(lower.get(c, c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20) for c in range(256))


_TERM_BYTES = _term_bytes()


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, so many bytes at a time, cut at spaces."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + _STRETCH)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the terms met since the last time that memory was full."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows():
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            times = [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            names = [pa.array([name] * len(n), pa.string()) for name in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, *times], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        texts = batch["text"].cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts, strict=True):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            before, own = len(n), set()
            for terms in _stretches(text):
                n.update(terms)
                own.update(terms)
            docs.update(own)
            size += len(n) - before
            if size >= _HELD:
                yield from rows()
                counts, size = {}, 0
    yield from rows()


def kept_terms(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, lang_n, groups): the kept terms with their occurrences, ``groups`` by source."""
    slim = documents.select(_named("lang"), _named("source"), _named("text"))
    # Summed up in each task before the shuffle, so a word that is everywhere is a few rows per task and source;
    # one exchange then serves both groupings.
    counted = slim.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    dealt = counted.repartition("lang", "term")
    by_source = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return (
        by_source.groupBy("lang", "term")
        .agg(
            F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("groups")
        )
        .where(F.col("docs") >= min_documents)
        .drop("docs")
    )


def _named(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (total + kept)) in longs, exact below 2.8 * 10^14 occurrences; beyond, an error."""
    a, size = (count + F.lit(1)).cast("long"), (total + kept).cast("long")
    # 10^9 = 31,250 * 32,000: the remainder of the first step carries on into the second.
    whole, rest = _div(a * F.lit(31_250), size), (a * F.lit(31_250)) % size
    return F.lit(1) + whole * F.lit(32_000) + _div(rest * F.lit(32_000), size)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most 10^9 + 1, so the square is a long."""
    return _div((p - q) * (p - q), q)


def beside(totals: DataFrame) -> DataFrame:
    """A table to be joined with all counts: sent to every task while it has at most ``SENT`` rows, else sorted and merged.

    Counts are small on disk and large in memory, so Spark's own guess would send those.
    """
    return F.broadcast(totals) if totals.count() <= SENT else totals.hint("merge")


class Audit:
    """Kept terms, stored once, and the totals of groups and languages that go with them."""

    def __init__(self, documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> None:
        self.kept = stored(kept_terms(documents, min_documents), "kept-terms")
        self.each = self.kept.select("lang", "term", "lang_n", F.inline("groups"))
        langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
        held = self.each.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
        zero = F.lit(0).cast("long")
        #: One row per group that occurs, with terms or without: (lang, source, total, held, kept, lang_total).
        self.groups = stored(
            documents.select(_named("lang"), _named("source"))
            .distinct()
            .join(held, ["lang", "source"], "left")
            .join(langs, "lang", "left")
            .na.fill(0, ["total", "held", "kept", "lang_total"])
            .withColumn("none", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))),
            "term-totals",
        )

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): each source with each other one of its language."""
        columns = ["total", "held", "kept", "none"]
        a = self.groups.select("lang", "source", *[F.col(c).alias(f"a_{c}") for c in columns])
        b = self.groups.select("lang", F.col("source").alias("item"), *[F.col(c).alias(f"b_{c}") for c in columns])
        # The result has a row for each of these pairs; nothing but totals of groups meets here.
        both = beside(stored(a.join(b, "lang").where(F.col("source") != F.col("item")), "pairs-of-sources"))
        counts = stored(self.each.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")), "term-histogram")
        p, q = share(F.col("n"), F.col("a_total"), F.col("a_kept")), share(F.col("n"), F.col("b_total"), F.col("b_kept"))
        mine = counts.join(both, ["lang", "source"]).select(
            "lang", "source", "item", (F.col("terms") * distance(p, F.col("b_none"))).alias("value")
        )
        others = counts.withColumnRenamed("source", "item").join(both, ["lang", "item"]).select(
            "lang", "source", "item", (F.col("terms") * distance(F.col("a_none"), q)).alias("value")
        )
        rest = (F.col("a_kept") - F.col("a_held") - F.col("b_held")) * distance(F.col("a_none"), F.col("b_none"))
        neither = both.select("lang", "source", "item", F.coalesce(rest, F.lit(0)).alias("value"))
        # Terms of both groups have been taken as terms of one of them only.
        a_total, b_total = F.col("a_total"), F.col("b_total")
        shared = (
            self.kept.select("lang", F.col("groups").alias("others"), F.inline("groups"))
            .select("lang", "source", "n", F.inline("others").alias("item", "m"))
            .join(both, ["lang", "source", "item"])
            .withColumn("p", share(F.col("n"), a_total, F.col("a_kept")))
            .withColumn("q", share(F.col("m"), b_total, F.col("b_kept")))
            .select(
                "lang",
                "source",
                "item",
                (
                    distance(F.col("p"), F.col("q"))
                    - distance(F.col("p"), F.col("b_none"))
                    - distance(F.col("a_none"), F.col("q"))
                    + distance(F.col("a_none"), F.col("b_none"))
                ).alias("value"),
            )
        )
        parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (mine, others, shared)]
        summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(neither)
        return summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value): terms among which are the first ``top`` of every group."""
        q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        over = (
            self.each.join(beside(self.groups), ["lang", "source"])
            .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
            .withColumn("q", q)
            .where(F.col("p") > F.col("q"))
            .select("lang", "source", "term", "n", "lang_n", "p", "q")
        )
        first = skyband(over, top)
        salted = first.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS)))
        return skyband(salted, top).select(
            "lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")
        )


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Of each partition's rows (lang, source, term, n, lang_n, ...), those that fewer than ``k`` of their group dominate.

    Sorted, all that can dominate a row come before it; rows arrive group by group.
    """
    order = ["lang", "source", F.desc("n"), "lang_n", "term"]

    def retained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = batch["lang"].to_pylist(), batch["source"].to_pylist()
            edges = [i for i in range(1, len(langs)) if (langs[i], sources[i]) != (langs[i - 1], sources[i - 1])]
            stay = np.zeros(batch.num_rows, bool)
            n, lang_n, terms = np.asarray(batch["n"]), np.asarray(batch["lang_n"]), batch["term"].to_pylist()
            for begin, end in zip([0, *edges], [*edges, len(langs)], strict=True):
                if (langs[begin], sources[begin]) != group:
                    group, band = (langs[begin], sources[begin]), Band(k)
                for at in range(begin, end, _BLOCK):
                    block = slice(at, min(end, at + _BLOCK))
                    stay[block] = band.add(n[block], lang_n[block], terms[block])
            yield batch.filter(pa.array(stay))

    return rows.sortWithinPartitions(*order).mapInArrow(retained, rows.schema)


class Band:
    """The k-skyband of one group's rows, taken in the order of (n descending, lang_n, term)."""

    def __init__(self, k: int) -> None:
        self.k, self.low, self.terms = k, np.zeros(0, np.int64), []
        self.last, self.equal = None, 0

    def add(self, n: np.ndarray, low: np.ndarray, terms: list[str]) -> np.ndarray:
        """Which of the next rows have fewer than ``k`` dominators."""
        size = len(n)
        # A row is dominated by all earlier ones with its own counts.
        new = np.ones(size, bool)
        new[1:] = (n[1:] != n[:-1]) | (low[1:] != low[:-1])
        new[0] = self.last != (n[0], low[0])
        begin = np.maximum.accumulate(np.where(new, np.arange(size), -1))
        place = np.where(begin < 0, self.equal + np.arange(size), np.arange(size) - begin)
        self.last, self.equal = (n[-1], low[-1]), int(place[-1]) + 1
        stay = np.zeros(size, bool)
        chosen = np.flatnonzero(place < self.k)
        if not len(chosen):
            return stay
        own = [terms[i] for i in chosen]
        # Code points stand in the order of their UTF-8. Places in order are compared, in short numbers.
        rank = np.empty(len(self.terms) + len(own), np.int32)
        names = self.terms + own
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        lows = np.unique(np.concatenate([self.low, low[chosen]]), return_inverse=True)[1].astype(np.int32)
        held = len(self.terms)
        own_rank, own_low = rank[held:], lows[held:]
        over = np.count_nonzero((lows[:held] <= own_low[:, None]) & (rank[:held] < own_rank[:, None]), axis=1)
        left = np.flatnonzero(over < self.k)
        earlier = (own_low[left] <= own_low[left][:, None]) & (own_rank[left] < own_rank[left][:, None])
        # Rows of the block that fell out have k dominators in the band, which count for whatever those dominate.
        left = left[over[left] + np.count_nonzero(np.tril(earlier, -1), axis=1) < self.k]
        stay[chosen[left]] = True
        self.low = np.concatenate([self.low, low[chosen[left]]])
        self.terms += [own[i] for i in left]
        return stay


def ranked(values: DataFrame, part: str, top: int | None = None) -> DataFrame:
    """Rank within group and part, value descending, item ascending."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = values.withColumn("rank", F.row_number().over(order))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def audit(documents: DataFrame, top: int = TOP, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank) of all pairs of sources of a language and of each group's first terms."""
    found = Audit(documents, min_documents)
    return ranked(found.pairs(), "pair").unionByName(ranked(found.terms(top), "term", top))
