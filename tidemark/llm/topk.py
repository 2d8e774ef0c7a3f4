"""Exact top-k inner products by bounds from multi-resolution segment statistics.

A vector is cut into segments, whose means and deviations bound the product of two
vectors from above (which is a lower bound of their distance): over a segment, the
product of means plus the product of deviations, times the length. Bounds go from
one segment to many; pairs whose bound falls below what a query already has are left
out, and exact products are computed for the rest. Thresholds start from the products
among the queries themselves, which are candidates too.

Queries come in blocks of bounded size, each sent to all tasks for one pass over all
vectors; tasks keep the best of each query, and Spark ranks what tasks have kept.

Vectors that are null, hold a null or a non-finite component, or have no id take no part.
Rows that repeat in full count once. Vectors of different lengths are not compared.
Scores beyond 64 bits stop at the largest or smallest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import stored

K = 5
#: Queries of one pass; with their vectors, what is sent to a task.
BLOCK = 8192
#: Vectors compared at once, and segments of each level.
STRETCH, LEVELS = 1024, (1, 4, 16)
_EXACT, _LONG = 2.0**53, 2**63 - 1


def scaled(values: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * values.astype(np.float64))


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each segment, both times the root of its length, side by side."""
    cuts = np.linspace(0, vectors.shape[1], min(segments, max(1, vectors.shape[1])) + 1).astype(int)
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = vectors[:, a:b]
        mean = part.mean(axis=1) if b > a else np.zeros(len(vectors))
        out += [mean * np.sqrt(b - a), np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1))]
    return np.column_stack(out)


class Search:
    """The best ``k`` of each query of one length, among stretches of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.levels = [statistics(vectors, s) for s in LEVELS]
        self.largest = np.abs(vectors).max(initial=0.0)
        self.floor = np.full(len(ids), -np.inf)
        self.at, self.found, self.scores = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64))

    def exact(self, vectors: np.ndarray) -> bool:
        """Whether every partial sum of products is a whole number that a double holds."""
        return self.largest * np.abs(vectors).max(initial=0.0) * max(1, vectors.shape[1]) < _EXACT

    def start(self) -> None:
        """Thresholds from products among the queries: the k-th best of at most a few thousand others."""
        if len(self.ids) <= self.k or not self.exact(self.vectors):
            return
        for a in range(0, len(self.ids), 512):
            products = self.vectors[a : a + 512] @ self.vectors[:4096].T
            products[self.ids[a : a + 512, None] == self.ids[None, :4096]] = -np.inf
            if products.shape[1] > self.k:
                self.floor[a : a + 512] = np.partition(products, -self.k, axis=1)[:, -self.k]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        for a in range(0, len(ids), STRETCH):
            self._add(ids[a : a + STRETCH], vectors[a : a + STRETCH])

    def _add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if not self.exact(vectors):
            q, x = np.nonzero(self.ids[:, None] != ids[None, :])
            wide = [_whole(self.vectors[i], vectors[j]) for i, j in zip(q, x, strict=True)]
            self._keep(q, ids[x], np.array(wide, np.int64))
            return
        # Rounding of the bounds stays far below a millionth of the largest possible product.
        slack = 1 + 1e-9 * self.largest * np.abs(vectors).max(initial=0.0) * max(1, vectors.shape[1])
        columns = np.arange(len(ids))
        alive = None
        for own, segments in zip(self.levels, LEVELS, strict=True):
            bound = own @ statistics(vectors[columns], segments).T + slack
            now = bound >= self.floor[:, None]
            alive = now if alive is None else alive & now
            some = alive.any(axis=0)
            columns, alive = columns[some], alive[:, some]
            if not len(columns):
                return
        if alive.mean() < 0.03:
            q, x = np.nonzero(alive)
            products = np.einsum("ij,ij->i", self.vectors[q], vectors[columns[x]])
        else:
            every = self.vectors @ vectors[columns].T
            q, x = np.nonzero(alive & (every >= self.floor[:, None]))
            products = every[q, x]
        good = (products >= self.floor[q]) & (self.ids[q] != ids[columns[x]])
        self._keep(q[good], ids[columns[x[good]]], products[good].astype(np.int64))

    def _keep(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.at, self.found, self.scores = (np.concatenate(x) for x in ((self.at, q), (self.found, ids), (self.scores, scores)))
        order = np.lexsort((self.found, -self.scores.astype(object) if len(self.scores) and self.scores.min() == -_LONG - 1 else -self.scores, self.at))
        at = self.at[order]
        first = np.searchsorted(at, at, side="left")
        best = order[np.arange(len(at)) - first < self.k]
        self.at, self.found, self.scores = self.at[best], self.found[best], self.scores[best]
        counts = np.bincount(self.at, minlength=len(self.ids))
        full = np.flatnonzero(counts >= self.k)
        last = np.cumsum(counts)[full] - 1
        self.floor[full] = np.maximum(self.floor[full], self.scores[last])


def _whole(x: np.ndarray, y: np.ndarray) -> int:
    total = sum(int(a) * int(b) for a, b in zip(x, y, strict=True))
    return max(-_LONG - 1, min(_LONG, total))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.col(id_column).isNotNull() & F.col(column).isNotNull() & good)
    return kept.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).distinct()


def _by_length(batch: pa.RecordBatch):
    """Ids and scaled vectors of a batch, for each length."""
    ids, lists = np.asarray(batch["id"]), batch["v"]
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield int(size), ids[rows], scaled(flat[starts[rows, None] + np.arange(size)])


def top_k(
    vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, id_column: str = "vec_id", column: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` (over ``id``) picks, its ``k`` best others."""
    spark = vectors.sparkSession
    every = stored(usable(vectors, id_column, column), "vectors", "lz4")
    queries = every.where(is_query)
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    out = None
    for number in range(blocks):
        # One block of queries at a time: about ``block`` vectors, whatever the size of the table.
        rows = numbered.where(F.col("block") == number).select("id", "v").toArrow()
        sent = spark.sparkContext.broadcast(rows)

        def searched(batches, sent=sent):
            own = {}
            for batch in sent.value.combine_chunks().to_batches():
                for size, ids, found in _by_length(batch):
                    own.setdefault(size, []).append((ids, found))
            searches = {
                size: Search(np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts]), k) for size, parts in own.items()
            }
            for search in searches.values():
                search.start()
            for batch in batches:
                for size, ids, found in _by_length(batch):
                    if size in searches:
                        searches[size].add(ids, found)
            for s in searches.values():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.ids[s.at]), pa.array(s.found), pa.array(s.scores)], ["query_id", "vec_id", "score"]
                )

        part = every.mapInArrow(searched, "query_id long, vec_id long, score long")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
