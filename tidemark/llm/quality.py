"""Quality classifier: logistic regression on hashed word n-grams, fitted with FTRL-proximal.

Features of a text are its words and word pairs, and the shapes of words and shape
pairs (runs of capitals, letters and digits count as one character; a word that
repeats the one before has a shape of its own). Each family's counts are divided by
its total, so a text's length does not matter. A score is a sparse dot product.

The classifier is fitted on a bounded sample of labelled rows; every text is scored
whole. A null or empty text has no features and gets the score of the intercept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import wordhash
from tidemark.llm.samples import labelled_sample
from tidemark.llm.shared import fold, freed, unused, utf8

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 4000
BITS = 18
THRESHOLD = 0.7
#: A text's features sum to this in each family.
SCALE = 8.0
#: Bytes of texts whose features a task holds at once: some 100 bytes each.
_STRETCH = 400_000
_CLASS = np.array([65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 97 if c >= 128 or 97 <= c <= 122 else c for c in range(256)], np.uint8)
_REPEATED = np.uint64(0x1234567)


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    kind = _CLASS[raw]
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    position = np.cumsum(new) - 1
    return wordhash.hash_runs(wordhash._BYTE[kind] * new, position, starts, ends)


def features(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each family: the hashed feature of every occurrence, and where each text's begin."""
    words, offsets, (raw, starts, ends, _) = wordhash.hashed(texts)
    if not len(words):
        none = np.zeros(0, np.int64)
        return [none] * 4, [np.zeros(len(texts) + 1, np.int64)] * 4
    shapes = _shapes(raw, starts, ends)
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inner = of[1:] == of[:-1]
    shapes[1:][inner & (words[1:] == words[:-1])] = _REPEATED
    pair_offsets = np.concatenate([[0], np.cumsum(np.bincount(of[1:][inner], minlength=len(texts)))])
    out, begins = [], []
    for salt, single in ((1, words), (3, shapes)):
        double = wordhash.pairs(single[:-1], single[1:])[inner]
        for k, values, begin in ((salt, single, offsets), (salt + 1, double, pair_offsets)):
            out.append((wordhash.mixed(values + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64))
            begins.append(begin)
    return out, begins


def dots(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    """The weights' product with each text's features."""
    total = np.zeros(len(texts))
    for begin, end in wordhash.stretches(texts, _STRETCH):
        for values, offsets in zip(*features(texts[begin:end]), strict=True):
            sums = np.concatenate([[0.0], np.cumsum(weights[values], dtype=np.float64)])
            total[begin:end] += SCALE * (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)
    return total


def sparse(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One text's features and their values."""
    found, value = [], []
    for values, _ in zip(*features([text]), strict=True):
        names, counts = np.unique(values, return_counts=True)
        found.append(names)
        value.append(SCALE * counts / max(1, len(values)))
    return np.concatenate(found), np.concatenate(value)


def fit_ftrl(
    examples: list[tuple[int, np.ndarray, np.ndarray]],
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-3,
    epochs: int = 4,
    seed: int = 9,
) -> tuple[np.ndarray, float]:
    """Weights and intercept. Without examples all are 0, which scores 0.5."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(seed)
    bias = 1 << BITS

    def weight(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            label, at, value = examples[i]
            at, value = np.append(at, bias), np.append(value, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            # Two families may meet in one hash: both their gradients count.
            np.add.at(z, at, g - sigma * w)
            np.add.at(n, at, g * g)
    w = weight(np.arange(len(z)))
    return w[:-1].astype(np.float32), float(w[-1])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on labelled rows outside the held-out fold; features are made by tasks, the driver gets them sparse."""
    learn = fold(F.col("doc_id"), 4) != 2
    rows = labelled_sample(documents, labels, "quality", learn, sample)

    def made(batches):
        for batch in batches:
            found = [sparse(t) for t in utf8(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].cast(pa.string()),
                    batch["label"],
                    pa.array([x.astype(np.int32) for x, _ in found], pa.list_(pa.int32())),
                    pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32())),
                ],
                ["id", "label", "at", "value"],
            )

    table = rows.mapInArrow(made, "id string, label int, at array<int>, value array<float>").toArrow()
    table = table.sort_by([("id", "ascending")])
    examples = [
        (y, np.asarray(a.values), np.asarray(v.values, np.float64))
        for y, a, v in zip(table["label"].to_pylist(), table["at"], table["value"], strict=True)
    ]
    return fit_ftrl(examples)


def score_quality(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> tuple[DataFrame, str, str]:
    """Documents with a score and a prediction as two more columns, whose names are returned too."""
    weights, bias = train(documents, labels, sample)
    sent = documents.sparkSession.sparkContext.broadcast(weights)
    score, predicted = unused("score", documents.columns), unused("predicted", documents.columns)
    added = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    schema = T.StructType([*documents.schema.fields, *added])

    def scored(batches):
        for batch in batches:
            p = 1 / (1 + np.exp(-np.clip(dots(utf8(batch["text"].to_pylist()), sent.value) + bias, -35, 35)))
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(freed(scored), schema), score, predicted


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    scored, _, predicted = score_quality(documents, labels, sample, threshold)
    return scored.where(F.col(predicted) == 1).select(*documents.columns)


def digest(scored: DataFrame, score: str, predicted: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col(score).alias("score"), F.col(predicted).alias("predicted")
    )
