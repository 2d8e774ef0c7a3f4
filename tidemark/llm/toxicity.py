"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learnt from labelled rows by log odds.
Features of a text: densities of lexicon words, how often one stands near a second
person, capitals, punctuation, and rates of obfuscated words. For fitting, each half of
the sample is described with the lexicon of the other half.

Lexicon, trees and calibration come from a bounded sample of labelled rows; every text
is scored whole. A null or empty text has all features 0 and a score like any other.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.samples import labelled_sample
from tidemark.llm.shared import fold, unused

#: Labelled rows for fitting, entries of the lexicon, and words a task remembers: at most.
SAMPLE, LEXICON, MEMORY = 6000, 3000, 300_000
THRESHOLD = 0.5
#: Words to either side in which a second person counts as near.
NEAR = 5
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti usted ustedes vosotros tus su".split()
)
_LEET = str.maketrans("013457@$!|", "oieastasil")
_MARKS = re.compile(r"[\W_]+")
_HIDDEN = re.compile(r"[^\W\d_][\d@$!|*._\-]+[^\W\d_]")
_THRICE = re.compile(r"(.)\1{2,}")
_STEMS = (4, 5, 6)
FEATURES = 14


def entries(word: str) -> list[str]:
    """What of a plain word the lexicon may hold: itself and its beginnings."""
    return [word, *[word[:n] + "*" for n in _STEMS if len(word) > n]]


def plain(token: str) -> str:
    return _MARKS.sub("", token)


class Lexicon(dict):
    """Token to (weight, obfuscated): remembers what it has looked up."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def weight(self, word: str) -> float:
        get = self.weights.get
        return max([0.0, *[get(e, 0.0) for e in entries(word)]]) if word else 0.0

    def __missing__(self, token: str) -> float:
        if len(self) > MEMORY:
            self.clear()
        found = self.weight(token.strip(".,;:!?\"'()[]%&*#$"))
        self[token] = found
        return found


def describe(text: str, lexicon: Lexicon) -> np.ndarray:
    """The features of one text."""
    x = np.zeros(FEATURES)
    if not text:
        return x
    lowered = text.lower()
    tokens = lowered.split()
    n = len(tokens) or 1
    weights = np.fromiter(map(lexicon.__getitem__, tokens), float, len(tokens))
    hits = np.flatnonzero(weights > 0)
    if len(hits):
        w = np.sort(weights[hits])[::-1]
        strong = int((w >= 3).sum())
        x[0], x[1] = 100 * strong / n, np.log1p(strong)
        x[2], x[3] = 100 * len(hits) / n, np.log1p(len(hits))
        x[4], x[5] = w[0], w[:4].sum()
        near = sum(any(plain(t) in SECOND_PERSON for t in tokens[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
        x[6] = near / len(hits)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    letters = size - len(raw.translate(None, _LETTERS)) or 1
    x[7] = (size - len(raw.translate(None, _CAPITALS))) / letters
    x[8] = (size - len(raw.translate(None, _PUNCTUATION))) / size
    x[9] = (raw.count(b"!") + raw.count(b"?")) / n
    hidden = _HIDDEN.findall(lowered)
    x[10] = len(hidden) / n
    if hidden:
        odd = [t for t in tokens if _HIDDEN.search(t)]
        x[11] = np.log1p(sum(lexicon.weight(plain(t.translate(_LEET))) > 0 or lexicon.weight(plain(t)) > 0 for t in odd))
    stretched = _THRICE.findall(lowered) if len(hits) else ()
    x[12] = len(stretched) / n
    x[13] = np.log1p(n)
    return x


_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def learn_lexicon(sample: DataFrame, part: str, size: int = LEXICON) -> list[dict[str, float]]:
    """Lexicons of rows with part 1, with part 0, and of all rows: entries with their smoothed log odds.

    An entry needs three toxic rows and counts by a cautious estimate of its odds. Counts are summed by tasks and by
    Spark; the driver gets at most ``size`` entries for each lexicon.
    """

    def counted(batches):
        held: Counter = Counter()
        for batch in batches:
            rows = zip(batch["text"].to_pylist(), batch["label"].to_pylist(), batch[part].to_pylist(), strict=True)
            for text, label, half in rows:
                words = {plain(t) for t in (text or "").lower().split()}
                held.update((e, label, half) for e in {e for w in words if w for e in entries(w)})
                if len(held) > 500_000:
                    yield _counts(held)
                    held = Counter()
        yield _counts(held)

    counts = (
        sample.mapInArrow(counted, "entry string, label int, half int, n long")
        .groupBy("entry")
        .agg(*[F.sum(F.when((F.col("label") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)])
        .where(F.col("n10") + F.col("n11") >= 3)
    )
    totals = {(r[0], r[1]): r[2] for r in sample.groupBy("label", part).count().collect()}
    # Of entries as good as toxic alone, the most frequent; bounded for the driver.
    best = counts.orderBy(((F.col("n10") + F.col("n11")) / (F.col("n00") + F.col("n01") + 3)).desc(), "entry").limit(2 * size)
    rows = best.collect()
    out = []
    for halves in ((1,), (0,), (0, 1)):
        toxic, clean = (max(1, sum(totals.get((y, h), 0) for h in halves)) for y in (1, 0))
        found = {}
        for r in rows:
            t, c = (sum(r[f"n{y}{h}"] for h in halves) for y in (1, 0))
            chance = toxic / (toxic + clean) * (t + c)
            if t >= 2 and (t - chance) / np.sqrt(chance + 0.5) >= 2.5:
                odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
                if odds >= 1.5:
                    found[r["entry"]] = float(odds - 1 / np.sqrt(t))
        out.append(dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:size]))
    return out


def _counts(held: Counter) -> pa.RecordBatch:
    keys = list(held)
    columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([held[k] for k in keys], pa.int64())], ["entry", "label", "half", "n"])


# --- trees -----------------------------------------------------------------------


class Boosted:
    """Gradient-boosted trees of depth 3 for the logistic loss, over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.15, least: float = 3.0, l2: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.least, self.l2 = trees, depth, rate, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 49)[1:-1])) for c in x.T] if len(x) else []
        chance = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.nodes = float(np.log(chance / (1 - chance))), []
        binned = self._bins(x)
        f = np.full(len(y), self.base)
        for _ in range(self.trees if len(np.unique(y)) > 1 else 0):
            p = 1 / (1 + np.exp(-f))
            tree, value = self._tree(binned, p - y, p * (1 - p))
            self.nodes.append(tree)
            f += value
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)]) if len(self.edges) else np.zeros(x.shape, int)

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        splits, at = {}, np.ones(len(g), int)
        for level in range(self.depth):
            for node in range(1 << level, 2 << level):
                rows = np.flatnonzero(at == node)
                best = (1e-6, 0, 0)
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, edges in enumerate(self.edges if len(rows) else []):
                    left_g = np.cumsum(np.bincount(b[rows, j], g[rows], len(edges) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b[rows, j], h[rows], len(edges) + 1))[:-1]
                    right_h = hs - left_h
                    gain = left_g**2 / (left_h + self.l2) + (gs - left_g) ** 2 / (right_h + self.l2) - gs**2 / (hs + self.l2)
                    gain[(left_h < self.least / 10) | (right_h < self.least / 10)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), j, int(gain.argmax()))
                if best[0] > 1e-6:
                    splits[node] = best[1:]
                    at[rows] = 2 * node + (b[rows, best[1]] > best[2])
        size = 2 << self.depth
        value = -self.rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + self.l2)
        return (splits, value), value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        b = self._bins(x)
        for splits, value in self.nodes:
            at = np.ones(len(x), int)
            for node in sorted(splits):
                j, cut = splits[node]
                rows = np.flatnonzero(at == node)
                at[rows] = 2 * node + (b[rows, j] > cut)
            f += value[at]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising line through the pooled rates of labels, by pool-adjacent-violators.

    Each pool counts half a label of either kind more, so no score is 0 or 1.
    """
    blocks: list[list[float]] = []
    for m, label in sorted(zip(margin.tolist(), y.tolist(), strict=True)):
        blocks.append([m, 1.0, float(label)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            m2, n2, s2 = blocks.pop()
            m1, n1, s1 = blocks.pop()
            blocks.append([(m1 * n1 + m2 * n2) / (n1 + n2), n1 + n2, s1 + s2])
    at = np.array([b[0] for b in blocks] or [0.0])
    rate = np.array([(b[2] + 0.5) / (b[1] + 1) for b in blocks] or [0.5])
    return at, np.maximum.accumulate(rate)


class Classifier:
    def __init__(self, weights: dict[str, float], trees: Boosted, at: np.ndarray, rate: np.ndarray) -> None:
        self.weights, self.trees, self.at, self.rate = weights, trees, at, rate

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.trees.margin(x)
        # The raw margin orders texts of one pool, without leaving it.
        return 0.98 * np.interp(margin, self.at, self.rate) + 0.02 / (1 + np.exp(-margin))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on labelled rows outside the held-out fold."""
    learn = fold(F.col("doc_id"), 5) != 0
    half = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(2)).cast("int").alias("half")
    rows = labelled_sample(documents, labels, "toxic", learn, sample).select("id", "text", "label", half)
    odd, even, every = learn_lexicon(rows, "half")
    crossed = (odd, even)

    def made(batches):
        own = [Lexicon(w) for w in crossed]
        for batch in batches:
            pairs = zip(batch["text"].to_pylist(), batch["half"].to_pylist(), strict=True)
            # Each half by the lexicon of the other.
            found = [describe(t or "", own[h]).tolist() for t, h in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch["id"].cast(pa.string()), batch["label"], pa.array(found, pa.list_(pa.float64()))], ["id", "label", "x"]
            )

    table = rows.mapInArrow(made, "id string, label int, x array<double>").toArrow().sort_by([("id", "ascending")])
    x = np.array(table["x"].to_pylist(), float).reshape(-1, FEATURES)
    y = np.array(table["label"].to_pylist(), float)
    margin = np.zeros(len(y))
    folds = np.arange(len(y)) % 5
    for k in range(5):
        margin[folds == k] = Boosted().fit(x[folds != k], y[folds != k]).margin(x[folds == k])
    return Classifier(every, Boosted().fit(x, y), *isotonic(margin, y))


def score_toxicity(
    documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> tuple[DataFrame, str, str]:
    """Documents with a score and a prediction as two more columns, whose names are returned too."""
    # Lexicon, trees and calibration are of bounded size.
    sent = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample))
    score, predicted = unused("score", documents.columns), unused("predicted", documents.columns)
    added = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    schema = T.StructType([*documents.schema.fields, *added])

    def scored(batches):
        model, lexicon = sent.value, Lexicon(sent.value.weights)
        for batch in batches:
            x = np.array([describe(t or "", lexicon) for t in batch["text"].to_pylist()]).reshape(-1, FEATURES)
            p = model.score(x)
            columns = [*batch.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(scored, schema), score, predicted


def digest(scored: DataFrame, score: str, predicted: str) -> DataFrame:
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col(score).alias("score"), F.col(predicted).alias("predicted")
    )
