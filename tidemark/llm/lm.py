"""Language-model scores: a gated recurrent network with a class-factored softmax.

Words are counted over all documents to learn from. The most frequent ones are the
network's vocabulary, in classes; all others fall into tail classes by their form, in
which a word has its share of the counts. So every text has a probability, and the
network has only a few outputs to compute: classes, and the words of one class.

The network starts from a bounded sample and then passes over all documents to learn
from, each task over its own part with truncated backpropagation; Spark averages what
tasks have learnt, weighted by tokens. Texts are scored in windows, with the state
carried from one to the next, to the end of the document.

Counts of rare words are joined, so nothing that grows with the corpus is sent to all
tasks. Words are compared by 64-bit hashes. A null or empty text is the end token alone.
Documents with a null id are scored and not learnt from; repeated rows count as often as
they stand there; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.shared import fold, stored, utf8

#: Words of the vocabulary and of a class, tail classes, hidden units, tokens of a window, documents side by side.
WORDS, PER_CLASS, TAILS, HIDDEN, WINDOW, LANES = 1024, 64, 8, 16, 48, 512
CLASSES = WORDS // PER_CLASS
#: Words whose counts every task has; documents of the starting sample, and the bytes that one of them may have.
KNOWN, START_ROWS, START_BYTES = 1 << 18, 768, 100_000
#: Bytes of texts whose words are hashed at once: few enough for a core's cache.
STRETCH = 1 << 18
#: Added to every count, in the base as in the tails.
ADD = 0.1
_END = np.uint64(0xE0D)
_SLOTS = 21


def tails_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The tail class of each word: how it ends, and whether it has other than ASCII letters."""
    last = raw[ends - 1]
    form = np.where(last == 44, 1, np.where(last == 46, 2, 3))
    letter = (last >= 128) | ((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))
    wide = np.zeros(len(starts), np.int64)
    wide[np.searchsorted(starts, np.flatnonzero(raw >= 128), side="right") - 1] = 4
    return np.where(letter, 0, form) + wide


def token_stretches(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, token hashes, tail classes, offsets): words of lower-cased texts, each with an end."""
    for begin, end in wordhash.stretches(texts, STRETCH):
        lowered = [t.translate(wordhash.LOWER) for t in texts[begin:end]]
        words, offsets, (raw, starts, ends, _) = wordhash.hashed(lowered)
        tails = tails_of(raw, starts, ends) if len(words) else np.zeros(0, np.int64)
        at = offsets[1:]
        yield begin, np.insert(words, at, _END), np.insert(tails, at, 0), offsets + np.arange(len(offsets))


class Known:
    """Counts of the most frequent words, by hash: two tables with a slot for each value of some of its bits.

    A word that finds no slot of its own is treated as one that is not among them, which changes no result.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.keys = np.zeros((2, 1 << _SLOTS), np.uint64)
        self.rank = np.full((2, 1 << _SLOTS), -1, np.int32)
        self.counts = counts
        left = np.arange(len(hashes))
        for turn in range(2):
            slots = self._slot(hashes[left], turn)
            # The first, most frequent word of a slot stays.
            taken, first = np.unique(slots, return_index=True)
            self.keys[turn, taken] = hashes[left[first]]
            self.rank[turn, taken] = left[first]
            left = np.delete(left, first)

    @staticmethod
    def _slot(hashes: np.ndarray, turn: int) -> np.ndarray:
        return ((hashes >> np.uint64(64 - _SLOTS)) if turn == 0 else (hashes & np.uint64((1 << _SLOTS) - 1))).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks of the words by count, -1 for those not here."""
        slots = self._slot(hashes, 0)
        found = np.where(self.keys[0, slots] == hashes, self.rank[0, slots], -1)
        other = np.flatnonzero(found < 0)
        slots = self._slot(hashes[other], 1)
        found[other] = np.where(self.keys[1, slots] == hashes[other], self.rank[1, slots], -1)
        return found


# --- the network -----------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """Parameters and gradients; inputs are word ids, then tail classes; id 0 is the start as input, the end as output."""

    def __init__(self, mass: np.ndarray, tail_mass: np.ndarray, seed: int = 3) -> None:
        random = np.random.default_rng(seed)
        h = HIDDEN
        words = np.log(mass.reshape(CLASSES, PER_CLASS) + 1e-9)
        classes = np.log(np.concatenate([mass.reshape(CLASSES, PER_CLASS).sum(axis=1), tail_mass]) + 1e-9)
        top = words.max(axis=1, keepdims=True)
        self.p = {
            "x": random.normal(0, 0.1, (WORDS + TAILS, 3 * h)),
            "u": random.normal(0, 0.2, (h, 3 * h)),
            "b": np.concatenate([np.ones(h), np.zeros(2 * h)]),
            "c": random.normal(0, 0.05, (h, CLASSES + TAILS)),
            "cb": np.maximum(classes - classes.max(), -20),
            "w": random.normal(0, 0.05, (CLASSES, h, PER_CLASS)),
            "wb": np.maximum(words - top, -20),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.reshape(-1) for v in self.p.values()])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = values[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def _gates(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of inputs and of states, one block a gate, so that each gate's values lie together. Those of the two sigmoids
        are halved, which is exact: sigmoid(a) = tanh(a / 2) / 2 + 1 / 2."""
        h = HIDDEN
        half = np.array([0.5, 0.5, 1], self.p["x"].dtype)[:, None, None]
        x = (self.p["x"] + self.p["b"]).reshape(-1, 3, h).transpose(1, 0, 2) * half
        return np.ascontiguousarray(x), np.ascontiguousarray(self.p["u"].reshape(h, 3, h).transpose(1, 0, 2) * half)

    def states(self, inputs: np.ndarray, active: np.ndarray, state: np.ndarray, fresh: np.ndarray, keep: bool):
        """Hidden states of a window [step, lane]; lanes are sorted, so those that still run come first.

        ``state`` is carried on in place, and begins anew where a step is the first of a text (``fresh``). With
        ``keep``, what backpropagation needs is returned too: states before, gates, new values and what those had of the state.
        """
        x, u = self._gates()
        steps, width, h = len(active), len(state), HIDDEN
        out = np.zeros((steps, width, h), x.dtype)
        # Lanes that do not run have zeros before them, which add nothing to a gradient.
        kept = [out.copy(), *(np.empty((steps, n, width, h), x.dtype) for n in (2, 1, 1))] if keep else None
        turned, zr_all, new_all = (np.empty((n, width, h), x.dtype) for n in (3, 2, 1))
        for t, n in enumerate(active):
            before, at = state[:n], inputs[t, :n]
            before[fresh[t, :n]] = 0
            if keep:
                kept[0][t, :n] = before
                zr_all, new_all = kept[1][t], kept[2][t]
            own, zr, new = turned[:, :n], zr_all[:, :n], new_all[0, :n]
            np.matmul(before, u, out=own)
            if keep:
                kept[3][t, 0, :n] = own[2]
            for k in range(2):
                np.take(x[k], at, axis=0, out=zr[k], mode="clip")
            np.take(x[2], at, axis=0, out=new, mode="clip")
            zr += own[:2]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            own[2] *= zr[1]
            new += own[2]
            np.tanh(new, out=new)
            # new + z * (before - new)
            before -= new
            before *= zr[0]
            before += new
            out[t, :n] = before
        return out, kept

    def _softmax(self, hidden: np.ndarray, weights: np.ndarray, bias: np.ndarray, at: np.ndarray, gradient: bool):
        """Natural log probabilities of the outputs ``at``, and the gradient of the logits."""
        # A state is below 1 in size, so a logit is below this; in between the exponentials neither overflow nor vanish.
        bound = float(np.abs(weights).sum(axis=0).max() + np.abs(bias).max()) if np.abs(hidden).max(initial=0) <= 1 else np.inf
        logits = hidden @ weights
        logits += bias
        if bound > 60:
            logits -= logits.max(axis=1, keepdims=True)
        rows = np.arange(len(at))
        chosen = logits[rows, at]
        e = np.exp(logits, out=logits)
        total = e @ np.ones(e.shape[1], e.dtype)
        if gradient:
            e /= total[:, None]
            e[rows, at] -= 1
        return chosen - np.log(total), e

    def losses(self, hidden: np.ndarray, targets: np.ndarray, gradients: dict | None):
        """Natural log probabilities of targets (word ids, or WORDS plus tail class); gradients are added up."""
        p = self.p
        # By class once, so that each class's rows lie together.
        group = np.where(targets < WORDS, targets // PER_CLASS, CLASSES + targets - WORDS).astype(np.int16)
        order = np.argsort(group, kind="stable")
        hidden, targets, group = hidden[order], targets[order], group[order]
        learns = gradients is not None
        found, e = self._softmax(hidden, p["c"], p["cb"], group, learns)
        found = found.astype(np.float64)
        if learns:
            gradients["c"] += hidden.T @ e
            gradients["cb"] += np.ones(len(e), e.dtype) @ e
            back = e @ p["c"].T
        cuts = np.searchsorted(group, np.arange(CLASSES + 1))
        for k in range(CLASSES):
            own = slice(cuts[k], cuts[k + 1])
            if cuts[k] < cuts[k + 1]:
                more, e = self._softmax(hidden[own], p["w"][k], p["wb"][k], targets[own] - k * PER_CLASS, learns)
                found[own] += more
                if learns:
                    gradients["w"][k] += hidden[own].T @ e
                    gradients["wb"][k] += np.ones(len(e), e.dtype) @ e
                    back[own] += e @ p["w"][k].T
        out = np.empty_like(found)
        out[order] = found
        if not learns:
            return out, None
        spread = np.empty_like(back)
        spread[order] = back
        return out, spread

    def backward(self, inputs: np.ndarray, active: np.ndarray, fresh: np.ndarray, kept: list, back: np.ndarray, gradients: dict) -> None:
        """Gradients of a window's steps, last first; what lies before the window is taken as given."""
        h, p = HIDDEN, self.p
        befores, zrs, news, turneds = kept
        steps, width = len(active), back.shape[1]
        u = np.ascontiguousarray(p["u"].reshape(h, 3, h).transpose(1, 2, 0))
        carried = np.zeros((width, h), back.dtype)
        # All steps' gates, lane by lane; lanes that do not run have no gradient.
        gates = np.zeros((3, steps, width, h), back.dtype)
        turned_new = np.zeros((steps, width, h), back.dtype)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            before, z, r, new, turned = befores[t, :n], zrs[t, 0, :n], zrs[t, 1, :n], news[t, 0, :n], turneds[t, 0, :n]
            g_z, g_r, g_new, g_turned = gates[0, t, :n], gates[1, t, :n], gates[2, t, :n], turned_new[t, :n]
            d = carried[:n]
            d += back[t, :n]
            rest = d * z
            # d * (1 - z) * (1 - new * new)
            np.subtract(d, rest, out=g_new)
            np.subtract(before, new, out=g_z)
            new *= new
            np.subtract(1, new, out=new)
            g_new *= new
            # d * (before - new) * z * (1 - z)
            g_z *= rest
            g_z -= g_z * z
            np.multiply(g_new, r, out=g_turned)
            # d_new * turned * r * (1 - r)
            np.multiply(g_turned, turned, out=g_r)
            g_r -= g_r * r
            rest += g_z @ u[0]
            rest += g_r @ u[1]
            rest += g_turned @ u[2]
            rest[fresh[t, :n]] = 0
            carried[:n] = rest
        flat = befores.reshape(-1, h).T
        at = inputs.reshape(-1).astype(np.int16)
        order = np.argsort(at, kind="stable")
        names, first = np.unique(at[order], return_index=True)
        ones = np.ones(len(at), back.dtype)
        for k, gate in enumerate(gates.reshape(3, -1, h)):
            own = slice(k * h, (k + 1) * h)
            gradients["u"][:, own] += flat @ (gate if k < 2 else turned_new.reshape(-1, h))
            gradients["b"][own] += ones @ gate
            gradients["x"][names, own] += np.add.reduceat(gate[order], first, axis=0)


class Adam:
    def __init__(self, network: Network, rate: float) -> None:
        self.network, self.rate, self.step = network, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in network.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in network.p.items()}

    def apply(self, gradients: dict, scale: float) -> None:
        self.step += 1
        correct = np.sqrt(1 - 0.99**self.step) / (1 - 0.9**self.step)
        for k, g in gradients.items():
            g *= scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.network.p[k] -= (self.rate * correct) * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


class Lanes:
    """Texts laid end to end in at most LANES lanes of about equal length, so that many run side by side to the end."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray) -> None:
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        heap = [(0, k) for k in range(min(LANES, len(order)))]
        own: list[list[int]] = [[] for _ in heap]
        for text in order.tolist():
            length, k = heap[0]
            own[k].append(text)
            heapq.heapreplace(heap, (length + int(size[text]), k))
        length = np.array([size[x].sum() for x in own], np.int64)
        longest = np.argsort(-length, kind="stable")
        self.length = length[longest]
        self.begins = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        texts = np.array([t for k in longest for t in own[k]], np.int64)
        sizes = size[texts]
        first = np.cumsum(sizes) - sizes
        #: For each token in its new place: its text, its id, and whether it is the first of its text.
        self.of = np.repeat(texts, sizes)
        self.tokens = tokens[np.arange(len(self.of)) + np.repeat(offsets[:-1][texts] - first, sizes)]
        self.fresh = np.zeros(len(self.of), bool)
        self.fresh[first] = True

    def windows(self):
        """Windows: inputs, targets, first tokens and texts [step, lane], and the lanes active at each step."""
        for start in range(0, int(self.length[0]) if len(self.length) else 0, WINDOW):
            steps = np.arange(start, min(start + WINDOW, int(self.length[0])))
            active = np.searchsorted(-self.length, -steps, side="left")
            width = active[0]
            at = np.minimum(self.begins[None, :width] + steps[:, None], self.begins[:width] + self.length[:width] - 1)
            fresh = self.fresh[at]
            yield np.where(fresh, 0, self.tokens[np.maximum(at - 1, 0)]), self.tokens[at], fresh, self.of[at], active


def learn(network: Network, tokens: np.ndarray, offsets: np.ndarray, adam: Adam) -> None:
    """One pass over the texts, window by window, the state carried on and gradients cut at a window's start."""
    state = np.zeros((LANES, HIDDEN), np.float32)
    for inputs, targets, fresh, _, active in Lanes(tokens, offsets).windows():
        hidden, kept = network.states(inputs, active, state[: active[0]], fresh, True)
        gradients = {k: np.zeros_like(v) for k, v in network.p.items()}
        if active[-1] == active[0]:
            _, back = network.losses(hidden.reshape(-1, HIDDEN), targets.reshape(-1), gradients)
            spread = back.reshape(hidden.shape)
        else:
            mask = np.arange(active[0])[None, :] < active[:, None]
            _, back = network.losses(hidden[mask], targets[mask], gradients)
            spread = np.zeros_like(hidden)
            spread[mask] = back
        network.backward(inputs, active, fresh, kept, spread, gradients)
        # Few lanes give a noisy gradient: it counts for as much less.
        adam.apply(gradients, 1.0 / max(int(active.sum()), LANES * WINDOW // 8))


def log_probabilities(network: Network, tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The natural log probability of each text."""
    out = np.zeros(len(offsets) - 1)
    state = np.zeros((LANES, HIDDEN), np.float32)
    for inputs, targets, fresh, of, active in Lanes(tokens, offsets).windows():
        hidden, _ = network.states(inputs, active, state[: active[0]], fresh, False)
        if active[-1] == active[0]:
            hidden, targets, of = hidden.reshape(-1, HIDDEN), targets.reshape(-1), of.reshape(-1)
        else:
            mask = np.arange(active[0])[None, :] < active[:, None]
            hidden, targets, of = hidden[mask], targets[mask], of[mask]
        found, _ = network.losses(hidden, targets, None)
        out += np.bincount(of, found, len(out))
    return out


# --- over Spark ------------------------------------------------------------------


def _encoded(texts: list[bytes], known: Known):
    """(hashes of unknown words, ranks, tokens, tails, offsets) of all texts; tokens are ids of the network."""
    parts, tokens = [], 0
    offsets = [np.zeros(1, np.int64)]
    for _, hashes, tails, own in token_stretches(texts):
        rank = known.find(hashes)
        ids = np.where((rank >= 0) & (rank < WORDS), rank, WORDS + tails).astype(np.int16)
        parts.append((hashes[rank < 0], rank, ids, tails.astype(np.int8)))
        offsets.append(tokens + own[1:])
        tokens += len(hashes)
    if not parts:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, offsets[0]
    return *[np.concatenate(x) for x in zip(*parts, strict=True)], np.concatenate(offsets)


def count_words(learning: DataFrame) -> DataFrame:
    """(h, tail, n): hash, tail class and count of every token, summed in tasks before the shuffle."""

    def counted(batches):
        for batch in batches:
            parts = [(h, t) for _, h, t, _ in token_stretches(utf8(batch["text"].to_pylist()))]
            if parts:
                hashes, tails = (np.concatenate(x) for x in zip(*parts, strict=True))
                # By tail class, so that hashes are sorted alone.
                for tail in np.unique(tails):
                    names, n = np.unique(hashes[tails == tail], return_counts=True)
                    of = np.full(len(names), tail, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(of), pa.array(n)], ["h", "tail", "n"])

    rows = learning.select("text").mapInArrow(counted, "h long, tail int, n long")
    return rows.groupBy("h").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


class Model:
    """What tasks need: the network, the frequent words' counts, the tails' totals, N and V."""

    def __init__(self, network: Network, known: Known, tail_total: np.ndarray, total: int, distinct: int) -> None:
        self.network, self.known, self.tail_total, self.total, self.distinct = network, known, tail_total, total, distinct


def start(counts: DataFrame) -> Model:
    """An untrained model from the counts: its size does not depend on theirs."""
    per_tail = {r["tail"]: (r["n"], r["words"]) for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect()}
    is_end = F.col("h") == int(_END.view(np.int64))
    # The end token comes first whatever its count, then words by count.
    top = counts.orderBy(is_end.desc(), F.col("n").desc(), "h").limit(KNOWN).toArrow()
    hashes = np.asarray(top["h"].combine_chunks()).view(np.uint64)
    n = np.asarray(top["n"].combine_chunks()).astype(np.float64)
    tails = np.asarray(top["tail"].combine_chunks())
    if not len(hashes):
        hashes, n, tails = np.array([_END]), np.zeros(1), np.zeros(1, np.int32)
    mass = np.zeros(WORDS)
    mass[: min(WORDS, len(n))] = n[:WORDS]
    words = np.array([per_tail.get(z, (0, 0)) for z in range(TAILS)], float)
    inside = np.column_stack([np.bincount(tails[:WORDS], n[:WORDS], TAILS), np.bincount(tails[:WORDS], minlength=TAILS)])
    rest = np.maximum(words - inside, 0)
    tail_total = rest[:, 0] + ADD * rest[:, 1] + ADD
    total, distinct = int(words[:, 0].sum()), int(words[:, 1].sum())
    return Model(Network(mass, tail_total), Known(hashes, n), tail_total, total, distinct)


def train(learning: DataFrame, model: Model, rate: float = 0.01) -> Network:
    """The network after a start on a sample and one pass over all documents."""
    spark = learning.sparkSession
    small = learning.where(F.coalesce(F.length("text"), F.lit(0)) <= START_BYTES)
    few = small.orderBy(F.xxhash64("id"), "id").limit(START_ROWS).toArrow()
    few = few.sort_by([("id", "ascending")])
    _, _, tokens, _, offsets = _encoded(utf8(few["text"].to_pylist()), model.known)
    network = model.network
    adam = Adam(network, rate)
    for _ in range(3):
        learn(network, tokens, offsets, adam)
    sent = spark.sparkContext.broadcast((model.known, network))

    def learnt(batches):
        known, begun = sent.value
        own = Network(np.zeros(WORDS), np.zeros(TAILS)).load(begun.flat())
        adam, seen = Adam(own, rate / 4), 0
        for batch in batches:
            _, _, tokens, _, offsets = _encoded(utf8(batch["text"].to_pylist()), known)
            learn(own, tokens, offsets, adam)
            seen += len(tokens)
        if seen:
            weighted = own.flat().astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([weighted], pa.list_(pa.float64()))], ["seen", "p"])

    each = learning.select("text").mapInArrow(learnt, "seen double, p array<double>")
    means = (
        each.select("seen", F.posexplode("p").alias("i", "p"))
        .groupBy("i")
        .agg((F.sum("p") / F.sum("seen")).alias("p"))
        .toArrow()
        .sort_by([("i", "ascending")])
    )
    # As many rows as the network has parameters.
    return network.load(np.asarray(means["p"].combine_chunks())) if means.num_rows else network


def score_texts(documents: DataFrame, key: str = "doc_id", folds: int = 10) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``."""
    spark = documents.sparkSession
    slim = documents.select(F.col(key).alias("id"), "text")
    learning = slim.where(fold(F.col("id"), folds) != 0)
    counts = stored(count_words(learning), "word-counts")
    model = start(counts)
    model.network = train(learning, model)
    sent = spark.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()

    def scored(batches):
        m = sent.value
        row = TaskContext.get().partitionId() << 40
        log_tail = np.log(m.tail_total)
        log_count = np.log(np.append(m.known.counts, 0.0) + ADD)
        for batch in batches:
            ids, texts = batch["id"], utf8(batch["text"].to_pylist())
            hashes, rank, tokens, tails, offsets = _encoded(texts, m.known)
            n = len(texts)
            found = log_probabilities(m.network, tokens, offsets)
            rare = rank < 0
            logs = np.where(rare, 0.0, log_count[rank])
            share = np.where(tokens >= WORDS, logs - log_tail[tails], 0.0)
            of = np.repeat(np.arange(n), np.diff(offsets))
            known = np.bincount(of[~rare & (m.known.counts[np.maximum(rank, 0)] > 0)], minlength=n)
            cuts = np.concatenate([[0], np.cumsum(np.bincount(of[rare], minlength=n))])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)),
                    ids,
                    pa.array(np.diff(offsets)),
                    pa.array(known),
                    pa.array(np.bincount(of, logs, n) / np.log(10)),
                    pa.array((found + np.bincount(of, share, n)) / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(hashes.view(np.int64))),
                ],
                ["row", "id", "n_tokens", "known", "base", "model", "rare"],
            )
            row += batch.num_rows

    schema = f"row long, id {kind}, n_tokens long, known long, base double, model double, rare array<long>"
    first = stored(slim.mapInArrow(scored, schema), "scored", "lz4")
    # Frequent words are not among the rare ones, so no hash has many rows here.
    each = first.select("row", F.explode("rare").alias("h")).join(counts.select("h", "n"), "h", "left")
    rest = each.groupBy("row").agg(
        F.count("n").alias("more"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))).alias("logs")
    )
    base_log = float(np.log10(model.total + ADD * (model.distinct + 1)))
    more = F.coalesce("logs", F.lit(0.0))
    return first.join(rest, "row", "left").select(
        "id",
        F.coalesce(fold(F.col("id"), folds) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(base_log)).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.withColumnRenamed("id", "doc_id")
