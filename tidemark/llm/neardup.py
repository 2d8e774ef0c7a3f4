"""Near duplicates by an LSH forest of sorted MinHash signatures.

Texts with equal shingle sets are one class. Classes' signatures are sorted in several
orders of their hashes; the rows next to a row in an order are those with the longest
common prefix, so the depth at which two are compared follows how crowded their region
is. Neighbours whose signatures agree enough are candidates. A first pass takes next
neighbours only, which joins large groups by chains, and compares some rows with all,
which saves later work; a second pass looks further, between groups that are not linked.

The common prefix with the farthest neighbour seen says how likely a similar row lay
beyond it in every order of the second pass. Rows for which that is not unlikely are
crowded, whatever the groups of their neighbours, and all pairs of them are found exactly:
similar sets share one of the rarest shingles of each (prefix and position filter).

Signatures only say what to compare: links are confirmed on the full sets. Candidates
are confirmed in turns, first those of the first pass, those with hubs and the likely best
one between any two groups, then, where groups are still apart, the others. A candidate is left out only if
confirmed links already join its two texts, so no component is lost by it. Links,
classes and components stay in tables, and orders are cut into ranges of equal size,
whatever repeats; the rows at both sides of a cut are compared in a step of their own.

Rows of one doc_id are one document. A null id is linked with nothing, has no component
and is kept. Texts without words (null and empty ones too) have an empty set and are
linked with nothing. An empty table gives no rows. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import wordhash
from tidemark.llm.components import components
from tidemark.llm.shared import stored, unused, utf8

#: MinHash values, orders of the first and the second pass, hashes in an order's key.
HASHES, FIRST, SECOND, DEPTH = 128, 4, 16, 8
#: Rows after a row that it is compared with, and rows that are compared with all others in a pass.
NEAR, HUBS = 8, 256
#: A row is crowded if a partner of just the wanted similarity is missed in all orders with more than this chance.
MISSED = 1e-4
#: Counters of shingles, as a power of two: how often is only estimated, any order of shingles gives the same pairs.
COUNTERS = 20
#: Hashes of the signature by which neighbours are compared, and how far below the wanted similarity they may agree:
#: over four deviations of what so many hashes say.
COMPARED, MARGIN = 96, 0.18
#: Candidates between two groups that are confirmed in one turn; in the last turn, all.
TURNS = (1, 4, None)
_SEED = np.random.default_rng(6)
_A = _SEED.integers(1, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _SEED.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingle_sets(texts: list[bytes], size: int):
    """Sorted distinct hashes of each text's shingles of ``size`` words; fewer words make one shingle."""
    for begin, end in wordhash.stretches(texts):
        lowered = [t.translate(wordhash.LOWER) for t in texts[begin:end]]
        words, offsets, _ = wordhash.hashed(lowered)
        rolled = words
        for k in range(1, size):
            rolled = wordhash.pairs(rolled[: len(words) - k], words[k:])
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            if b - a >= size:
                yield np.unique(rolled[a : b - size + 1])
            elif b > a:
                whole = words[a : a + 1]
                for k in range(a + 1, b):
                    whole = wordhash.pairs(whole, words[k : k + 1])
                yield wordhash.mixed(whole + np.uint64(b - a))
            else:
                yield words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash over the set, cut to 16 bits."""
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 4096):
        np.minimum(least, (folded[i : i + 4096, None] * _A + _B).min(axis=0), out=least)
    # Small values have few bits set: mix before cutting.
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (least >> np.uint32(16)).astype(">u2")


def signatures(documents: DataFrame, shingle: int, key: str) -> DataFrame:
    """(id, n, a, b, sig): set size, 128 bits of the set and the signature of every row."""

    def made(batches):
        for batch in batches:
            n, a, b, sig = [], [], [], []
            for found in shingle_sets(utf8(batch["text"].to_pylist()), shingle):
                n.append(len(found))
                if len(found):
                    digest = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                    a.append(int.from_bytes(digest[:8], "little", signed=True))
                    b.append(int.from_bytes(digest[8:], "little", signed=True))
                    sig.append(signature(found).tobytes())
                else:
                    a.append(None)
                    b.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary())],
                ["id", "n", "a", "b", "sig"],
            )

    slim = documents.select(F.col(key).cast("long").alias("id"), "text")
    return slim.mapInArrow(made, "id long, n long, a long, b long, sig binary")


_ROW = "order int, key binary, node long, group long, n long, sig binary"


def ordered_rows(nodes: DataFrame, orders: range) -> DataFrame:
    """A row for each node (node, group, n, sig) and order, with the order's key."""

    def exploded(batches):
        # As many orders in a row as fit share no hash, so that they miss a pair independently.
        fit = HASHES // DEPTH
        turns = [divmod(o - orders.start, fit) for o in orders]
        columns = [np.random.default_rng((1000, orders.start, t)).permutation(HASHES)[DEPTH * i :][:DEPTH] for t, i in turns]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), ">u2").reshape(-1, HASHES)
            short = pa.array([r.tobytes() for r in (sig[:, :COMPARED] & 0xFF).astype(np.uint8)], pa.binary())
            for order, chosen in zip(orders, columns, strict=True):
                keys = pa.array([r.tobytes() for r in np.ascontiguousarray(sig[:, chosen])], pa.binary())
                number = pa.array(np.full(len(sig), order, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [number, keys, batch["node"], batch["group"], batch["n"], short],
                    ["order", "key", "node", "group", "n", "sig"],
                )

    return nodes.select("node", "group", "n", "sig").mapInArrow(exploded, _ROW)


class _Neighbours:
    """Compares sorted rows, given in stretches, with those at most ``near`` before them."""

    def __init__(self, near: int, share: float, floor: float, given: int | None = None) -> None:
        self.near, self.share, self.floor, self.given, self.tail = near, share, floor, given or near, None

    def pairs(self, now: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, tuple]:
        """Pairs (u, v) of nodes with their groups (gu, gv) and the share of equal hashes, of rows at most ``given``
        apart; nodes with their run and the hashes their key shares with that of the farthest row, where two at least; and
        nodes with the number of their likely partners."""
        held = 0 if self.tail is None else len(self.tail["node"])
        if held:
            now = {k: np.concatenate([self.tail[k], v]) for k, v in now.items()}
        n, found, crowded = len(now["node"]), [], (now["node"][:0],) * 3
        likely = np.zeros(n, np.int64)
        for step in range(1, self.near + 1):
            right = np.arange(max(held, step), n)
            left = right - step
            same_run = now["run"][left] == now["run"][right]
            if step == self.near and step == self.given and "key" in now:
                a, b = left[same_run], right[same_run]
                depth = np.logical_and.accumulate(now["key"][a] == now["key"][b], axis=1).sum(axis=1)
                a, b, depth = a[depth > 1], b[depth > 1], depth[depth > 1]
                both = np.concatenate([a, b])
                crowded = now["node"][both], now["run"][both], np.concatenate([depth, depth])
            alike = same_run & (now["group"][left] != now["group"][right])
            small = np.minimum(now["n"][left], now["n"][right])
            alike &= small >= self.share * np.maximum(now["n"][left], now["n"][right])
            left, right = left[alike], right[alike]
            share = (now["sig"][left] == now["sig"][right]).mean(axis=1)
            close = share >= self.floor
            left, right, share = left[close], right[close], share[close]
            for side in (left, right):
                np.add.at(likely, side[share >= self.share], 1)
            if step > self.given:
                continue
            swap = now["node"][left] > now["node"][right]
            u, v = np.where(swap, right, left), np.where(swap, left, right)
            found.append((now["node"][u], now["node"][v], now["group"][u], now["group"][v], share))
        self.tail = {k: v[max(0, n - self.near) :] for k, v in now.items()}
        names = ("u", "v", "gu", "gv", "share")
        some = np.flatnonzero(likely)
        pairs = {k: np.concatenate([f[i] for f in found]) for i, k in enumerate(names)}
        return pairs, crowded, (now["node"][some], likely[some])


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {k: np.asarray(batch[k]) for k in ("node", "group", "n")}
    out["run"] = np.asarray(batch["order"])
    out["sig"] = np.frombuffer(b"".join(batch["sig"].to_pylist()), np.uint8).reshape(-1, COMPARED)
    out["key"] = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u2").reshape(-1, DEPTH)
    return out


_FOUND = f"kind int, u long, v long, gu long, gv long, share double, cut int, {_ROW}"


def neighbours(rows: DataFrame, near: int, given: int, similarity: float) -> DataFrame:
    """Rows of kind 0: candidate pairs (u < v) with their groups and share; of kind 1: nodes (u), an order (v) and the
    depth (gu) to which the farthest row they were compared with has the same key; of kind 3: nodes (u) with a number (v) of likely partners near them."""
    share, floor = similarity, similarity - MARGIN
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def result(kind: int, found: dict[str, np.ndarray]) -> pa.RecordBatch:
        n = len(found["u"])
        columns = [pa.array(np.full(n, kind, np.int32)), *[pa.array(found[k]) for k in ("u", "v", "gu", "gv", "share")]]
        columns += [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names)

    def compared(state: _Neighbours, batch: pa.RecordBatch, run: str):
        arrays = _arrays(batch)
        if run != "order":
            arrays["run"] = np.asarray(batch[run]).astype(np.int64) * 100_000 + arrays["run"]
        found, crowded, (near_by, count) = state.pairs(arrays)
        yield result(0, found)
        nodes, runs, depth = crowded
        yield result(1, {"u": nodes, "v": runs.astype(np.int64) % 100_000, "gu": depth, "gv": depth, "share": np.zeros(len(nodes))})
        yield result(3, {"u": near_by, "v": count, "gu": near_by, "gv": near_by, "share": np.zeros(len(near_by))})

    def edge(batch: pa.RecordBatch, cut: int) -> pa.RecordBatch:
        n = batch.num_rows
        head = [pa.array(np.full(n, 2, np.int32)), *[pa.nulls(n, pa.int64())] * 4, pa.nulls(n, pa.float64())]
        return pa.RecordBatch.from_arrays([*head, pa.array(np.full(n, cut, np.int32)), *batch.columns], names)

    def inside(batches):
        state, part, first, last = _Neighbours(near, share, floor, given), TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            yield from compared(state, batch, "order")
            if first < near:
                yield edge(batch.slice(0, near - first), part - 1)
                first += min(batch.num_rows, near - first)
            joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            last = joined.slice(max(0, joined.num_rows - near))
        if last is not None:
            yield edge(last, part)

    def across(batches):
        state = _Neighbours(near, share, floor, given)
        for batch in batches:
            if batch.num_rows:
                yield from compared(state, batch, "cut")

    ranged = rows.repartitionByRange("order", "key", "node").sortWithinPartitions("order", "key", "node")
    found = stored(ranged.mapInArrow(inside, _FOUND), "neighbours")
    cuts = found.where("kind = 2").repartition("cut").sortWithinPartitions("cut", "order", "key", "node")
    wanted = ["kind", "u", "v", "gu", "gv", "share"]
    beyond = cuts.select("cut", *[f.split()[0] for f in _ROW.split(", ")]).mapInArrow(across, _FOUND)
    return found.where("kind != 2").select(*wanted).unionByName(beyond.select(*wanted))


def full_sets(documents: DataFrame, wanted: DataFrame, shingle: int, key: str) -> DataFrame:
    """(node, set): the sets of the wanted ids, made again from their texts."""

    def made(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(utf8(batch["text"].to_pylist()), shingle)]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(sets, pa.binary())], ["node", "set"])

    slim = documents.select(F.col(key).cast("long").alias("id"), "text")
    # The same plan at every size: texts are shuffled once.
    chosen = slim.join(wanted.hint("merge"), F.col("id") == F.col("node"), "left_semi")
    return stored(chosen.mapInArrow(made, "node long, set binary"), "sets", "lz4")


def confirmed(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""
    percent = round(100 * similarity)

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            mask = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch["u"])[mask]), pa.array(np.asarray(batch["v"])[mask])], ["u", "v"])

    left = sets.select(F.col("node").alias("u"), F.col("set").alias("x"))
    right = sets.select(F.col("node").alias("v"), F.col("set").alias("y"))
    joined = pairs.select("u", "v").hint("merge").join(left, "u").hint("merge").join(right, "v").select("u", "v", "x", "y")
    return stored(joined.mapInArrow(similar, "u long, v long").distinct(), "links")


def grouped_rows(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, n, sig, group): a node without a group is one of its own."""
    mapped = groups.select(F.col("node").alias("member"), "root").hint("merge")
    joined = nodes.join(mapped, F.col("node") == F.col("member"), "left")
    return joined.select("node", "n", "sig", F.coalesce("root", "node").alias("group"))


def to_hubs(rows: DataFrame, found: DataFrame, groups: DataFrame, similarity: float, most: int) -> DataFrame:
    """Candidate pairs between any row and the hubs: of each of ``groups`` the row with the most likely partners, and of
    those the ``most`` first ones, which is what is sent to tasks. Only rows of one group are left out."""
    degrees = found.where("kind = 3").groupBy("u").agg(F.sum("v").alias("degree"))
    mapped = groups.select(F.col("node").alias("member"), "root")
    of = degrees.join(mapped, F.col("u") == F.col("member"), "left").select("u", "degree", F.coalesce("root", "u").alias("of"))
    best = of.groupBy("of").agg(F.max(F.struct("degree", "u")).alias("hub")).select("hub.*")
    first = best.orderBy(F.desc("degree"), "u").limit(most)
    hubs = rows.join(F.broadcast(first), F.col("node") == F.col("u")).select("node", "n", "sig", "group").toArrow()
    sent = rows.sparkSession.sparkContext.broadcast(hubs)

    def compared(batches):
        own = sent.value.to_pydict()
        theirs = [(np.frombuffer(x, ">u2")[:COMPARED], *rest) for x, *rest in zip(own["sig"], own["node"], own["group"], own["n"], strict=True)]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch["sig"].to_pylist()), ">u2").reshape(-1, HASHES)[:, :COMPARED]
            node, group, n = (np.asarray(batch[k]) for k in ("node", "group", "n"))
            for hub, hub_node, hub_group, hub_n in theirs:
                share = (sig == hub).mean(axis=1)
                sized = np.minimum(n, hub_n) >= similarity * np.maximum(n, hub_n)
                at = np.flatnonzero((share >= similarity - MARGIN) & sized & (group != hub_group))
                if not len(at):
                    continue
                swap = node[at] > hub_node
                other, own_group = np.full(len(at), hub_node), np.full(len(at), hub_group)
                columns = [np.where(swap, other, node[at]), np.where(swap, node[at], other)]
                columns += [np.where(swap, own_group, group[at]), np.where(swap, group[at], own_group), share[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["u", "v", "gu", "gv", "share"])

    return rows.mapInArrow(compared, "u long, v long, gu long, gv long, share double")


def once(found: DataFrame) -> DataFrame:
    """Candidate pairs, each one time."""
    return stored(found.groupBy("u", "v").agg(*[F.first(c).alias(c) for c in ("gu", "gv", "share")]), "pairs")


def in_turns(sets: DataFrame, pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """New links of (u, v, gu, gv, share): a pair is confirmed unless links found before already join its texts."""
    left, done, out = pairs, None, None
    for most in TURNS:
        rank = F.row_number().over(Window.partitionBy(F.least("gu", "gv"), F.greatest("gu", "gv")).orderBy(F.desc("share"), "u", "v"))
        now = left if most is None else left.withColumn("place", rank).where(F.col("place") <= most)
        if most == TURNS[0]:
            now = now.where(F.col("share") >= similarity)
        now = stored(now.select("u", "v"), "turn")
        new = confirmed(sets, now, similarity)
        out = new if out is None else out.unionByName(new)
        if most is None:
            break
        done = now if done is None else done.unionByName(now)
        root = components(known.unionByName(out))
        a, b = (root.select(F.col("node").alias(n), F.col("root").alias(r)) for n, r in (("nu", "ru"), ("nv", "rv")))
        rest = pairs.select("u", "v", "share").join(done, ["u", "v"], "left_anti")
        rest = rest.join(a, F.col("u") == F.col("nu"), "left").join(b, F.col("v") == F.col("nv"), "left")
        rest = rest.withColumn("gu", F.coalesce("ru", "u")).withColumn("gv", F.coalesce("rv", "v"))
        left = stored(rest.where("gu != gv").select("u", "v", "gu", "gv", "share"), "left")
        if not left.take(1):
            break
    return out


def crowded_nodes(nodes: DataFrame, found: DataFrame, orders: int, similarity: float) -> DataFrame:
    """(node): those that a row of just ``similarity`` may lie beside without having been seen in any of the orders."""
    if (1 - similarity**2) ** orders > MISSED:
        return nodes.select("node")
    # A row that shares more of the key than the farthest one is nearer than that one.
    beyond = F.when(F.col("depth") >= DEPTH, 1.0).otherwise(1 - F.pow(F.lit(similarity), F.col("depth") + 1))
    each = found.where("kind = 1").groupBy("u", "v").agg(F.max("gu").alias("depth"))
    chance = F.sum(F.log(beyond)) + (orders - F.count("*")) * float(np.log(1 - similarity**2))
    missed = each.groupBy("u").agg(chance.alias("chance")).where(F.col("chance") > float(np.log(MISSED)))
    return stored(missed.select(F.col("u").alias("node")), "crowded")


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets each counter has: a table of fixed size."""

    def counted(batches):
        total = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            for found in batch["set"].to_pylist():
                np.add.at(total, np.frombuffer(found, np.uint64) >> np.uint64(64 - COUNTERS), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "c"])

    summed = sets.select("set").mapInArrow(counted, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(1 << COUNTERS, np.int64)
    out[np.asarray(summed["slot"])] = np.asarray(summed["c"])
    return out


def exact_pairs(sets: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs of ``members`` (node, group), with no similar pair of two groups left out.

    Shingles are in one order, rare ones first. The first shingle that two similar sets have in common is so early in
    both that what follows can still make up the overlap; in the smaller set it is earlier yet (``low``).
    """
    percent = round(100 * similarity)
    sent = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def early(batches):
        for batch in batches:
            for node, group, found in zip(batch["node"].to_pylist(), batch["group"].to_pylist(), batch["set"].to_pylist(), strict=True):
                shingles = np.frombuffer(found, np.uint64)
                n = len(shingles)
                count = sent.value[shingles >> np.uint64(64 - COUNTERS)]
                # The sets are sorted by hash, and so are shingles of one count.
                first = np.argsort(count, kind="stable")[: n + (-percent * n) // 100 + 1]
                place = np.flatnonzero(count[first] > 1)
                token = shingles[first[place]].view(np.int64)
                low = (100 + percent) * (n - place) >= 2 * percent * n
                k = len(token)
                columns = [token, np.full(k, node), np.full(k, group), np.full(k, n), n - place, low]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "node", "group", "n", "left", "low"])

    made = sets.join(members, "node").select("node", "group", "set").mapInArrow(early, "token long, node long, group long, n long, left long, low boolean")
    tokens = stored(made, "tokens")
    each = tokens.groupBy("token", "group").agg(F.count("*").alias("c"), F.max("low").alias("low"))
    several = each.groupBy("token").agg(F.max_by("group", F.struct("c", "group")).alias("main"), F.count("*").alias("groups"), F.max("low").alias("any"))
    # Rows of a token's largest group meet only rows of others, so a group that is linked already costs no pairs.
    several = several.where("groups > 1 AND any").select("token", "main")
    rows = stored(tokens.join(several.hint("merge"), "token").withColumn("minor", F.col("group") != F.col("main")).drop("main"), "tokens")

    def met(small: DataFrame, large: DataFrame) -> DataFrame:
        a = small.select("token", *[F.col(c).alias(f"{c}_a") for c in ("node", "group", "n", "left")])
        b = large.select("token", *[F.col(c).alias(f"{c}_b") for c in ("node", "group", "n", "left")])
        total = F.col("n_a") + F.col("n_b")
        fits = (100 + percent) * F.least("left_a", "left_b") >= percent * total
        sized = (F.col("n_a") <= F.col("n_b")) & (100 * F.col("n_a") >= percent * F.col("n_b"))
        # Of two rows of one size, either may be the smaller one; one of the two is enough.
        once_only = (F.col("n_a") < F.col("n_b")) | (F.col("node_a") < F.col("node_b")) | ~F.lit(large is minor)
        both = a.hint("merge").join(b, (a["token"] == b["token"]) & (F.col("group_a") != F.col("group_b")) & sized & fits & once_only)
        u, v = F.least("node_a", "node_b"), F.greatest("node_a", "node_b")
        of_u = F.when(F.col("node_a") <= F.col("node_b"), F.col("group_a")).otherwise(F.col("group_b"))
        of_v = F.when(F.col("node_a") <= F.col("node_b"), F.col("group_b")).otherwise(F.col("group_a"))
        return both.select(u.alias("u"), v.alias("v"), of_u.alias("gu"), of_v.alias("gv"), F.lit(float(similarity)).alias("share"))

    minor = rows.where("minor")
    main = rows.where("NOT minor")
    return once(met(minor.where("low"), minor).unionByName(met(minor.where("low"), main)).unionByName(met(main.where("low"), minor)))


def links(
    documents: DataFrame, nodes: DataFrame, similarity: float, shingle: int, key: str, first: int, second: int, near: int, hubs: int = HUBS
) -> DataFrame:
    """Confirmed links (u, v) whose components are those of all confirmed candidates."""

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("u", "v")).alias("node"))

    rows = nodes.withColumn("group", F.col("node"))
    found = stored(neighbours(ordered_rows(rows, range(first)), near, 1, similarity), "found")
    chains = once(found.where("kind = 0"))
    # What signatures alone would join only helps to choose the hubs, which only spare later steps work.
    likely = components(chains.where(F.col("share") >= similarity))
    pairs = once(chains.unionByName(to_hubs(rows, found, likely, similarity, hubs)))
    have = stored(ends(pairs).distinct(), "wanted")
    sets = full_sets(documents, have, shingle, key)
    known = confirmed(sets, pairs, similarity)
    rows = stored(grouped_rows(nodes, stored(components(known), "groups")), "rows")
    found = stored(neighbours(ordered_rows(rows, range(first, first + second)), near, near, similarity), "found")
    new = once(found.where("kind = 0").select("u", "v", "gu", "gv", "share"))
    crowded = crowded_nodes(nodes, found, second, similarity)
    wanted = stored(ends(new).unionByName(crowded).distinct().join(have, "node", "left_anti"), "wanted")
    sets = sets.unionByName(full_sets(documents, wanted, shingle, key))
    known = known.unionByName(in_turns(sets, new, known, similarity))
    if not crowded.take(1):
        return known
    groups = components(known).withColumnRenamed("node", "member")
    members = crowded.join(groups, F.col("node") == F.col("member"), "left").select("node", F.coalesce("root", "node").alias("group"))
    return known.unionByName(in_turns(sets, exact_pairs(sets, stored(members, "members"), similarity), known, similarity))


def near_duplicates(
    documents: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    key: str = "doc_id",
    first: int = FIRST,
    second: int = SECOND,
    near: int = NEAR,
) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``documents``.

    ``component_id`` is the smallest id that links of at least ``similarity`` reach; ``kept`` tells whether it is the
    row's own.
    """
    every = stored(signatures(documents, shingle, key), "signatures")
    # A class's rows have one signature; a huge class is one row per task before the shuffle.
    classes = stored(
        every.where("n > 0 AND id IS NOT NULL")
        .groupBy("a", "b")
        .agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("sig").alias("sig")),
        "classes",
    )
    found = links(documents, classes.select("node", "n", "sig"), similarity, shingle, key, first=first, second=second, near=near)
    mapped = components(found).select(F.col("node").alias("member"), "root")
    named = stored(
        classes.join(mapped, F.col("node") == F.col("member"), "left").select(
            F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("root", "node").alias("component_id")
        ),
        "class-components",
    )
    # Rows of one huge class share a key here; both sides come from tables, so the skew-join rule can split them.
    same = (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & F.col("id").isNotNull()
    joined = every.select("id", "n", "a", "b").join(named.hint("merge"), same, "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        "id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def keep_one(documents: DataFrame, similarity: float = 0.8, shingle: int = 5, key: str = "doc_id", **settings) -> DataFrame:
    """Documents without those that a component keeps another one for."""
    gone = unused("gone", documents.columns)
    drop = stored(
        near_duplicates(documents, similarity, shingle, key, **settings).where(~F.col("kept")).select(F.col("id").alias(gone)).distinct(),
        "duplicates",
    )
    return documents.join(drop, documents[key] == drop[gone], "left_anti")


def digest(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")
