"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, found by branch and bound.

Rows of a conversation are taken by turn (null first; rows of one turn by role and the text's
hash). Each has at most one fault: blank, duplicate of an earlier row, or truncated. Keeping a row
is free, giving it another role costs 3, deleting it 4, an empty turn put in 3; a truncated row
that stays adds 3; blank and duplicate rows must go. Initials of roles alone decide what is legal.

The search goes depth first over an explicit stack. A node is a row and what the rows kept so far
end in; bounds of all suffixes come from one pass backwards; the first dive gives an incumbent
(cost, audit); what cannot beat it, or reaches a node no cheaper than before, is cut off, until the
stack is empty and the incumbent proved. One byte per row is kept for that, and no text.

Texts are shuffled once, behind their conversation's audit, and repaired as they stream by; so a
conversation's rows are sorted and spilled by Spark and never held together in Python. Its
rows do pass through one task, as one audit and one hash are wanted of each.

Null role and text are one space; a row with an empty role has no initial and can't be kept. A null conv_id is a conversation like others. Rows that repeat
in full are duplicates. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import stored

RENAME, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
_SPACE = r"\x20\x09-\x0D"
#: Bits of a row's code: its role's initial (s, u, a, another), truncated, must be deleted.
_INITIALS, _TRUNCATED, _GONE = "sua", 4, 8

# --- search ----------------------------------------------------------------------

#: What the rows so far end in: nothing, s, u or a. Where a user (assistant) turn leads from there; where one may end.
_NEXT = (2, 2, 3, 2)
_KEEP = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
_OPEN = {0: 0, 1: 2 * INSERT, 2: INSERT, 3: 0}


def _bounds(codes: bytes) -> array:
    """For each row and state, what repairing the rows from there on costs at least."""
    n = len(codes)
    out = array("q", bytes(32 * (n + 1)))
    later = [_OPEN[s] for s in range(4)]
    for i in range(n, -1, -1):
        if i < n:
            code, own = codes[i], [DELETE + x for x in later]
            if not code & _GONE:
                extra = CUT_SHORT if code & _TRUNCATED else 0
                for state in range(4):
                    own[state] = min(own[state], RENAME + extra + later[_NEXT[state]])
                    kept = _KEEP[state].get(code & 3)
                    if kept is not None:
                        own[state] = min(own[state], extra + later[kept])
            # Turns put in before the row; a pair of them leads back to where it began.
            own[2], own[3] = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
            own[0], own[1] = min(own[0], INSERT + own[2]), min(own[1], INSERT + own[2])
            later = own
        out[4 * i : 4 * i + 4] = array("q", later)
    return out


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit (D, I, K, R in order) of the cheapest repair, the least audit in ASCII among equals."""
    n, bound = len(codes), _bounds(codes)
    reached = array("q", [-1]) * (4 * (n + 1))
    best, audit, path = -1, b"", bytearray()
    #: Row, state, cost, length of the path to it, its last letter, whether an incumbent was known as it was pushed.
    stack = [(0, 0, 0, 0, 0, False)]
    while stack:
        row, state, cost, depth, letter, late = stack.pop()
        node = 4 * row + state
        if best >= 0:
            least = cost + bound[node]
            # An incumbent found since then went through this node's parent: the letters there decide between equals.
            if least > best or least == best and (bytes(path[: depth - 1]) + bytes([letter]) > audit[:depth] if late else letter > audit[depth - 1]):
                continue
        # Children are taken by bound, then letter, so whoever came here before at this cost has the lesser prefix.
        if 0 <= reached[node] <= cost:
            continue
        reached[node] = cost
        if depth:
            del path[depth - 1 :]
            path.append(letter)
        if row == n and not _OPEN[state]:
            best, audit = cost, bytes(path)
            continue
        children = [(row, _NEXT[state], cost + INSERT, 73)]
        if row < n:
            code = codes[row]
            children.append((row + 1, state, cost + DELETE, 68))
            if not code & _GONE:
                extra = cost + (CUT_SHORT if code & _TRUNCATED else 0)
                kept = _KEEP[state].get(code & 3)
                if kept is not None:
                    children.append((row + 1, kept, extra, 75))
                children.append((row + 1, _NEXT[state], extra + RENAME, 82))
        children.sort(key=lambda c: (-c[2] - bound[4 * c[0] + c[1]], -c[3]))
        stack += [(r, s, c, depth + 1, x, best >= 0) for r, s, c, x in children]
    return best, audit.decode()


# --- rows ------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with damage that their conversation and turn decide."""
    rows = _rows(conversations)
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return (
        rows.where(kind != 0)
        .select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
        .select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy"))
        .drop("copy")
    )


def _rows(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    return conversations.select("conv_id", "turn", role, text)


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, hash, hash2, seen, code): rows without their texts; ``seen`` is true of a later turn's duplicates."""
    initial = F.substring("role", 1, 1)
    number = F.lit(len(_INITIALS))
    for i, letter in enumerate(_INITIALS):
        number = F.when(initial == letter, i).otherwise(number)
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    whole = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    fault = F.when(blank, _GONE).when(~whole, _TRUNCATED).otherwise(0)
    slim = rows.select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(1), "text").alias("hash2"), (number + fault).cast("byte").alias("code")
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    keys = ["conv_id", "role", "hash", "hash2"]
    # Summed up before the shuffle, so one text said over and over is a row per task.
    repeated = (
        slim.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        .where(F.col("n") > 1)
        .select(*[F.col(k).alias(f"of_{k}") for k in keys], "first")
    )
    same = F.lit(True)
    for k in keys:
        same = same & slim[k].eqNullSafe(repeated[f"of_{k}"])
    seen = F.coalesce(place > F.col("first"), F.lit(False))
    return slim.join(repeated, same, "left").select("conv_id", "turn", "role", "hash", "hash2", seen.alias("seen"), "code")


_PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan_repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    slim = coded(rows)
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T._parse_datatype_string(_PLAN).fields])

    def planned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, done, own = None, [], None
        for batch in batches:
            if arrow is None:
                names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
                arrow = pa.schema([batch.schema.field(0), *[(n, pa.int64()) for n in names], ("audit", pa.string())])
            for conv, turn, role, first, second, seen, code in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or conv != own.conv:
                    if own is not None:
                        done.append(own.report())
                    own = _Conversation(conv)
                own.add(turn, (role, first, second), seen, code)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if own is not None:
            yield pa.RecordBatch.from_pylist([*done, own.report()], schema=arrow)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "hash", "hash2"]
    return slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(planned, schema)


class _Conversation:
    """What is known of one conversation's rows, in order."""

    def __init__(self, conv) -> None:
        self.conv, self.codes = conv, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = self.before = None

    def add(self, turn, row: tuple, seen: bool, code: int) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.distinct = turn, self.distinct + 1
        initial = _INITIALS[code & 3 : (code & 3) + 1]
        if self.codes and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if code & _GONE:
            self.blank += 1
        elif seen or self.before == (turn, row):
            self.duplicate += 1
            code = code & 3 | _GONE
        elif code & _TRUNCATED:
            self.truncated += 1
        self.codes.append(code)
        self.last, self.before = initial, (turn, row)

    def report(self) -> dict:
        cost, audit = cheapest(bytes(self.codes))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        counts = {n: getattr(self, n) for n in ("blank", "duplicate", "truncated", "illegal")}
        return {"conv_id": self.conv, "gaps": gaps, **counts, "cost": cost, "audit": audit}


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the turns after repair; put-in ones have a null turn.

    All turns of a conversation are in one partition, in order.
    """
    texts = _rows(rows)
    nothing = F.lit(None)
    audits = plans.select(
        "conv_id",
        F.lit(0).alias("kind"),
        nothing.cast(texts.schema["turn"].dataType).alias("turn"),
        F.lit("").alias("role"),
        F.lit(0).cast("long").alias("hash"),
        F.col("audit").alias("text"),
    )
    lines = texts.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.xxhash64("text").alias("hash"), "text")
    order = ["conv_id", "kind", F.asc_nulls_first("turn"), "role", "hash"]
    mixed = audits.unionByName(lines).repartition("conv_id").sortWithinPartitions(*order)
    fields = [rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), rows.schema["turn"]]
    schema = T.StructType([*fields, T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place, last = "", 0, 0, ""
        for batch in batches:
            out = []

            def inserted(conv):
                nonlocal at, place, last
                while audit[at : at + 1] == "I":
                    last = "assistant" if last == "user" else "user"
                    out.append((conv, place, "I", None, last, ""))  # noqa: B023
                    at, place = at + 1, place + 1

            for conv, kind, turn, role, _, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if kind == 0:
                    audit, at, place, last = text, 0, 0, ""
                    inserted(conv)
                    continue
                edit, at = audit[at], at + 1
                if edit != "D":
                    if edit == "R":
                        role = "assistant" if last == "user" else "user"
                    last = {"u": "user", "a": "assistant"}.get(role[:1], "")
                    out.append((conv, place, edit, turn, role, text))
                    place += 1
                inserted(conv)
            names = [f.name for f in schema.fields]
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), batch.schema.field("turn").type, pa.string(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return mixed.mapInArrow(edited, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans and repaired turns of conversations; plans are stored, as the turns are made from them."""
    plans = stored(plan_repairs(_rows(rows)), "repair-plans")
    return plans, repaired(rows, plans)


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired turns, each conversation hashed as it streams by."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, kind = None, None, None
        for batch in batches:
            out = []
            kind = batch.schema.field("conv_id").type
            for conv, place, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True):
                if place == 0:
                    if state is not None:
                        out.append((own, state.hexdigest()))
                    own, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if out:
                yield _pairs(out, kind)
        if state is not None:
            yield _pairs([(own, state.hexdigest())], kind)

    def _pairs(out, kind):
        ids, digests = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(digests, pa.string())], schema.names)

    # Repaired turns lie together by conversation; they are only put in order again.
    return turns.select("conv_id", "place", "role", "text").sortWithinPartitions("conv_id", "place").mapInArrow(digests, schema)


def digest(ids: DataFrame, plans: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conversation of ``ids``; those without rows have nothing to repair."""
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = ids.select("conv_id").distinct()
    plans = plans.withColumnRenamed("conv_id", "of_plan")
    hashes = hashed(turns).withColumnRenamed("conv_id", "of_turns")
    return (
        every.join(plans, every["conv_id"].eqNullSafe(plans["of_plan"]), "left")
        .join(hashes, every["conv_id"].eqNullSafe(hashes["of_turns"]), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in counts],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
        )
    )
