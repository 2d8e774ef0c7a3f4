import hashlib
import heapq
import itertools
import random
import re
import zlib

from tests.llm.conftest import words
from tidemark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place string, audit string, edit string, hash string"
LEGAL = re.compile(r"(s?(ua)+)?")


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


def by_hand(rows):
    """Cheapest audit and turns by a best-first walk over (cost, audit, rows done, turns), legal at its end.

    ``rows`` are (role, text, fault).
    """
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, turns = heapq.heappop(heap)
        initials = "".join(r[:1] or "?" for r, _ in turns)
        if i == len(rows) and LEGAL.fullmatch(initials):
            return cost, audit, turns
        if not LEGAL.fullmatch(initials) and not LEGAL.fullmatch(initials + "a") and not LEGAL.fullmatch(initials + "ua"):
            continue
        key = (i, initials[-1:], cost, audit)
        if key in done or cost > 4 * len(rows):
            continue
        done.add(key)
        steps = [(3, "I", i, (r, "")) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            steps.append((4, "D", i + 1, None))
            if fault in (None, "truncated"):
                extra = 3 if fault else 0
                steps.append((extra, "K", i + 1, (role, text)))
                steps += [(3 + extra, "R", i + 1, (r, text)) for r in ("user", "assistant")]
        for more, letter, after, turn in steps:
            heapq.heappush(heap, (cost + more, audit + letter, after, turns if turn is None else (*turns, turn)))
    raise AssertionError


def brute(rows, damage):
    out = []
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20 if damage else 9
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        known = [t for t, _, _ in own if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faults))
        cost, audit, turns = by_hand(faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        counts = [sum(f == kind for _, _, f in faults) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def found(frame, damage):
    rows = repair.damaged(frame) if damage else frame
    return sorted((tuple(r) for r in repair.digest(frame, *repair.repair(rows)).collect()), key=repr)


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        turns = rng.sample(range(-2, 12), rng.randrange(0, 7))
        rows += [
            (
                conv,
                turn,
                rng.choice(["user", "assistant", "assistant", "system", "tool", None, "", "umpire"]),
                rng.choice(["Hi.", "Yes!", "so\n", "what? \t", " \n", "", None, "end. ", f"Own {rng.random()}."]),
            )
            for turn in turns
        ]
    # Two rows without a turn keep a role each, so that their order does not depend on a hash.
    whole = next(i for i in range(40) if zlib.crc32(f"{i}: ".encode()) % 20 > 4)
    rows += [(whole, None, "assistant", "no turn."), (whole, None, "user", "no turn!"), (77, None, "user", "alone."), (78, None, None, None)]
    return rows + rng.sample(rows, 12)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = conversations(seed)
        for damage in (False, True):
            assert found(table(spark, rows).repartition(3 + seed), damage) == brute(rows, damage)


def test_search_against_best_first():
    rng = random.Random(4)
    for n in range(5):
        for codes in itertools.product(range(9), repeat=n) if n < 4 else [[rng.randrange(9) for _ in range(6)] for _ in range(500)]:
            rows = [("suax"[c & 3], "t", "blank" if c & 8 else "truncated" if c & 4 else None) for c in codes]
            assert repair.cheapest(bytes(codes)) == by_hand(rows)[:2]


def test_long_conversations_and_texts(spark):
    roles = ["user", "assistant"]
    rows = [(1, i, roles[i % 2], f"Turn {i}.") for i in range(20_000)]
    rows += [(2, i, "user", "the same.") for i in range(5000)]
    rows += [(3, i, roles[i % 2], " ".join(words(2000, i)) + ".") for i in range(400)] + [(4, 0, "user", " ".join(words(200_000)))]
    plans, turns = repair.repair(table(spark, rows))
    got = {r["conv_id"]: r for r in plans.collect()}
    assert got[1]["cost"] == 0 and got[1]["audit"] == "K" * 20_000
    # All but the first are duplicates, and one user turn alone is cheaper to complete than to delete.
    assert got[2]["duplicate"] == 4999 and got[2]["cost"] == 4 * 4999 + 3
    assert got[2]["audit"] == min("K" + "D" * 4999 + "I", "KI" + "D" * 4999) and got[4]["audit"] == "D"
    out = [tuple(r) for r in turns.where("conv_id = 3").orderBy("place").collect()]
    assert [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in out] == [(3, i, "K", i, r[2], r[3]) for i, r in enumerate(r for r in rows if r[0] == 3)]
    digests = {r[0]: r[1] for r in repair.hashed(turns).collect()}
    assert digests[1] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows[:20_000]).encode()).hexdigest()
    assert 4 not in digests


def test_empty_table(spark):
    assert found(table(spark, []), True) == []


def test_everything_dropped(spark):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(table(spark, [(lost, 0, "user", "x")]), True) == [(lost, 0, 0, 0, 0, 0, 0, "", nothing)]
