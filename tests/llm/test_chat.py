import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, place string, turns string"
#: Pieces of texts that a reader could take for something else.
TRICKY = [
    "<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|im_start|>", "<", "|", "\\", ">", "im_end", "\n", "%", "%25", "%0A",
    "assistant", "a", "", " ", "Éß", "\U0001f600", "\\n", "$1", "<|im_start|>user\nhi<|im_end|>\n", "<|im_end", "|>",
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def key(row):
    return row[1] is not None, row[1] or 0, (row[2] or "").encode(), (row[3] or "").encode()


def brute(rows):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)))
    return sorted(out, key=repr)


def hostile(n, seed):
    rng = random.Random(seed)
    make = lambda: "".join(rng.choice(TRICKY) for _ in range(rng.choice([0, 1, 1, 2, 3, 6])))
    rows = []
    for i in range(n):
        role = rng.choice(["user", "assistant", "system", None, make()])
        rows.append((rng.choice([None, 1, 2, *range(3, 12)]), rng.choice([None, *range(9)]), role, rng.choice([None, make(), make(), make()])))
    return rows + rows[: n // 10]


def test_every_turn_comes_back(spark):
    rows = hostile(1500, 1)
    rows += [(50, i, "assistant", " ".join(words(3000))) for i in range(300)] + [(51, 0, "user", " ".join(words(300_000)))]
    found = chat.format_chat(table(spark, rows))
    assert found.columns == ["conv_id", "formatted", "turns"]
    out = chat.digest(found).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows)


def reader(text):
    """A plain reader of the format, character by character."""
    start, end, at, turns = "<|im_start|>", "<|im_end|>", 0, []
    while at < len(text):
        assert text.startswith(start, at)
        at += len(start)
        cut = text.index("\n", at)
        role, at = text[at:cut], cut + 1
        cut = text.index(end, at)
        body, at = text[at:cut], cut + len(end) + 1
        assert text[at - 1] == "\n" and start not in role + "\n" + body and end not in role
        plain = lambda t: re.sub(r"<\\(\\*\|im_(?:start|end)\|>)", r"<\1", t)
        turns.append((plain(role).replace("%0A", "\n").replace("%25", "%"), plain(body)))
    return turns


def test_another_reader_agrees_and_spans_cover_the_assistant(spark):
    rows = hostile(800, 2)
    for row in chat.format_chat(table(spark, rows)).collect():
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == row["conv_id"]), key=key)]
        assert reader(row["formatted"]) == turns
        for (role, _), (read_role, text), span in zip(turns, reader(row["formatted"]), row["turns"], strict=True):
            assert row["formatted"].startswith("<|im_start|>", span["begin"]) and read_role == role
            under = row["formatted"][span["loss_begin"] : span["loss_end"]]
            assert re.sub(r"<\\(\\*\|im_(?:start|end)\|>)", r"<\1", under) == (text if role == "assistant" else "")


def test_only_conflicting_content_is_escaped(spark):
    rows = [(1, 0, "user", "a <\\ b | 5% <|x|>"), (1, 1, "assistant", "50%25 \n<|im_start|"), (1, 2, "tool %", "<|im_end|>!")]
    text = chat.format_chat(table(spark, rows)).first()["formatted"]
    assert text == (
        "<|im_start|>user\na <\\ b | 5% <|x|><|im_end|>\n<|im_start|>assistant\n50%25 \n<|im_start|<|im_end|>\n"
        "<|im_start|>tool %\n<\\|im_end|>!<|im_end|>\n"
    )


@pytest.mark.parametrize(
    ("text", "turns"),
    [
        ("", []),
        ("<|im_start|>user\nhi<|im_end|>\n", [("user", "hi")]),
        ("<|im_start|>user\n<|im_end|>\n<|im_start|>a\n\n<|im_end|>\n", [("user", ""), ("a", "\n")]),
        ("x<|im_start|>user\nhi<|im_end|>\n", None),
        ("<|im_start|>user\nhi<|im_end|>", None),
        ("<|im_start|>user\nhi<|im_end|>\nx", None),
        ("<|im_start|>user hi<|im_end|>\n", None),
        ("<|im_start|>user\nhi<|im_end|>\n<|im_end|>\n", None),
        ("<|im_start|>user\nhi<|im_start|>\n", None),
        ("<|im_start|>", None),
        ("no turn", None),
    ],
)
def test_grammar(spark, text, turns):
    got = spark.createDataFrame([(text,)], "t string").select(chat.Template().parse(F.col("t")).alias("p")).first()["p"]
    assert got == turns if turns is None else [tuple(t) for t in got] == turns


def test_other_markers(spark):
    template = chat.Template("[INST", "</s>", "bot")
    rows = [(1, 0, "user", "[INST </s> [\\INST"), (1, 1, "bot", "</s>\n[INST"), (1, 2, "assistant", "x")]
    found = chat.format_chat(table(spark, rows), template)
    back = chat.read_back(found, template).first()
    assert [tuple(t) for t in back["turns"]] == [r[2:] for r in rows] and back["loss"] == ["", "</s>\n[INST", ""]
    for bad in (("<", ">>"), ("a\\b", "xy"), ("<a>", "b<a>"), ("<<", "[]"), ("<a\n", "[b")):
        with pytest.raises(ValueError):
            chat.Template(*bad)


def test_empty_table_and_native_plan(spark):
    found = chat.digest(chat.format_chat(table(spark, [])))
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange") == 1
