r"""Chat formatting whose output a parser reads back to the very same turns.

A turn is written as start marker, role, line break, text, end marker, line break. The grammar is
read by cutting at start markers; each piece must then hold one header and one end marker, as
its last. Each rendered turn is parsed before it is accepted: if role and text do not come back
as they were, the conflicting one is escaped and the turn tried again, until they do. Most turns
are written as they are.

In texts and roles a marker that must not act gets a backslash after its first character, and so
does one that looks escaped already: ``<|x|>`` becomes ``<\|x|>``, and that ``<\\|x|>``. Roles,
which end at a line break, also write it as ``%0A`` and a percent sign as ``%25``. The reader takes one
backslash, or one such code, away. Markers hold no line break, so none can arise between two turns.

Rendering, escaping and checking are per row. Only then are the rows of a conversation put in
order: turns ascending, null first, rows of one turn by role and text. A conversation is one value
of the result, hence at most 2 GB.

Null text and role are empty ones. Rows that repeat are turns of their own. A null conv_id is a
conversation like others. An empty table gives none. Other columns are not carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BREAK = "\n"


@dataclass(frozen=True)
class Template:
    """The two markers of a turn and the role whose texts are learnt from."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    learnt: str = "assistant"

    def __post_init__(self) -> None:
        for marker in (self.start, self.end):
            if len(marker) < 2 or marker.count(marker[0]) > 1 or set(marker) & {"\\", "\n", "%", "$"}:
                raise ValueError(f"{marker!r}: two characters or more, the first only once, none of backslash, line break, % or $")
        if self.start[0] in self.end[1:] or self.end[0] in self.start[1:] or self.start in self.end or self.end in self.start:
            raise ValueError("markers must not reach into each other")

    # Escaping of texts and roles.

    def escape(self, text: Column) -> Column:
        for marker in (self.start, self.end):
            text = F.regexp_replace(text, rf"{re.escape(marker[0])}(\\*){re.escape(marker[1:])}", f"{marker[0]}\\\\$1{marker[1:]}")
        return text

    def unescape(self, text: Column) -> Column:
        for marker in (self.start, self.end):
            text = F.regexp_replace(text, rf"{re.escape(marker[0])}\\(\\*){re.escape(marker[1:])}", f"{marker[0]}$1{marker[1:]}")
        return text

    def escape_role(self, role: Column) -> Column:
        return self.escape(_replaced(_replaced(role, "%", "%25"), _BREAK, "%0A"))

    def unescape_role(self, role: Column) -> Column:
        return _replaced(_replaced(self.unescape(role), "%0A", _BREAK), "%25", "%")

    # The grammar.

    def render(self, role: Column, text: Column) -> Column:
        return F.concat(F.lit(self.start), role, F.lit(_BREAK), text, F.lit(self.end + _BREAK))

    def pieces(self, formatted: Column) -> Column:
        """What follows each start marker."""
        return F.slice(F.split(formatted, re.escape(self.start), -1), F.lit(2), F.length(formatted) + 1)

    def parse(self, formatted: Column) -> Column:
        """The turns (role, text) of a formatted text; null where it is not in the grammar."""
        tail = self.end + _BREAK

        def sound(piece: Column) -> Column:
            body = F.length(piece) - F.lit(len(tail))
            header = F.locate(_BREAK, piece).between(1, body)
            return header & piece.endswith(tail) & (F.locate(self.end, piece) == body + 1)

        def turn(piece: Column) -> Column:
            role = F.substring_index(piece, _BREAK, 1)
            begin = F.length(role) + 2
            text = F.substr(piece, begin, F.length(piece) - begin + 1 - F.lit(len(tail)))
            return F.struct(self.unescape_role(role).alias("role"), self.unescape(text).alias("text"))

        pieces = self.pieces(formatted)
        return F.when(
            ((formatted == "") | formatted.startswith(self.start)) & F.forall(pieces, sound), F.transform(pieces, turn)
        )

    def round_trip(self, role: Column, text: Column) -> Column:
        """The least escaped (role, text) that the parser reads back as they are here."""
        source = F.array(F.struct(role.alias("role"), text.alias("text")))
        tried = [
            (role, text), (role, self.escape(text)), (self.escape_role(role), text), (self.escape_role(role), self.escape(text)),
        ]
        found = None
        for as_role, as_text in tried:
            kept = F.struct(as_role.alias("role"), as_text.alias("text"))
            same = self.parse(self.render(as_role, as_text)).eqNullSafe(source)
            found = F.when(same, kept) if found is None else found.when(same, kept)
        return found.otherwise(F.raise_error(F.lit("a turn does not survive its template")))


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def format_chat(conversations: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, formatted, turns): one row per conversation.

    ``turns`` has for each turn in order where it begins in ``formatted``, and the span [loss_begin, loss_end) of
    characters that is learnt from, empty for all roles but one.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    safe = rows.select("conv_id", "turn", "role", "text", template.round_trip(F.col("role"), F.col("text")).alias("safe"))
    head = F.length(template.render(F.col("safe.role"), F.lit(""))) - F.lit(len(template.end) + 1)
    placed = safe.select(
        "conv_id",
        "turn",
        "role",
        "text",
        template.render(F.col("safe.role"), F.col("safe.text")).alias("segment"),
        head.cast("long").alias("head"),
        F.when(F.col("role") == template.learnt, F.length("safe.text")).otherwise(0).cast("long").alias("learnt"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = placed.select(
        "conv_id",
        "segment",
        "head",
        "learnt",
        F.row_number().over(order).alias("place"),
        F.coalesce(before, F.lit(0)).cast("long").alias("begin"),
    )
    # The window's exchange and sort serve the grouping, too.
    begin, loss = F.col("begin"), F.col("begin") + F.col("head")
    turn = F.struct(
        "place",
        "segment",
        F.struct(begin.alias("begin"), loss.alias("loss_begin"), (loss + F.col("learnt")).alias("loss_end")).alias("turn"),
    )
    return (
        begun.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("all"))
        .select("conv_id", F.array_join("all.segment", "").alias("formatted"), F.col("all.turn").alias("turns"))
    )


def read_back(found: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    """(conv_id, turns, loss, formatted): (role, text) of each turn, and the texts under the loss mask, from the output."""
    segments = F.transform(template.pieces(F.col("formatted")), lambda piece: F.concat(F.lit(template.start), piece))
    masked = F.zip_with(
        segments,
        "turns",
        lambda segment, at: template.unescape(
            F.substr(segment, (at.loss_begin - at.begin + 1).cast("int"), (at.loss_end - at.loss_begin).cast("int"))
        ),
    )
    return found.select("conv_id", template.parse(F.col("formatted")).alias("turns"), masked.alias("loss"), "formatted")


def digest(found: DataFrame, template: Template = Template()) -> DataFrame:  # noqa: B008
    back = read_back(found, template)
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit(_BREAK), t.text, F.lit(_BREAK)))
    loss = F.array_join("loss", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
