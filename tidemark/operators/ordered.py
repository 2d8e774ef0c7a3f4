"""Positions, running sums and neighbours over a total order, without a global window.

Rows are cut into parts at fixed keys of the full order, so one hot commit time, core or
batch is cut like any other stretch. The keys are taken from a sample that the rows' hashes decide, and stand in the
plan as literals: every pass cuts alike, however often it is made. One aggregate gives each part's total, of which only
one row per part is looked at in a single task; windows then run inside the parts. The number of parts is a parameter,
hence the broadcast offset table has a known size.

The order columns must identify a row (add an id as the last one); nulls come first. Rows are written down once, as all
passes start from them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.session import freeze

PART, WEIGHT, INSIDE = "_part", "_weight", "_inside"
#: Sampled keys per part; parts differ in size by a few tenths.
SAMPLED = 100


def part_count(df: DataFrame, parts: int | None = None) -> int:
    return parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bounds(rows: DataFrame, order: Sequence[str], parts: int) -> list[tuple]:
    """At most ``parts - 1`` keys that cut the rows into stretches of about one length."""
    every = max(1, rows.count() // (SAMPLED * parts))
    chosen = rows.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
    known = chosen.where(F.least(*[F.col(c).isNotNull().cast("int") for c in order], F.lit(1)) == 1)
    keys = sorted(tuple(r) for r in known.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _not_before(order: Sequence[str], key: tuple) -> Column:
    """Whether a row's key is the given one or comes after it; null where it comes before for a null's sake."""
    out = F.col(order[-1]) >= F.lit(key[-1])
    for column, value in zip(reversed(order[:-1]), reversed(key[:-1]), strict=True):
        out = (F.col(column) > F.lit(value)) | ((F.col(column) == F.lit(value)) & out)
    return out


def _part(order: Sequence[str], bounds: list[tuple], first: int = 0) -> Column:
    """The number of bounds that are not after the row, found by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    upper = _part(order, bounds[half + 1 :], first + half + 1)
    return F.when(_not_before(order, bounds[half]), upper).otherwise(_part(order, bounds[:half], first))


def cut(df: DataFrame, order: Sequence[str], parts: int | None = None, descending: bool = False) -> tuple[DataFrame, int]:
    """The rows with the number of their part, and how many parts there may be."""
    rows, n = freeze(df), part_count(df, parts)
    bounds = _bounds(rows, order, n) if n > 1 else []
    part = _part(order, bounds)
    return rows.withColumn(PART, F.lit(len(bounds)) - part if descending else part), n


def _together(rows: DataFrame, n: int) -> DataFrame:
    """Each part in a task of its own, as windows over a part need them."""
    return rows.repartitionById(n, F.col(PART))


def _inside(order: Sequence[str], descending: bool = False):
    return Window.partitionBy(PART).orderBy(*[F.col(c).desc() if descending else F.col(c) for c in order])


def _earlier_parts(totals: DataFrame, total: str, offset: str) -> DataFrame:
    """Sum of ``total`` over all earlier parts; one row per part goes in and out."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(PART, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(offset))


def _summed(
    rows: DataFrame, order: Sequence[str], weight: Column, name: str, n: int | None = None, descending: bool = False
) -> DataFrame:
    """Exclusive running sum over cut rows, in ``n`` parts unless those are together already; a null weighs nothing."""
    weighed = rows.withColumn(WEIGHT, F.coalesce(weight, F.lit(0)).cast("long"))
    # Totals are made in each task where the rows are; only the windows need a part's rows together.
    offsets = _earlier_parts(weighed.groupBy(PART).agg(F.sum(WEIGHT).alias("_total")), "_total", "_offset")
    before = F.sum(WEIGHT).over(_inside(order, descending).rowsBetween(Window.unboundedPreceding, -1))
    return (
        (weighed if n is None else _together(weighed, n))
        .withColumn(INSIDE, F.coalesce(before, F.lit(0)))
        .join(F.broadcast(offsets), PART)
        .withColumn(name, F.col("_offset") + F.col(INSIDE))
        .drop("_offset", INSIDE, WEIGHT)
    )


def with_running_sum(
    df: DataFrame, order: Sequence[str], weight: Column, name: str = "before", parts: int | None = None
) -> DataFrame:
    """Add the exclusive running sum of ``weight`` in the total order."""
    rows, n = cut(df, order, parts)
    return _summed(rows, order, weight, name, n).drop(PART)


def with_position(
    df: DataFrame, order: Sequence[str], name: str = "position", parts: int | None = None, descending: bool = False
) -> DataFrame:
    """Add the 0-based position of each row in the total order, or in its reverse."""
    rows, n = cut(df, order, parts, descending)
    return _summed(rows, order, F.lit(1), name, n, descending).drop(PART)


def with_place(
    df: DataFrame, group: str, order: Sequence[str], name: str = "place", parts: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row within its group, however large a group is.

    Rows are in the order of (group, order). Only a part's first group can have begun in an earlier part; it goes on
    counting from what those parts hold of it: one row per part, on the driver.
    """
    rows, _ = cut(df, [group, *order], parts)
    held = rows.groupBy(PART, group).agg(F.count("*").alias("n"))
    key = F.struct(F.col(group).alias("group"), "n")
    edges = held.groupBy(PART).agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("groups"))
    carried, before, count = [], object(), 0
    for part in sorted(edges.collect(), key=lambda r: r[PART]):
        carry = count if part["first"]["group"] == before else 0
        if carry:
            carried.append((part[PART], before, carry))
        count = part["last"]["n"] + (carry if part["groups"] == 1 else 0)
        before = part["last"]["group"]
    fields = [T.StructField("_of", T.IntegerType()), T.StructField("_group", rows.schema[group].dataType)]
    schema = T.StructType([*fields, T.StructField("_carry", T.LongType())])
    goes_on = df.sparkSession.createDataFrame(carried, schema)
    own = Window.partitionBy(PART, group).orderBy(*order)
    same = (rows[PART] == F.col("_of")) & rows[group].eqNullSafe(F.col("_group"))
    return (
        rows.join(F.broadcast(goes_on), same, "left")
        .withColumn(name, (F.row_number().over(own) - 1 + F.coalesce("_carry", F.lit(0))).cast("long"))
        .drop(PART, "_of", "_group", "_carry")
    )


def _looked_back(rows: DataFrame, n: int, order: Sequence[str], columns: Sequence[str], prefix: str) -> DataFrame:
    """The row before, for cut rows; a part's first row has that of the last row of the part before."""
    last = rows.groupBy(PART).agg(F.max(F.struct(*order, F.struct(*columns).alias("_row"))).alias("_last"))
    carried = last.select(PART, F.lag("_last._row").over(Window.orderBy(PART)).alias("_carried"))
    window = _inside(order)
    out = (
        _together(rows, n)
        .withColumn("_before", F.lag(F.struct(*columns)).over(window))
        .withColumn("_first", F.row_number().over(window) == 1)
        .join(F.broadcast(carried), PART)
        .withColumn("_before", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")))
    )
    for column in columns:
        out = out.withColumn(prefix + column, F.col("_before")[column])
    return out.drop("_before", "_first", "_carried")


def with_previous(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_", parts: int | None = None
) -> DataFrame:
    """Add, for each of ``columns``, the value of the row before in the total order."""
    rows, n = cut(df, order, parts)
    return _looked_back(rows, n, order, columns, prefix).drop(PART)


def with_runs(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str],
    breaks: Column,
    name: str = "run",
    prefix: str = "prev_",
    parts: int | None = None,
) -> DataFrame:
    """Add the row before, and the number of rows before at which ``breaks`` holds, which may ask for the row before."""
    rows, n = cut(df, order, parts)
    seen = _looked_back(rows, n, order, columns, prefix)
    return _summed(seen, order, F.coalesce(breaks, F.lit(False)).cast("long"), name).drop(PART)
