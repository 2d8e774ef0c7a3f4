"""Comparing two sides as sets of ids before any id is joined.

Bitmaps hold a bucket of 32,768 neighbouring ids in 4 KB, built in each task and merged
behind the shuffle. A bucket is alike if both sides have the same bits and no id twice; its
rows are known from one side alone. Only rows of the other buckets meet by id.

Digests are order-free sums of hashes over ranges of ids, wide ones first; only ranges that differ
are cut into narrow ones, and only rows of narrow ones that differ meet by id. They suit ids that
are far apart, where bitmaps would be mostly zeros, and ask only for what differs.

Buckets and ranges of null ids always differ. What differs is written down once, since several scans use it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import freeze

BUCKET = "_bucket"
#: Low bits of an id that a range of each level spans.
LEVELS = (20, 10)


def bitmaps(rows: DataFrame, id_col: str, tags: Sequence[str] = ()) -> DataFrame:
    """One bitmap per tags and bucket of ids, with the number of rows."""
    return rows.groupBy(*tags, F.bitmap_bucket_number(F.col(id_col)).alias(BUCKET)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(id_col))).alias("bits"), F.count("*").alias("n")
    )


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(right[f"{key}_r"])
    return same


def _unlike(left: DataFrame, right: DataFrame, keys: Sequence[str], alike: Column) -> DataFrame:
    """Keys of either side whose other columns are not alike; those of the right side end in ``_r``."""
    renamed = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    joined = left.join(renamed, _same(left, renamed, keys), "full_outer").where(~F.coalesce(alike, F.lit(False)))
    present = F.col("n").isNotNull()
    return joined.select(*[F.when(present, F.col(k)).otherwise(F.col(f"{k}_r")).alias(k) for k in keys])


def unlike_buckets(source: DataFrame, index: DataFrame, id_col: str, tags: Sequence[str] = ()) -> DataFrame:
    """(tags, bucket) of the buckets that differ or hold an id twice; written once."""
    once = (F.col("n") == F.bitmap_count("bits")) & (F.col("n_r") == F.col("n"))
    alike = (F.col("bits") == F.col("bits_r")) & once
    return freeze(_unlike(bitmaps(source, id_col, tags), bitmaps(index, id_col, tags), [*tags, BUCKET], alike))


def _with_bucket(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.withColumn(BUCKET, F.bitmap_bucket_number(F.col(id_col)))


def _matching(rows: DataFrame, marked: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    renamed = marked.select(*[F.col(k).alias(f"{k}_r") for k in keys])
    return rows.join(renamed, _same(rows, renamed, keys), how)


def in_buckets(rows: DataFrame, buckets: DataFrame, id_col: str, tags: Sequence[str] = ()) -> DataFrame:
    """Rows whose bucket is among the given ones."""
    return _matching(_with_bucket(rows, id_col), buckets, [*tags, BUCKET], "left_semi").drop(BUCKET)


def counted_on_both(source: DataFrame, index: DataFrame, id_col: str, tags: Sequence[str] = ()) -> DataFrame:
    """(tags, id, in_source, in_index) of every id of either side; ids are joined only where their bitmaps differ."""
    buckets = unlike_buckets(source, index, id_col, tags)
    one = F.lit(1).cast("long")
    alike = _matching(_with_bucket(source, id_col), buckets, [*tags, BUCKET], "left_anti").select(
        *tags, id_col, one.alias("in_source"), one.alias("in_index")
    )
    sides = [in_buckets(side, buckets, id_col, tags) for side in (source, index)]
    return alike.unionByName(joined_counts(*sides, id_col, tags))


def joined_counts(source: DataFrame, index: DataFrame, id_col: str, tags: Sequence[str] = ()) -> DataFrame:
    """(tags, id, in_source, in_index); both sides are counted before they meet, so an id said often is a row per task."""
    keys = [*tags, id_col]
    left = source.groupBy(*keys).agg(F.count("*").alias("in_source"))
    right = index.groupBy(*keys).agg(F.count("*").alias("in_index"))
    return left.join(right, keys, "full_outer").select(
        *keys, F.coalesce("in_source", F.lit(0)).alias("in_source"), F.coalesce("in_index", F.lit(0)).alias("in_index")
    )


def digests(rows: DataFrame, id_col: str, bits: int) -> DataFrame:
    """Row number and two order-free sums of hashes per range of ids."""
    return rows.groupBy(F.shiftright(F.col(id_col), bits).alias("_range")).agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64(id_col)).alias("xor"),
        F.sum(F.hash(id_col).cast("long")).alias("sum"),
    )


def unlike_ranges(source: DataFrame, index: DataFrame, id_col: str, bits: int) -> DataFrame:
    """Ranges of ids whose digests differ, written once; both sides may be cut down to wider ranges before."""
    alike = F.lit(True)
    for column in ("n", "xor", "sum"):
        alike = alike & (F.col(column) == F.col(f"{column}_r"))
    left, right = (digests(side, id_col, bits) for side in (source, index))
    return freeze(_unlike(left, right, ["_range"], alike & F.col("_range").isNotNull()))


def in_ranges(rows: DataFrame, ranges: DataFrame, id_col: str, bits: int) -> DataFrame:
    cut = rows.withColumn("_range", F.shiftright(F.col(id_col), bits))
    return _matching(cut, ranges, ["_range"], "left_semi").drop("_range")


def differing_counts(source: DataFrame, index: DataFrame, id_col: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """(id, in_source, in_index) of the ids that one side has more often than the other."""
    source, index = source.select(id_col), index.select(id_col)
    for bits in levels:
        ranges = unlike_ranges(source, index, id_col, bits)
        source, index = (in_ranges(side, ranges, id_col, bits) for side in (source, index))
    return joined_counts(source, index, id_col).where("in_source <> in_index")
