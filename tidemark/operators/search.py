"""Prefix search, result pages and suggestions over node fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SUGGEST_FIELDS = ("name", "title", "description", "content")
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: t != "")


def prefix_matches(field: str, prefix: str, whole_value: bool = False, ignore_case: bool = True) -> Column:
    """Does the field, or any word of it, start with the prefix?

    A case-sensitive test of the whole value is a plain ``startswith``, which
    reaches the file scan.
    """
    column = F.col(field)
    if not ignore_case:
        if whole_value:
            return column.startswith(prefix)
        return F.exists(F.split(column, TOKEN_BREAK), lambda t: t.startswith(prefix))
    if whole_value:
        return F.lower(column).startswith(prefix.lower())
    return F.exists(tokens(column), lambda t: t.startswith(prefix.lower()))


def field_prefix_search(rows: DataFrame, field: str, prefix: str, **options) -> DataFrame:
    return rows.filter(prefix_matches(field, prefix, **options))


def search_page(hits: DataFrame, key: str, limit: int, offset: int = 0) -> DataFrame:
    """One page of the hits in key order; each row carries the total number of hits.

    The page is a top-k of the scan and the total an aggregate of a second one that needs no columns but those searched;
    nothing is stored.
    """
    page = hits.orderBy(key).offset(offset).limit(limit)
    return page.withColumn("total_items", search_total(hits).scalar())


def search_total(hits: DataFrame) -> DataFrame:
    return hits.agg(F.count("*").alias("total_items"))


def suggest_terms(
    rows: DataFrame, prefix: str, limit: int = 10, fields: Sequence[str] = SUGGEST_FIELDS
) -> DataFrame:
    """Most frequent words with a prefix over all suggest fields.

    Ranked by count, then alphabetically. Words are filtered inside a text's
    array, before they become rows, and counted per task before the shuffle. A
    field that the rows lack is an error.
    """
    missing = [f for f in fields if f not in rows.columns]
    if missing:
        raise ValueError(f"no such fields: {', '.join(missing)}")
    whole = F.lower(F.concat_ws(" ", *[F.col(f) for f in fields]))
    wanted = F.filter(F.split(whole, TOKEN_BREAK), lambda t: (t != "") & t.startswith(prefix.lower()))
    counted = rows.select(F.explode(wanted).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "term").limit(limit)


def facet_counts(rows: DataFrame, fields: Sequence[str], top: int | None = None) -> DataFrame:
    """Value counts of several fields at once, optionally the ``top`` values of each."""
    long = rows.select(
        F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
        ).alias("_f")
    ).select("_f.field", "_f.value")
    counted = long.filter("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    if top is None:
        return counted
    # The rank limit is applied in every task before the rows of a field meet.
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def reindex_by_query(index_nodes: DataFrame, names: DataFrame, field: str, prefix: str) -> DataFrame:
    """Ids of indexed nodes that match a query, to be queued for reindexing."""
    hits = field_prefix_search(names, field, prefix).select("node_id")
    return index_nodes.select("node_id").join(hits, "node_id", "left_semi")
