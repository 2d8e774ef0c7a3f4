"""Searching by sorted term tables instead of by texts.

Postings are (field, term, id), stored as (field, term, ids), a row for each term of a stretch of texts;
a dictionary is (term, n). Both are written in the order of their terms, split by
range. A prefix is a range of terms, so it reaches the scan as two bounds, files and row groups beside it are skipped by
their statistics, and texts are cut into words once instead of for every search. A frequent term is spread over files, as
its rows are split by their first ids, too.

A dictionary is kept as runs: each run writes the counts that its texts add, or take away, and a search sums up its range of
all runs. Merging runs into one is the same sum over all terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from tidemark.operators.search import SUGGEST_FIELDS, tokens
from tidemark.session import freeze

#: Words are gathered by term in stretches of about so many bytes, which bounds the memory a task takes.
STRETCH = 32_000_000


def postings(rows: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, term, key) for each field of each row: its words, each once, as one array."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    each = rows.select(key, F.inline(texts))
    return each.select("field", F.array_distinct(tokens(F.col("text"))).alias("term"), key)


def _by_term(stretch: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each term of a stretch of rows, with all its keys in the order they came."""

    # Functions inside this one reach Python workers whole, which then need not have this package.
    def lists(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        names = rows.column_names
        field, words, key = (column.combine_chunks() for column in rows.columns)
        row = pc.list_parent_indices(words)
        each = pa.table([field.take(row), words.flatten(), key.take(row)], ["field", "term", "key"])
        found = each.group_by(["field", "term"], use_threads=False).aggregate([("key", "list")])
        yield from found.select(["field", "term", "key_list"]).rename_columns(names).to_batches(max_chunksize=10_000)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= stretch:
                yield from lists(held)
                held, size = [], 0
        if held:
            yield from lists(held)

    return gathered


def write_postings(found: DataFrame, path: str, parts: int | None = None) -> None:
    """One folder of files of (field, term, keys) whose (field, term, first key) ranges do not overlap."""
    field, term, key = found.schema.fields
    schema = StructType([field, StructField(term.name, term.dataType.elementType), StructField(key.name, ArrayType(key.dataType))])
    # Ranges are sampled, so texts would be cut into words again for the sample.
    lists = freeze(found.mapInArrow(_by_term(STRETCH), schema))
    order = [field.name, term.name, F.col(key.name)[0]]
    cut = lists.repartitionByRange(*order) if parts is None else lists.repartitionByRange(parts, *order)
    cut.sortWithinPartitions(*order).write.parquet(path)


def after_prefix(prefix: str) -> str | None:
    """The least text above all that start with ``prefix``, in the order of code points; none for the last of all."""
    for i in range(len(prefix) - 1, -1, -1):
        point = ord(prefix[i]) + 1
        # Surrogates are no characters of their own.
        point = 0xE000 if 0xD800 <= point < 0xE000 else point
        if point <= 0x10FFFF:
            return prefix[:i] + chr(point)
    return None


def in_prefix(column: str, prefix: str) -> Column:
    """Whether a term starts with the prefix, as bounds that a scan can use."""
    end = after_prefix(prefix)
    above = F.col(column) >= prefix
    return above if end is None else above & (F.col(column) < end)


def search(found: DataFrame, field: str, prefix: str) -> DataFrame:
    """Keys of rows with a word of the field that starts with the prefix, each once, from what ``write_postings`` wrote."""
    key = found.columns[-1]
    lists = found.where((F.col("field") == field) & in_prefix("term", prefix.lower()))
    return lists.select(F.explode(key).alias(key)).distinct()


def reindex_by_postings(index_nodes: DataFrame, found: DataFrame, field: str, prefix: str) -> DataFrame:
    """Ids of indexed nodes that match a query, to be queued for reindexing."""
    return index_nodes.select("node_id").join(search(found, field, prefix), "node_id", "left_semi")


def dictionary(rows: DataFrame, fields: Sequence[str] = SUGGEST_FIELDS, sign: int = 1) -> DataFrame:
    """(term, n): how often the fields say each word; with a ``sign`` of -1, what rows that go take away."""
    whole = F.concat_ws(" ", *[F.col(f) for f in fields])
    return rows.select(F.explode(tokens(whole)).alias("term")).groupBy("term").agg((F.count("*") * sign).alias("n"))


def merged(runs: DataFrame) -> DataFrame:
    """One dictionary for many runs; terms that are gone leave it."""
    return runs.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0")


def write_dictionary(found: DataFrame, path: str, parts: int | None = None) -> None:
    """Append one run, in the order of its terms."""
    cut = found.repartitionByRange("term") if parts is None else found.repartitionByRange(parts, "term")
    cut.sortWithinPartitions("term").write.mode("append").parquet(path)


def suggest(runs: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """The most frequent words with a prefix, then alphabetically, from the range of the runs that holds them."""
    return merged(runs.where(in_prefix("term", prefix.lower()))).orderBy(F.desc("n"), "term").limit(limit)
