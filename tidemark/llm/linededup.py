"""Line deduplication: lines that many documents share are dropped from all of them.

Lines are exploded as 128-bit hashes of their keys (never as text) and each hash is
counted once per document, summed before the shuffle. The shared hashes are written
out, so that Spark knows their size: it sends them to all executors when they are few,
and else splits the rows of a hot line between tasks. Only positions of lines to drop
go back to the documents, where the others are joined again in order.

A document is a row of the table. Null and empty texts are one empty line; rows that
repeat in full count one by one and get the same result; an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import stored, unused

MIN_POINTS = 1
MIN_DOCUMENTS = 10
_SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_keys(text: Column) -> Column:
    """The keys of all lines, in order."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.transform(lines, lambda line: F.translate(F.btrim(line, F.lit(_SPACE)), _UPPER, _UPPER.lower()))


def dedup_lines(
    documents: DataFrame, min_documents: int = MIN_DOCUMENTS, min_points: int = MIN_POINTS, key: str = "doc_id"
) -> DataFrame:
    """Documents with ``text`` cut to the lines that stay, and n_lines and n_dropped as last columns.

    A key of at least ``min_points`` code points that at least ``min_documents`` documents hold loses its lines.
    Columns of the names n_lines and n_dropped are replaced; all others stay.
    """
    name, at = unused("_id", documents.columns), unused("_at", documents.columns)
    digest_name = unused("_text", documents.columns)
    hashes = F.transform(
        line_keys(F.col("text")),
        lambda k: F.when(
            F.length(k) >= min_points, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))
        ),
    )
    text_hash = F.xxhash64("text")
    slim = stored(documents.select(F.col(key).alias("id"), text_hash.alias("of"), hashes.alias("hashes")), "lines")
    shared = stored(
        slim.select(F.explode(F.array_distinct("hashes")).alias("hash"))
        .where(F.col("hash").isNotNull())
        .groupBy("hash.a", "hash.b")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_documents)
        .select("a", "b"),
        "shared-lines",
    )
    each = slim.select("id", "of", F.posexplode("hashes").alias("at", "hash")).where(F.col("hash").isNotNull())
    drop = stored(
        each.select("id", "of", "at", "hash.a", "hash.b")
        .join(shared, ["a", "b"])
        .groupBy("id", "of")
        .agg(F.collect_set("at").alias(at))
        .select(F.col("id").alias(name), F.col("of").alias(digest_name), at),
        "dropped-lines",
    )
    same = documents[key].eqNullSafe(drop[name]) & text_hash.eqNullSafe(drop[digest_name])
    others = [c for c in documents.columns if c not in ("n_lines", "n_dropped")]
    # The same plan at every size: one shuffle of the texts, however few positions there are.
    joined = documents.join(drop.hint("merge"), same, "left").select(*[F.col(f"`{c}`") for c in others], at)
    place = others.index("text")
    schema = T.StructType(
        [
            *[documents.schema[c] if c != "text" else T.StructField("text", T.StringType()) for c in others],
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
        ]
    )

    def reassembled(batches):
        for batch in batches:
            texts, counts, dropped = [], [], []
            for text, gone in zip(batch["text"].to_pylist(), batch[at].to_pylist(), strict=True):
                text = text or ""
                counts.append(text.count("\n") + 1)
                dropped.append(len(gone or ()))
                if gone:
                    gone = set(gone)
                    text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
                texts.append(text)
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            columns += [pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(reassembled, schema)


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )
