"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next one's documents. All but the last keep the columns of documents.

Null texts are empty ones. Documents without words have no near duplicates and no benchmark passages, and take no words of
the mix; whether they get that far the classifier decides by its intercept. Rows that repeat in full are near duplicates of
each other unless they are empty. Of equal scores none goes before another: each document is judged by itself, and
groups keep their least doc_id. An empty table, and an empty result of any stage, gives empty results from there on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, neardup, quality, tokenfile
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.shared import stored, table, workers_import


#: Texts that go to a Python worker at once. Stages follow each other in the same executors, so what one holds counts
#: for the next; whole batches of long texts stand in memory three times.
BATCH_ROWS = 1000
#: Bytes of words that the encoder remembers here; the workers also hold what earlier stages have left.
ENCODER_MEMORY = 24_000_000


def prepared(spark: SparkSession) -> None:
    workers_import(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepared(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity 0.8 or more."""
    prepared(spark)
    return neardup.keep_one(docs, similarity=0.8, shingle=5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those made of them mostly go."""
    prepared(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, in the sources' target weights."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's ids, written in files and read back: start, count and checksum of each document."""
    prepared(spark)
    return tokenfile.digest(tokenfile.token_files(docs, tokenizer_path(), memory=ENCODER_MEMORY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_quality),
    ("near duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixture", mixed_sources),
    ("token files", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifier, draws and tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
