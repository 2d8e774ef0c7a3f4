"""Streaming reads of a feed that arrives as parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_feed(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of new files; the file limit plays the part of the page cap."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_commit_ts(feed: DataFrame) -> DataFrame:
    """The commit time as a timestamp, as watermarks need it."""
    return feed.withColumn("commit_ts", F.timestamp_millis("commit_time_ms"))


def run_available(query: StreamingQuery) -> None:
    """Wait until everything that is there has been processed; errors surface here."""
    query.awaitTermination()
