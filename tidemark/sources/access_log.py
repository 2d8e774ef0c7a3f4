"""Request logs in the common NCSA format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed format: host, identity, user, [time], "request", status, bytes.
LINE = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+)[^"]*" (\d{3}) (\d+|-)'
TIME = "dd/MMM/yyyy:HH:mm:ss Z"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _read(lines: DataFrame) -> DataFrame:
    """Every line with its columns; ``ok`` tells whether all of them could be read."""
    text = F.col("value")
    # One match per line: the groups are joined by a character no log line holds, then split.
    groups = F.split(F.regexp_replace(text, LINE + ".*$", "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6"), "\u0001")
    matched = F.coalesce(text.rlike(LINE), F.lit(False))
    parts = lines.withColumn("_g", F.when(matched, groups))
    size = F.col("_g")[5]
    fields = parts.select(
        *lines.columns,
        F.col("_g")[0].alias("host"),
        F.unix_millis(F.try_to_timestamp(F.col("_g")[1], F.lit(TIME))).alias("ts_ms"),
        F.col("_g")[2].alias("method"),
        F.col("_g")[3].alias("path"),
        F.col("_g")[4].try_cast("int").alias("status"),
        size.try_cast("long").alias("bytes"),
        (size == "-").alias("_no_size"),
    )
    sized = F.col("_no_size") | F.col("bytes").isNotNull()
    ok = F.col("host").isNotNull() & F.col("ts_ms").isNotNull() & F.col("status").isNotNull() & sized
    return fields.withColumn("ok", F.coalesce(ok, F.lit(False)))


def scan_access_log(lines: DataFrame) -> DataFrame:
    """Request lines as columns; a line in another format, or with a time or size that is none, is left to
    ``rejected_lines``."""
    return _read(lines).filter("ok").select("host", "ts_ms", "method", "path", "status", "bytes")


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The lines that ``scan_access_log`` leaves out, null ones too: both together are all lines."""
    return _read(lines).filter("NOT ok").select(*lines.columns)
