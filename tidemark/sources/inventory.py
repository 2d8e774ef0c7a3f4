"""Object inventories: a stored listing, or a live one of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inventory import directory_prefix


def scan_object_inventory(inventory: DataFrame, prefix: str = "") -> DataFrame:
    """Every object below a prefix, at any depth. The prefix test reaches the file scan."""
    return inventory.filter(F.col("key").startswith(directory_prefix(prefix)))


def list_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Live listing of a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.col("path").alias("key"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("last_modified"),
        F.lit("application/octet-stream").alias("content_type"),
    )
