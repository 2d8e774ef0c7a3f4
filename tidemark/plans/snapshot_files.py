"""Named snapshots of tables as files, with a manifest of checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.snapshots import compare_manifests

#: Keeps a file far below the size one row may have when it is read whole for its checksum.
MAX_ROWS_PER_FILE = 1_000_000


def data_folder(root: str, name: str) -> str:
    return f"{root}/snapshot.{name}"


def manifest_folder(root: str, name: str) -> str:
    return f"{root}/manifests/snapshot.{name}"


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Key (below the folder), size and checksum of every data file; files are read by the executors."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
    )
    last = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(
        F.substring_index("path", f"/{last}/", -1).alias("key"),
        F.col("length").alias("size"),
        F.crc32("content").cast("string").alias("checksum"),
    )


def snapshot_write(tables: dict[str, DataFrame], root: str, name: str) -> DataFrame:
    """Write the tables as a new snapshot; the manifest comes last and makes it one."""
    spark = next(iter(tables.values())).sparkSession
    folder = data_folder(root, name)
    for table, rows in tables.items():
        rows.write.option("maxRecordsPerFile", MAX_ROWS_PER_FILE).parquet(f"{folder}/{table}")
    file_manifest(spark, folder).write.parquet(manifest_folder(root, name))
    return stored_manifest(spark, root, name)


def stored_manifest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(manifest_folder(root, name))


def snapshot_verify(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Each file of the snapshot as ok, changed, missing or extra; an empty file counts as changed."""
    compared = compare_manifests(stored_manifest(spark, root, name), file_manifest(spark, data_folder(root, name)))
    empty = file_manifest(spark, data_folder(root, name)).filter("size = 0").select("key", F.lit(True).alias("_empty"))
    status = F.when(F.col("_empty") & (F.col("status") == "ok"), "changed").otherwise(F.col("status"))
    return compared.join(empty, "key", "left").select("key", status.alias("status"))


def snapshot_restore(spark: SparkSession, root: str, name: str, tables: list[str]) -> tuple[DataFrame, dict]:
    """Status row and, if the snapshot is sound, its tables."""
    report = snapshot_verify(spark, root, name).groupBy("status").agg(F.count("*").alias("files"))
    bad = report.filter("status <> 'ok'")
    status = bad.agg(
        F.lit(name).alias("snapshot"),
        F.when(F.count("*") == 0, "success").otherwise("failed").alias("status"),
        F.coalesce(F.sum("files"), F.lit(0)).alias("bad_files"),
    )
    if not bad.isEmpty():
        return status, {}
    folder = data_folder(root, name)
    return status, {t: spark.read.parquet(f"{folder}/{t}") for t in tables}
