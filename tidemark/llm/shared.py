"""Reading of input tables, folds and scratch tables used by several operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: the space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
#: A word between white space.
WORD = r"[^\x20\x09-\x0D]+"


def workers_import(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it; a cluster may also have it installed."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(column: Column, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; null where the value is null."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names; without one, writing intermediates is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that does not exist yet."""
    return f"{shared_folder(spark)}/tidemark-llm/{label}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """``frame`` written to the shared folder and read back: lineage is cut, a lost executor loses nothing."""
    spark = frame.sparkSession
    path = scratch(spark, label)
    frame.write.option("compression", codec).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def freed(function: Callable) -> Callable:
    """``function`` of a task's batches, with memory that is free given back to the system before and after.

    Workers serve many tasks; the C library and Arrow keep what earlier ones have freed.
    """

    def run(batches):
        _give_back()
        # Nothing here makes cycles, and looking for them among so many strings takes time.
        gc.disable()
        try:
            yield from function(batches)
        finally:
            gc.enable()
            _give_back()

    return run


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # Another C library, which gives back by itself or not at all.


def utf8(texts) -> list[bytes]:
    """Texts as UTF-8 bytes; null is the empty text."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def integers(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64)


def unused(name: str, columns) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
