"""Session settings the operators rely on."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that change results (time zone, duplicate map keys), let a hot join
#: key be split although an aggregate on the same key follows, or keep state small.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Stream state on the executors' disks, not in their heaps.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "tidemark", cores: int | str = 8, folder: str | None = None) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own.

    ``folder`` takes intermediates, unless the machine's settings already name one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    )
    if folder is not None:
        builder = builder.config("spark.checkpoint.dir", folder)
    spark = configure(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as ``spark.checkpoint.dir`` or the context's checkpoint folder names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rsplit("/", 1)[0]
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share, before the session starts")


#: Folders that ``scratch`` has named and ``release`` has not deleted.
_HELD: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder, deleted by ``release``."""
    if not _HELD:
        atexit.register(_release_at_exit, spark)
    _HELD.append(f"{shared_folder(spark)}/tidemark/{label}-{uuid.uuid4().hex}")
    return _HELD[-1]


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete intermediates; frames that were made from them can't be read any more."""
    paths = _HELD[since:]
    del _HELD[since:]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        for name in (path, f"{path}-progress"):
            target = hadoop.Path(name)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _release_at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        release(spark)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end of the block, the intermediates that were made inside."""
    since = len(_HELD)
    try:
        yield
    finally:
        release(spark, since)


def freeze(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder, once, and go on from the files.

    Needed wherever two passes must see the very same split of the rows (range
    boundaries are sampled, so a recomputed exchange may cut elsewhere).
    """
    path = scratch(df.sparkSession, "frozen")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
