"""Which snapshots there are, which is the latest, which to keep, and whether they are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.maps import pairs_to_map
from tidemark.functions.paths import DIRECTORY_TYPE, snapshot_name
from tidemark.operators.ordered import with_previous

SNAPSHOT_WORD = "snapshot"
RESTORE_MAX_KB = 100  # a larger index is left alone


def is_marker(inventory: DataFrame) -> Column:
    """A directory marker: its key ends in a slash, or it has the directory type. An empty file is a file."""
    slash = F.col("key").endswith("/")
    if "content_type" not in inventory.columns:
        return slash
    return slash | F.coalesce(F.lower("content_type") == DIRECTORY_TYPE, F.lit(False))


def snapshot_markers(inventory: DataFrame) -> DataFrame:
    """Marker keys of snapshots; a snapshot copied from elsewhere has none."""
    return inventory.filter(is_marker(inventory) & F.col("key").contains(SNAPSHOT_WORD)).select("key")


def snapshot_list(inventory: DataFrame) -> DataFrame:
    """Files, bytes, last change and marker of each snapshot."""
    name, marker = snapshot_name(F.col("key")), is_marker(inventory)
    return (
        inventory.withColumn("snapshot", name)
        .filter("snapshot is not null")
        .groupBy("snapshot")
        .agg(
            F.count_if(~marker).alias("files"),
            F.sum("size").alias("bytes"),
            F.max("last_modified").alias("last_modified"),
            F.bool_or(marker).alias("has_marker"),
        )
    )


def snapshot_latest(inventory: DataFrame) -> DataFrame:
    """Name of the snapshot with the most recently modified object (ties: largest key)."""
    newest = inventory.filter(F.col("key").contains(SNAPSHOT_WORD)).agg(
        F.max_by("key", F.struct("last_modified", "key")).alias("key")
    )
    return newest.select(snapshot_name(F.col("key")).alias("snapshot"), "key")


def snapshot_retain(snapshots: DataFrame, keep: int) -> DataFrame:
    """Decision for each snapshot: keep the newest ``keep``, delete the others.

    The newest are found as a top-k, the rest by an anti join, so that not even
    the list of snapshots is ranked in one task.
    """
    newest = snapshots.orderBy(F.desc("last_modified"), F.desc("snapshot")).limit(keep)
    kept = newest.select("snapshot", F.lit("keep").alias("decision"))
    gone = snapshots.join(kept, "snapshot", "left_anti").select("snapshot", F.lit("delete").alias("decision"))
    return kept.unionByName(gone)


def retained_objects(inventory: DataFrame, keep: int) -> DataFrame:
    """The objects that retention removes."""
    gone = snapshot_retain(snapshot_list(inventory), keep).filter("decision = 'delete'")
    named = inventory.withColumn("snapshot", snapshot_name(F.col("key")))
    return named.join(gone, "snapshot", "left_semi").select("snapshot", "key", "size")


def restore_decision(
    inventory: DataFrame, asked: bool, restored_before: bool, index_kb: int | None, name: str | None = None
) -> DataFrame:
    """One row: restore or not, which snapshot, and why.

    Restore only if asked to, never twice, and only over an index that is absent
    or no larger than the limit. A given name wins over the latest snapshot.
    """
    reason = (
        F.when(~F.lit(asked), "not requested")
        .when(F.lit(restored_before), "already restored")
        .when(F.lit(index_kb).cast("long").isNull(), "no index")
        .when(F.lit(index_kb).cast("long") > RESTORE_MAX_KB, "index is large enough")
        .otherwise("index is small")
    )
    chosen = F.coalesce(F.lit(name).cast("string"), F.col("snapshot"))
    restore = reason.isin("no index", "index is small")
    return snapshot_latest(inventory).select(
        restore.alias("restore"), F.when(restore, chosen).alias("snapshot"), reason.alias("reason")
    )


def snapshot_status(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Last result of each snapshot from polled detail records.

    ``records`` has (snapshot, ts_ms, event_id, pairs). A record equal to the
    one polled before it is not a new result.
    """
    fields = records.select("snapshot", "ts_ms", "event_id", pairs_to_map(F.col("pairs")).alias("_map"))
    read = fields.select(
        "snapshot",
        "ts_ms",
        "event_id",
        F.size("_map").alias("fields"),
        *[
            F.col("_map")[key].alias(name)
            for key, name in (
                ("status", "status"),
                ("snapshotCompletedAt", "completed_at"),
                ("fileCount", "file_count"),
                ("exception", "exception"),
            )
        ],
        # Maps do not compare; their sorted entries do.
        F.to_json(F.sort_array(F.map_entries("_map"))).alias("_record"),
    )
    seen = with_previous(read, ["snapshot", "ts_ms", "event_id"], ["snapshot", "_record"], parts=parts)
    repeated = F.col("prev_snapshot").eqNullSafe(F.col("snapshot")) & (F.col("prev__record") == F.col("_record"))
    fresh = seen.filter(~F.coalesce(repeated, F.lit(False)))
    last = F.struct("status", "completed_at", "file_count", "exception", "fields")
    return (
        fresh.groupBy("snapshot")
        .agg(F.max_by(last, F.struct("ts_ms", "event_id")).alias("_last"), F.count("*").alias("results"))
        .select("snapshot", "_last.*", "results")
    )


def compare_manifests(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Each file of either side as ok, changed, missing or extra (by checksum and size)."""
    then = manifest.select("key", F.struct("size", "checksum").alias("_then"))
    now = current.select("key", F.struct("size", "checksum").alias("_now"))
    verdict = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("_then").isNull(), "extra")
        .when(F.col("_then").eqNullSafe(F.col("_now")), "ok")
        .otherwise("changed")
    )
    return then.join(now, "key", "full_outer").select("key", verdict.alias("status"))
