"""Index tables as parquet directories that change in one step.

A table is split into buckets of consecutive ids. A commit writes the touched
buckets anew, below a directory of its own, then a manifest that names the
directory of every bucket of every table, and last a version file that names the
manifest. A version file is created only if there is none of its number: that is
the commit. Of two writers one comes first; the other finds the number taken,
reads the new manifest, does again what has changed under it and takes the next
number. Readers follow the newest version, so a run that dies half-way is never
seen, and data and markers change together.

Stretches of ids are dealt to a bounded number of buckets, so sparse ids give no
more of them, and a manifest has at most that many rows for each table.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.operators.mutate import upsert_acls, upsert_nodes, write_markers
from tidemark.operators.pending import recover_state
from tidemark.plans.track import AclRun, NodeRun, Scope, TrackerState, track_acls_once, track_once

BUCKET = "bucket"
MANIFEST = "version long, run string, table_name string, bucket long, path string, marks map<string,long>"
#: Tries of a commit that other writers get ahead of.
TRIES = 20


class Conflict(RuntimeError):
    """Other writers kept getting ahead of a commit."""


@dataclass(frozen=True)
class TableSpec:
    key: str
    schema: str
    width: int = 4_000_000
    order: tuple[str, ...] = ()
    buckets: int = 4096


SPECS = {
    "nodes": TableSpec(
        "node_id",
        "node_id long, tx_id long, acl_id long, node_ref string, tenant string, status string",
    ),
    "index_tx": TableSpec("tx_id", "tx_id long, commit_time_ms long", 64_000_000),
    "acls": TableSpec("acl_id", "acl_id long, authority string", order=("authority",)),
    "index_change_sets": TableSpec("change_set_id", "change_set_id long, commit_time_ms long", 64_000_000),
}


class IndexStore:
    """The index tables of one deployment below ``root``."""

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, TableSpec] | None = None):
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs or SPECS

    # files

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, text: str) -> bool:
        """Write a small file that must not be there yet; False if it is."""
        try:
            stream = self._files().create(self._path(name), False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _text(self, name: str) -> str | None:
        files, path = self._files(), self._path(name)
        if not files.exists(path):
            return None
        stream = files.open(path)
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def _versions(self) -> list[int]:
        """Numbers of the versions, newest first: names alone are listed."""
        files, path = self._files(), self._path("versions")
        if not files.exists(path):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path)]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    # reading

    def manifest(self) -> list:
        """Rows of the newest manifest: at most one per bucket, and one without a table."""
        for version in self._versions():
            # Empty as long as its writer is still at it.
            if text := self._text(f"versions/{version:012d}"):
                return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{json.loads(text)['manifest']}").collect()
        return []

    def marks(self, manifest: list | None = None) -> dict[str, int]:
        rows = self.manifest() if manifest is None else manifest
        return dict(rows[0]["marks"] or {}) if rows else {}

    def has_run(self, run: str) -> bool:
        """Whether a run of this name is in: one small file tells its version, however many there have been."""
        noted = self._text(f"runs/{quote(run, safe='')}")
        if not noted:
            return False
        claim = self._text(f"versions/{int(noted):012d}")
        return bool(claim) and json.loads(claim)["run"] == run

    def read(self, table: str, buckets: list[int] | None = None, manifest: list | None = None) -> DataFrame:
        """A table, or some of its buckets, as of the newest or the given manifest."""
        wanted = None if buckets is None else set(buckets)
        paths = [
            f"{self.root}/{r['path']}"
            for r in (self.manifest() if manifest is None else manifest)
            if r["table_name"] == table and (wanted is None or r[BUCKET] in wanted)
        ]
        schema = StructType.fromDDL(self.specs[table].schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # writing

    def _bucket_of(self, table: str):
        spec = self.specs[table]
        return F.expr(f"pmod({spec.key} div {spec.width}, {spec.buckets})")

    def commit(
        self,
        run: str,
        changes: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
        marks: dict[str, int] | None = None,
        old: list | None = None,
    ) -> None:
        """Apply changes to several tables in one step; a run that is already in is left alone.

        ``changes`` has, for each table in the order of writing, the touched
        keys and a function from the old rows of the touched buckets to the new.
        ``old`` is the manifest the changes were made from. If another commit
        comes first, buckets that it has changed are made again from its rows.
        """
        if self.has_run(run):
            return
        base = self.manifest() if old is None else old
        written: dict[tuple[str, int], tuple[str | None, str | None]] = {}  # new path, and the one it was made from
        todo = set(changes)
        for _ in range(TRIES):
            version = (base[0]["version"] if base else 0) + 1
            paths = {(r["table_name"], r[BUCKET]): r["path"] for r in base if r["table_name"]}
            stale = {t for (t, b), (_, source) in written.items() if paths.get((t, b)) != source}
            for table, (keys, mutate) in changes.items():
                if table in todo | stale:
                    for bucket, path in self._write(table, keys, mutate, version, base).items():
                        written[table, bucket] = path, paths.get((table, bucket))
            todo = set()
            for place, (path, _) in written.items():
                if path is None:
                    paths.pop(place, None)
                else:
                    paths[place] = path
            merged = {**self.marks(base), **(marks or {})}
            rows = [(version, run, t, b, p, merged) for (t, b), p in paths.items()]
            folder = f"manifests/{version:012d}-{uuid.uuid4().hex}"
            manifest = self.spark.createDataFrame([*rows, (version, run, None, None, None, merged)], MANIFEST)
            manifest.coalesce(1).write.parquet(f"{self.root}/{folder}")
            if self._claim(version, run, folder):
                return
            base = self.manifest()
            if self.has_run(run):
                return
            if (base[0]["version"] if base else 0) + 1 == version:
                time.sleep(1)  # the other writer has the number, and not yet written what it names
        raise Conflict(f"{run}: other commits came first {TRIES} times, or one has died and left an empty version file")

    def _claim(self, version: int, run: str, folder: str) -> bool:
        """Take the version, unless another writer has; the run's note points to it."""
        # The note is only a hint and counts once the version names the same run.
        note = f"runs/{quote(run, safe='')}"
        self._files().delete(self._path(note), False)
        self._create(note, str(version))
        return self._create(f"versions/{version:012d}", json.dumps({"run": run, "manifest": folder}))

    def _write(self, table: str, keys: DataFrame, mutate, version: int, old: list) -> dict[int, str | None]:
        """New directory of each touched bucket, None for one that has become empty."""
        spec, bucket = self.specs[table], self._bucket_of(table)
        touched = [r[BUCKET] for r in keys.select(bucket.alias(BUCKET)).distinct().collect()]
        if not touched:
            return {}
        folder = f"data/{table}/{version:012d}-{uuid.uuid4().hex}"
        new = mutate(self.read(table, touched, old)).withColumn(BUCKET, bucket)
        # By range, so that a bucket with one huge key is written by several tasks.
        order = [BUCKET, spec.key, *spec.order]
        new = new.repartitionByRange(*order).sortWithinPartitions(*order)
        new.write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        schema = StructType.fromDDL(f"{spec.schema}, {BUCKET} long")
        written = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}").select(BUCKET).distinct().collect()
        filled = {r[BUCKET] for r in written}
        return {b: f"{folder}/{BUCKET}={b}" if b in filled else None for b in touched}

    # runs

    def replace(self, run: str, frames: dict[str, DataFrame], marks: dict[str, int] | None = None) -> None:
        """Set whole tables, as when a snapshot is restored: buckets of the old ones are replaced too."""
        changes = {}
        for table, rows in frames.items():
            key = self.specs[table].key
            keys = rows.select(key).unionByName(self.read(table).select(key))
            changes[table] = (keys, lambda _, rows=rows: rows)
        self.commit(run, changes, marks)

    def node_state(self, hole_ms: int = 3_600_000, stop_ms: int = 2**62) -> TrackerState:
        return self._state(self.manifest(), "tx", hole_ms, stop_ms)

    def acl_state(self, hole_ms: int = 3_600_000, stop_ms: int = 2**62) -> TrackerState:
        return self._state(self.manifest(), "set", hole_ms, stop_ms)

    def _state(self, manifest: list, feed: str, hole_ms: int, stop_ms: int) -> TrackerState:
        marks = self.marks(manifest)
        return TrackerState(marks.get(f"{feed}_ms", 0), marks.get(f"{feed}_id", 0), hole_ms, stop_ms)

    def track_nodes(
        self,
        run: str,
        feed: DataFrame,
        nodes: DataFrame,
        hole_ms: int = 3_600_000,
        stop_ms: int = 2**62,
        shard_count: int = 1,
        history: DataFrame | None = None,
        scope: Scope | None = None,
        late: bool = False,
    ) -> NodeRun | None:
        """One committed run of the metadata tracker; None if this run is already in.

        Nodes are written before their markers, and nothing counts before the commit. With ``late``, rows further back
        than the hole are taken too and counted in the mark ``late_tx``.
        """
        if self.has_run(run):
            return None
        old = self.manifest()
        index = [self.read(t, manifest=old) for t in ("nodes", "index_tx")]
        state = self._state(old, "tx", hole_ms, stop_ms)
        result = track_once(*index, feed, nodes, state, shard_count, history, scope, late)
        reached = result.state.first()
        behind = self._behind(result.todo, state) if late else 0
        self.commit(
            run,
            {
                "nodes": (result.changes, lambda base: upsert_nodes(base, result.changes)),
                "index_tx": (result.todo, lambda base: write_markers(base, result.todo, "tx_id")),
            },
            {
                "tx_ms": reached["commit_time_ms"],
                "tx_id": reached["tx_id"],
                "late_tx": self.marks(old).get("late_tx", 0) + behind,
            },
            old,
        )
        return result

    @staticmethod
    def _behind(todo: DataFrame, state: TrackerState) -> int:
        return todo.filter(F.col("commit_time_ms") < state.last_indexed_ms - state.hole_ms).count()

    def recover(self, run: str) -> None:
        """After a rollback: set the marks anew from the markers that are in the index."""
        manifest = self.manifest()
        marks = {}
        for feed, table, key in (("tx", "index_tx", "tx_id"), ("set", "index_change_sets", "change_set_id")):
            last = recover_state(self.read(table, manifest=manifest), key).first()
            marks |= {f"{feed}_ms": last["commit_time_ms"] or 0, f"{feed}_id": last[key] or 0}
        self.commit(run, {}, marks, manifest)

    def track_acls(
        self,
        run: str,
        feed: DataFrame,
        acls: DataFrame,
        readers: DataFrame,
        hole_ms: int = 3_600_000,
        stop_ms: int = 2**62,
        late: bool = False,
    ) -> AclRun | None:
        """One committed run of the ACL tracker; None if this run is already in. ``late`` as for nodes."""
        if self.has_run(run):
            return None
        old = self.manifest()
        index = [self.read(t, manifest=old) for t in ("acls", "index_change_sets")]
        state = self._state(old, "set", hole_ms, stop_ms)
        result = track_acls_once(*index, feed, acls, readers, state, late=late)
        reached = result.state.first()
        behind = self._behind(result.todo, state) if late else 0
        self.commit(
            run,
            {
                "acls": (result.changes, lambda base: upsert_acls(base, result.changes, readers)),
                "index_change_sets": (result.todo, lambda base: write_markers(base, result.todo, "change_set_id")),
            },
            {
                "set_ms": reached["commit_time_ms"],
                "set_id": reached["change_set_id"],
                "late_sets": self.marks(old).get("late_sets", 0) + behind,
            },
            old,
        )
        return result
