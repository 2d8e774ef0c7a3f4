"""Feed, index and inventory tables derived from the driver's parquet tables.

A deployment stores these tables; here every one is a declarative view over the
given parquet files, so that it grows with them (``store`` writes them out). The same definitions exist as
SQL in ``checks/views.py`` for the second engine.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.order import to_millis
from tidemark.operators.batch import latest_per_node
from tidemark.operators.mutate import NODE_COLUMNS
from tidemark.operators.ordered import with_running_sum
from tidemark.operators.pending import remember
from tidemark.session import freeze, scratch

#: Scalars of the example trackers (epoch milliseconds, UTC).
LAST_INDEXED_MS = 946_684_800_000  # 2000-01-01
HOLE_MS = 3_600_000
STOP_MS = 993_945_600_000  # 2001-07-01
ACL_LAST_INDEXED_MS = 1_705_276_800_000  # 2024-01-15
ACL_STOP_MS = 1_706_140_800_000  # 2024-01-25
SHARD_COUNT = 3

#: Store reference -> core. The names of the cores are the deployment's choice.
STORE_CORES = {
    "workspace://SpacesStore": "live",
    "archive://SpacesStore": "archive",
    "workspace://version2Store": "version",
}

_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One given table. Its schema is read from the files once, not for every view on it."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


_STORED: dict[tuple[str, str], tuple[str, StructType]] = {}
View = Callable[[SparkSession, str], DataFrame]
DERIVED: dict[str, View] = {}


def derived(view: View) -> View:
    """A view that is read from its stored copy if ``store`` has made one."""

    @functools.wraps(view)
    def read(spark: SparkSession, folder: str) -> DataFrame:
        stored = _STORED.get((folder, view.__name__))
        if stored is None:
            return view(spark, folder)
        path, schema = stored
        return spark.read.schema(schema).parquet(path)

    DERIVED[view.__name__] = read
    return read


def store(spark: SparkSession, folder: str, names: Sequence[str] = ()) -> None:
    """Write derived tables, as a deployment has them: feeds by commit time, the others as they come."""
    for name in names or DERIVED:
        rows = DERIVED[name](spark, folder)
        if "commit_time_ms" in rows.columns:
            rows = rows.repartitionByRange("commit_time_ms").sortWithinPartitions("commit_time_ms")
        path = scratch(spark, name)
        rows.write.parquet(path)
        _STORED[folder, name] = path, rows.schema


def forget_stored() -> None:
    _STORED.clear()


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    """What ``nodes`` is made of: its ids and flags, which are short and all of one width."""
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_partkey").alias("node_id"), F.col("l_orderkey").alias("tx_id"))
        .agg(
            # Fixed-width buffers only, so that this stays a hash aggregate.
            F.bool_and(F.col("l_returnflag") == "R").alias("_deleted"),
            F.min("l_suppkey").alias("acl_id"),
            F.min(F.ascii("l_linestatus")).alias("_property"),
        )
    )


def _described(versions: DataFrame, *more: str) -> DataFrame:
    """Versions with the texts that go with their ids and flags, and the columns named besides."""
    node = F.col("node_id")
    protocol = F.when(node % 10 == 0, "archive").otherwise("workspace")
    identifier = F.when(node % 10 == 1, "version2Store").otherwise("SpacesStore")
    return versions.select(
        "node_id",
        "tx_id",
        "acl_id",
        F.concat(protocol, F.lit("://"), identifier, F.lit("/"), node.cast("string")).alias("node_ref"),
        F.lit("").alias("tenant"),
        F.when(F.col("_deleted"), "DELETED").otherwise("UPDATED").alias("status"),
        protocol.alias("store_protocol"),
        identifier.alias("store_identifier"),
        F.char("_property").alias("shard_property"),
        *more,
    )


@derived
def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (transaction, node) with the node's status after that transaction."""
    return _described(_versions(spark, folder))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The feed's ids and times, without its counts."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("tx_id"), to_millis("o_orderdate").alias("commit_time_ms")
    )


@derived
def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return transactions_of(commits(spark, folder), nodes(spark, folder))


def transactions_of(feed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The feed: each commit with the nodes that it updates and deletes."""
    counts = nodes.groupBy("tx_id").agg(
        F.count_if(F.col("status") == "UPDATED").alias("updates"),
        F.count_if(F.col("status") == "DELETED").alias("deletes"),
    )
    return feed.join(counts, "tx_id", "left").select(
        "tx_id",
        "commit_time_ms",
        F.coalesce("updates", F.lit(0)).alias("updates"),
        F.coalesce("deletes", F.lit(0)).alias("deletes"),
    )


def nodes_and_transactions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both views, written once, for a job that reads them many times."""
    written = freeze(nodes(spark, folder), "zstd")
    return written, freeze(transactions_of(commits(spark, folder), written), "zstd")


@derived
def change_sets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("change_set_id"),
        to_millis("ts").alias("commit_time_ms"),
        F.when(F.col("event_type") == "view", 0).otherwise(1 + F.col("event_id") % 3).cast("int").alias("acl_count"),
    )


@derived
def acls(spark: SparkSession, folder: str) -> DataFrame:
    sets = table(spark, folder, "events").filter(F.col("event_type") != "view")
    step = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))).alias("i")
    return sets.select("event_id", "user_id", step).select(
        F.col("event_id").alias("change_set_id"), (F.col("user_id") + 7 * F.col("i")).alias("acl_id")
    )


@derived
def acl_readers(spark: SparkSession, folder: str) -> DataFrame:
    """Long form: one row per (ACL, authority)."""
    users = table(spark, folder, "events").agg((F.max("user_id") + 15).alias("n"))
    return (
        table(spark, folder, "customer")
        .select(
            (F.col("c_custkey") % users.scalar()).alias("acl_id"),
            F.concat(F.lit("GROUP_"), F.col("c_mktsegment")).alias("authority"),
        )
        .distinct()
    )


def _with_faults(markers: DataFrame, feed: DataFrame, id_col: str) -> DataFrame:
    """Drop some markers, repeat some and add some the source does not know."""
    key = F.col(id_col)
    kept = markers.filter(key % 50 != 7)
    repeated = kept.filter(key % 97 == 0)
    # Ids beyond the largest one, whatever the size of the feed.
    beyond = feed.agg((F.max(id_col) + 1).alias("n")).scalar()
    ghosts = feed.filter(key % 211 == 0).withColumn(id_col, key + beyond)
    return kept.unionByName(repeated).unionByName(ghosts)


@derived
def index_tx(spark: SparkSession, folder: str) -> DataFrame:
    feed = commits(spark, folder)
    return _with_faults(feed.filter(F.col("commit_time_ms") < LAST_INDEXED_MS), feed, "tx_id")


@derived
def index_change_sets(spark: SparkSession, folder: str) -> DataFrame:
    feed = change_sets(spark, folder).select("change_set_id", "commit_time_ms")
    return _with_faults(feed.filter(F.col("commit_time_ms") < ACL_LAST_INDEXED_MS), feed, "change_set_id")


@derived
def index_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Latest version of every node over the indexed transactions, deleted ones left out."""
    indexed = index_tx(spark, folder).select("tx_id", "commit_time_ms").distinct()
    # Only ids and flags are joined and ranked; texts come to the last versions alone.
    latest = latest_per_node(_versions(spark, folder).join(indexed, "tx_id"))
    return _described(latest).filter(F.col("status") != "DELETED").select(*NODE_COLUMNS)


@derived
def current_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """What the source holds now: each node once, in the transaction that touched it last."""
    latest = latest_per_node(_versions(spark, folder).join(commits(spark, folder), "tx_id"))
    rows = _described(latest, "commit_time_ms")
    return rows.select("tx_id", *[c for c in rows.columns if c != "tx_id"])


@derived
def index_acls(spark: SparkSession, folder: str) -> DataFrame:
    """Readers of the ACLs of the indexed change sets."""
    indexed = index_change_sets(spark, folder).select("change_set_id")
    wanted = acls(spark, folder).join(indexed, "change_set_id", "left_semi").select("acl_id")
    return acl_readers(spark, folder).join(wanted, "acl_id", "left_semi")


@derived
def objects(spark: SparkSession, folder: str) -> DataFrame:
    day = F.date_format("ts", "yyyyMMdd")
    events = table(spark, folder, "events")
    files = events.select(
        F.concat(F.lit("backups/snapshot."), day, F.lit("/"), "event_type", F.lit("_"), "event_id").alias("key"),
        F.round(F.col("value") * 1000).cast("long").alias("size"),
        F.col("ts").alias("last_modified"),
        F.lit("application/octet-stream").alias("content_type"),
    )
    markers = (
        events.groupBy(day.alias("day"))
        .agg(F.min("ts").alias("last_modified"))
        .select(
            F.concat(F.lit("backups/snapshot."), "day", F.lit("/")).alias("key"),
            F.lit(0).cast("long").alias("size"),
            "last_modified",
            F.lit("application/x-directory").alias("content_type"),
        )
    )
    return files.unionByName(markers)


@derived
def requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("ts"),
        to_millis("ts").alias("ts_ms"),
        F.when(F.col("user_id") % 2 == 0, "/afts").otherwise("/cmis").alias("handler"),
        F.col("value").alias("elapsed_ms"),
        (F.col("event_type") == "error").alias("is_error"),
        (F.col("value") > 200).alias("is_timeout"),
    )


@derived
def cache_events(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.col("event_type").isin("view", "click")
    return table(spark, folder, "events").select(
        F.concat(F.lit("cache_"), (F.col("user_id") % 9).cast("string")).alias("cache"),
        hit.alias("hit"),
        (~hit).alias("insert"),
        (F.col("event_type") == "error").alias("evict"),
        to_millis("ts").alias("ts_ms"),
    )


@derived
def doc_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Document count of each core, sampled at every full minute the events span."""
    minute = F.col("ts_ms") - F.col("ts_ms") % 60_000 + 60_000
    events = table(spark, folder, "events").select(
        (F.col("user_id") % SHARD_COUNT).alias("core"), to_millis("ts").alias("ts_ms")
    )
    per_minute = events.groupBy("core", minute.alias("sample_ms")).agg(F.count("*").alias("n"))
    span = events.agg(F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    ticks = span.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARD_COUNT - 1).cast("long"))).alias("core"), "lo", "hi"
    ).select(
        "core",
        F.explode(
            F.sequence(F.col("lo") - F.col("lo") % 60_000, F.col("hi") - F.col("hi") % 60_000 + 60_000, F.lit(60_000))
        ).alias("sample_ms"),
    )
    grown = ticks.join(per_minute, ["core", "sample_ms"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = with_running_sum(grown, ["core", "sample_ms"], F.col("n"), "before")
    first = totals.groupBy("core").agg(F.min("before").alias("start"))
    return totals.join(first, "core").select(
        F.concat(F.lit("core-"), F.col("core").cast("string")).alias("core"),
        F.col("sample_ms"),
        (F.col("before") - F.col("start") + F.col("n")).alias("docs"),
    )


@derived
def access_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Request-log lines; of a hundred one is broken, one has no such day and one a size beyond 64 bits."""
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    shape = F.col("event_id") % 100
    line = F.concat(
        F.lit("10.0.0."),
        (F.col("user_id") % 250).cast("string"),
        F.lit(" - - ["),
        F.when(shape == 98, "99/Foo/2024").otherwise(F.date_format("ts", "dd/MMM/yyyy")),
        F.date_format("ts", ":HH:mm:ss"),
        F.lit(' +0000] "GET /'),
        "event_type",
        F.lit(' HTTP/1.1" '),
        status,
        F.lit(" "),
        F.when(shape == 97, "99999999999999999999").otherwise(F.round(F.col("value") * 1000).cast("long").cast("string")),
    )
    broken = F.concat(F.lit("malformed "), F.col("event_id").cast("string"))
    return table(spark, folder, "events").select(F.when(shape == 99, broken).otherwise(line).alias("value"))


@derived
def names(spark: SparkSession, folder: str) -> DataFrame:
    """Searchable fields of the nodes; the content is the whole text of the document."""
    content = table(spark, folder, "documents").select(
        F.col("doc_id").alias("node_id"), F.col("text").alias("content")
    )
    return (
        table(spark, folder, "part")
        .select(
            F.col("p_partkey").alias("node_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("title"),
            F.col("p_type").alias("category"),
            F.concat_ws(" ", "p_type", "p_brand").alias("description"),
        )
        .join(content, "node_id", "left")
    )


@derived
def raw_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Object keys as callers write them: stray blanks, leading, trailing and lone slashes."""
    key = F.concat("event_type", F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), "event_id")
    shape = F.col("event_id") % 8
    return table(spark, folder, "events").select(
        "event_id",
        F.when(shape == 0, key)
        .when(shape == 1, F.concat(F.lit("/"), key))
        .when(shape == 2, F.concat(F.lit("  "), key, F.lit("/ ")))
        .when(shape == 3, F.concat(F.lit("//"), key, F.lit("//")))
        .when(shape == 4, F.lit("/"))
        .when(shape == 5, F.lit(" "))
        .when(shape == 6, F.concat(F.lit(" / "), F.col("event_type"), F.lit("\t")))
        .otherwise(F.concat(F.lit("/"), "event_type", F.lit("/")))
        .alias("raw_key"),
    )


@derived
def backup_details(spark: SparkSession, folder: str) -> DataFrame:
    """Polled backup records: flat key/value lists, with repeats, null keys and odd tails."""
    shape = F.col("event_id") % 4
    status = F.when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "signup", "In Progress"
    ).otherwise("success")
    base = [
        F.lit("status"),
        F.lit("started"),
        F.lit("fileCount"),
        F.col("user_id").cast("string"),
        F.lit("status"),
        status,
        F.lit("snapshotCompletedAt"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
    ]
    nothing = F.lit(None).cast("string")
    return table(spark, folder, "events").select(
        F.concat(F.lit("backup-"), (F.col("user_id") % 20).cast("string")).alias("snapshot"),
        "event_id",
        to_millis("ts").alias("ts_ms"),
        F.when(shape == 0, F.array(*base))
        .when(shape == 1, F.array(*base, F.lit("odd")))
        .when(shape == 2, F.array(*base, nothing, F.lit("x")))
        .otherwise(F.array(*base, F.lit("exception"), nothing))
        .alias("pairs"),
    )


@derived
def maintenance_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Queued requests: purge, reindex and index by transaction or node, for known ids and as many unknown ones."""

    def queued(name: str, key: str, kind: str, actions: dict[int, str]) -> DataFrame:
        rows = table(spark, folder, name).select(F.col(key).cast("long").alias("id"))
        beyond = rows.agg((F.max("id") + 1).alias("n")).scalar()
        ids = rows.unionByName(rows.select((F.col("id") + beyond).alias("id")))
        action: Column = F.lit(None).cast("string")
        for value, asked in actions.items():
            action = F.when(F.col("id") % 100 == value, asked).otherwise(action)
        return ids.select(F.lit(kind).alias("kind"), action.alias("action"), "id").filter("action is not null")

    by_tx = queued("orders", "o_orderkey", "tx", {3: "purge", 5: "reindex", 7: "index"})
    by_node = queued("part", "p_partkey", "node", {1: "purge", 2: "reindex", 4: "index"})
    return by_tx.unionByName(by_node)


def seen_transactions(spark: SparkSession, folder: str, memory: int = 100) -> DataFrame:
    """The tracker's memory: the newest ``memory`` indexed transactions, numbered by arrival."""
    known = transactions(spark, folder).join(
        index_tx(spark, folder).select("tx_id").distinct(), "tx_id", "left_semi"
    )
    return remember(known.select("tx_id", "commit_time_ms"), "tx_id", memory)


