"""One registered query per operator, over the whole derived tables.

Keys name the operators; every callable takes (spark, folder of parquet tables).
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import maps, paths
from tidemark.operators import (
    batch,
    expand,
    inventory,
    mutate,
    pending,
    postings,
    reconcile,
    route,
    search,
    snapshots,
    telemetry,
)
from tidemark.plans import maintenance, snapshot_files, track
from tidemark.plans.store import IndexStore
from tidemark.session import configure, freeze, scratch
from tidemark.sources import access_log, feed
from tidemark.sources import inventory as listing
from tidemark.sources import tables as T
from tidemark.streaming import feeds, rates
from tidemark.streaming import track as stream

DAY_MS = 86_400_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATE = track.TrackerState(T.LAST_INDEXED_MS, 0, T.HOLE_MS, T.STOP_MS)
ACL_STATE = track.TrackerState(T.ACL_LAST_INDEXED_MS, 0, T.HOLE_MS, T.ACL_STOP_MS)
READING_GROUPS = ["GROUP_BUILDING", "GROUP_MACHINERY"]


def query(function: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(configure(spark), folder)

    QUERIES[function.__name__] = run
    return run


def pending_tx(spark, folder):
    return pending.pending_transactions(T.transactions(spark, folder), T.index_tx(spark, folder), T.LAST_INDEXED_MS)


def pending_sets(spark, folder):
    return pending.pending_change_sets(
        T.change_sets(spark, folder), T.index_change_sets(spark, folder), T.ACL_LAST_INDEXED_MS
    )


def node_bound(spark, folder) -> int:
    """The number after the largest node id."""
    return T.table(spark, folder, "part").agg(F.max("p_partkey")).first()[0] + 1


def node_ranges(spark, folder):
    return route.even_ranges(node_bound(spark, folder), T.SHARD_COUNT)


# --- scans and sources -------------------------------------------------------


@query
def scan_transactions(spark, folder):
    return feed.scan_transactions(
        T.transactions(spark, folder),
        from_time=T.LAST_INDEXED_MS - T.HOLE_MS,
        to_time=T.STOP_MS,
        max_results=feed.PAGE_CAP,
    )


@query
def scan_change_sets(spark, folder):
    return feed.scan_change_sets(
        T.change_sets(spark, folder),
        from_time=T.ACL_LAST_INDEXED_MS - T.HOLE_MS,
        to_time=T.ACL_STOP_MS,
        max_results=feed.PAGE_CAP,
    )


@query
def scan_all_transactions(spark, folder):
    rows = T.transactions(spark, folder)
    return feed.scan_transactions(rows, from_time=T.LAST_INDEXED_MS - T.HOLE_MS, to_time=T.STOP_MS, max_results=None)


@query
def scan_all_change_sets(spark, folder):
    rows = T.change_sets(spark, folder)
    return feed.scan_change_sets(rows, from_time=T.ACL_LAST_INDEXED_MS - T.HOLE_MS, to_time=T.ACL_STOP_MS, max_results=None)


@query
def first_transaction(spark, folder):
    return feed.first_transaction(T.transactions(spark, folder))


@query
def first_change_set(spark, folder):
    return feed.first_change_set(T.change_sets(spark, folder))


@query
def next_page(spark, folder):
    return feed.next_page(
        T.transactions(spark, folder),
        T.seen_transactions(spark, folder),
        "tx_id",
        T.LAST_INDEXED_MS - DAY_MS,
        T.STOP_MS,
    )


@query
def next_commit_time(spark, folder):
    rows = T.transactions(spark, folder)
    here = feed.next_commit_time(rows, T.LAST_INDEXED_MS + 1).select(F.lit("inside").alias("at"), "next_commit_ms")
    after = feed.next_commit_time(rows, 4_102_444_800_000).select(F.lit("behind").alias("at"), "next_commit_ms")
    return here.unionByName(after)


@query
def next_commit_page(spark, folder):
    return feed.next_commit_page(T.transactions(spark, folder), "tx_id", T.LAST_INDEXED_MS + 1)


@query
def adaptive_windows(spark, folder):
    sets = T.change_sets(spark, folder)
    known = sets.join(T.index_change_sets(spark, folder).select("change_set_id"), "change_set_id", "left_semi")
    seen = pending.remember(known.select("change_set_id", "commit_time_ms"), "change_set_id")
    return feed.adaptive_windows(sets, seen, "change_set_id", T.ACL_LAST_INDEXED_MS - DAY_MS, T.ACL_STOP_MS)


@query
def commit_interval(spark, folder):
    third = node_bound(spark, folder) // 3
    return feed.commit_interval(T.nodes(spark, folder), T.transactions(spark, folder), third, third * 2)


@query
def nodes_by_id_range(spark, folder):
    half = node_bound(spark, folder) // 2
    return feed.nodes_by_id_range(T.current_nodes(spark, folder), half, half * 2)


@query
def scan_object_inventory(spark, folder):
    return listing.scan_object_inventory(T.objects(spark, folder), "/backups")


@query
def scan_access_log(spark, folder):
    return access_log.scan_access_log(T.access_lines(spark, folder))


@query
def read_lines(spark, folder):
    """Log lines written as text files and read again."""
    path = scratch(spark, "log")
    T.access_lines(spark, folder).write.text(path)
    return access_log.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query
def list_objects(spark, folder):
    """A live listing of files that were just written, by folder."""
    path = scratch(spark, "objects")
    T.index_tx(spark, folder).withColumn("stretch", F.pmod("tx_id", F.lit(3))).write.partitionBy("stretch").parquet(path)
    found = listing.list_objects(spark, path)
    below = F.regexp_extract("key", "(stretch=[^/]*)/", 1)
    return found.filter(below != "").groupBy(below.alias("folder")).agg(
        (F.count("*") > 0).alias("listed"), (F.sum("size") > 0).alias("has_bytes")
    )


@query
def scan_access_log_rejects(spark, folder):
    return access_log.rejected_lines(T.access_lines(spark, folder))


# --- filters -----------------------------------------------------------------


@query
def pending_transactions(spark, folder):
    return pending_tx(spark, folder)


@query
def pending_change_sets(spark, folder):
    return pending_sets(spark, folder)


@query
def already_seen(spark, folder):
    rows, seen = T.transactions(spark, folder), T.seen_transactions(spark, folder)
    out = []
    for days in (1, 5, -1):
        page = feed.scan_transactions(
            rows,
            from_time=T.LAST_INDEXED_MS - days * DAY_MS,
            to_time=T.LAST_INDEXED_MS - (days - 1) * DAY_MS,
            max_results=feed.PAGE_CAP,
        )
        out.append(pending.already_seen(page, seen, "tx_id").withColumn("days_back", F.lit(days)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def stop_guard(spark, folder):
    rows = T.transactions(spark, folder)
    up_to = feed.scan_transactions(rows, to_time=T.STOP_MS + 1)
    kept = pending.stop_guard(up_to, T.STOP_MS).withColumn("page", F.lit("up to the stop"))
    dropped = pending.stop_guard(rows, T.STOP_MS).withColumn("page", F.lit("past the stop"))
    return kept.unionByName(dropped)


@query
def nonempty_transactions(spark, folder):
    return pending.nonempty_transactions(T.transactions(spark, folder))


@query
def nonempty_change_sets(spark, folder):
    return pending.nonempty_change_sets(T.change_sets(spark, folder))


@query
def resume_point(spark, folder):
    seen = T.seen_transactions(spark, folder)
    known = pending.resume_point(seen, T.LAST_INDEXED_MS).withColumn("memory", F.lit("filled"))
    empty = pending.resume_point(seen.filter("false"), T.LAST_INDEXED_MS).withColumn("memory", F.lit("empty"))
    return known.unionByName(empty)


@query
def hole_rescan(spark, folder):
    return pending.hole_rescan(
        T.transactions(spark, folder), T.index_tx(spark, folder), "tx_id", T.LAST_INDEXED_MS, 30 * DAY_MS
    )


@query
def clamp_to_shard_range(spark, folder):
    rows, index = T.transactions(spark, folder), T.index_tx(spark, folder)
    bound = node_bound(spark, folder)
    out = []
    for name, low, high in (("inside", 0, bound), ("empty", bound, bound + 1)):
        interval = feed.commit_interval(T.nodes(spark, folder), rows, low, high)
        part = pending.clamp_to_shard_range(rows, interval, index, T.LAST_INDEXED_MS, T.LAST_INDEXED_MS)
        out.append(part.withColumn("shard", F.lit(name)))
    return out[0].unionByName(out[1])


# --- joins -------------------------------------------------------------------


@query
def nodes_of_transactions(spark, folder):
    return expand.nodes_of_transactions(
        pending_tx(spark, folder), T.nodes(spark, folder), "workspace://SpacesStore", "O"
    )


@query
def nodes_of_transaction(spark, folder):
    newest = T.table(spark, folder, "orders").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")))
    return expand.nodes_of_transaction(T.nodes(spark, folder), newest.scalar(), "workspace://SpacesStore")


@query
def acls_of_change_sets(spark, folder):
    return expand.acls_of_change_sets(pending_sets(spark, folder), T.acls(spark, folder))


@query
def acls_of_change_set(spark, folder):
    sets = T.change_sets(spark, folder)
    newest = sets.filter("acl_count > 0").agg(F.max_by("change_set_id", F.struct("commit_time_ms", "change_set_id")))
    return expand.acls_of_change_set(sets, T.acls(spark, folder), newest.scalar()).select("acl_id")


@query
def readers_of_acls(spark, folder):
    wanted = expand.acls_of_change_sets(pending_sets(spark, folder), T.acls(spark, folder))
    return expand.readers_of_acls(wanted, T.acl_readers(spark, folder))


@query
def visible_nodes(spark, folder):
    return expand.visible_nodes(T.index_nodes(spark, folder), T.acl_readers(spark, folder), READING_GROUPS)


@query
def visible_by_bitmap(spark, folder):
    bitmaps = freeze(expand.authority_bitmaps(T.acl_readers(spark, folder)))
    return expand.visible_by_bitmap(T.index_nodes(spark, folder), bitmaps, READING_GROUPS)


@query
def repo_vs_index(spark, folder):
    return reconcile.repo_vs_index(T.transactions(spark, folder), T.index_tx(spark, folder), "tx_id")


@query
def repo_vs_index_differences(spark, folder):
    return reconcile.repo_vs_index_differences(T.transactions(spark, folder), T.index_tx(spark, folder), "tx_id")


@query
def repo_vs_index_acl(spark, folder):
    return reconcile.repo_vs_index(
        T.change_sets(spark, folder), T.index_change_sets(spark, folder), "change_set_id"
    )


# --- routing and scalar functions --------------------------------------------


@query
def route_nodes(spark, folder):
    by_range = route.home_shard(T.SHARD_COUNT, route.DB_ID_RANGE, node_ranges(spark, folder))
    routed = route.route_nodes(T.nodes(spark, folder), T.SHARD_COUNT)
    return routed.select("tx_id", "node_id", "shard", by_range.alias("range_shard"))


@query
def route_acls(spark, folder):
    return route.route_acls(T.acls(spark, folder), T.SHARD_COUNT)


@query
def expand_shard_range(spark, folder):
    bound = T.table(spark, folder, "part").agg((F.max("p_partkey") + 1).alias("n"))
    bounds = bound.select(F.explode(F.sequence(F.lit(0), F.lit(T.SHARD_COUNT - 1))).alias("i"), "n")
    shards = bounds.select(
        F.col("i").alias("shard"),
        F.expr(f"(i * n) div {T.SHARD_COUNT}").alias("start_id"),
        F.expr(f"((i + 1) * n) div {T.SHARD_COUNT}").alias("end_id"),
        F.expr(f"CASE i WHEN 0 THEN ((i + 1) * n) div {T.SHARD_COUNT} + 100 WHEN 1 THEN -1L ELSE n - 50 END").alias(
            "index_cap"
        ),
    )
    return route.expand_shard_range(shards)


@query
def shard_view(spark, folder):
    return route.shard_view(T.nodes(spark, folder), T.SHARD_COUNT, cascade=True)


@query
def shard_view_home(spark, folder):
    return route.home_rows(T.nodes(spark, folder), T.SHARD_COUNT)


@query
def store_to_core(spark, folder):
    return route.store_to_core(T.nodes(spark, folder), T.STORE_CORES).select("tx_id", "node_id", "node_ref", "core")


@query
def normalize_key(spark, folder):
    return inventory.normalize_keys(T.raw_keys(spark, folder)).drop("raw_key")


@query
def parent_key(spark, folder):
    keys = inventory.normalize_keys(T.raw_keys(spark, folder)).select("event_id", F.col("path").alias("key"))
    return inventory.parents(keys)


@query
def location_uri(spark, folder):
    key = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"))
    shape = F.col("event_id") % 4
    location = (
        F.when(shape == 0, "")
        .when(shape == 1, key)
        .when(shape == 2, F.concat(F.lit("/"), key, F.lit("/")))
        .otherwise(F.concat(F.lit("s3://bucket/"), key))
    )
    events = T.table(spark, folder, "events")
    return inventory.location_uris(events.select("event_id", location.alias("location"))).drop("location")


@query
def resolve_key(spark, folder):
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    shape = F.col("event_id") % 4
    base = F.when(shape == 0, "/backups//").when(shape == 1, "/backups").when(shape == 2, "/").otherwise("/a/../b")
    middle = F.when(shape == 0, ".").when(shape == 1, "..").when(shape == 2, "x/./y").otherwise("")
    key = paths.resolve_key(base, F.col("event_type"), middle, user)
    folder_key = paths.resolve_directory(base, F.col("event_type"))
    return T.table(spark, folder, "events").select("event_id", key.alias("key"), folder_key.alias("dir"))


@query
def pairs_to_map(spark, folder):
    read = T.backup_details(spark, folder).select("event_id", maps.pairs_to_map(F.col("pairs")).alias("m"))
    return read.select(
        "event_id",
        F.size("m").cast("long").alias("fields"),
        F.col("m")["status"].alias("status"),
        F.col("m")["fileCount"].alias("file_count"),
        F.col("m")["snapshotCompletedAt"].alias("completed_at"),
        F.col("m")["null"].alias("null_key"),
        F.map_contains_key("m", "exception").alias("has_exception"),
    )


@query
def snapshot_name(spark, folder):
    return T.objects(spark, folder).select("key", paths.snapshot_name(F.col("key")).alias("snapshot"))


@query
def metric_long_form(spark, folder):
    stats = telemetry.handler_stats(T.requests(spark, folder))
    handler = F.regexp_replace("handler", "^/", "").alias("handler")
    numbers = [F.round(F.col(c), 6).alias(c) for c in stats.columns if c != "handler"]
    return telemetry.metric_long_form(stats.select(handler, *numbers), "handler", "handler")


# --- aggregations ------------------------------------------------------------


@query
def server_maxima(spark, folder):
    tx = pending.server_maxima(T.transactions(spark, folder), "tx_id").withColumn("feed", F.lit("transactions"))
    acl = pending.server_maxima(T.change_sets(spark, folder), "change_set_id").withColumn("feed", F.lit("change sets"))
    return tx.unionByName(acl)


@query
def high_watermark(spark, folder):
    return pending.high_watermark(pending_tx(spark, folder), "tx_id", T.LAST_INDEXED_MS, 0)


@query
def recover_state(spark, folder):
    tx = pending.recover_state(T.index_tx(spark, folder), "tx_id").withColumnRenamed("tx_id", "id")
    acl = pending.recover_state(T.index_change_sets(spark, folder), "change_set_id")
    acl = acl.withColumnRenamed("change_set_id", "id")
    none = pending.recover_state(T.index_tx(spark, folder).filter("false"), "tx_id").withColumnRenamed("tx_id", "id")
    named = [df.withColumn("index", F.lit(n)) for df, n in ((tx, "tx"), (acl, "change sets"), (none, "empty"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query
def feed_stats(spark, folder):
    return pending.feed_stats(batch.weighted_batches(pending_tx(spark, folder)))


@query
def feed_stats_acl(spark, folder):
    return pending.acl_feed_stats(batch.count_batches(pending_sets(spark, folder)))


@query
def core_doc_counts(spark, folder):
    docs = route.store_to_core(T.index_nodes(spark, folder), T.STORE_CORES)
    return telemetry.core_doc_counts(docs, [*T.STORE_CORES.values(), "not yet created"])


@query
def total_docs(spark, folder):
    docs = route.store_to_core(T.index_nodes(spark, folder), T.STORE_CORES)
    return telemetry.total_docs(telemetry.core_status(docs))


@query
def searcher_counts(spark, folder):
    return telemetry.searcher_counts(route.store_to_core(T.current_nodes(spark, folder), T.STORE_CORES))


@query
def handler_stats(spark, folder):
    stats = telemetry.handler_stats(T.requests(spark, folder))
    keep = ("handler", "requests", "errors", "timeouts")
    return stats.select(*[c if c in keep else F.round(F.col(c), 6).alias(c) for c in stats.columns])


@query
def handler_sketches(spark, folder):
    """Statistics from stored hourly sketches, and whether each percentile's rank is as near as promised."""
    requests = T.requests(spark, folder)
    stats = telemetry.stats_of_sketches(freeze(telemetry.handler_sketches(requests)))
    names = list(telemetry.PERCENTILES)
    asked = stats.select(F.col("handler").alias("of"), *[F.col(n).alias(f"at_{n}") for n in names])
    near = []
    for name, q in telemetry.PERCENTILES.items():
        below = F.count_if(F.col("elapsed_ms") < F.col(f"at_{name}")) / F.count("elapsed_ms")
        not_above = F.count_if(F.col("elapsed_ms") <= F.col(f"at_{name}")) / F.count("elapsed_ms")
        error = telemetry.RANK_ERROR
        near.append(((below <= q + error) & (not_above >= q - error)).alias(f"{name}_near"))
    joined = requests.join(asked, F.col("handler").eqNullSafe(F.col("of")))
    ranks = joined.groupBy("of").agg(*near)
    counts = ["requests", "errors", "timeouts"]
    return stats.join(ranks, F.col("handler").eqNullSafe(F.col("of"))).select(
        "handler", *counts, F.round("total_time", 6).alias("total_time"), *[f"{n}_near" for n in names]
    )


@query
def cache_stats(spark, folder):
    stats = telemetry.cache_stats(T.cache_events(spark, folder))
    return stats.withColumn("hitratio", F.round("hitratio", 6))


@query
def cache_stats_cumulative(spark, folder):
    stats = telemetry.cumulative_cache_stats(T.cache_events(spark, folder))
    return stats.withColumn("cumulative_hitratio", F.round("cumulative_hitratio", 6))


@query
def cache_stats_field(spark, folder):
    entry = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("entry")
    return telemetry.field_cache_stats(T.table(spark, folder, "events").select(entry))


@query
def facet_counts(spark, folder):
    return search.facet_counts(T.names(spark, folder), ["category", "title", "name"])


@query
def facet_counts_top(spark, folder):
    return search.facet_counts(T.names(spark, folder), ["category", "title", "name"], top=3)


# --- reports -----------------------------------------------------------------


@query
def check_index_tx(spark, folder):
    return reconcile.check_index_tx(T.transactions(spark, folder), T.index_tx(spark, folder), to_ms=T.STOP_MS)


@query
def check_index_tx_prefix(spark, folder):
    top = T.table(spark, folder, "orders").agg(F.max("o_orderkey")).first()[0] - 3
    rows = T.transactions(spark, folder)
    return reconcile.check_index_tx(rows, T.index_tx(spark, folder), to_id=top, id_range=feed.FIRST_ID_RANGE)


@query
def check_index_acl(spark, folder):
    return reconcile.check_index_acl(
        T.change_sets(spark, folder), T.index_change_sets(spark, folder), to_ms=T.ACL_STOP_MS
    )


@query
def check_index_summary(spark, folder):
    report = reconcile.check_index_tx(T.transactions(spark, folder), T.index_tx(spark, folder), to_ms=T.STOP_MS)
    return reconcile.health_summary(report)


@query
def check_node(spark, folder):
    ids = T.table(spark, folder, "part").select(F.col("p_partkey").alias("node_id"))
    beyond = ids.select((F.col("node_id") + node_bound(spark, folder)).alias("node_id"))
    return reconcile.check_node(
        ids.unionByName(beyond), T.current_nodes(spark, folder), T.index_nodes(spark, folder)
    )


@query
def check_acl(spark, folder):
    ids = T.table(spark, folder, "customer").select(F.col("c_custkey").alias("acl_id"))
    return reconcile.check_acl(ids, T.acl_readers(spark, folder), T.index_acls(spark, folder))


@query
def check_first(spark, folder):
    tx, index = T.transactions(spark, folder), T.index_tx(spark, folder)
    whole = reconcile.check_first(tx, index, "tx_id", T.LAST_INDEXED_MS).withColumn("case", F.lit("tx"))
    new = reconcile.check_first(tx, index, "tx_id", 0).withColumn("case", F.lit("tx, new index"))
    none = feed.commit_interval(T.nodes(spark, folder), tx, node_bound(spark, folder), 2**62)
    floor = none.first()["min_commit_ms"]
    skip = reconcile.check_first(tx, index, "tx_id", T.LAST_INDEXED_MS, floor).withColumn("case", F.lit("tx, empty shard"))
    acl = reconcile.check_first(
        T.change_sets(spark, folder), T.index_change_sets(spark, folder), "change_set_id", T.ACL_LAST_INDEXED_MS
    ).withColumn("case", F.lit("change sets"))
    return whole.unionByName(new).unionByName(skip).unionByName(acl)


@query
def check_last(spark, folder):
    tx, index = T.transactions(spark, folder), T.index_tx(spark, folder)
    whole = reconcile.check_last(tx, index, "tx_id").withColumn("case", F.lit("tx"))
    early = tx.filter(F.col("commit_time_ms") < T.LAST_INDEXED_MS - 30 * DAY_MS)
    cut = reconcile.check_last(early, index, "tx_id").withColumn("case", F.lit("source cut off"))
    none = reconcile.check_last(tx.filter("false"), index, "tx_id").withColumn("case", F.lit("no source"))
    acl = reconcile.check_last(
        T.change_sets(spark, folder), T.index_change_sets(spark, folder), "change_set_id"
    ).withColumn("case", F.lit("change sets"))
    return whole.unionByName(cut).unionByName(none).unionByName(acl)


@query
def settled_at(spark, folder):
    return reconcile.settled_at(T.doc_samples(spark, folder))


@query
def settled_at_long(spark, folder):
    return reconcile.settled_at(T.doc_samples(spark, folder), hold_ms=600_000)


@query
def readiness(spark, folder):
    lines = access_log.scan_access_log(T.access_lines(spark, folder)).filter("path <> '/error'")
    probes = lines.select(
        F.col("path").alias("probe"), "status", F.col("path").alias("body"), F.lit("/").alias("expected")
    )
    shards = route.route_nodes(T.index_nodes(spark, folder), T.SHARD_COUNT).groupBy("shard").agg(F.count("*").alias("docs"))
    hits = search.search_total(search.field_prefix_search(T.names(spark, folder), "name", "ring"))
    return reconcile.readiness(probes, shards, hits)


# --- batches and top-k -------------------------------------------------------


@query
def weighted_batches(spark, folder):
    return batch.weighted_batches(pending_tx(spark, folder))


@query
def count_batches(spark, folder):
    return batch.count_batches(pending_sets(spark, folder))


@query
def fixed_chunks(spark, folder):
    batched = batch.weighted_batches(pending_tx(spark, folder)).select("tx_id", "batch_no")
    rows = T.nodes(spark, folder).select("tx_id", "node_id").join(batched, "tx_id")
    return batch.fixed_chunks(rows, "batch_no", ["tx_id", "node_id"], batch.NODE_CHUNK)


@query
def fixed_chunks_acl(spark, folder):
    batched = batch.count_batches(pending_sets(spark, folder)).select("change_set_id", "batch_no")
    rows = T.acls(spark, folder).join(batched, "change_set_id")
    return batch.fixed_chunks(rows, "batch_no", ["change_set_id", "acl_id"], batch.ACL_CHUNK)


@query
def delete_batches(spark, folder):
    keys = T.objects(spark, folder).select("key")
    return batch.delete_batches(keys.unionAll(keys))


@query
def latest_per_node(spark, folder):
    commits = T.transactions(spark, folder).select("tx_id", "commit_time_ms")
    return batch.latest_per_node(T.nodes(spark, folder).join(commits, "tx_id"))


@query
def request_rates(spark, folder):
    rates = batch.request_rates(T.requests(spark, folder))
    return rates.select(
        "handler", "second", "requests", *[F.round(c, 6).alias(c) for c in ("rate_5min", "rate_15min")]
    )


# --- search ------------------------------------------------------------------


@query
def field_prefix_search(spark, folder):
    rows = T.names(spark, folder)
    word = search.field_prefix_search(rows, "name", "Wid").select("node_id", F.lit("word").alias("mode"))
    whole = search.field_prefix_search(rows, "name", "RED", whole_value=True).select("node_id", F.lit("value").alias("mode"))
    exact = search.field_prefix_search(rows, "title", "Brand#1", whole_value=True, ignore_case=False)
    text = search.field_prefix_search(rows, "content", "the").select("node_id", F.lit("content").alias("mode"))
    return word.unionByName(whole).unionByName(exact.select("node_id", F.lit("case").alias("mode"))).unionByName(text)


def stored_postings(spark, folder):
    path = scratch(spark, "postings")
    postings.write_postings(postings.postings(T.names(spark, folder), "node_id", ["name", "content"]), path)
    return spark.read.parquet(path)


@query
def postings_search(spark, folder):
    found = stored_postings(spark, folder)
    modes = [("name", "Wid"), ("name", "ring"), ("content", "the"), ("content", "")]
    hits = [postings.search(found, f, p).select("node_id", F.lit(f"{f} {p}").alias("mode")) for f, p in modes]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).unionByName(hits[3])


@query
def reindex_by_postings(spark, folder):
    return postings.reindex_by_postings(T.index_nodes(spark, folder), stored_postings(spark, folder), "name", "ring")


@query
def suggest_from_dictionary(spark, folder):
    """Three runs: all even nodes, all nodes of a third, and those taken away again that are in both."""
    rows, path = T.names(spark, folder), scratch(spark, "dictionary")
    even, third = F.col("node_id") % 2 == 0, F.col("node_id") % 3 == 0
    runs = [(rows.where(even), 1), (rows.where(third | ~even), 1), (rows.where(even & third), -1)]
    for run, sign in runs:
        postings.write_dictionary(postings.dictionary(run, sign=sign), path)
    return postings.suggest(spark.read.parquet(path), "re", limit=20)


@query
def search_page(spark, folder):
    hits = search.field_prefix_search(T.names(spark, folder), "name", "ring").select("node_id", "name")
    return search.search_page(hits, "node_id", limit=25, offset=5)


@query
def suggest_terms(spark, folder):
    return search.suggest_terms(T.names(spark, folder), "re", limit=20)


@query
def reindex_by_query(spark, folder):
    return search.reindex_by_query(T.index_nodes(spark, folder), T.names(spark, folder), "name", "ring")


# --- index mutation ----------------------------------------------------------


def node_index(spark, folder):
    return mutate.NodeIndex(T.index_nodes(spark, folder), T.index_tx(spark, folder))


def acl_index(spark, folder):
    return mutate.AclIndex(T.index_acls(spark, folder), T.index_change_sets(spark, folder))


def asked(spark, folder, kind, action, id_col):
    return maintenance.requested(T.maintenance_requests(spark, folder), kind, action, id_col)


def asked_sets(spark, folder):
    """Change sets of slow failed requests, and as many ids the feed does not have."""
    failed = T.table(spark, folder, "events").filter("event_type = 'error' AND value > 200")
    ids = failed.select(F.col("event_id").alias("change_set_id"))
    beyond = T.table(spark, folder, "events").agg((F.max("event_id") + 1).alias("n")).scalar()
    return ids.unionByName(ids.select((F.col("change_set_id") + beyond).alias("change_set_id")))


@query
def upsert_nodes(spark, folder):
    return mutate.upsert_nodes(T.index_nodes(spark, folder), T.current_nodes(spark, folder))


@query
def append_nodes(spark, folder):
    return mutate.append_nodes(T.index_nodes(spark, folder), T.current_nodes(spark, folder))


@query
def delete_by_node(spark, folder):
    return mutate.delete_by_node(T.index_nodes(spark, folder), asked(spark, folder, "node", "purge", "node_id"))


@query
def delete_by_tx(spark, folder):
    index = mutate.delete_by_tx(node_index(spark, folder), asked(spark, folder, "tx", "purge", "tx_id"))
    nodes = index.nodes.select(F.lit("node").alias("doc"), F.col("node_id").alias("id"), "tx_id")
    return nodes.unionByName(index.markers.select(F.lit("tx").alias("doc"), F.col("tx_id").alias("id"), "tx_id"))


@query
def delete_by_acl(spark, folder):
    ids = maintenance.requested(acl_requests(spark, folder), "acl", "purge", "acl_id")
    return mutate.delete_by_acl(T.index_acls(spark, folder), ids)


@query
def delete_by_change_set(spark, folder):
    index = mutate.delete_by_change_set(acl_index(spark, folder), asked_sets(spark, folder), T.acls(spark, folder))
    acls = index.acls.select(F.lit("acl").alias("doc"), F.col("acl_id").alias("id"), "authority")
    markers = index.markers.select(
        F.lit("change set").alias("doc"), F.col("change_set_id").alias("id"), F.lit("").alias("authority")
    )
    return acls.unionByName(markers)


@query
def write_markers(spark, folder):
    return mutate.write_markers(T.index_tx(spark, folder), T.transactions(spark, folder), "tx_id")


@query
def reindex_transactions(spark, folder):
    index = mutate.reindex_transactions(
        node_index(spark, folder),
        asked(spark, folder, "tx", "reindex", "tx_id"),
        T.transactions(spark, folder),
        T.current_nodes(spark, folder),
        T.SHARD_COUNT,
    )
    return _with_unknown(index)


def _with_unknown(index):
    nodes = index.nodes.select(F.lit("node").alias("doc"), F.col("node_id").alias("id"), "tx_id", "status")
    none = F.lit(None).cast("string").alias("status")
    markers = index.markers.select(F.lit("tx").alias("doc"), F.col("tx_id").alias("id"), "tx_id", none)
    lost = index.unknown.select(F.lit("not found").alias("doc"), F.col("tx_id").alias("id"), "tx_id", none)
    return nodes.unionByName(markers).unionByName(lost)


@query
def index_transactions(spark, folder):
    index = mutate.index_transactions(
        node_index(spark, folder),
        asked(spark, folder, "tx", "index", "tx_id"),
        T.transactions(spark, folder),
        T.current_nodes(spark, folder),
    )
    return _with_unknown(index)


@query
def reindex_nodes(spark, folder):
    return mutate.reindex_nodes(
        T.index_nodes(spark, folder),
        asked(spark, folder, "node", "reindex", "node_id"),
        T.current_nodes(spark, folder),
        T.SHARD_COUNT,
    )


@query
def index_nodes(spark, folder):
    return mutate.index_nodes_by_id(
        T.index_nodes(spark, folder),
        asked(spark, folder, "node", "index", "node_id"),
        T.current_nodes(spark, folder),
    )


@query
def upsert_acls(spark, folder):
    ids = T.acls(spark, folder).join(pending_sets(spark, folder), "change_set_id", "left_semi")
    return mutate.upsert_acls(T.index_acls(spark, folder), ids.select("acl_id"), T.acl_readers(spark, folder))


def _acl_docs(index):
    none = F.lit(None).cast("string").alias("authority")
    acls = index.acls.select(F.lit("acl").alias("doc"), F.col("acl_id").alias("id"), "authority")
    markers = index.markers.select(F.lit("change set").alias("doc"), F.col("change_set_id").alias("id"), none)
    lost = index.unknown.select(F.lit("not found").alias("doc"), F.col("change_set_id").alias("id"), none)
    return acls.unionByName(markers).unionByName(lost)


@query
def reindex_change_sets(spark, folder):
    return _acl_docs(
        mutate.reindex_change_sets(
            acl_index(spark, folder),
            asked_sets(spark, folder),
            T.change_sets(spark, folder),
            T.acls(spark, folder),
            T.acl_readers(spark, folder),
        )
    )


@query
def index_change_sets(spark, folder):
    return _acl_docs(
        mutate.index_change_sets(
            acl_index(spark, folder),
            asked_sets(spark, folder),
            T.change_sets(spark, folder),
            T.acls(spark, folder),
            T.acl_readers(spark, folder),
        )
    )


@query
def apply_maintenance(spark, folder):
    base = node_index(spark, folder)
    # The index is read four times below; a deployment has it as files, and its markers need no counts of the feed.
    base = base._replace(nodes=freeze(base.nodes))
    queried = search.reindex_by_query(base.nodes, T.names(spark, folder), "name", "ring")
    index = maintenance.apply_maintenance(
        base,
        T.maintenance_requests(spark, folder),
        T.commits(spark, folder),
        T.current_nodes(spark, folder),
        queried,
    )
    return _with_unknown(index)


def acl_requests(spark, folder):
    """Queued ACL requests: by event type for change sets, by user for ACLs."""
    events = T.table(spark, folder, "events")
    by_set = F.when(F.col("event_type") == "error", "purge").when(F.col("event_type") == "signup", "reindex").when(
        F.col("event_type") == "purchase", "index"
    )
    by_acl = F.when(F.col("user_id") % 10 == 1, "purge").when(F.col("user_id") % 10 == 2, "reindex").when(
        F.col("user_id") % 10 == 3, "index"
    )
    sets = events.select(F.lit("change_set").alias("kind"), by_set.alias("action"), F.col("event_id").alias("id"))
    acls = events.select(F.lit("acl").alias("kind"), by_acl.alias("action"), F.col("user_id").alias("id"))
    return sets.unionByName(acls).filter("action is not null")


@query
def apply_maintenance_acl(spark, folder):
    return _acl_docs(
        maintenance.apply_acl_maintenance(
            acl_index(spark, folder),
            acl_requests(spark, folder),
            T.change_sets(spark, folder),
            T.acls(spark, folder),
            T.acl_readers(spark, folder),
        )
    )


def node_run(spark, folder):
    return track.track_once(
        T.index_nodes(spark, folder),
        T.index_tx(spark, folder),
        T.transactions(spark, folder),
        T.nodes(spark, folder),
        STATE,
        T.SHARD_COUNT,
    )


def acl_run(spark, folder):
    return track.track_acls_once(
        T.index_acls(spark, folder),
        T.index_change_sets(spark, folder),
        T.change_sets(spark, folder),
        T.acls(spark, folder),
        T.acl_readers(spark, folder),
        ACL_STATE,
    )


@query
def track_once(spark, folder):
    return node_run(spark, folder).nodes


@query
def track_once_markers(spark, folder):
    return node_run(spark, folder).markers


@query
def track_once_state(spark, folder):
    return node_run(spark, folder).state


def scoped_runs(spark, folder):
    """One run for each kind of scope: a store, a store and a shard property, an id range with and without cascade."""
    ranges = tuple(node_ranges(spark, folder))
    yield "store", track.Scope(store="archive://SpacesStore")
    yield "property", track.Scope(store="workspace://SpacesStore", shard_property="F")
    yield "range", track.Scope(method=route.DB_ID_RANGE, ranges=ranges, instance=1)
    yield "widened", track.Scope(method=route.DB_ID_RANGE, ranges=ranges, instance=0, index_cap=ranges[0][1] + 10)
    yield "cascade", track.Scope(method=route.DB_ID_RANGE, ranges=ranges, instance=2, cascade=True)


@query
def track_once_scoped(spark, folder):
    """Changes and markers of runs that belong to one store, property or shard, on an empty index."""
    nothing = T.index_nodes(spark, folder).limit(0), T.index_tx(spark, folder).limit(0)
    state = track.TrackerState(0, 0, T.HOLE_MS, T.STOP_MS)
    nodes, feed_rows = T.nodes_and_transactions(spark, folder)
    out = None
    for name, scope in scoped_runs(spark, folder):
        run = track.track_once(*nothing, feed_rows, nodes, state, T.SHARD_COUNT, scope=scope)
        changes = run.changes.select(F.lit("node").alias("doc"), F.col("node_id").alias("id"), "tx_id", "status")
        marks = run.todo.select(F.lit("tx").alias("doc"), F.col("tx_id").alias("id"), "tx_id", F.lit(None).cast("string").alias("status"))
        part = changes.unionByName(marks).withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query
def track_acls_once_routed(spark, folder):
    """The ACLs that a run sets, once for each shard."""
    run = track.track_acls_once(
        T.index_acls(spark, folder),
        T.index_change_sets(spark, folder),
        T.change_sets(spark, folder),
        T.acls(spark, folder),
        T.acl_readers(spark, folder),
        ACL_STATE,
        T.SHARD_COUNT,
    )
    return run.routed


@query
def track_acls_once(spark, folder):
    return acl_run(spark, folder).acls


@query
def track_acls_once_markers(spark, folder):
    run = acl_run(spark, folder)
    return run.markers


@query
def pending_by_shard_and_batch(spark, folder):
    return track.pending_by_shard_and_batch(
        T.transactions(spark, folder), T.nodes(spark, folder), T.index_tx(spark, folder), STATE, T.SHARD_COUNT
    )


# --- snapshots ---------------------------------------------------------------


@query
def list_children(spark, folder):
    objects = T.objects(spark, folder)
    top = inventory.list_children(objects, "/").withColumn("directory", F.lit("/"))
    mid = inventory.list_children(objects, "backups").withColumn("directory", F.lit("backups"))
    days = objects.agg(F.min("key").alias("k")).first()["k"]
    low = inventory.list_children(objects, days).withColumn("directory", F.lit("first snapshot"))
    return top.unionByName(mid).unionByName(low)


def requested_keys(spark, folder):
    """Keys as callers write them: stored ones in several forms, days, and ones that are not there."""
    key = F.col("key")
    asked_for = T.objects(spark, folder).select(
        F.explode(
            F.array(
                key,
                F.concat(F.lit(" /"), key),
                F.regexp_replace(key, "/$", ""),
                F.concat(key, F.lit(".lost")),
                F.lit("/"),
            )
        ).alias("raw_key")
    )
    return asked_for.distinct()


@query
def key_status(spark, folder):
    return inventory.key_status(requested_keys(spark, folder), T.objects(spark, folder))


@query
def delete_plan(spark, folder):
    return inventory.delete_plan(requested_keys(spark, folder), T.objects(spark, folder))


@query
def delete_plan_directory(spark, folder):
    return inventory.delete_directory(T.objects(spark, folder), " /backups/snapshot.20240105")


@query
def missing_parents(spark, folder):
    return inventory.missing_parents(T.objects(spark, folder))


@query
def snapshot_list(spark, folder):
    return snapshots.snapshot_list(T.objects(spark, folder))


@query
def snapshot_latest(spark, folder):
    return snapshots.snapshot_latest(T.objects(spark, folder))


@query
def snapshot_retain(spark, folder):
    return snapshots.snapshot_retain(snapshots.snapshot_list(T.objects(spark, folder)), keep=2)


@query
def snapshot_retain_objects(spark, folder):
    return snapshots.retained_objects(T.objects(spark, folder), keep=2)


@query
def restore_decision(spark, folder):
    objects = T.objects(spark, folder)
    cases = [
        (False, False, None, None),
        (True, True, None, None),
        (True, False, None, None),
        (True, False, 100, None),
        (True, False, 101, None),
        (True, False, 5, "by-name"),
    ]
    out = None
    for number, (wanted, before, size, name) in enumerate(cases):
        row = snapshots.restore_decision(objects, wanted, before, size, name).withColumn("case", F.lit(number))
        out = row if out is None else out.unionByName(row)
    return out


@query
def snapshot_status(spark, folder):
    status = snapshots.snapshot_status(T.backup_details(spark, folder))
    return status.withColumn("fields", F.col("fields").cast("long"))


@query
def snapshot_verify(spark, folder):
    """The inventory as manifest against a copy with lost, changed and added objects."""
    manifest = T.objects(spark, folder).select("key", "size", F.md5("key").alias("checksum"))
    changed = F.col("key").contains("error")
    current = manifest.filter(~F.col("key").contains("signup")).select(
        "key", "size", F.when(changed, F.md5(F.concat("key", F.lit("!")))).otherwise(F.col("checksum")).alias("checksum")
    )
    added = manifest.filter(F.col("key").contains("purchase")).withColumn("key", F.concat("key", F.lit(".new")))
    return snapshots.compare_manifests(manifest, current.unionByName(added))


# --- snapshots as files, and streams -------------------------------------------
# These write tables that Spark derives from the given ones to the shared folder.


def store_with_index(spark, folder):
    return {"nodes": T.index_nodes(spark, folder), "index_tx": T.index_tx(spark, folder)}


@query
def snapshot_write(spark, folder):
    """Rows of each table read back from the snapshot's files, and whether the manifest lists all of those files."""
    root = scratch(spark, "snapshot")
    manifest = snapshot_files.snapshot_write(store_with_index(spark, folder), root, "now")
    listed = manifest.select(F.split_part("key", F.lit("/"), F.lit(1)).alias("t"), "key", "size")
    out = None
    for name, sums in (("nodes", F.col("node_id") * 31 + F.col("tx_id")), ("index_tx", F.col("tx_id") * 31 + F.col("commit_time_ms"))):
        rows = spark.read.parquet(f"{snapshot_files.data_folder(root, 'now')}/{name}")
        files = rows.select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("file")).distinct()
        own = listed.filter(F.col("t") == name).select(F.regexp_extract("key", "[^/]+$", 0).alias("file"))
        unlisted = files.join(own, "file", "left_anti").agg(F.count("*").alias("n")).scalar()
        row = rows.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.sum(sums).alias("checksum"))
        row = row.withColumn("listed", unlisted == 0)
        out = row if out is None else out.unionByName(row)
    return out


@query
def snapshot_restore(spark, folder):
    """The rows that come back from a snapshot, next to the status of the restore."""
    root = scratch(spark, "snapshot")
    snapshot_files.snapshot_write(store_with_index(spark, folder), root, "now")
    status, tables = snapshot_files.snapshot_restore(spark, root, "now", ["nodes", "index_tx"])
    store = IndexStore(spark, scratch(spark, "store"))
    store.replace("restore", tables)
    state = status.select("status").scalar()
    nodes = store.read("nodes").select(F.lit("node").alias("doc"), F.col("node_id").alias("id"), "tx_id")
    markers = store.read("index_tx").select(F.lit("tx").alias("doc"), F.col("tx_id").alias("id"), "tx_id")
    return nodes.unionByName(markers).withColumn("status", state)


@query
def snapshot_verify_files(spark, folder):
    """Files of a snapshot that was just written, by table and status."""
    root = scratch(spark, "snapshot")
    snapshot_files.snapshot_write(store_with_index(spark, folder), root, "now")
    report = snapshot_files.snapshot_verify(spark, root, "now")
    return report.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("table_name"), "status").agg(
        (F.count("*") > 0).alias("any_files")
    )


ARRIVALS = 4


def arriving(
    rows: DataFrame,
    label: str,
    time_col: str,
    step: Callable[[str], None],
    stretches: int,
    late_id: str | None = None,
    again: bool = False,
) -> None:
    """Write rows in the order of time, in equal stretches, and call ``step`` with their path whenever so many have come.

    The last stretch comes twice if asked to. With ``late_id``, the rows of the
    first stretch whose id leaves 7 when divided by 50 come last of all, long
    after their time. However many files a stretch has, a step sees all of them.
    """
    target = scratch(rows.sparkSession, label)
    span = rows.agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi")).first()
    width = (span["hi"] - span["lo"]) // ARRIVALS + 1
    stretch = F.expr(f"({time_col} - {span['lo']}L) div {width}L")
    late = (stretch == 0) & (F.col(late_id) % 50 == 7) if late_id else F.lit(False)
    numbered = freeze(rows.withColumn("_late", late).withColumn("_stretch", stretch))
    parts = [numbered.filter((F.col("_stretch") == n) & ~F.col("_late")) for n in range(ARRIVALS)]
    parts += [parts[-1]] if again else []
    parts += [numbered.filter("_late")] if late_id else []
    for number, part in enumerate(parts, 1):
        part.drop("_late", "_stretch").write.parquet(f"{target}/{number:04d}")
        if number % stretches == 0 or number == len(parts):
            step(f"{target}/*")


def into(frame: DataFrame, out: str) -> None:
    """Run a stream over what is there into files, going on from the last run."""
    writer = frame.writeStream.format("parquet").option("checkpointLocation", f"{out}-progress")
    feeds.run_available(writer.trigger(availableNow=True).start(out))


@query
def stream_track(spark, folder):
    rows = T.transactions(spark, folder)
    root = scratch(spark, "store")
    store = IndexStore(spark, root)
    nodes = freeze(T.nodes(spark, folder))

    def step(target: str) -> None:
        feeds.run_available(
            stream.stream_track(
                feeds.read_feed(spark, target, rows.schema),
                store,
                lambda: nodes,
                lambda: spark.read.schema(rows.schema).parquet(target).dropDuplicates(["tx_id"]),
                f"{root}-progress",
                T.SHARD_COUNT,
            )
        )

    arriving(rows, "transactions", "commit_time_ms", step, 3, "tx_id", again=True)
    none = F.lit(None).cast("string").alias("status")
    found = store.read("nodes").select(F.lit("node").alias("doc"), F.col("node_id").alias("id"), "tx_id", "status")
    markers = store.read("index_tx").select(F.lit("tx").alias("doc"), F.col("tx_id").alias("id"), "tx_id", none)
    return found.unionByName(markers).unionByName(_late(spark, store, "late_tx").select("doc", "id", F.lit(None).cast("long").alias("tx_id"), none))


def _late(spark, store, mark):
    """How many rows came too late and were applied all the same."""
    return spark.range(1).select(F.lit("late").alias("doc"), F.lit(store.marks().get(mark, 0)).cast("long").alias("id"))


@query
def stream_track_acls(spark, folder):
    rows = T.change_sets(spark, folder)
    root = scratch(spark, "store")
    store = IndexStore(spark, root)

    def step(target: str) -> None:
        feeds.run_available(
            stream.stream_track_acls(
                feeds.read_feed(spark, target, rows.schema),
                store,
                lambda: T.acls(spark, folder),
                lambda: T.acl_readers(spark, folder),
                f"{root}-progress",
            )
        )

    arriving(rows, "change-sets", "commit_time_ms", step, 3, "change_set_id", again=True)
    none = F.lit(None).cast("string").alias("authority")
    found = store.read("acls").select(F.lit("acl").alias("doc"), F.col("acl_id").alias("id"), "authority")
    markers = store.read("index_change_sets").select(
        F.lit("change set").alias("doc"), F.col("change_set_id").alias("id"), none
    )
    return found.unionByName(markers).unionByName(_late(spark, store, "late_sets").select("doc", "id", none))


def deduplicated(spark, rows):
    """What the deduplicating stream lets through, in three steps."""
    out = scratch(spark, "dedup")

    def step(target: str) -> None:
        into(stream.stream_dedup(feeds.read_feed(spark, target, rows.schema)), out)

    arriving(rows, "transactions", "commit_time_ms", step, 2, "tx_id", again=True)
    return spark.read.schema(rows.schema).parquet(out)


@query
def stream_dedup(spark, folder):
    return deduplicated(spark, T.transactions(spark, folder))


@query
def stream_dedup_late(spark, folder):
    """Rows the stream left out as too late, found by comparing with the whole feed."""
    rows = T.transactions(spark, folder)
    return stream.late_rows(rows, deduplicated(spark, rows))


@query
def stream_high_watermark(spark, folder):
    rows = T.transactions(spark, folder)
    nodes = freeze(route.store_to_core(T.nodes(spark, folder), T.STORE_CORES).select("tx_id", "node_id", "core"))
    out = scratch(spark, "watermark")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/{batch_id % 2}")

    def step(target: str) -> None:
        marks = stream.stream_high_watermark(feeds.read_feed(spark, target, rows.schema).join(nodes, "tx_id"))
        feeds.run_available(
            marks.writeStream.outputMode("complete")
            .foreachBatch(save)
            .option("checkpointLocation", f"{out}-progress")
            .trigger(availableNow=True)
            .start()
        )

    arriving(rows, "transactions", "commit_time_ms", step, 2)
    saved = spark.read.parquet(f"{out}/*")
    return saved.filter(F.col("batch_id") == saved.agg(F.max("batch_id")).scalar()).drop("batch_id")


@query
def stream_request_rates(spark, folder):
    rows = T.requests(spark, folder).select(F.col("ts").cast("timestamp").alias("ts"), "ts_ms", "handler")
    outs = {width: scratch(spark, f"rates-{width}") for width in (5, 15)}

    def step(target: str) -> None:
        for width, out in outs.items():
            into(rates.stream_request_rates(feeds.read_feed(spark, target, rows.schema), width), out)

    arriving(rows, "requests", "ts_ms", step, 2)
    found = None
    for out in outs.values():
        part = spark.read.parquet(out).select("handler", "start_ms", "end_ms", "requests", F.round("rate", 6).alias("rate"))
        found = part if found is None else found.unionByName(part)
    return found
