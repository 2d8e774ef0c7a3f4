"""The registered queries once more as SQL for a second engine, on the same parquet tables."""

from __future__ import annotations

from checks.views import ACL_LAST, ACL_STOP, HOLE, LAST, STOP, with_views

DAY = 86400000
HOUR = 3600000
ORACLE: dict[str, str] = {}


def sql(name: str, views: str, text: str, **extra: str) -> None:
    ORACLE[name] = with_views(views, text, extra)


PENDING_TX = f"""
    SELECT * FROM transactions t WHERE NOT (commit_time_ms <= {LAST} AND tx_id IN (SELECT tx_id FROM index_tx))"""
PENDING_SETS = f"""
    SELECT * FROM change_sets c
    WHERE NOT (commit_time_ms <= {ACL_LAST} AND change_set_id IN (SELECT change_set_id FROM index_change_sets))"""
CORE = """CASE regexp_extract(node_ref, '^(.*)/[^/]*$', 1)
    WHEN 'workspace://SpacesStore' THEN 'live' WHEN 'archive://SpacesStore' THEN 'archive'
    WHEN 'workspace://version2Store' THEN 'version' END"""

# --- scans and sources -------------------------------------------------------

sql("scan_transactions", "transactions", f"""
    SELECT * FROM transactions WHERE commit_time_ms >= {LAST - HOLE} AND commit_time_ms < {STOP}
    ORDER BY commit_time_ms, tx_id LIMIT 2000""")
sql("scan_change_sets", "change_sets", f"""
    SELECT * FROM change_sets WHERE commit_time_ms >= {ACL_LAST - HOLE} AND commit_time_ms < {ACL_STOP}
    ORDER BY commit_time_ms, change_set_id LIMIT 2000""")
sql("scan_all_transactions", "transactions", f"""
    SELECT * FROM transactions WHERE commit_time_ms >= {LAST - HOLE} AND commit_time_ms < {STOP}""")
sql("scan_all_change_sets", "change_sets", f"""
    SELECT * FROM change_sets WHERE commit_time_ms >= {ACL_LAST - HOLE} AND commit_time_ms < {ACL_STOP}""")
sql("first_transaction", "transactions", """
    SELECT * FROM transactions WHERE tx_id >= 0 AND tx_id < 2000 ORDER BY commit_time_ms, tx_id LIMIT 1""")
sql("first_change_set", "change_sets", """
    SELECT * FROM change_sets WHERE change_set_id >= 0 AND change_set_id < 2000
    ORDER BY commit_time_ms, change_set_id LIMIT 1""")

PAGES = """
    , paged AS (
        SELECT *, row_number() OVER (PARTITION BY w ORDER BY commit_time_ms, id) AS rn FROM windowed),
    pages AS (SELECT *, id IN (SELECT id FROM memory) AS known FROM paged WHERE rn <= 2000),
    judged AS (
        SELECT w, min(start_ms) AS start_ms,
               CASE WHEN count(*) = 1 THEN min(id) <> (SELECT max_by(id, arrival) FROM memory)
                    ELSE NOT bool_and(known) END AS is_new
        FROM pages GROUP BY w),
    walked AS (SELECT *, w - coalesce(lag(w) OVER (ORDER BY w), -1) > 1 AS gap FROM judged),
    target AS (
        SELECT min(w) AS w FROM walked WHERE is_new AND w <= coalesce(
            (SELECT min(w) - 1 FROM walked WHERE gap AND start_ms >= %d), 9223372036854775807))"""
sql("next_page", "transactions seen", """
    SELECT id AS tx_id, commit_time_ms, updates, deletes FROM pages JOIN target USING (w)""",
    memory="SELECT tx_id AS id, arrival FROM seen",
    windowed=f"""
    SELECT tx_id AS id, commit_time_ms, updates, deletes, (commit_time_ms - {LAST - DAY}) // {HOUR} AS w,
           {LAST - DAY} + (commit_time_ms - {LAST - DAY}) // {HOUR} * {HOUR} AS start_ms
    FROM transactions WHERE commit_time_ms >= {LAST - DAY}) {PAGES % STOP}, done AS (SELECT 1""")
sql("adaptive_windows", "change_sets index_change_sets", """
    SELECT id AS change_set_id, commit_time_ms, acl_count FROM pages JOIN target USING (w)""",
    memory="""
    SELECT change_set_id AS id, row_number() OVER (ORDER BY commit_time_ms, change_set_id) AS arrival FROM (
        SELECT * FROM change_sets WHERE change_set_id IN (SELECT change_set_id FROM index_change_sets)
        ORDER BY commit_time_ms DESC, change_set_id DESC LIMIT 100)""",
    schedule=f"""
    SELECT k AS w, {ACL_LAST - DAY} + CAST(sum(width) OVER (ORDER BY k) - width AS BIGINT) AS start_ms, width
    FROM (SELECT k, CAST(least(power(2, k), 768) AS BIGINT) * {HOUR} AS width FROM (SELECT unnest(range(0, 200)) AS k))""",
    windowed=f"""
    SELECT change_set_id AS id, commit_time_ms, acl_count, w, start_ms
    FROM change_sets JOIN schedule ON commit_time_ms >= start_ms AND commit_time_ms < start_ms + width)
    {PAGES % ACL_STOP}, done AS (SELECT 1""")
sql("next_commit_time", "transactions", f"""
    SELECT 'inside' AS "at", coalesce(min(commit_time_ms), -1) AS next_commit_ms
    FROM transactions WHERE commit_time_ms >= {LAST + 1}
    UNION ALL
    SELECT 'behind', coalesce(min(commit_time_ms), -1) FROM transactions WHERE commit_time_ms >= 4102444800000""")
sql("next_commit_page", "transactions", f"""
    SELECT t.* FROM transactions t, (SELECT min(commit_time_ms) AS b FROM transactions WHERE commit_time_ms >= {LAST + 1})
    WHERE commit_time_ms >= b AND commit_time_ms < b + {HOUR} ORDER BY commit_time_ms, tx_id LIMIT 2000""")
BOUND = "(SELECT max(p_partkey) + 1 FROM part)"
sql("commit_interval", "nodes transactions", f"""
    SELECT coalesce(min(commit_time_ms), -1) AS min_commit_ms, coalesce(max(commit_time_ms), -1) AS max_commit_ms
    FROM transactions WHERE tx_id IN (
        SELECT tx_id FROM nodes WHERE node_id >= {BOUND} // 3 AND node_id < {BOUND} // 3 * 2)""")
sql("nodes_by_id_range", "current_nodes", f"""
    SELECT * FROM current_nodes WHERE node_id BETWEEN {BOUND} // 2 AND {BOUND} // 2 * 2""")
sql("scan_object_inventory", "objects", "SELECT * FROM objects WHERE starts_with(key, 'backups/')")
sql("scan_access_log", "access_lines", """
    SELECT split_part(value, ' ', 1) AS host,
           epoch_ms(strptime(substr(split_part(value, '[', 2), 1, 20), '%d/%b/%Y:%H:%M:%S')) AS ts_ms,
           ltrim(split_part(value, ' ', 6), '"') AS method, split_part(value, ' ', 7) AS path,
           CAST(split_part(value, ' ', 9) AS INTEGER) AS status, CAST(split_part(value, ' ', 10) AS BIGINT) AS bytes
    FROM (SELECT * FROM access_lines WHERE value NOT LIKE 'malformed%' AND value NOT LIKE '%/Foo/%' AND value NOT LIKE '% 99999999999999999999')""")
sql("read_lines", "access_lines", """
    SELECT value AS line, count(*) AS n FROM access_lines GROUP BY 1""")
sql("list_objects", "index_tx", """
    SELECT 'stretch=' || CAST(tx_id % 3 AS VARCHAR) AS folder, true AS listed, true AS has_bytes FROM index_tx GROUP BY 1""")
sql("scan_access_log_rejects", "access_lines", """
    SELECT value FROM access_lines
    WHERE value LIKE 'malformed%' OR value LIKE '%/Foo/%' OR value LIKE '% 99999999999999999999'""")

# --- filters -----------------------------------------------------------------

sql("pending_transactions", "transactions index_tx", PENDING_TX)
sql("pending_change_sets", "change_sets index_change_sets", PENDING_SETS)
ORACLE["already_seen"] = with_views("transactions seen", " UNION ALL ".join(
    f"""SELECT count(*) AS page_rows,
           CASE WHEN (SELECT count(*) FROM seen) = 0 THEN false
                WHEN count(*) = 1 THEN min(tx_id) = (SELECT max_by(tx_id, arrival) FROM seen)
                ELSE coalesce(bool_and(tx_id IN (SELECT tx_id FROM seen)), true) END AS already_seen,
           {d} AS days_back
        FROM (SELECT * FROM transactions WHERE commit_time_ms >= {LAST - d * DAY} AND commit_time_ms < {LAST - (d - 1) * DAY}
              ORDER BY commit_time_ms, tx_id LIMIT 2000)""" for d in (1, 5, -1)))
sql("stop_guard", "transactions", f"""
    SELECT *, 'up to the stop' AS page FROM transactions WHERE commit_time_ms <= {STOP}
    UNION ALL
    SELECT *, 'past the stop' FROM transactions WHERE (SELECT max(commit_time_ms) FROM transactions) <= {STOP}""")
sql("nonempty_transactions", "transactions", "SELECT * FROM transactions WHERE updates > 0 OR deletes > 0")
sql("nonempty_change_sets", "change_sets", "SELECT * FROM change_sets WHERE acl_count > 0")
sql("resume_point", "seen", f"""
    SELECT max_by(commit_time_ms, arrival) AS from_commit_ms, 'filled' AS memory FROM seen
    UNION ALL SELECT {LAST}, 'empty'""")
sql("hole_rescan", "transactions index_tx", f"""
    SELECT * FROM ({PENDING_TX}) WHERE commit_time_ms >= {LAST - 30 * DAY}""")
sql("clamp_to_shard_range", "transactions nodes index_tx", f"""
    SELECT tx_id, commit_time_ms, updates, deletes, 'inside' AS shard FROM transactions
    WHERE commit_time_ms >= greatest({LAST}, (
        SELECT min(commit_time_ms) FROM transactions WHERE tx_id IN (SELECT tx_id FROM nodes)))
    UNION ALL
    SELECT max(tx_id), max(commit_time_ms), NULL, NULL, 'empty' FROM transactions
    HAVING NOT (max(commit_time_ms) <= {LAST} AND max(tx_id) IN (SELECT tx_id FROM index_tx))""")

# --- joins -------------------------------------------------------------------

sql("nodes_of_transactions", "nodes transactions index_tx", f"""
    SELECT n.*, p.commit_time_ms FROM nodes n JOIN ({PENDING_TX}) p ON p.tx_id = n.tx_id
    WHERE store_protocol = 'workspace' AND store_identifier = 'SpacesStore' AND shard_property = 'O'""")
sql("nodes_of_transaction", "nodes", """
    SELECT * FROM nodes WHERE store_protocol = 'workspace' AND store_identifier = 'SpacesStore'
    AND tx_id = (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)""")
sql("acls_of_change_sets", "acls change_sets index_change_sets", f"""
    SELECT a.* FROM acls a JOIN ({PENDING_SETS}) p ON p.change_set_id = a.change_set_id""")
sql("acls_of_change_set", "acls change_sets", """
    SELECT acl_id FROM acls WHERE change_set_id = (
        SELECT change_set_id FROM change_sets WHERE acl_count > 0 ORDER BY commit_time_ms DESC, change_set_id DESC LIMIT 1)""")
WANTED_ACLS = f"SELECT acl_id FROM acls WHERE change_set_id IN (SELECT change_set_id FROM ({PENDING_SETS}))"
sql("readers_of_acls", "acl_readers acls change_sets index_change_sets", f"""
    SELECT DISTINCT acl_id, authority FROM acl_readers WHERE acl_id IN ({WANTED_ACLS})""")
sql("visible_nodes", "index_nodes acl_readers", """
    SELECT * FROM index_nodes WHERE acl_id IN (
        SELECT acl_id FROM acl_readers WHERE authority IN ('GROUP_BUILDING', 'GROUP_MACHINERY'))""")

sql("visible_by_bitmap", "index_nodes acl_readers", """
    SELECT * FROM index_nodes WHERE acl_id IN (
        SELECT acl_id FROM acl_readers WHERE authority IN ('GROUP_BUILDING', 'GROUP_MACHINERY'))""")


def compared(source: str, index: str, key: str) -> str:
    return f"""
    SELECT coalesce(s.k, i.k) AS {key}, coalesce(s.n, 0) AS in_source, coalesce(i.n, 0) AS in_index,
           CASE WHEN s.k IS NULL THEN 'extra' WHEN i.k IS NULL THEN 'missing' WHEN i.n > 1 THEN 'duplicate'
                ELSE 'ok' END AS status
    FROM (SELECT {key} AS k, count(*) AS n FROM {source} GROUP BY 1) s
    FULL JOIN (SELECT {key} AS k, count(*) AS n FROM {index} GROUP BY 1) i ON s.k = i.k"""


sql("repo_vs_index", "transactions index_tx", compared("transactions", "index_tx", "tx_id"))
sql("repo_vs_index_acl", "change_sets index_change_sets", compared("change_sets", "index_change_sets", "change_set_id"))

sql("repo_vs_index_differences", "transactions index_tx", f"""
    SELECT * FROM ({compared("transactions", "index_tx", "tx_id")}) WHERE in_source <> in_index""")

# --- routing and scalar functions --------------------------------------------

sql("route_nodes", "nodes", f"""
    SELECT tx_id, node_id, CAST(node_id % 3 AS INTEGER) AS shard,
           CASE WHEN node_id < {BOUND} // 3 THEN 0 WHEN node_id < 2 * {BOUND} // 3 THEN 1 ELSE 2 END AS range_shard
    FROM nodes""")
sql("route_acls", "acls", """
    SELECT acls.*, CAST(s AS INTEGER) AS shard FROM acls, unnest(range(0, 3)) AS t(s)""")
sql("expand_shard_range", "", f"""
    SELECT *, greatest(end_id, index_cap) AS effective_end, index_cap > end_id AS expanded FROM (
        SELECT CAST(i AS INTEGER) AS shard, i * n // 3 AS start_id, (i + 1) * n // 3 AS end_id,
               CASE i WHEN 0 THEN (i + 1) * n // 3 + 100 WHEN 1 THEN -1 ELSE n - 50 END AS index_cap
        FROM (SELECT max(p_partkey) + 1 AS n FROM part), unnest(range(0, 3)) AS t(i))""")
sql("shard_view", "nodes", """
    SELECT CAST(s AS INTEGER) AS shard, acl_id, node_id, node_ref, tenant, tx_id,
           CASE WHEN node_id % 3 = s THEN status WHEN status = 'UPDATED' THEN 'NON_SHARD_UPDATED'
                ELSE 'NON_SHARD_DELETED' END AS status
    FROM nodes, unnest(range(0, 3)) AS t(s)""")
sql("shard_view_home", "nodes", """
    SELECT CAST(node_id % 3 AS INTEGER) AS shard, acl_id, node_id, node_ref, tenant, tx_id, status FROM nodes""")
sql("store_to_core", "nodes", f"SELECT tx_id, node_id, node_ref, {CORE} AS core FROM nodes")
TRIM = "regexp_replace({0}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
PATH = TRIM.format("regexp_replace(" + TRIM.format("raw_key") + ", '^/', '')")
FILE = TRIM.format("regexp_replace(path, '/$', '')")
sql("normalize_key", "raw_keys", f"""
    SELECT event_id, path, nullif({FILE}, '') AS file, CASE WHEN {FILE} = '' THEN 'empty key' END AS file_error,
           CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END AS dir
    FROM (SELECT event_id, {PATH} AS path FROM raw_keys)""")
sql("parent_key", "raw_keys", f"""
    SELECT event_id, key, CASE
        WHEN strpos(key, '/') = 0 THEN ''
        WHEN length(rtrim_one) <= 1 THEN '/'
        ELSE coalesce(substr(rtrim_one, 1, nullif(length(rtrim_one) - strpos(reverse(rtrim_one), '/') + 1,
                             length(rtrim_one) + 1)), '') END AS parent
    FROM (SELECT event_id, {PATH} AS key, regexp_replace({PATH}, '/$', '') AS rtrim_one FROM raw_keys)""")
sql("location_uri", "", """
    SELECT event_id,
           CASE WHEN event_id % 4 > 0 THEN 's3' END AS scheme,
           CASE WHEN event_id % 4 = 3 THEN 'bucket' END AS host,
           CASE WHEN event_id % 4 > 0 THEN '/' || k || '/' END AS path,
           CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 4 = 3 THEN 'bucket' ELSE '' END || '/' || k || '/' END AS key,
           CASE WHEN event_id % 4 = 0 THEN 'empty location' END AS error
    FROM (SELECT event_id, event_type || '/' || CAST(user_id AS VARCHAR) AS k FROM events)""")
sql("resolve_key", "", """
    SELECT event_id,
           CASE event_id % 4 WHEN 0 THEN '/backups/' || event_type || '/' || u WHEN 1 THEN '/backups/' || u
                WHEN 2 THEN '/' || event_type || '/x/y/' || u ELSE '/b/' || event_type || '/' || u END AS key,
           CASE event_id % 4 WHEN 0 THEN '/backups/' WHEN 1 THEN '/backups/' WHEN 2 THEN '/' ELSE '/b/' END
               || event_type || '/' AS dir
    FROM (SELECT event_id, event_type, 'u' || CAST(user_id AS VARCHAR) AS u FROM events)""")
sql("pairs_to_map", "backup_details", """
    SELECT event_id, CAST(3 + (shape >= 2)::INT AS BIGINT) AS fields, status, file_count, completed_at,
           CASE WHEN shape = 2 THEN 'x' END AS null_key, shape = 3 AS has_exception
    FROM backup_details""")
sql("snapshot_name", "objects", """
    SELECT key, nullif(regexp_extract(key, 'snapshot\\.(.*?)/', 1), '') AS snapshot FROM objects""")
HANDLER = """
    SELECT handler, count(*) AS requests, count(*) FILTER (is_error) AS errors, count(*) FILTER (is_timeout) AS timeouts,
           round(sum(elapsed_ms), 6) AS total_time, round(avg(elapsed_ms), 6) AS avg_time_per_request,
           round(count(*) * 1000.0::DOUBLE / (max(ts_ms) - min(ts_ms)), 6) AS avg_requests_per_second,
           round(quantile_cont(elapsed_ms, 0.5), 6) AS median, round(quantile_cont(elapsed_ms, 0.75), 6) AS p75,
           round(quantile_cont(elapsed_ms, 0.95), 6) AS p95, round(quantile_cont(elapsed_ms, 0.99), 6) AS p99,
           round(quantile_cont(elapsed_ms, 0.999), 6) AS p999
    FROM requests GROUP BY handler"""
ATTRIBUTES = ["requests", "errors", "timeouts", "total_time", "avg_time_per_request", "avg_requests_per_second",
              "median", "p75", "p95", "p99", "p999"]
sql("metric_long_form", "requests", " UNION ALL ".join(
    f"SELECT 'handler.' || ltrim(handler, '/') || '.{a}' AS alias, CAST({a} AS DOUBLE) AS value FROM stats"
    for a in ATTRIBUTES), stats=HANDLER)

# --- aggregations ------------------------------------------------------------

sql("server_maxima", "transactions change_sets", """
    SELECT max(commit_time_ms) AS max_commit_ms, max(tx_id) AS max_id, 'transactions' AS feed FROM transactions
    UNION ALL SELECT max(commit_time_ms), max(change_set_id), 'change sets' FROM change_sets""")
sql("high_watermark", "transactions index_tx", f"""
    SELECT commit_time_ms, tx_id FROM (
        SELECT commit_time_ms, tx_id FROM ({PENDING_TX}) UNION ALL SELECT {LAST}, 0)
    ORDER BY commit_time_ms DESC, tx_id DESC LIMIT 1""")
sql("recover_state", "index_tx index_change_sets", """
    SELECT * FROM (SELECT commit_time_ms, tx_id AS id, 'tx' AS "index" FROM index_tx
                   ORDER BY commit_time_ms DESC, tx_id DESC LIMIT 1)
    UNION ALL
    SELECT * FROM (SELECT commit_time_ms, change_set_id, 'change sets' FROM index_change_sets
                   ORDER BY commit_time_ms DESC, change_set_id DESC LIMIT 1)
    UNION ALL SELECT 0, 0, 'empty'""")
BATCHED = f"""
    SELECT *, docs_before // 2000 AS batch_no FROM (
        SELECT *, CAST(coalesce(sum(updates + deletes) OVER (
            ORDER BY commit_time_ms, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS docs_before
        FROM ({PENDING_TX}))"""
COUNTED = f"""
    SELECT *, position // 512 AS batch_no FROM (
        SELECT *, row_number() OVER (ORDER BY commit_time_ms, change_set_id) - 1 AS position FROM ({PENDING_SETS}))"""
sql("feed_stats", "transactions index_tx", """
    SELECT batch_no, count(*) AS transactions, CAST(sum(updates + deletes) AS BIGINT) AS docs,
           min(commit_time_ms) AS first_commit_ms, max(commit_time_ms) AS last_commit_ms
    FROM batched GROUP BY batch_no""", batched=BATCHED)
sql("feed_stats_acl", "change_sets index_change_sets", """
    SELECT batch_no, count(*) AS change_sets, CAST(sum(acl_count) AS BIGINT) AS acls,
           min(commit_time_ms) AS first_commit_ms, max(commit_time_ms) AS last_commit_ms
    FROM batched GROUP BY batch_no""", batched=COUNTED)
sql("core_doc_counts", "index_nodes", f"""
    SELECT core, count(node_id) AS docs
    FROM (VALUES ('live'), ('archive'), ('version'), ('not yet created')) AS c(core)
    LEFT JOIN (SELECT node_id, {CORE} AS core FROM index_nodes) USING (core) GROUP BY core""")
sql("total_docs", "index_nodes", "SELECT count(*) AS total_docs FROM index_nodes")
sql("searcher_counts", "current_nodes", f"""
    SELECT {CORE} AS core, count(*) FILTER (status <> 'DELETED') AS num_docs,
           count(*) FILTER (status = 'DELETED') AS deleted_docs, count(*) AS max_doc
    FROM current_nodes GROUP BY 1""")
sql("handler_stats", "requests", HANDLER)
sql("handler_sketches", "requests", """
    SELECT handler, count(*) AS requests, count(*) FILTER (is_error) AS errors, count(*) FILTER (is_timeout) AS timeouts,
           round(sum(elapsed_ms), 6) AS total_time, true AS median_near, true AS p75_near, true AS p95_near,
           true AS p99_near, true AS p999_near
    FROM requests GROUP BY handler""")
sql("cache_stats", "cache_events", """
    SELECT cache, count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (insert_) AS inserts,
           count(*) FILTER (evict) AS evictions, round(count(*) FILTER (hit) / count(*), 6) AS hitratio,
           count(*) FILTER (insert_) - count(*) FILTER (evict) AS size
    FROM cache_events GROUP BY cache""")
sql("cache_stats_cumulative", "cache_events", """
    SELECT cache, period, cumulative_lookups, cumulative_hits, cumulative_inserts, cumulative_evictions,
           round(cumulative_hits / cumulative_lookups, 6) AS cumulative_hitratio
    FROM (
        SELECT DISTINCT cache, period, CAST(count(*) OVER w AS BIGINT) AS cumulative_lookups,
               CAST(sum(hit::INT) OVER w AS BIGINT) AS cumulative_hits,
               CAST(sum(insert_::INT) OVER w AS BIGINT) AS cumulative_inserts,
               CAST(sum(evict::INT) OVER w AS BIGINT) AS cumulative_evictions
        FROM (SELECT *, ts_ms // 3600000 AS period FROM cache_events)
        WINDOW w AS (PARTITION BY cache ORDER BY period RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
sql("cache_stats_field", "", """
    SELECT count(*) AS entries_count, count(*) FILTER (n > 1) AS insanity_count
    FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)""")
FACETS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM names WHERE {f} IS NOT NULL GROUP BY {f}"
    for f in ("category", "title", "name"))
sql("facet_counts", "names", FACETS)
sql("facet_counts_top", "names", f"""
    SELECT field, value, n FROM ({FACETS})
    QUALIFY row_number() OVER (PARTITION BY field ORDER BY n DESC, value) <= 3""")

# --- reports -----------------------------------------------------------------


def checked(
    name: str, feed: str, index: str, key: str, begin: str, cut: str, from_first: bool = False, tail: str = "SELECT * FROM report"
) -> None:
    least = f"(SELECT {key} FROM covered ORDER BY rn LIMIT 1)" if from_first else f"(SELECT min({key}) FROM (SELECT {key} FROM {feed} UNION ALL SELECT {key} FROM {index}))"
    inside = f"coalesce({key} >= {least} AND {key} <= (SELECT max({key}) FROM covered), false)"
    sql(name, f"{feed} {index}", tail,
        ordered=f"""
        SELECT *, commit_time_ms >= {begin} AS begun, row_number() OVER (ORDER BY commit_time_ms, {key}) AS rn FROM {feed}""",
        covered=f"""
        SELECT * FROM ordered WHERE begun
        AND rn < coalesce((SELECT min(rn) FROM ordered WHERE begun AND ({cut})), 9223372036854775807)""",
        held=f"SELECT * FROM {index} WHERE {inside}",
        bounded=f"SELECT * FROM covered WHERE {inside}",
        out_source=f"SELECT * FROM ordered WHERE rn NOT IN (SELECT rn FROM bounded)",
        out_index=f"SELECT * FROM {index} WHERE NOT {inside}",
        compared=compared("bounded", "held", key),
        outside=compared("out_source", "out_index", key),
        report="SELECT * FROM compared UNION ALL SELECT * REPLACE ('outside' AS status) FROM outside")


START_TX, START_SET = "(SELECT min(commit_time_ms) FROM transactions)", "(SELECT min(commit_time_ms) FROM change_sets)"
FIRST_TX = "(SELECT commit_time_ms FROM transactions WHERE tx_id < 2000 ORDER BY commit_time_ms, tx_id LIMIT 1)"
checked("check_index_tx", "transactions", "index_tx", "tx_id", START_TX, f"commit_time_ms > {STOP}")
checked("check_index_tx_prefix", "transactions", "index_tx", "tx_id", FIRST_TX,
        "tx_id > (SELECT max(o_orderkey) - 3 FROM orders)", from_first=True)
checked("check_index_acl", "change_sets", "index_change_sets", "change_set_id", START_SET, f"commit_time_ms > {ACL_STOP}")
checked("check_index_summary", "transactions", "index_tx", "tx_id", START_TX, f"commit_time_ms > {STOP}", tail="""
    SELECT status, count(*) AS ids, CAST(sum(in_source) AS BIGINT) AS in_source, CAST(sum(in_index) AS BIGINT) AS in_index
    FROM report GROUP BY status""")
sql("check_node", "current_nodes index_nodes", f"""
    SELECT a.node_id, coalesce(c.status, 'UNKNOWN') AS db_status, coalesce(c.tx_id, -1) AS db_tx,
           CAST((i.node_id IS NOT NULL)::INT AS BIGINT) AS in_index, i.tx_id AS index_tx
    FROM (SELECT p_partkey AS node_id FROM part UNION ALL SELECT p_partkey + {BOUND} FROM part) a
    LEFT JOIN current_nodes c ON c.node_id = a.node_id LEFT JOIN index_nodes i ON i.node_id = a.node_id""")
sql("check_acl", "acl_readers index_acls", """
    SELECT c_custkey AS acl_id, c_custkey IN (SELECT acl_id FROM acl_readers) AS exists_in_db,
           (SELECT count(*) FROM index_acls i WHERE i.acl_id = c_custkey) AS in_index
    FROM customer""")


def first_checked(case: str, feed: str, index: str, key: str, status: str, state: str, empty: bool = False) -> str:
    return f"""
    SELECT max({key}) AS first_id, max(commit_time_ms) AS first_commit_ms, max(m) AS matches,
           {status} AS status, {state} AS state_ms, '{case}' AS "case"
    FROM (SELECT {key}, commit_time_ms,
                 (SELECT count(*) FROM {index} i WHERE i.{key} = f.{key} AND i.commit_time_ms = f.commit_time_ms) AS m
          FROM {feed} f WHERE {key} < 2000 ORDER BY commit_time_ms, {key} LIMIT 1)"""


FOUND = "CASE max(m) WHEN 0 THEN 'not in index' WHEN 1 THEN 'verified' ELSE 'duplicate' END"
sql("check_first", "transactions index_tx change_sets index_change_sets", " UNION ALL ".join([
    first_checked("tx", "transactions", "index_tx", "tx_id", FOUND, str(LAST)),
    first_checked("tx, new index", "transactions", "index_tx", "tx_id", "'nothing to verify'", "max(commit_time_ms)"),
    # An empty shard's interval starts at -1: no row is left out, and none is checked.
    first_checked("tx, empty shard", "transactions", "index_tx", "tx_id", "'skipped'", str(LAST)),
    first_checked("change sets", "change_sets", "index_change_sets", "change_set_id", FOUND, str(ACL_LAST))]))


def last_checked(case: str, feed: str, index: str, key: str) -> str:
    return f"""
    SELECT source_ms, source_id, index_ms, CASE WHEN source_ms IS NULL THEN 'undecided'
           WHEN index_ms > source_ms THEN 'index ahead of source' ELSE 'verified' END AS status, '{case}' AS "case"
    FROM (SELECT max(commit_time_ms) AS source_ms, max({key}) AS source_id FROM {feed}),
         (SELECT max(commit_time_ms) AS index_ms FROM {index})"""


sql("check_last", "transactions index_tx change_sets index_change_sets", " UNION ALL ".join([
    last_checked("tx", "transactions", "index_tx", "tx_id"),
    last_checked("source cut off", f"(SELECT * FROM transactions WHERE commit_time_ms < {LAST - 30 * DAY})", "index_tx", "tx_id"),
    last_checked("no source", "(SELECT * FROM transactions WHERE false)", "index_tx", "tx_id"),
    last_checked("change sets", "change_sets", "index_change_sets", "change_set_id")]))


def settled(name: str, hold: int) -> None:
    sql(name, "doc_samples", f"""
    SELECT core, min(sample_ms) AS settled_ms, CAST(min_by(docs, sample_ms) AS BIGINT) AS docs FROM (
        SELECT *, min(sample_ms) OVER (PARTITION BY core, stretch) AS begin_ms FROM (
            SELECT *, sum((NOT still)::INT) OVER (PARTITION BY core ORDER BY sample_ms) AS stretch FROM (
                SELECT *, docs > 0 AND docs = coalesce(lag(docs) OVER (PARTITION BY core ORDER BY sample_ms), -1) AS still
                FROM doc_samples)) WHERE still)
    WHERE sample_ms - begin_ms >= {hold} GROUP BY core""")


settled("settled_at", 10000)
settled("settled_at_long", 600000)
sql("readiness", "access_lines index_nodes names", """
    SELECT *, has_hits AND probes_ok AND shards_ok AS ready FROM (
        SELECT (SELECT count(*) FROM names WHERE regexp_matches(lower(name), '(^|[^\\p{L}\\p{N}])ring')) > 0 AS has_hits,
               (SELECT bool_and(split_part(value, ' ', 9) = '200') FROM access_lines
                WHERE value NOT LIKE 'malformed%' AND value NOT LIKE '%GET /error %') AS probes_ok,
               (SELECT bool_and(n > 50) FROM (SELECT count(*) AS n FROM index_nodes GROUP BY node_id % 3)) AS shards_ok)""")

# --- batches and top-k -------------------------------------------------------

sql("weighted_batches", "transactions index_tx", BATCHED)
sql("count_batches", "change_sets index_change_sets", COUNTED)
sql("fixed_chunks", "nodes transactions index_tx", """
    SELECT b.batch_no, n.tx_id, n.node_id,
           (row_number() OVER (PARTITION BY batch_no ORDER BY n.tx_id, n.node_id) - 1) // 50 AS chunk_no
    FROM nodes n JOIN batched b ON b.tx_id = n.tx_id""", batched=BATCHED)
sql("fixed_chunks_acl", "acls change_sets index_change_sets", """
    SELECT b.batch_no, a.change_set_id, a.acl_id,
           (row_number() OVER (PARTITION BY batch_no ORDER BY a.change_set_id, a.acl_id) - 1) // 100 AS chunk_no
    FROM acls a JOIN batched b ON b.change_set_id = a.change_set_id""", batched=COUNTED)
sql("delete_batches", "objects", """
    SELECT key, position, position // 1000 AS batch_no FROM (
        SELECT key, row_number() OVER (ORDER BY key DESC) - 1 AS position FROM (SELECT DISTINCT key FROM objects))""")
sql("latest_per_node", "current_nodes", "SELECT * FROM current_nodes")
sql("request_rates", "requests", """
    SELECT handler, second, requests,
           round(sum(requests) OVER (PARTITION BY handler ORDER BY second RANGE BETWEEN 299 PRECEDING AND CURRENT ROW) / 300, 6) AS rate_5min,
           round(sum(requests) OVER (PARTITION BY handler ORDER BY second RANGE BETWEEN 899 PRECEDING AND CURRENT ROW) / 900, 6) AS rate_15min
    FROM (SELECT handler, ts_ms // 1000 AS second, count(*) AS requests FROM requests GROUP BY ALL)""")

# --- search ------------------------------------------------------------------

sql("field_prefix_search", "names", """
    SELECT node_id, 'word' AS mode FROM names WHERE regexp_matches(lower(name), '(^|[^\\p{L}\\p{N}])wid')
    UNION ALL SELECT node_id, 'value' FROM names WHERE lower(name) LIKE 'red%'
    UNION ALL SELECT node_id, 'case' FROM names WHERE title LIKE 'Brand#1%'
    UNION ALL SELECT node_id, 'content' FROM names WHERE regexp_matches(lower(content), '(^|[^\\p{L}\\p{N}])the')""")
RINGS = "SELECT node_id, name FROM names WHERE regexp_matches(lower(name), '(^|[^\\p{L}\\p{N}])ring')"
sql("search_page", "names", f"""
    SELECT *, (SELECT count(*) FROM ({RINGS})) AS total_items FROM ({RINGS}) ORDER BY node_id LIMIT 25 OFFSET 5""")
POSTED = "regexp_matches(lower({f}), '(^|[^\\p{{L}}\\p{{N}}]){p}')"
sql("postings_search", "names", " UNION ALL ".join(
    f"SELECT DISTINCT node_id, '{f} {p}' AS mode FROM names WHERE "
    + (POSTED.format(f=f, p=p.lower()) if p else f"regexp_matches(lower({f}), '[\\p{{L}}\\p{{N}}]')")
    for f, p in [("name", "Wid"), ("name", "ring"), ("content", "the"), ("content", "")]))
sql("reindex_by_postings", "names index_nodes", f"""
    SELECT node_id FROM index_nodes WHERE node_id IN (SELECT node_id FROM ({RINGS}))""")
sql("suggest_from_dictionary", "names", """
    SELECT term, count(*) AS n FROM (
        SELECT unnest(string_split_regex(lower(concat_ws(' ', name, title, description, content)), '[^\\p{L}\\p{N}]+')) AS term FROM names)
    WHERE starts_with(term, 're') GROUP BY term ORDER BY n DESC, term LIMIT 20""")
sql("suggest_terms", "names", """
    SELECT term, count(*) AS n FROM (
        SELECT unnest(string_split_regex(lower(concat_ws(' ', name, title, description, content)), '[^\\p{L}\\p{N}]+')) AS term FROM names)
    WHERE starts_with(term, 're') GROUP BY term ORDER BY n DESC, term LIMIT 20""")
sql("reindex_by_query", "names index_nodes", f"""
    SELECT node_id FROM index_nodes WHERE node_id IN (SELECT node_id FROM ({RINGS}))""")

# --- index mutation ----------------------------------------------------------

NODE = "node_id, tx_id, acl_id, node_ref, tenant, status"


def wanted(kind: str, action: str) -> str:
    return f"(SELECT id FROM maintenance_requests WHERE kind = '{kind}' AND action = '{action}')"


sql("upsert_nodes", "index_nodes current_nodes", f"""
    SELECT {NODE} FROM index_nodes WHERE node_id NOT IN (SELECT node_id FROM current_nodes)
    UNION ALL SELECT {NODE} FROM current_nodes WHERE status <> 'DELETED'""")
sql("append_nodes", "index_nodes current_nodes", f"""
    SELECT {NODE} FROM index_nodes UNION ALL
    SELECT {NODE} FROM current_nodes WHERE status <> 'DELETED' AND node_id NOT IN (SELECT node_id FROM index_nodes)""")
sql("delete_by_node", "index_nodes maintenance_requests", f"""
    SELECT {NODE} FROM index_nodes WHERE node_id NOT IN {wanted('node', 'purge')}""")
sql("delete_by_tx", "index_nodes index_tx maintenance_requests", f"""
    SELECT 'node' AS doc, node_id AS id, tx_id FROM index_nodes WHERE tx_id NOT IN {wanted('tx', 'purge')}
    UNION ALL SELECT 'tx', tx_id, tx_id FROM index_tx WHERE tx_id NOT IN {wanted('tx', 'purge')}""")
FAILED = "SELECT event_id FROM events WHERE event_type = 'error' AND value > 200"
sql("delete_by_acl", "index_acls acls", f"""
    SELECT * FROM index_acls WHERE acl_id NOT IN (SELECT user_id FROM events WHERE user_id % 10 = 1)""")
sql("delete_by_change_set", "index_acls acls index_change_sets", f"""
    SELECT 'acl' AS doc, acl_id AS id, authority FROM index_acls
    WHERE acl_id NOT IN (SELECT acl_id FROM acls WHERE change_set_id IN ({FAILED}))
    UNION ALL SELECT 'change set', change_set_id, '' FROM index_change_sets
    WHERE change_set_id NOT IN ({FAILED} UNION ALL SELECT event_id + (SELECT max(event_id) + 1 FROM events) FROM events WHERE event_type = 'error' AND value > 200)""")
sql("write_markers", "index_tx transactions", """
    SELECT tx_id, commit_time_ms FROM index_tx WHERE tx_id NOT IN (SELECT tx_id FROM transactions)
    UNION ALL SELECT tx_id, commit_time_ms FROM transactions""")


def with_docs(nodes: str, markers: str, lost: str) -> str:
    return f"""
    SELECT 'node' AS doc, node_id AS id, tx_id, status FROM {nodes}
    UNION ALL SELECT 'tx', tx_id, tx_id, NULL FROM {markers}
    UNION ALL SELECT 'not found', id, id, NULL FROM {lost}"""


def not_in_feed(action: str) -> str:
    return f"SELECT id FROM {wanted('tx', action)} WHERE id NOT IN (SELECT tx_id FROM transactions)"


def marked(base: str, action: str) -> str:
    """Markers after the requested transactions were written again (once each)."""
    return f"""
    SELECT tx_id FROM {base} WHERE tx_id NOT IN {wanted('tx', action)}
    UNION ALL SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', action)}"""


sql("reindex_transactions", "index_nodes index_tx transactions current_nodes maintenance_requests",
    with_docs("after", "markers", "lost"),
    fresh=f"SELECT * FROM current_nodes WHERE tx_id IN {wanted('tx', 'reindex')}",
    after=f"""
    SELECT {NODE} FROM index_nodes
    WHERE tx_id NOT IN {wanted('tx', 'reindex')} AND node_id NOT IN (SELECT node_id FROM fresh)
    UNION ALL SELECT {NODE} FROM fresh WHERE status <> 'DELETED'""",
    markers=marked("index_tx", "reindex"), lost=not_in_feed("reindex"))
sql("index_transactions", "index_nodes index_tx transactions current_nodes maintenance_requests",
    with_docs("after", "markers", "lost"),
    after=f"""
    SELECT {NODE} FROM index_nodes UNION ALL SELECT {NODE} FROM current_nodes
    WHERE tx_id IN {wanted('tx', 'index')} AND status <> 'DELETED' AND node_id NOT IN (SELECT node_id FROM index_nodes)""",
    markers=f"""
    SELECT tx_id FROM index_tx WHERE tx_id NOT IN (
        SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', 'index')})
    UNION ALL SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', 'index')}""",
    lost=not_in_feed("index"))
sql("reindex_nodes", "index_nodes current_nodes maintenance_requests", f"""
    SELECT {NODE} FROM index_nodes WHERE node_id NOT IN {wanted('node', 'reindex')}
    UNION ALL SELECT {NODE} FROM current_nodes WHERE node_id IN {wanted('node', 'reindex')} AND status <> 'DELETED'""")
sql("index_nodes", "index_nodes current_nodes maintenance_requests", f"""
    SELECT {NODE} FROM index_nodes UNION ALL
    SELECT {NODE} FROM current_nodes WHERE node_id IN {wanted('node', 'index')} AND status <> 'DELETED'
    AND node_id NOT IN (SELECT node_id FROM index_nodes)""")
sql("upsert_acls", "index_acls acl_readers acls change_sets index_change_sets", f"""
    SELECT acl_id, authority FROM index_acls WHERE acl_id NOT IN ({WANTED_ACLS})
    UNION ALL SELECT acl_id, authority FROM acl_readers WHERE acl_id IN ({WANTED_ACLS})""")
LOST_SETS = "SELECT event_id + (SELECT max(event_id) + 1 FROM events) FROM events WHERE event_type = 'error' AND value > 200"
FAILED_ACLS = f"SELECT acl_id FROM acls WHERE change_set_id IN ({FAILED})"
REWRITTEN_SETS = f"""
    SELECT 'change set', change_set_id, NULL FROM index_change_sets WHERE change_set_id NOT IN ({FAILED} UNION ALL {LOST_SETS})
    UNION ALL SELECT 'change set', event_id, NULL FROM events WHERE event_type = 'error' AND value > 200
    UNION ALL SELECT 'not found', * , NULL FROM ({LOST_SETS})"""
sql("reindex_change_sets", "index_acls acl_readers acls index_change_sets", f"""
    SELECT 'acl' AS doc, acl_id AS id, authority FROM index_acls WHERE acl_id NOT IN ({FAILED_ACLS})
    UNION ALL SELECT 'acl', acl_id, authority FROM acl_readers WHERE acl_id IN ({FAILED_ACLS})
    UNION ALL {REWRITTEN_SETS}""")
sql("index_change_sets", "index_acls acl_readers acls index_change_sets", f"""
    SELECT 'acl' AS doc, acl_id AS id, authority FROM index_acls
    UNION ALL SELECT 'acl', acl_id, authority FROM acl_readers
    WHERE acl_id IN ({FAILED_ACLS}) AND acl_id NOT IN (SELECT acl_id FROM index_acls)
    UNION ALL {REWRITTEN_SETS.replace(f"NOT IN ({FAILED} UNION ALL {LOST_SETS})", f"NOT IN ({FAILED})")}""")

sql("apply_maintenance", "index_nodes index_tx transactions current_nodes maintenance_requests names",
    with_docs("inserted", "markers2", "lost"),
    purged=f"""
    SELECT * FROM index_nodes WHERE tx_id NOT IN {wanted('tx', 'purge')} AND node_id NOT IN {wanted('node', 'purge')}""",
    fresh=f"SELECT * FROM current_nodes WHERE tx_id IN {wanted('tx', 'reindex')}",
    after_tx=f"""
    SELECT {NODE} FROM purged WHERE tx_id NOT IN {wanted('tx', 'reindex')} AND node_id NOT IN (SELECT node_id FROM fresh)
    UNION ALL SELECT {NODE} FROM fresh WHERE status <> 'DELETED'""",
    again=f"""
    SELECT id AS node_id FROM {wanted('node', 'reindex')} UNION
    SELECT node_id FROM index_nodes WHERE node_id IN (SELECT node_id FROM ({RINGS}))""",
    after_nodes=f"""
    SELECT {NODE} FROM after_tx WHERE node_id NOT IN (SELECT node_id FROM again)
    UNION ALL SELECT {NODE} FROM current_nodes WHERE node_id IN (SELECT node_id FROM again) AND status <> 'DELETED'""",
    inserted=f"""
    SELECT {NODE} FROM after_nodes
    UNION ALL SELECT {NODE} FROM current_nodes
    WHERE (tx_id IN {wanted('tx', 'index')} OR node_id IN {wanted('node', 'index')}) AND status <> 'DELETED'
    AND node_id NOT IN (SELECT node_id FROM after_nodes)""",
    markers1=f"""
    SELECT tx_id FROM index_tx WHERE tx_id NOT IN {wanted('tx', 'purge')} AND tx_id NOT IN {wanted('tx', 'reindex')}
    UNION ALL SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', 'reindex')}""",
    markers2=f"""
    SELECT tx_id FROM markers1 WHERE tx_id NOT IN (SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', 'index')})
    UNION ALL SELECT tx_id FROM transactions WHERE tx_id IN {wanted('tx', 'index')}""",
    lost=not_in_feed("reindex") + " UNION ALL " + not_in_feed("index"))


def by_type(event_type: str) -> str:
    return f"(SELECT event_id FROM events WHERE event_type = '{event_type}')"


def by_user(rest: int) -> str:
    return f"(SELECT DISTINCT user_id FROM events WHERE user_id % 10 = {rest})"


def acls_by_type(event_type: str) -> str:
    return f"(SELECT acl_id FROM acls WHERE change_set_id IN {by_type(event_type)})"


sql("apply_maintenance_acl", "index_acls acl_readers acls index_change_sets", f"""
    SELECT 'acl' AS doc, acl_id AS id, authority FROM a5
    UNION ALL SELECT 'change set', change_set_id, NULL FROM index_change_sets
    WHERE change_set_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('error', 'signup', 'purchase'))
    UNION ALL SELECT 'change set', event_id, NULL FROM events WHERE event_type IN ('signup', 'purchase')""",
    a1=f"SELECT * FROM index_acls WHERE acl_id NOT IN {acls_by_type('error')} AND acl_id NOT IN {by_user(1)}",
    a2=f"""SELECT * FROM a1 WHERE acl_id NOT IN {acls_by_type('signup')}
           UNION ALL SELECT acl_id, authority FROM acl_readers WHERE acl_id IN {acls_by_type('signup')}""",
    a3=f"""SELECT * FROM a2 WHERE acl_id NOT IN {by_user(2)}
           UNION ALL SELECT acl_id, authority FROM acl_readers WHERE acl_id IN {by_user(2)}""",
    a4=f"""SELECT * FROM a3 UNION ALL SELECT acl_id, authority FROM acl_readers
           WHERE acl_id IN {acls_by_type('purchase')} AND acl_id NOT IN (SELECT acl_id FROM a3)""",
    a5=f"""SELECT * FROM a4 UNION ALL SELECT acl_id, authority FROM acl_readers
           WHERE acl_id IN {by_user(3)} AND acl_id NOT IN (SELECT acl_id FROM a4)""")

TODO = f"SELECT * FROM ({PENDING_TX}) WHERE commit_time_ms >= {LAST - HOLE} AND commit_time_ms <= {STOP}"
# What the source holds, at the stop time, of every node that the run touches.
TOUCHED = f"""
    SELECT {NODE} FROM (
        SELECT n.*, row_number() OVER (PARTITION BY node_id ORDER BY t.commit_time_ms DESC, n.tx_id DESC) AS rn
        FROM nodes n JOIN transactions t ON t.tx_id = n.tx_id
        WHERE t.commit_time_ms <= {STOP}
        AND node_id IN (SELECT node_id FROM nodes WHERE tx_id IN (SELECT tx_id FROM todo)))
    WHERE rn = 1"""
sql("track_once", "index_nodes nodes transactions index_tx", f"""
    SELECT {NODE} FROM index_nodes WHERE node_id NOT IN (SELECT node_id FROM touched)
    UNION ALL SELECT {NODE} FROM touched WHERE status <> 'DELETED'""", todo=TODO, touched=TOUCHED)
sql("track_once_markers", "transactions index_tx", """
    SELECT tx_id, commit_time_ms FROM index_tx WHERE tx_id NOT IN (SELECT tx_id FROM todo)
    UNION ALL SELECT tx_id, commit_time_ms FROM todo""", todo=TODO)
sql("track_once_state", "transactions index_tx", f"""
    SELECT commit_time_ms, tx_id FROM (SELECT commit_time_ms, tx_id FROM todo UNION ALL SELECT {LAST}, 0)
    ORDER BY commit_time_ms DESC, tx_id DESC LIMIT 1""", todo=TODO)
B3 = "(SELECT max(p_partkey) + 1 FROM part)"
RANGES = [(f"({i} * {B3} // 3)", f"({i + 1} * {B3} // 3)") for i in range(3)]


def scoped(run: str, where: str, shard: str = "true", begin: int | None = None, end: str = "", status: str = "status") -> str:
    """One run on an empty index: its nodes and transactions."""
    own = f"SELECT * FROM nodes WHERE {where}"
    least = "true"
    if begin is not None:
        least = f"""commit_time_ms >= (SELECT min(commit_time_ms) FROM transactions WHERE tx_id IN (
            SELECT tx_id FROM nodes WHERE node_id >= {RANGES[begin][0]} AND node_id < {end or RANGES[begin][1]}))"""
    todo = f"(SELECT * FROM transactions WHERE commit_time_ms <= {STOP} AND {least})"
    return f"""
    SELECT 'node' AS doc, node_id AS id, tx_id, {status} AS status, '{run}' AS run FROM (
        SELECT n.*, row_number() OVER (PARTITION BY node_id ORDER BY t.commit_time_ms DESC, n.tx_id DESC) AS rn
        FROM ({own}) n JOIN {todo} t ON t.tx_id = n.tx_id) WHERE rn = 1 AND {shard}
    UNION ALL SELECT 'tx', tx_id, tx_id, NULL, '{run}' FROM {todo}"""


IN_2 = f"node_id >= {RANGES[2][0]} AND node_id < {RANGES[2][1]}"
WIDENED = f"({RANGES[0][1]} + 10)"
ORACLE["track_once_scoped"] = with_views("nodes transactions", " UNION ALL ".join([
    scoped("store", "store_protocol = 'archive' AND store_identifier = 'SpacesStore'"),
    scoped("property", "store_protocol = 'workspace' AND store_identifier = 'SpacesStore' AND shard_property = 'F'"),
    scoped("range", "true", f"node_id >= {RANGES[1][0]} AND node_id < {RANGES[1][1]}", 1),
    scoped("widened", "true", f"node_id >= 0 AND node_id < {WIDENED}", 0, WIDENED),
    scoped("cascade", "true", "true", 2, "",
           f"CASE WHEN {IN_2} THEN status WHEN status = 'UPDATED' THEN 'NON_SHARD_UPDATED' ELSE 'NON_SHARD_DELETED' END"),
]))
TODO_SETS = f"""
    SELECT * FROM ({PENDING_SETS}) WHERE commit_time_ms >= {ACL_LAST - HOLE} AND commit_time_ms <= {ACL_STOP}"""
TODO_ACLS = "(SELECT acl_id FROM acls WHERE change_set_id IN (SELECT change_set_id FROM todo))"
sql("track_acls_once", "index_acls acl_readers acls change_sets index_change_sets", f"""
    SELECT acl_id, authority FROM index_acls WHERE acl_id NOT IN {TODO_ACLS}
    UNION ALL SELECT acl_id, authority FROM acl_readers WHERE acl_id IN {TODO_ACLS}""", todo=TODO_SETS)
sql("track_acls_once_routed", "acls change_sets index_change_sets", f"""
    SELECT acl_id, CAST(shard AS INTEGER) AS shard FROM (SELECT DISTINCT acl_id FROM {TODO_ACLS}), unnest(range(0, 3)) AS t(shard)""",
    todo=TODO_SETS)
sql("track_acls_once_markers", "change_sets index_change_sets", """
    SELECT change_set_id, commit_time_ms FROM index_change_sets
    WHERE change_set_id NOT IN (SELECT change_set_id FROM todo)
    UNION ALL SELECT change_set_id, commit_time_ms FROM todo""", todo=TODO_SETS)
sql("pending_by_shard_and_batch", "nodes transactions index_tx", """
    SELECT batch_no, CAST(node_id % 3 AS INTEGER) AS shard, count(DISTINCT n.tx_id) AS transactions, count(*) AS nodes,
           count(*) FILTER (status = 'DELETED') AS deletions
    FROM nodes n JOIN batched b ON b.tx_id = n.tx_id GROUP BY ALL""",
    todo=TODO, batched=BATCHED.replace(PENDING_TX, "SELECT * FROM todo"))

# --- snapshots ---------------------------------------------------------------

FIRST_DAY = "(SELECT min(key) FROM objects)"
sql("list_children", "objects", f"""
    SELECT DISTINCT split_part(key, '/', 1) AS name, '/' AS directory FROM objects
    UNION ALL SELECT DISTINCT split_part(key, '/', 2), 'backups' FROM objects WHERE starts_with(key, 'backups/')
    UNION ALL SELECT DISTINCT split_part(key, '/', 3), 'first snapshot' FROM objects
    WHERE starts_with(key, {FIRST_DAY}) AND key <> {FIRST_DAY}""")
REQUESTED = """
    SELECT DISTINCT raw_key, CASE WHEN raw_key = '/' THEN '' ELSE regexp_replace(trim(raw_key), '^/', '') END AS path
    FROM (SELECT unnest([key, ' /' || key, regexp_replace(key, '/$', ''), key || '.lost', '/']) AS raw_key FROM objects)"""
sql("key_status", "objects", """
    SELECT raw_key, coalesce(d.is_dir, f.is_dir, false) OR path = '' OR p.key IS NOT NULL AS "exists",
           CASE WHEN coalesce(d.is_dir, f.is_dir, false) THEN 'directory'
                WHEN path = '' OR p.key IS NOT NULL THEN 'file' ELSE 'none' END AS path_type,
           CASE WHEN NOT coalesce(f.is_dir, false) THEN f.size END AS length,
           CASE WHEN coalesce(f.is_dir, false) THEN 'is a directory' WHEN f.size IS NULL THEN 'not found' END AS length_error
    FROM requested
    LEFT JOIN typed d ON d.key = CASE WHEN path LIKE '%/' THEN path ELSE path || '/' END
    LEFT JOIN typed f ON f.key = nullif(regexp_replace(path, '/$', ''), '')
    LEFT JOIN typed p ON p.key = path""",
    typed="SELECT key, size, content_type = 'application/x-directory' AS is_dir FROM objects", requested=REQUESTED)
sql("delete_plan", "objects", """
    SELECT DISTINCT k AS key, CASE WHEN k IN (SELECT key FROM objects) THEN 'delete' ELSE 'missing' END AS action
    FROM (SELECT nullif(regexp_replace(path, '/$', ''), '') AS k FROM requested) WHERE k IS NOT NULL""",
    requested=REQUESTED)
sql("delete_plan_directory", "objects", "SELECT key FROM objects WHERE starts_with(key, 'backups/snapshot.20240105/')")
sql("missing_parents", "objects", """
    SELECT DISTINCT parent AS key FROM (
        SELECT unnest([split_part(key, '/', 1) || '/', split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/']) AS parent
        FROM objects) WHERE parent NOT IN (SELECT key FROM objects)""")
SNAPSHOTS = """
    SELECT split_part(substr(key, 18), '/', 1) AS snapshot, count(*) FILTER (NOT key LIKE '%/') AS files,
           CAST(sum(size) AS BIGINT) AS bytes, max(last_modified) AS last_modified, bool_or(key LIKE '%/') AS has_marker
    FROM objects GROUP BY 1"""
sql("snapshot_list", "objects", SNAPSHOTS)
sql("snapshot_latest", "objects", """
    SELECT split_part(substr(key, 18), '/', 1) AS snapshot, key FROM objects ORDER BY last_modified DESC, key DESC LIMIT 1""")
DECIDED = f"""
    SELECT snapshot, CASE WHEN row_number() OVER (ORDER BY last_modified DESC, snapshot DESC) <= 2
                          THEN 'keep' ELSE 'delete' END AS decision FROM ({SNAPSHOTS})"""
sql("snapshot_retain", "objects", DECIDED)
sql("snapshot_retain_objects", "objects", f"""
    SELECT split_part(substr(key, 18), '/', 1) AS snapshot, key, size FROM objects
    WHERE split_part(substr(key, 18), '/', 1) IN (SELECT snapshot FROM ({DECIDED}) WHERE decision = 'delete')""")
sql("restore_decision", "objects", """
    SELECT r AS restore, CASE WHEN r THEN coalesce(n, (SELECT split_part(substr(key, 18), '/', 1) FROM objects
               ORDER BY last_modified DESC, key DESC LIMIT 1)) END AS snapshot, reason, c AS "case"
    FROM (VALUES (0, false, NULL, 'not requested'), (1, false, NULL, 'already restored'), (2, true, NULL, 'no index'),
                 (3, true, NULL, 'index is small'), (4, false, NULL, 'index is large enough'),
                 (5, true, 'by-name', 'index is small')) AS t(c, r, n, reason)""")
sql("snapshot_status", "backup_details", """
    SELECT snapshot, max_by(status, o) AS status, max_by(completed_at, o) AS completed_at,
           max_by(file_count, o) AS file_count, CAST(NULL AS VARCHAR) AS exception,
           CAST(max_by(3 + (shape >= 2)::INT, o) AS BIGINT) AS fields, count(*) AS results
    FROM (SELECT *, row(ts_ms, event_id) AS o,
                 coalesce(lag(body) OVER (PARTITION BY snapshot ORDER BY ts_ms, event_id) = body, false) AS repeated
          FROM (SELECT *, concat_ws('|', status, completed_at, file_count, CASE WHEN shape >= 2 THEN shape END) AS body
                FROM backup_details))
    WHERE NOT repeated GROUP BY snapshot""")
sql("snapshot_verify", "objects", """
    SELECT key, CASE WHEN key LIKE '%signup%' THEN 'missing' WHEN key LIKE '%error%' THEN 'changed' ELSE 'ok' END AS status
    FROM objects
    UNION ALL SELECT key || '.new', 'extra' FROM objects WHERE key LIKE '%purchase%'""")

# --- snapshots as files, and streams -------------------------------------------

sql("snapshot_write", "index_nodes index_tx", """
    SELECT 'nodes' AS table_name, count(*) AS row_count, CAST(sum(node_id * 31 + tx_id) AS BIGINT) AS checksum, true AS listed FROM index_nodes
    UNION ALL SELECT 'index_tx', count(*), CAST(sum(tx_id * 31 + commit_time_ms) AS BIGINT), true FROM index_tx""")
sql("snapshot_restore", "index_nodes index_tx", """
    SELECT 'node' AS doc, node_id AS id, tx_id, 'success' AS status FROM index_nodes
    UNION ALL SELECT 'tx', tx_id, tx_id, 'success' FROM index_tx""")
sql("snapshot_verify_files", "index_nodes index_tx", """
    SELECT 'nodes' AS table_name, 'ok' AS status, count(*) > 0 AS any_files FROM index_nodes
    UNION ALL SELECT 'index_tx', 'ok', count(*) > 0 FROM index_tx""")


def on_time(feed: str, key: str) -> str:
    """Rows that reach the stream in time: all but a few of the first of four equal stretches."""
    return f"""
    SELECT * FROM {feed} WHERE NOT ({key} % 50 = 7 AND commit_time_ms - (SELECT min(commit_time_ms) FROM {feed})
        < (SELECT (max(commit_time_ms) - min(commit_time_ms)) // 4 + 1 FROM {feed}))"""


sql("stream_track", "nodes transactions", """
    SELECT 'node' AS doc, node_id AS id, tx_id, status FROM (
        SELECT n.node_id, n.tx_id, n.status,
               row_number() OVER (PARTITION BY n.node_id ORDER BY a.commit_time_ms DESC, a.tx_id DESC) AS rn
        FROM nodes n JOIN transactions a ON a.tx_id = n.tx_id) WHERE rn = 1 AND status <> 'DELETED'
    UNION ALL SELECT 'tx', tx_id, tx_id, NULL FROM transactions
    UNION ALL SELECT 'late', count(*), NULL, NULL FROM transactions WHERE tx_id NOT IN (SELECT tx_id FROM applied)""",
    applied=on_time("transactions", "tx_id"))
sql("stream_track_acls", "acls acl_readers change_sets", """
    SELECT 'acl' AS doc, acl_id AS id, authority FROM acl_readers
    WHERE acl_id IN (SELECT acl_id FROM acls WHERE change_set_id IN (SELECT change_set_id FROM change_sets))
    UNION ALL SELECT 'change set', change_set_id, NULL FROM change_sets
    UNION ALL SELECT 'late', count(*), NULL FROM change_sets WHERE change_set_id NOT IN (SELECT change_set_id FROM applied)""",
    applied=on_time("change_sets", "change_set_id"))
sql("stream_dedup", "transactions", "SELECT * FROM applied", applied=on_time("transactions", "tx_id"))
sql("stream_dedup_late", "transactions", "SELECT * FROM transactions WHERE tx_id NOT IN (SELECT tx_id FROM applied)",
    applied=on_time("transactions", "tx_id"))
sql("stream_high_watermark", "nodes transactions", f"""
    SELECT core, max(o).commit_time_ms AS commit_time_ms, max(o).tx_id AS tx_id, count(*) AS docs FROM (
        SELECT {CORE} AS core, {{'commit_time_ms': t.commit_time_ms, 'tx_id': t.tx_id}} AS o
        FROM nodes n JOIN transactions t ON t.tx_id = n.tx_id)
    GROUP BY core""")
sql("stream_request_rates", "requests", """
    SELECT handler, start_ms, start_ms + width * 60000 AS end_ms, n AS requests, round(n / (60 * width), 6) AS rate
    FROM (
        SELECT handler, width, start_ms, count(*) AS n
        FROM (SELECT handler, width, ts_ms // 60000 * 60000 - back * 60000 AS start_ms
              FROM requests, (VALUES (5), (15)) AS w(width), unnest(range(0, 15)) AS b(back) WHERE back < width)
        GROUP BY ALL)
    WHERE start_ms + width * 60000 <= (SELECT max(ts_ms) FROM requests) - 600000""")
