"""The derived tables of ``tidemark.sources.tables`` once more, as SQL for a second engine.

Written against the driver's table names only. ``with_views`` puts the views a
query names, and those they need, in front of it as common table expressions.
"""

from __future__ import annotations

LAST, HOLE, STOP = 946684800000, 3600000, 993945600000
ACL_LAST, ACL_STOP = 1705276800000, 1706140800000

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "nodes": (
        (),
        """
        SELECT l_partkey AS node_id, l_orderkey AS tx_id, min(l_suppkey) AS acl_id,
               (CASE WHEN l_partkey % 10 = 0 THEN 'archive' ELSE 'workspace' END) || '://' ||
               (CASE WHEN l_partkey % 10 = 1 THEN 'version2Store' ELSE 'SpacesStore' END) || '/' ||
               CAST(l_partkey AS VARCHAR) AS node_ref,
               '' AS tenant,
               CASE WHEN min(l_returnflag) = 'R' AND max(l_returnflag) = 'R' THEN 'DELETED' ELSE 'UPDATED' END AS status,
               CASE WHEN l_partkey % 10 = 0 THEN 'archive' ELSE 'workspace' END AS store_protocol,
               CASE WHEN l_partkey % 10 = 1 THEN 'version2Store' ELSE 'SpacesStore' END AS store_identifier,
               min(l_linestatus) AS shard_property
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    ),
    "transactions": (
        ("nodes",),
        """
        SELECT o_orderkey AS tx_id, epoch_us(o_orderdate) // 1000 AS commit_time_ms,
               CAST(coalesce(u, 0) AS BIGINT) AS updates, CAST(coalesce(d, 0) AS BIGINT) AS deletes
        FROM orders LEFT JOIN (
            SELECT tx_id, count(*) FILTER (status = 'UPDATED') AS u, count(*) FILTER (status = 'DELETED') AS d
            FROM nodes GROUP BY tx_id) n ON n.tx_id = o_orderkey""",
    ),
    "change_sets": (
        (),
        """
        SELECT event_id AS change_set_id, epoch_us(ts) // 1000 AS commit_time_ms,
               CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 1 + event_id % 3 END AS INTEGER) AS acl_count
        FROM events""",
    ),
    "acls": (
        (),
        """
        SELECT event_id AS change_set_id, user_id + 7 * i AS acl_id
        FROM events, unnest(range(0, 1 + event_id % 3)) AS t(i) WHERE event_type <> 'view'""",
    ),
    "acl_readers": (
        (),
        """
        SELECT DISTINCT c_custkey % (SELECT max(user_id) + 15 FROM events) AS acl_id,
               'GROUP_' || c_mktsegment AS authority FROM customer""",
    ),
    "index_tx": (
        ("transactions",),
        f"""
        SELECT tx_id, commit_time_ms FROM transactions WHERE commit_time_ms < {LAST} AND tx_id % 50 <> 7
        UNION ALL
        SELECT tx_id, commit_time_ms FROM transactions
        WHERE commit_time_ms < {LAST} AND tx_id % 50 <> 7 AND tx_id % 97 = 0
        UNION ALL
        SELECT tx_id + (SELECT max(tx_id) + 1 FROM transactions), commit_time_ms FROM transactions WHERE tx_id % 211 = 0""",
    ),
    "index_change_sets": (
        ("change_sets",),
        f"""
        SELECT change_set_id, commit_time_ms FROM change_sets
        WHERE commit_time_ms < {ACL_LAST} AND change_set_id % 50 <> 7
        UNION ALL
        SELECT change_set_id, commit_time_ms FROM change_sets
        WHERE commit_time_ms < {ACL_LAST} AND change_set_id % 50 <> 7 AND change_set_id % 97 = 0
        UNION ALL
        SELECT change_set_id + (SELECT max(change_set_id) + 1 FROM change_sets), commit_time_ms FROM change_sets WHERE change_set_id % 211 = 0""",
    ),
    "index_nodes": (
        ("nodes", "index_tx"),
        """
        SELECT node_id, tx_id, acl_id, node_ref, tenant, status FROM (
            SELECT n.*, row_number() OVER (PARTITION BY node_id ORDER BY i.commit_time_ms DESC, n.tx_id DESC) AS rn
            FROM nodes n JOIN (SELECT DISTINCT tx_id, commit_time_ms FROM index_tx) i ON i.tx_id = n.tx_id)
        WHERE rn = 1 AND status <> 'DELETED'""",
    ),
    "current_nodes": (
        ("nodes", "transactions"),
        """
        SELECT node_id, tx_id, acl_id, node_ref, tenant, status, store_protocol, store_identifier,
               shard_property, commit_time_ms FROM (
            SELECT n.*, t.commit_time_ms,
                   row_number() OVER (PARTITION BY node_id ORDER BY t.commit_time_ms DESC, n.tx_id DESC) AS rn
            FROM nodes n JOIN transactions t ON t.tx_id = n.tx_id)
        WHERE rn = 1""",
    ),
    "index_acls": (
        ("acl_readers", "acls", "index_change_sets"),
        """
        SELECT acl_id, authority FROM acl_readers WHERE acl_id IN (
            SELECT acl_id FROM acls WHERE change_set_id IN (SELECT change_set_id FROM index_change_sets))""",
    ),
    "objects": (
        (),
        """
        SELECT 'backups/snapshot.' || strftime(ts, '%Y%m%d') || '/' || event_type || '_' || CAST(event_id AS VARCHAR) AS key,
               CAST(round(value * 1000) AS BIGINT) AS size, ts AS last_modified,
               'application/octet-stream' AS content_type FROM events
        UNION ALL
        SELECT 'backups/snapshot.' || strftime(ts, '%Y%m%d') || '/', CAST(0 AS BIGINT), min(ts), 'application/x-directory'
        FROM events GROUP BY strftime(ts, '%Y%m%d')""",
    ),
    "requests": (
        (),
        """
        SELECT ts, epoch_us(ts) // 1000 AS ts_ms,
               CASE WHEN user_id % 2 = 0 THEN '/afts' ELSE '/cmis' END AS handler, value AS elapsed_ms,
               event_type = 'error' AS is_error, value > 200 AS is_timeout FROM events""",
    ),
    "cache_events": (
        (),
        """
        SELECT 'cache_' || CAST(user_id % 9 AS VARCHAR) AS cache,
               event_type IN ('view','click') AS hit, event_type NOT IN ('view','click') AS insert_,
               event_type = 'error' AS evict, epoch_us(ts) // 1000 AS ts_ms FROM events""",
    ),
    "doc_samples": (
        (),
        """
        SELECT 'core-' || CAST(core AS VARCHAR) AS core, sample_ms,
               CAST(sum(n) OVER (PARTITION BY core ORDER BY sample_ms) AS BIGINT) AS docs
        FROM (
            SELECT c.core, m.sample_ms, coalesce(e.n, 0) AS n
            FROM (SELECT unnest(range(0, 3)) AS core) c,
                 (SELECT unnest(range(lo - lo % 60000, hi - hi % 60000 + 60001, 60000)) AS sample_ms
                  FROM (SELECT min(epoch_us(ts) // 1000) AS lo, max(epoch_us(ts) // 1000) AS hi FROM events)) m
            LEFT JOIN (SELECT user_id % 3 AS core, epoch_us(ts) // 1000 // 60000 * 60000 + 60000 AS sample_ms, count(*) AS n
                       FROM events GROUP BY ALL) e ON e.core = c.core AND e.sample_ms = m.sample_ms)""",
    ),
    "access_lines": (
        (),
        """
        SELECT CASE WHEN event_id % 100 = 99 THEN 'malformed ' || CAST(event_id AS VARCHAR)
               ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) || ' - - [' ||
                    CASE WHEN event_id % 100 = 98 THEN '99/Foo/2024' ELSE strftime(ts, '%d/%b/%Y') END || strftime(ts, ':%H:%M:%S') ||
                    ' +0000] "GET /' || event_type || ' HTTP/1.1" ' ||
                    CASE WHEN event_type = 'error' THEN '500' ELSE '200' END || ' ' ||
                    CASE WHEN event_id % 100 = 97 THEN '99999999999999999999'
                         ELSE CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) END END AS value
        FROM events""",
    ),
    "names": (
        (),
        """
        SELECT p_partkey AS node_id, p_name AS name, p_brand AS title, p_type AS category, p_type || ' ' || p_brand AS description, text AS content
        FROM part LEFT JOIN documents ON doc_id = p_partkey""",
    ),
    "raw_keys": (
        (),
        """
        SELECT event_id, CASE event_id % 8
            WHEN 0 THEN k WHEN 1 THEN '/' || k WHEN 2 THEN '  ' || k || '/ ' WHEN 3 THEN '//' || k || '//'
            WHEN 4 THEN '/' WHEN 5 THEN ' ' WHEN 6 THEN ' / ' || event_type || chr(9)
            ELSE '/' || event_type || '/' END AS raw_key
        FROM (SELECT *, event_type || '/u' || CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) AS k FROM events)""",
    ),
    "backup_details": (
        (),
        """
        SELECT 'backup-' || CAST(user_id % 20 AS VARCHAR) AS snapshot, event_id, epoch_us(ts) // 1000 AS ts_ms,
               event_id % 4 AS shape, CAST(user_id AS VARCHAR) AS file_count,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'In Progress' ELSE 'success' END AS status,
               strftime(ts, '%Y-%m-%d %H:%M:%S') AS completed_at
        FROM events""",
    ),
    "maintenance_requests": (
        (),
        """
        SELECT 'tx' AS kind, CASE id % 100 WHEN 3 THEN 'purge' WHEN 5 THEN 'reindex' ELSE 'index' END AS action, id
        FROM (SELECT o_orderkey AS id FROM orders
              UNION ALL SELECT o_orderkey + (SELECT max(o_orderkey) + 1 FROM orders) FROM orders) WHERE id % 100 IN (3, 5, 7)
        UNION ALL
        SELECT 'node', CASE id % 100 WHEN 1 THEN 'purge' WHEN 2 THEN 'reindex' ELSE 'index' END, id
        FROM (SELECT p_partkey AS id FROM part
              UNION ALL SELECT p_partkey + (SELECT max(p_partkey) + 1 FROM part) FROM part) WHERE id % 100 IN (1, 2, 4)""",
    ),
    "seen": (
        ("transactions", "index_tx"),
        """
        SELECT tx_id, commit_time_ms, row_number() OVER (ORDER BY commit_time_ms, tx_id) AS arrival FROM (
            SELECT tx_id, commit_time_ms FROM transactions WHERE tx_id IN (SELECT tx_id FROM index_tx)
            ORDER BY commit_time_ms DESC, tx_id DESC LIMIT 100)""",
    ),
}


def _needed(names: tuple[str, ...]) -> list[str]:
    found: list[str] = []
    for name in names:
        for item in [*_needed(VIEWS[name][0]), name]:
            if item not in found:
                found.append(item)
    return found


def with_views(names: str, sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the named views (blank-separated) and any extra ones."""
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in _needed(tuple(names.split()))]
    parts += [f"{name} AS ({body})" for name, body in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
