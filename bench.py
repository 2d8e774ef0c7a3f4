"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

The feed, index and inventory tables are derived from the given parquet files
once and stored, as a deployment has them; that time is reported as ``prepare``
and is not part of the value. Each query is then run once to warm up and
``$BENCH_RUNS`` times (default 3) into the no-op sink, so that every row and
column is computed; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from checks.queries import QUERIES
from tidemark.session import local_session, release, temporary
from tidemark.sources import tables

HEADLINE = [
    "track_once",
    "track_acls_once",
    "pending_by_shard_and_batch",
    "repo_vs_index",
    "check_index_tx",
    "weighted_batches",
    "fixed_chunks",
    "shard_view",
    "latest_per_node",
    "visible_nodes",
    "apply_maintenance",
    "handler_stats",
    "request_rates",
    "suggest_terms",
    "key_status",
    "snapshot_list",
    "snapshot_status",
    "snapshot_write",
    "settled_at",
    "stream_track",
]


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    folder_of_intermediates = tempfile.TemporaryDirectory(prefix="tidemark-bench-")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")), folder_of_intermediates.name)
    begin = time.perf_counter()
    tables.store(spark, folder)
    prepare = round(time.perf_counter() - begin, 3)
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            with temporary(spark):
                begin = time.perf_counter()
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken[1:] or taken), 3)
    print(
        json.dumps(
            {
                "metric": "median seconds over the headline queries, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "prepare": prepare,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    release(spark)
    spark.stop()
    folder_of_intermediates.cleanup()


if __name__ == "__main__":
    main(sys.argv[1:] or HEADLINE)
