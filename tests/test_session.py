"""Where intermediates go, and that they go away."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import batch
from tidemark.sources import access_log
from tidemark.operators import telemetry
from tidemark.operators.snapshots import snapshot_list
from tests.conftest import rows


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def test_nothing_is_left_behind(spark):
    folder = session.shared_folder(spark).removeprefix("file:")
    before = files(f"{folder}/tidemark")
    with session.temporary(spark):
        feed = spark.range(100).select(F.col("id").alias("tx_id"), "id", F.col("id").alias("updates"), F.lit(0).alias("deletes"))
        assert batch.weighted_batches(feed.withColumnRenamed("id", "commit_time_ms")).count() == 100
        assert files(f"{folder}/tidemark") != before
    assert files(f"{folder}/tidemark") == before


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from tidemark import session
from tidemark.operators.ordered import with_running_sum
spark = session.local_session("own", 1, {folder})
try:
    print("SUM", with_running_sum(spark.range(5), ["id"], F.col("id"), parts=2).agg(F.sum("before")).first()[0])
except RuntimeError as error:
    print("ERROR", error)
session.release(spark)
"""


@pytest.mark.parametrize("folder", ["given", None])
def test_a_session_without_settings_of_the_machine(tmp_path, folder):
    given = str(tmp_path / "shared") if folder else None
    script = SCRIPT.format(root=os.getcwd(), folder=repr(given))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", script], env=env, capture_output=True, text=True, timeout=300)
    assert ("SUM 10" if folder else "ERROR set spark.checkpoint.dir") in done.stdout, done.stderr[-2000:]
    if folder:
        assert not [f for f in files(given) if "part-" in f]


def test_log_lines_are_accepted_or_rejected(spark):
    good = '1.2.3.4 - - [05/Jan/2024:10:00:00 +0000] "GET /x HTTP/1.1" 200 17'
    lines = [good, good.replace("17", "-"), good.replace("05/Jan", "99/Foo"), good.replace("17", "9" * 20), "x", "", None]
    frame = spark.createDataFrame([(x,) for x in lines], "value string")
    assert rows(access_log.scan_access_log(frame), "status", "bytes") == [(200, 17), (200, None)]
    assert access_log.rejected_lines(frame).count() == 5


def test_handlers_without_span_times_or_name(spark):
    data = [("once", 5, 1.0), ("null times", 1, None), ("null times", 1001, None), (None, 0, 2.0), (None, 1000, 4.0)]
    frame = spark.createDataFrame(data, "handler string, ts_ms long, elapsed_ms double")
    frame = frame.withColumn("is_error", F.lit(False)).withColumn("is_timeout", F.lit(False))
    got = {r["handler"]: (r["requests"], r["avg_requests_per_second"], r["median"]) for r in telemetry.handler_stats(frame).collect()}
    assert got == {"once": (1, None, 1.0), "null times": (2, 2.0, None), None: (2, 2.0, 3.0)}


def test_an_empty_file_is_no_marker(spark):
    data = [("b/snapshot.x/", 0), ("b/snapshot.x/f", 0), ("b/snapshot.x/g", 5)]
    listed = spark.createDataFrame(data, "key string, size long").withColumn("last_modified", F.timestamp_seconds(F.lit(0)))
    assert rows(snapshot_list(listed), "files", "has_marker") == [(2, True)]
