"""Request rates of a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_request_rates(
    requests: DataFrame, width_minutes: int = 5, slide_minutes: int = 1, delay: str = "10 minutes"
) -> DataFrame:
    """Requests and rate of each handler in sliding windows; a window is final once the watermark is past it.

    A slide as wide as the window gives tumbling counts.
    """
    window = F.window("ts", f"{width_minutes} minutes", f"{slide_minutes} minutes")
    counted = requests.withWatermark("ts", delay).groupBy("handler", window).agg(F.count("*").alias("requests"))
    return counted.select(
        "handler",
        F.unix_millis(F.col("window.start")).alias("start_ms"),
        F.unix_millis(F.col("window.end")).alias("end_ms"),
        "requests",
        (F.col("requests") / (60 * width_minutes)).alias("rate"),
    )
