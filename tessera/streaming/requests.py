"""Search requests as a stream: each key is called once within a watermark, and calls are counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_requests(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first request of each run and key (run_id, key, ts); repeats within the watermark are dropped, state stays bounded."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "key"])


def calls_by_window(requests: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests and distinct runs (approximately) by event-time window and key; windows close behind the watermark."""
    counted = requests.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "key").agg(F.count("*").alias("n_requests"), F.approx_count_distinct("run_id").alias("n_runs"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n_requests", "n_runs")
