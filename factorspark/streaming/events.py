"""Streaming extension: windowed rollups and running exponential means of an event stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) a window; events later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(start, end, user_id, n) of a user's sessions."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return got.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def running_ema(events: DataFrame, span: int = 10) -> DataFrame:
    """(event_type, n, ema) after each trigger: state of one mean and one count a key."""
    alpha = 2.0 / (span + 1.0)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                mean = v if n == 0 else alpha * v + (1 - alpha) * mean
                n += 1
        state.update((n, mean))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n], "ema": [mean]})

    return events.groupBy("event_type").applyInPandasWithState(step, "event_type string, n long, ema double", "n long, ema double", "update", GroupStateTimeout.NoTimeout)
