"""Windowed aggregates of event streams, beyond what the batch operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, by: list[str], value: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Count, sum and mean in windows of fixed width; events later than the watermark are left out of closed windows."""
    return sliding(events, width, width, by, value, time, late)


def sliding(events: DataFrame, width: str, step: str, by: list[str], value: str, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, width, step), *by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total", "mean")


def sessions(events: DataFrame, gap: str, by: list[str], time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a pause of at least `gap`."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
