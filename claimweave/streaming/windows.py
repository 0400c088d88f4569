"""Event-time windows; they take batch and streaming frames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, column: str = "ts", late: str | None = None) -> DataFrame:
    """Events with their time as a timestamp, and for streams a watermark of ``late``."""
    rows = events.withColumn(column, F.col(column).cast("timestamp"))
    return rows.withWatermark(column, late) if late else rows


def _summed(events: DataFrame, window: Column, keys: tuple[str, ...]) -> DataFrame:
    agg = events.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def tumbling(events: DataFrame, length: str, *keys: str) -> DataFrame:
    """Counts and sums of values by fixed windows."""
    return _summed(events, F.window("ts", length), keys)


def sliding(events: DataFrame, length: str, step: str, *keys: str) -> DataFrame:
    """Counts and sums of values by overlapping windows."""
    return _summed(events, F.window("ts", length, step), keys)


def by_session(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Counts and sums of values by sessions that end after a gap."""
    return _summed(events, F.session_window("ts", gap), keys)
