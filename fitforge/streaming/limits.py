"""Counts of activity per user and hour over a stream, late rows up to a limit included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, user: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """user, hour and n of a stream with watermark; in batch the same without one."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(user, F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("hour"), "n")
