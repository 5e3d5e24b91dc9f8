"""Windowed counts of an event stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total: counts and summed values of each window; events later than `late` are left out.

    Works on a stream (state ends with the watermark) and on a batch alike.
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    d = events.withColumn("ts", F.col("ts").cast("timestamp"))
    d = d.withWatermark("ts", late) if events.isStreaming else d
    return d.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
