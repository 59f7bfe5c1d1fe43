"""Beyond the batch layers: accident counts over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts_by_window(events: DataFrame, at: str = "ts", length: str = "1 hour", late: str = "2 hours", category: str = "event_type") -> DataFrame:
    """Events per tumbling window and category; rows later than the watermark are dropped, and
    state is held no longer than it. The same plan serves a batch frame and a stream."""
    seen = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    counted = seen.groupBy(F.window(at, length).alias("w"), category).agg(F.count("*").alias("events"))
    return counted.select(F.col("w.start").alias("window_start"), category, "events")
