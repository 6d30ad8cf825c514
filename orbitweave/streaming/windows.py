"""Event-time windows over streams: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str = "ts", width: str = "20 minutes", late: str | None = "10 minutes") -> DataFrame:
    """(event_type, start, n, total) by window, of a batch or a stream; on a stream what comes later than ``late`` is lost."""
    df = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming and late:
        df = df.withWatermark("__ts", late)
    by = df.groupBy("event_type", F.window("__ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return by.select("event_type", F.col("w.start").alias("start"), "n", "total")


def first_arrivals(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """A stream with each key once, as long as repeats come within ``late``."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
