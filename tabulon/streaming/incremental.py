"""Running statistics of event streams: frequencies and aggregates by windows, with late events by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, sum, mean, minimum and maximum per window and key; for streams and tables alike."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    g = source.groupBy(F.window(time, window).alias("w"), F.col(key)).agg(F.count(value).alias("n"), F.sum(value).alias("sum"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "sum", "mean", "min", "max")


def running_frequencies(events: DataFrame, col: str) -> DataFrame:
    return events.groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("frequency"))
