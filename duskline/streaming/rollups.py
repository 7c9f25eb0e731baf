"""The time-bucket rollup over an unbounded source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_stream(points: DataFrame, width: str = "1 hour", late: str = "10 minutes", timestamp: str = "ts", value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """min, max, avg and count in tumbling windows of event time. Points later than `late` are dropped, and a window is out once that has passed.

    Sources that give times without a zone are read as UTC (the session's time zone must be UTC).
    """
    timed = points.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late)
    rolled = timed.groupBy(F.window(timestamp, width), *by).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.count(value).alias("n"))
    return rolled.select(F.col("window.start").alias("bucket"), *by, "min_value", "max_value", "avg_value", "n")


def latency_alerts_stream(points: DataFrame, threshold: float, timestamp: str = "ts", value: str = "value") -> DataFrame:
    """Points over a threshold with their severity, as they come; no state is kept."""
    from ..functions.scalars import severity

    return points.where(F.col(value) > threshold).withColumn("severity", severity(F.col(value), threshold))
