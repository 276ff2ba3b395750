"""Rows and classes per week of a stream; a week closes once the watermark has passed it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(stream: DataFrame, time_col: str = "date_decision", late: str = "7 days") -> DataFrame:
    """week_start, n_rows, positives. Rows later than the allowance are dropped; null times never count."""
    at = stream.withColumn("event_time", F.col(time_col).cast("timestamp")).where("event_time IS NOT NULL")
    week = F.window("event_time", "7 days", startTime="4 days")  # Mondays, the epoch being a Thursday
    return at.withWatermark("event_time", late).groupBy(week).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("target").alias("positives")).select(F.col("window.start").alias("week_start"), "n_rows", "positives")
