"""Hourly station rows as a stream of daily rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_stream(hourly: DataFrame, late: str = "2 days") -> DataFrame:
    """The batch aggregation by day, for a stream: a day is final once the watermark has passed its end."""
    return hourly.withWatermark("hour", late).groupBy("station", "lead", F.window("hour", "1 day").alias("w")).agg(
        F.max("temp").alias("temp_max"), F.min("temp").alias("temp_min"), F.sum("precip").alias("rain"), F.sum(F.when(F.col("precip") >= 0.1, 1).when(F.col("precip").isNotNull(), 0)).alias("wet_hours")
    ).select("station", F.to_date("w.start").alias("date"), "lead", "temp_max", "temp_min", "rain", "wet_hours")
