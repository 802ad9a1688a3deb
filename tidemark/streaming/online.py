"""Streaming forms of the time-series operators; ours, as the batch engine's counterparts for live feeds.

Sources and sinks are any Structured Streaming ones. All state is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import MINUTE, round_half_even


def snapped(stream: DataFrame, delay: str = "1 hour", step: int = MINUTE) -> DataFrame:
    """Times to the nearest step, one row per series and step; later repeats within the watermark are dropped."""
    s = stream.withColumn("ts", round_half_even("ts", step).cast("timestamp")).withWatermark("ts", delay)
    return s.dropDuplicatesWithinWatermark(["series_id", "ts"])


def binned(stream: DataFrame, width: str = "10 minutes", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Mean, sum and count per series in tumbling (or sliding) windows."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return s.groupBy("series_id", w.alias("w")).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("value").alias("n")).select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "total", "n")


def wet_sessions(stream: DataFrame, dry: str = "6 hours", wet: float = 0.2, delay: str = "12 hours") -> DataFrame:
    """Rain events of a live series: wet rows no more than ``dry`` apart are one session."""
    s = stream.filter(F.col("value") >= wet).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    e = s.groupBy("series_id", F.session_window("ts", dry).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("value").alias("wet_depth"), F.count("*").alias("n"))
    return e.select("series_id", "start", "end", "wet_depth", "n")


def exceedances(stream: DataFrame, threshold: float, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Per series and window: rows above a threshold and the largest value, for alarms."""
    s = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return s.groupBy("series_id", F.window("ts", width).alias("w")).agg(F.count_if(F.col("value") > threshold).alias("n_above"), F.max("value").alias("peak")).select("series_id", F.col("w.start").alias("start"), "n_above", "peak")
