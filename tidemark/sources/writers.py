"""Sinks: partitioned Parquet, CSV (gzip), appended and rewritten versions, metadata notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ingest import append_after


def to_parquet(df: DataFrame, path: str, *partitions: str, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partitions) if partitions else w).parquet(path)


def to_csv(df: DataFrame, path: str, gzip: bool = False, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    (w.option("compression", "gzip") if gzip else w).csv(path)


def append_new(new: DataFrame, path: str) -> None:
    """Appends only rows later than what the dataset has for their series."""
    existing = new.sparkSession.read.parquet(path)
    append_after(existing, new).select(existing.columns).write.mode("append").parquet(path)


def rewrite_sorted(df: DataFrame, path: str) -> None:
    """A new version of a dataset in order of series and time."""
    df.repartitionByRange("series_id", "ts").sortWithinPartitions("series_id", "ts").write.mode("overwrite").parquet(path)


def metadata_lines(inventory: DataFrame) -> DataFrame:
    """One line of text per series from its inventory."""
    return inventory.select(F.format_string("%s: T0 = %s; T_end = %s; rows = %d; flagged = %d", "series_id", F.col("t0").cast("string"), F.col("t_end").cast("string"), "total_rows", "quality_nonzero").alias("value"))


def to_notes(inventory: DataFrame, path: str) -> None:
    metadata_lines(inventory).write.mode("overwrite").text(path)
