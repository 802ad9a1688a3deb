"""Gaps and islands: runs of equal state along a series, the gap catalogue, imputation of short gaps, missing flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import HOUR, micros
from tidemark.operators.grid import bracket, linear


def islands(df: DataFrame, state: Column, keys: tuple[str, ...] = ("series_id",), order: str = "ts", name: str = "island") -> DataFrame:
    """Adds ``name``, a running number that grows by one wherever ``state`` differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(state.eqNullSafe(F.lag(state).over(w)), 0).otherwise(1)
    return df.withColumn("__c", changed).withColumn(name, F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__c")


def null_runs(grid: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``run``, the number of cells of the NULL run that a NULL cell is in (0 elsewhere)."""
    isl = islands(grid, F.col(value).isNull())
    w = Window.partitionBy("series_id", "island")
    return isl.withColumn("run", F.when(F.col(value).isNull(), F.count(F.lit(1)).over(w)).otherwise(0)).drop("island")


def gap_catalogue(grid: DataFrame, value: str = "value") -> DataFrame:
    """One row per NULL run: first and last cell, cells, the valid times around it and the hours between those."""
    w = Window.partitionBy("series_id").orderBy("ts")
    isl = islands(grid.select("series_id", "ts", value), F.col(value).isNull()).withColumn("prev", F.lag("ts").over(w)).withColumn("next", F.lead("ts").over(w))
    g = isl.filter(F.col(value).isNull()).groupBy("series_id", "island").agg(
        F.min("ts").alias("gap_start"), F.max("ts").alias("gap_end"), F.count("*").alias("n_missing"), F.min_by("prev", "ts").alias("prev_valid"), F.max_by("next", "ts").alias("next_valid")
    )
    return g.select("series_id", "gap_start", "gap_end", "n_missing", "prev_valid", "next_valid", ((micros("next_valid") - micros("prev_valid")) / float(HOUR)).alias("span_h"))


def impute_gaps(grid: DataFrame, max_cells: int = 144) -> DataFrame:
    """NULL runs of up to ``max_cells`` cells filled time-linearly, constant at the ends; longer runs stay NULL. Filled cells
    are labelled ``imputed``; observed values are never touched."""
    runs = null_runs(grid)
    near = bracket(grid, runs.filter((F.col("run") > 0) & (F.col("run") <= max_cells))).select("series_id", "ts", linear().alias("fill"))
    out = runs.join(near, ["series_id", "ts"], "left")
    value = F.coalesce("value", "fill")
    label = F.when(F.col("value").isNull() & F.col("fill").isNotNull(), "imputed").otherwise(F.col("data_type") if "data_type" in grid.columns else F.lit("observed"))
    return out.select(*[value.alias("value") if c == "value" else F.col(c) for c in grid.columns if c != "data_type"], label.alias("data_type"))


def missing_flags(grid: DataFrame) -> DataFrame:
    return grid.withColumn("missing", F.col("value").isNull().cast("int"))


def fill_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per series: NULL cells before and after, and how many were filled."""
    both = before.select("series_id", F.col("value").isNull().cast("int").alias("b"), F.lit(0).alias("a")).unionByName(after.select("series_id", F.lit(0).alias("b"), F.col("value").isNull().cast("int").alias("a")))
    return both.groupBy("series_id").agg(F.sum("b").alias("nulls_before"), F.sum("a").alias("nulls_after")).withColumn("filled", F.col("nulls_before") - F.col("nulls_after"))


def long_gaps(grid: DataFrame, hours: float = 168) -> DataFrame:
    """Per series: gaps longer than ``hours``."""
    return gap_catalogue(grid).groupBy("series_id").agg(F.count_if(F.col("span_h") > hours).alias("n_long"))


def gap_overlaps(windows: DataFrame, gaps: DataFrame, keys: tuple[str, ...], width: int = 144) -> DataFrame:
    """``keys`` of windows (``series_id, start_idx, end_idx``, told apart by ``keys``) that a gap (``a, b``, end exclusive)
    overlaps: a < end and b > start. Both sides are listed under the blocks of ``width`` positions that they touch, so the
    join has equal keys and a series' windows don't meet all of its gaps."""
    block = lambda x: F.floor(F.col(x) / F.lit(width))
    w = windows.select("series_id", *[k for k in keys if k != "series_id"], "start_idx", "end_idx", F.explode(F.sequence(block("start_idx"), block("end_idx"))).alias("__k"))
    g = gaps.select("series_id", "a", "b", F.explode(F.sequence(block("a"), block("b"))).alias("__k"))
    return w.join(g, ["series_id", "__k"]).filter("a < end_idx AND b > start_idx").select(*keys).distinct()


