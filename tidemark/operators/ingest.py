"""Ingestion: exports merged into clean series, precedence, append after a high-water mark, wide days to hours, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import HOUR, from_micros, micros, parse_number, parse_ts


def outer_merge(a: DataFrame, b: DataFrame, a_value: str, b_value: str, keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Two variables of a station by time (full outer); the quality is the worse of those that are known."""
    x = a.select(*keys, F.col("value").alias(a_value), F.col("quality").alias("__qa"))
    y = b.select(*keys, F.col("value").alias(b_value), F.col("quality").alias("__qb"))
    return x.join(y, list(keys), "full").select(*keys, a_value, b_value, F.greatest("__qa", "__qb").alias("quality"))


def last_of_duplicates(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """Of rows with equal keys the last in input order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def append_after(existing: DataFrame, new: DataFrame, key: str = "series_id") -> DataFrame:
    """New rows strictly later than the last existing row of their series; all rows of unknown series."""
    mark = existing.groupBy(key).agg(F.max("ts").alias("__mark"))
    return new.join(mark, key, "left").filter(F.col("__mark").isNull() | (F.col("ts") > F.col("__mark"))).drop("__mark")


def merge_precedence(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Union where an existing row wins over a new one of equal keys, even if its value is NULL."""
    both = existing.withColumn("__p", F.lit(0)).unionByName(new.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("__p")
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__p")


def overlap(existing: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Per series: keys that both have."""
    return existing.select(*keys).intersect(new.select(*keys)).groupBy("series_id").agg(F.count("*").alias("n_overlap"))


def export_rows(raw: DataFrame, variables: dict[str, float], drop_quality: tuple[int, ...] = (2,), digits: int = 6) -> DataFrame:
    """Rows of a database export as observations: known variables only, divided by their unit factor, numbers and times
    parsed tolerantly, wrong rows (by quality) left out."""
    factor = F.lit(None).cast("double")
    for k, f in variables.items():
        factor = F.when(F.col("variable") == k, float(f)).otherwise(factor)
    q = F.col("quality").try_cast("int")
    rows = raw.filter(F.col("variable").isin(*variables)).select(F.col("code_id").alias("series_id"), F.col("variable"), parse_ts("timestamp").alias("ts"), F.bround(parse_number("value") / factor, digits).alias("value"), q.alias("quality"))
    return rows.filter(F.col("ts").isNotNull() & ~F.coalesce(F.col("quality").isin(*drop_quality), F.lit(False)))


def expand_days(days: DataFrame, hours: list[str], scale: float = 10.0, digits: int = 4) -> DataFrame:
    """``station, y, m, d`` and hourly columns as rows: the k-th column ends at hour k, the 24th at midnight of the next day."""
    base = micros(F.make_timestamp_ntz(F.col("y"), F.col("m"), F.col("d"), F.lit(0), F.lit(0), F.lit(0)))
    return days.select("station", base.alias("__t"), F.posexplode(F.array(*[F.col(h).cast("string") for h in hours])).alias("k", "v")).select(
        F.col("station").alias("series_id"), from_micros(F.col("__t") + (F.col("k") + 1) * F.lit(HOUR)).alias("ts"), F.bround(parse_number("v", ("", "-")) / scale, digits).alias("value")
    )


def days_without_hours(days: DataFrame, total: str, hours: list[str]) -> DataFrame:
    """Per station: days that have a total but no hourly value."""
    none: Column = F.coalesce(*[parse_number(h, ("", "-")) for h in hours]).isNull()
    return days.groupBy(F.col("station").alias("series_id")).agg(F.count_if(none & parse_number(total, ("", "-")).isNotNull()).alias("n_days"))


def inventory(obs: DataFrame, sensors: DataFrame | None = None, outlet: tuple[float, float] | None = None) -> DataFrame:
    """Per series: first and last time, rows, flagged rows; with coordinates and the distance to the outlet in km. Of several
    registry rows of a station the first by variable counts."""
    out = obs.groupBy("series_id").agg(F.min("ts").alias("t0"), F.max("ts").alias("t_end"), F.count("*").alias("total_rows"), F.count_if(F.coalesce(F.col("quality"), F.lit(0)) != 0).alias("quality_nonzero"))
    if sensors is None:
        return out
    w = Window.partitionBy("station_code").orderBy("variable_code")
    one = sensors.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(F.col("station_code").alias("series_id"), "x", "y", "z")
    joined = out.join(one, "series_id", "left")
    return joined.withColumn("distance_km", F.round(F.hypot(F.col("x") - outlet[0], F.col("y") - outlet[1]) / 1000.0, 2)) if outlet else joined
