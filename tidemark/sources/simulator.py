"""Interchange with an external hydrological simulator: path names, incremental series, minute counts, control text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import MINUTE, from_micros, micros

#: Fixed value: minute 0 of the simulator's time, as micros.
MINUTE_ZERO = -2_208_988_800_000_000


def path_name(gage: Column, variable: Column, date: Column, minutes: int, tag: Column) -> Column:
    """``//gage/variable/date/interval/tag/``; an hour or more is given in hours."""
    step = f"{minutes // 60}Hour" if minutes >= 60 else f"{minutes}Minute"
    return F.concat(F.lit("//"), gage, F.lit("/"), variable, F.lit("/"), date, F.lit(f"/{step}/"), tag, F.lit("/"))


def path_matches(path: Column, pattern: str) -> Column:
    """Part by part: a part of the pattern that is empty or ``*`` matches anything, others match regardless of case."""
    parts = pattern.strip("/").split("/")
    have = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    ok = F.size(have) == len(parts)
    for k, p in enumerate(parts):
        if p not in ("", "*"):
            ok = ok & (F.upper(F.get(have, F.lit(k))) == p.upper())
    return ok


def from_minutes(m: Column) -> Column:
    return from_micros(m.cast("long") * F.lit(MINUTE) + F.lit(MINUTE_ZERO))


def to_minutes(ts: Column) -> Column:
    return ((micros(ts) - F.lit(MINUTE_ZERO)) / F.lit(MINUTE)).cast("long")


def incremental_rows(precip: DataFrame, minutes: int, tag: str = "OBS") -> DataFrame:
    """``path, minute, value, type, units`` of known increments, each with its own time, so that gaps stay where they are."""
    p = precip.filter("value is not null")
    return p.select(path_name(F.col("series_id"), F.lit("PRECIP-INC"), F.upper(F.date_format("ts", "ddMMMyyyy")), minutes, F.lit(tag)).alias("path"), to_minutes(F.col("ts")).alias("minute"), "value", F.lit("PER-CUM").alias("type"), F.lit("MM").alias("units"))


def event_rows(precip: DataFrame, start: Column, end: Column, minutes: int = 10, tag: str = "OBS") -> DataFrame:
    """The increments of an event, both ends included."""
    return incremental_rows(precip.filter(F.col("ts").between(start, end)), minutes, tag)


def write_series(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records of paths as a dataset, a folder for each gauge and variable, so that a reader of few paths opens few files."""
    part = F.split("path", "/")
    keyed = records.withColumn("gauge", F.upper(F.get(part, F.lit(2)))).withColumn("variable", F.upper(F.get(part, F.lit(3))))
    keyed.write.mode(mode).partitionBy("variable", "gauge").parquet(path)


def read_series(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, ts, value, type, units`` of the dataset's paths that fit ``pattern`` (see ``path_matches``)."""
    df = spark.read.option("inferSchema", False).schema("path string, minute long, value double, type string, units string, variable string, gauge string").parquet(path)
    if pattern:
        for name, want in zip(("gauge", "variable"), pattern.strip("/").split("/")):
            df = df if want in ("", "*") else df.filter(F.col(name) == want.upper())  # folders that are not read
        df = df.filter(path_matches(F.col("path"), pattern))
    return df.select("path", from_minutes(F.col("minute")).alias("ts"), "value", "type", "units")


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def control_xml(name: Column, start: Column, end: Column, minutes: int = 10) -> Column:
    """Control of a run between two times as an XML text."""
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    return F.concat(F.lit('<control name="'), _escaped(name), F.lit(f'" minutes="{minutes}"><window start="'), stamp(start), F.lit('" end="'), stamp(end), F.lit('"/></control>'))


def gauges_xml(gauges: DataFrame, gauge: str, file: str, *keys: str) -> DataFrame:
    """An XML text for each of ``keys`` (one in all without them) that weights its gauges equally, in order of their names. As
    long as the list of gauges of a key."""
    one = F.concat(F.lit('<gauge name="'), _escaped(F.col(gauge)), F.lit(f'" weight="1.00" file="{file}"/>'))
    listed = gauges.select(*keys, F.struct(F.col(gauge).alias("g"), one.alias("x")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_set("s")).alias("s"))
    return listed.select(*keys, F.concat(F.lit("<meteorology>"), F.concat_ws("", F.transform("s", lambda s: s["x"])), F.lit("</meteorology>")).alias("text"))


def control_text(start: Column, end: Column, minutes: int = 15) -> Column:
    """Control section of a run between two times."""
    stamp = lambda t: F.date_format(t, "d MMMM yyyy, HH:mm")
    return F.concat(F.lit("Start: "), stamp(start), F.lit("\nEnd: "), stamp(end), F.lit(f"\nTime Interval: {minutes}\n"))


def inverse_distance(gauges: DataFrame, x: float, y: float, power: float = 2.0) -> DataFrame:
    """Rain at a point: gauges (``ts, value, gx, gy``) weighted by inverse distance; a gauge at the point counts alone."""
    d = F.hypot(F.col("gx") - x, F.col("gy") - y)
    w = 1.0 / F.pow(F.greatest(d, F.lit(1e-9)), power)
    known = F.col("value").isNotNull()
    return gauges.groupBy("ts").agg((F.sum(F.when(known, w * F.col("value"))) / F.nullif(F.sum(F.when(known, w)), F.lit(0.0))).alias("value"))
