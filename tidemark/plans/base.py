"""Registry of queries, and the views of the driver tables that they share.

``events`` stands in for five irregular sensors: a series per event type, the JSON number ``k`` as a secondary signal whose
remainder by 3 is a quality flag.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import MINUTE
from tidemark.operators import grid, stats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
SERIES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("series_id"), "ts", "value", k.alias("k"), (k % 3).alias("quality"))


def span(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """Whole hours around all events of the table: where its grids begin and end."""
    return grid.bounds(table(spark, sf_dir, "events"))


def binned(spark: SparkSession, sf_dir: str, minutes: int = 10) -> DataFrame:
    """Means of each step on the full grid, NULL where a step has no reading."""
    obs = observations(spark, sf_dir)
    cells = grid.spine(obs, *span(spark, sf_dir), minutes * MINUTE)
    return cells.join(stats.calendar_mean(obs, minutes * MINUTE), ["series_id", "ts"], "left")


# --- the same views in SQL -------------------------------------------------------------------------------------------

OBS = "obs AS (SELECT event_id, event_type AS series_id, ts, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS quality FROM events)"
#: Whole hours around all events.
SPAN = "span AS (SELECT date_trunc('hour', min(ts))::TIMESTAMP AS a, make_timestamp(((epoch_us(max(ts)) + 3599999999) // 3600000000) * 3600000000) AS z FROM events)"


def sql_spine(minutes: int = 10) -> str:
    return f"{SPAN}, spine AS (SELECT series_id, ts FROM (SELECT DISTINCT series_id FROM obs), (SELECT unnest(generate_series(a, z, INTERVAL {minutes} MINUTE)) AS ts FROM span))"


def sql_binned(minutes: int = 10) -> str:
    return f"{OBS}, {sql_spine(minutes)}, grid AS (SELECT series_id, ts, m.value FROM spine LEFT JOIN (SELECT series_id, time_bucket(INTERVAL {minutes} MINUTE, ts) AS ts, avg(value) AS value FROM obs GROUP BY 1, 2) m USING (series_id, ts))"


def sql_bracket(points: str, targets: str = "spine", value: str = "value", out: str = "near") -> str:
    """CTE ``out``: targets with their nearest non-null points before and after, times in micros."""
    return f"""
    {out}_u AS (SELECT series_id, t, max(v) AS v, max(target) AS target FROM (
      SELECT series_id, epoch_us(ts) AS t, {value} AS v, 0 AS target FROM {points} WHERE {value} IS NOT NULL UNION ALL SELECT series_id, epoch_us(ts), NULL, 1 FROM {targets}) GROUP BY 1, 2),
    {out} AS (SELECT * FROM (SELECT series_id, make_timestamp(t) AS ts, t, target,
        last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER a AS pt, last_value(v IGNORE NULLS) OVER a AS pv,
        first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS nt, first_value(v IGNORE NULLS) OVER b AS nv
      FROM {out}_u WINDOW a AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
      WHERE target = 1)"""


LINEAR = "coalesce(CASE WHEN nt > pt THEN pv + (nv - pv) * ((t - pt) / (nt - pt)) END, pv, nv)"


def sql_within(minutes: int) -> str:
    us = minutes * 60_000_000
    return f"(coalesce(nt - t <= {us}, false) OR coalesce(t - pt <= {us}, false))"


CEIL_HOUR = "make_timestamp(((epoch_us(ts) + 3599999999) // 3600000000) * 3600000000)"
