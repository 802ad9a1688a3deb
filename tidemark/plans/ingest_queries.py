"""Queries on reading, writing, parsing and the interchange with the simulator; what they write lies in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import features, ingest, models
from tidemark.plans.base import OBS, binned, observations, query, sql_binned, table
from tidemark.plans.event_queries import TRAINING_SQL, training
from tidemark.plans.grid_queries import r6
from tidemark.sources import readers, simulator, writers


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of this application that driver and executors share, deleted when the session ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}-{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


# --- parsing -----------------------------------------------------------------------------------------------------------

_TIES = "floor(value * 8) / 8"


@query("binary_rounding", f"SELECT event_id, CAST(format('{{:.1f}}', value) AS DOUBLE) + 0.0 AS one, CAST(format('{{:.2f}}', {_TIES}) AS DOUBLE) + 0.0 AS tie, CAST(format('{{:.2f}}', (floor(value * 100) * 10 + 5) / 1000) AS DOUBLE) + 0.0 AS near_tie FROM events")
def binary_rounding(spark: SparkSession, d: str) -> DataFrame:
    """Values, exact halves, and numbers whose decimal text ends in 5 while the binary value lies on either side."""
    e = table(spark, d, "events")
    near = (F.floor(F.col("value") * 100) * 10 + 5) / 1000
    return e.select("event_id", exprs.round_binary("value", 1).alias("one"), exprs.round_binary(F.floor(F.col("value") * 8) / 8, 2).alias("tie"), exprs.round_binary(near, 2).alias("near_tie"))


@query("number_coercion", f"WITH {OBS}, c AS (SELECT event_id, CASE k % 4 WHEN 0 THEN '=0.2*' || k WHEN 1 THEN ' ' || k || ' ' WHEN 2 THEN k || '.5e1' ELSE 'n/a' END AS cell FROM obs) SELECT event_id, TRY_CAST(cell AS DOUBLE) AS value FROM c")
def number_coercion(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("k"), F.col("k").cast("string")
    cell = F.when(k % 4 == 0, F.concat(F.lit("=0.2*"), text)).when(k % 4 == 1, F.concat(F.lit(" "), text, F.lit(" "))).when(k % 4 == 2, F.concat(text, F.lit(".5e1"))).otherwise("n/a")
    return observations(spark, d).select("event_id", exprs.number_or_null(cell).alias("value"))


@query("planar_distance", "SELECT c_custkey, round(sqrt((c_acctbal * 10 - 500) * (c_acctbal * 10 - 500) + c_custkey * 1.0 * c_custkey) / 1000.0, 2) AS km FROM customer")
def planar_distance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", exprs.planar_km(F.col("c_acctbal") * 10 - 500, F.col("c_custkey").cast("double")).alias("km"))


# --- files ---------------------------------------------------------------------------------------------------------------

_RAW = f"{OBS}, raw AS (SELECT event_id, series_id, ts, CASE WHEN k % 11 = 0 THEN NULL ELSE value END AS value, quality, CASE k % 3 WHEN 0 THEN 'level' WHEN 1 THEN 'rain' ELSE 'other' END AS variable FROM obs)"


@query("export_roundtrip", f"WITH {_RAW} SELECT series_id, variable, date_trunc('second', ts)::TIMESTAMP AS ts, round(value / CASE variable WHEN 'level' THEN 100 ELSE 1 END, 6) AS value, quality FROM raw WHERE variable <> 'other' AND quality <> 1")
def export_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as a gzip export and read back: known variables in their units, rows of quality 1 left out, ``-`` is NULL."""
    k = F.col("k")
    raw = observations(spark, d).select(
        F.col("event_id").cast("string").alias("id"), F.col("series_id").alias("code_id"), F.lit("a, b").alias("station_name"), F.lit("0").alias("x_utm"), F.lit("0").alias("y_utm"),
        F.when(k % 3 == 0, "level").when(k % 3 == 1, "rain").otherwise("other").alias("variable"), F.col("quality").cast("string").alias("quality"), F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+00")).alias("timestamp"),
        F.when(k % 11 == 0, "-").otherwise(F.col("value").cast("string")).alias("value"),
    )
    path = scratch(spark, "export")
    writers.to_csv(raw, path, gzip=True)
    got = ingest.export_rows(readers.export_csv(spark, path), {"level": 100.0, "rain": 1.0}, drop_quality=(1,))
    return got.select("series_id", "variable", "ts", F.round("value", 6).alias("value"), "quality")


_DAYS = "days AS (SELECT event_type AS station, date_trunc('day', ts) AS day, CAST(hour(ts) AS INT) AS h, max(floor(value)) AS v FROM events GROUP BY 1, 2, 3)"


@query("wide_text_roundtrip", f"WITH {_DAYS}, full_days AS (SELECT DISTINCT station, day FROM days) SELECT f.station AS series_id, (f.day + to_hours(CAST(r.h + 1 AS INT)))::TIMESTAMP AS ts, round(days.v / 10, 4) AS value FROM full_days f CROSS JOIN (SELECT unnest(range(24)) AS h) r LEFT JOIN days ON days.station = f.station AND days.day = f.day AND days.h = r.h")
def wide_text_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A day per line in latin-1 with ``;``, hours in columns, written and read back as hourly rows."""
    e = table(spark, d, "events").select(F.col("event_type").alias("station"), F.date_trunc("day", "ts").alias("day"), F.hour("ts").alias("h"), F.floor("value").alias("v"))
    wide = e.groupBy("station", "day").pivot("h", list(range(24))).agg(F.max("v"))
    cells = [F.col("station"), F.year("day").cast("string"), F.month("day").cast("string"), F.dayofmonth("day").cast("string"), *[F.lit("é")] * 4, F.lit("-"), *[F.coalesce(F.col(str(h)).cast("string"), F.lit("-")) for h in range(24)]]
    path = scratch(spark, "wide")
    wide.select(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).write.mode("overwrite").option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    return ingest.expand_days(readers.wide_days(spark, path), [f"h{k}" for k in range(1, 25)])


@query("sorted_version", f"WITH {OBS} SELECT series_id, count(*) AS n, count(DISTINCT ts) AS n_times, round(sum(value), 4) AS total FROM obs GROUP BY 1")
def sorted_version(spark: SparkSession, d: str) -> DataFrame:
    """A rewritten version holds the rows of the table, and those that lie before the mark are not appended again."""
    path = scratch(spark, "sorted")
    obs = observations(spark, d).select("series_id", "ts", "value", "quality")
    writers.rewrite_sorted(obs, path)
    writers.append_new(obs, path)
    return readers.parquet(spark, path).groupBy("series_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("n_times"), F.round(F.sum("value"), 4).alias("total"))


@query("registry_roundtrip", "SELECT s_suppkey AS station_code, s_acctbal AS x, s_nationkey AS y FROM supplier")
def registry_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "registry")
    writers.to_csv(table(spark, d, "supplier").select("s_name", "s_suppkey", "s_acctbal", "s_nationkey"), path)
    return readers.positional(readers.registry(spark, path), {"station_code": 1, "x": 2, "y": 3}).select(F.col("station_code").cast("long").alias("station_code"), F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y"))


# --- models' input -------------------------------------------------------------------------------------------------------

_CHOSEN = "c NOT IN ('ts', 'split', 'event_id', 'basin', 'series_id') AND NOT lower(c) LIKE 'target\\_%' ESCAPE '\\' AND NOT suffix(lower(c), '_quality') AND NOT suffix(lower(c), '_data_type') AND NOT contains(c, 'lag_24h')"


# The SQL table has no cyclical columns; they are known whenever the time is, so the parts of it that they are made of are counted.
_CYCLICAL = "hour(ts) AS hour_sin, hour(ts) AS hour_cos, dayofyear(ts) AS doy_sin, dayofyear(ts) AS doy_cos, month(ts) AS month"


@query("predictor_selection", f"WITH {TRAINING_SQL}, timed AS (SELECT *, {_CYCLICAL} FROM tt), chosen AS (SELECT CAST(COLUMNS(lambda c: {_CHOSEN}) AS DOUBLE) FROM timed), u AS (UNPIVOT chosen ON COLUMNS(*) INTO NAME feature VALUE v) SELECT feature, count(*) AS n FROM u GROUP BY 1")
def predictor_selection(spark: SparkSession, d: str) -> DataFrame:
    """Known values of each column that a model may see, without the lags of a day; columns without any are left out."""
    t = features.drop_like(training(spark, d), "lag_24h")
    names = features.predictor_columns(t)
    one = t.agg(*[F.count(F.col(c)).alias(c) for c in names])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in names]))).filter("n > 0")


@query("event_subsample", f"WITH {TRAINING_SQL}, picked AS (SELECT view > 60 AS inside FROM tt WHERE split = 'train'), sizes AS (SELECT count(*) FILTER (WHERE inside) AS a, count(*) FILTER (WHERE NOT coalesce(inside, false)) AS b FROM picked) SELECT inside, n FROM (SELECT unnest([true, false]) AS inside, unnest([a, least(b, greatest(0, 300 - a))]) AS n FROM sizes) WHERE n > 0")
def event_subsample(spark: SparkSession, d: str) -> DataFrame:
    """Rows of events are all kept, others up to 300 rows in all: the cap is the operator's purpose."""
    t = training(spark, d).filter("split = 'train'").select("ts", F.when(F.col("view") > 60, 1).alias("event_id"))
    return models.subsample(t, 300).groupBy(F.col("event_id").isNotNull().alias("inside")).agg(F.count("*").alias("n"))


# --- interchange ---------------------------------------------------------------------------------------------------------


@query("simulator_readback", f"WITH {sql_binned(60)} SELECT '//' || series_id || '/PRECIP-INC/' || upper(strftime(ts, '%d%b%Y')) || '/1Hour/OBS/' AS path, ts, round(value, 6) AS value, 'PER-CUM' AS type, 'MM' AS units FROM grid WHERE value IS NOT NULL AND series_id = 'view'")
def simulator_readback(spark: SparkSession, d: str) -> DataFrame:
    """All series are written; those whose path fits a pattern are read back."""
    path = scratch(spark, "series")
    simulator.write_series(simulator.incremental_rows(binned(spark, d, 60), 60), path)
    return r6(simulator.read_series(spark, path, "//VIEW/*/*/1Hour/obs/"), "value")


_SPANS = f"WITH {OBS}, s AS (SELECT date_trunc('day', ts) AS day, min(date_trunc('minute', ts))::TIMESTAMP AS a, max(date_trunc('minute', ts))::TIMESTAMP AS b FROM obs GROUP BY 1)"


@query(
    "event_control",
    f"""{_SPANS}, g AS (SELECT date_trunc('day', ts) AS day, string_agg(DISTINCT '<gauge name="' || series_id || '" weight="1.00" file="rain.parquet"/>', '' ORDER BY '<gauge name="' || series_id || '" weight="1.00" file="rain.parquet"/>') AS x FROM obs GROUP BY 1)
    SELECT strftime(day, 'D%Y%m%d') AS event, '<control name="' || strftime(day, 'D%Y%m%d') || '" minutes="10"><window start="' || strftime(a, '%Y-%m-%d %H:%M') || '" end="' || strftime(b, '%Y-%m-%d %H:%M') || '"/></control>' AS control, '<meteorology>' || x || '</meteorology>' AS gauges FROM s JOIN g USING (day)""",
)
def event_control(spark: SparkSession, d: str) -> DataFrame:
    """Control and gauge texts of a run for each day."""
    o = observations(spark, d).select(F.date_format("ts", "'D'yyyyMMdd").alias("event"), "series_id", F.date_trunc("minute", "ts").alias("ts"))
    spans = o.groupBy("event").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    texts = spans.select("event", simulator.control_xml(F.col("event"), F.col("a"), F.col("b")).alias("control"))
    return texts.join(simulator.gauges_xml(o, "series_id", "rain.parquet", "event").withColumnRenamed("text", "gauges"), "event")
