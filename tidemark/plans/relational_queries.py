"""Queries on parsing, ingestion, set operations, ranking, statistics and interchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.functions.exprs import DAY, HOUR
from tidemark.operators import ingest, qc, stats
from tidemark.plans.base import OBS, SERIES, binned, observations, query, sql_binned, table
from tidemark.plans.grid_queries import r6
from tidemark.sources import simulator


@query(
    "tipping_bucket_parse",
    """WITH c AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '=0.2*' || (event_id % 40) WHEN 1 THEN '=' || (event_id % 25) || '*0.2' WHEN 2 THEN 'NAN' WHEN 3 THEN '=AVERAGE(A1)' WHEN 4 THEN CAST(value AS VARCHAR) ELSE 'abc' END AS cell FROM events),
    n AS (SELECT event_id, cell, coalesce(nullif(regexp_extract(cell, '^=0\\.2\\*(\\d+)$', 1), ''), nullif(regexp_extract(cell, '^=(\\d+)\\*0\\.2$', 1), '')) AS n FROM c)
    SELECT event_id, round(CASE WHEN n IS NOT NULL THEN CAST(n AS DOUBLE) * 0.2 WHEN starts_with(cell, '=') OR upper(cell) = 'NAN' THEN NULL ELSE try_cast(cell AS DOUBLE) END, 4) AS value, n IS NOT NULL AS corrected FROM n""",
)
def tipping_bucket_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    cell = F.when(i % 6 == 0, F.concat(F.lit("=0.2*"), i % 40)).when(i % 6 == 1, F.concat(F.lit("="), i % 25, F.lit("*0.2"))).when(i % 6 == 2, "NAN").when(i % 6 == 3, "=AVERAGE(A1)").when(i % 6 == 4, F.col("value").cast("string")).otherwise("abc")
    return table(spark, d, "events").select("event_id", exprs.tipping_bucket(cell).alias("p")).select("event_id", F.round("p.value", 4).alias("value"), "p.corrected")


@query(
    "null_token_parse",
    """WITH c AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN 'None' WHEN 3 THEN 'NaN' WHEN 4 THEN ' 12.5 ' WHEN 5 THEN 'x1' ELSE CAST(value AS VARCHAR) END AS t FROM events)
    SELECT event_id, CASE WHEN trim(t) IN ('', '-', 'None', 'NaN', 'nan') THEN NULL ELSE try_cast(trim(t) AS DOUBLE) END AS value FROM c""",
)
def null_token_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    t = F.when(i % 7 == 0, "").when(i % 7 == 1, "-").when(i % 7 == 2, "None").when(i % 7 == 3, "NaN").when(i % 7 == 4, " 12.5 ").when(i % 7 == 5, "x1").otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", exprs.parse_number(t).alias("value"))


@query("braced_list_parse", "SELECT event_id, list_sum(list_transform(string_split('' || (event_id % 9) || ',' || (event_id % 4) || '.5', ','), lambda x: CAST(x AS DOUBLE))) AS total FROM events")
def braced_list_parse(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    text = F.concat(F.lit("{"), i % 9, F.lit(", "), i % 4, F.lit(".5}"))
    return table(spark, d, "events").select("event_id", F.aggregate(exprs.braced_list(text), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("strip_subseconds", "SELECT event_id, date_trunc('second', ts)::TIMESTAMP AS ts FROM events")
def strip_subseconds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", exprs.strip_subseconds("ts").alias("ts"))


@query(
    "plausible_values",
    "WITH v AS (SELECT event_id, event_type, value - 20 AS v FROM events) SELECT event_id, round(CASE WHEN event_type IN ('view', 'click') AND v < 0 THEN 0 WHEN event_type = 'error' AND v < -15 THEN NULL WHEN event_type = 'signup' AND NOT v BETWEEN -1 AND 45 THEN NULL ELSE v END, 6) AS value FROM v",
)
def plausible_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "HEIGHT_m").when(F.col("event_type") == "click", "PRECIP_mm").when(F.col("event_type") == "error", "TEMP_C").when(F.col("event_type") == "signup", "WATER_TEMP_C").otherwise("OTHER")
    return table(spark, d, "events").select("event_id", F.round(exprs.plausible(kind, F.col("value") - 20), 6).alias("value"))


@query("season_hydro_year", "SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'MAM' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season, CAST(year(o_orderdate) + (month(o_orderdate) >= 10)::INT AS INT) AS hydro_year FROM orders")
def season_hydro_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", exprs.season("o_orderdate").alias("season"), exprs.hydro_year("o_orderdate").cast("int").alias("hydro_year"))


@query("cyclical_time", "SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24), 6) AS hour_cos, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos, CAST(month(ts) AS INT) AS month FROM events")
def cyclical_time(spark: SparkSession, d: str) -> DataFrame:
    return r6(table(spark, d, "events").select("event_id", *[c.alias(k) for k, c in exprs.cyclical("ts").items()]), "hour_sin", "hour_cos", "doy_sin", "doy_cos")


# --- ingestion ---------------------------------------------------------------------------------------------------------

_BASE = "base AS (SELECT event_type AS series_id, ts, value FROM events WHERE ts < TIMESTAMP '2024-01-20'), ext AS (SELECT event_type AS series_id, ts, value + 1 AS value FROM events WHERE ts >= TIMESTAMP '2024-01-18')"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), "ts", "value")
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    return e.filter(F.col("ts") < at("2024-01-20 00:00:00")), e.filter(F.col("ts") >= at("2024-01-18 00:00:00")).withColumn("value", F.col("value") + 1)


@query("incremental_append", f"WITH {_BASE}, m AS (SELECT series_id, max(ts) AS m FROM base GROUP BY 1) SELECT ext.series_id, ext.ts, round(ext.value, 4) AS value FROM ext LEFT JOIN m USING (series_id) WHERE m IS NULL OR ts > m")
def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    a, b = _split(spark, d)
    return ingest.append_after(a, b).select("series_id", "ts", F.round("value", 4).alias("value"))


@query("merge_precedence", f"WITH {_BASE}, u AS (SELECT *, 0 AS p FROM base UNION ALL SELECT *, 1 FROM ext) SELECT series_id, ts, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY p) AS n FROM u) WHERE n = 1")
def merge_precedence(spark: SparkSession, d: str) -> DataFrame:
    a, b = _split(spark, d)
    return ingest.merge_precedence(a, b).select("series_id", "ts", F.round("value", 4).alias("value"))


@query("overlap_count", f"WITH {_BASE} SELECT series_id, count(*) AS n_overlap FROM (SELECT series_id, ts FROM base INTERSECT SELECT series_id, ts FROM ext) GROUP BY 1")
def overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return ingest.overlap(*_split(spark, d))


_HOURLY = "h AS (SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, max(value) AS value, max(quality) AS quality FROM obs GROUP BY 1, 2)"


@query(
    "outer_merge_worst_quality",
    f"WITH {OBS}, {_HOURLY} SELECT coalesce(a.ts, b.ts) AS ts, a.value AS level, b.value AS temperature, CAST(greatest(a.quality, b.quality) AS INT) AS quality FROM (SELECT * FROM h WHERE series_id = 'view') a FULL JOIN (SELECT * FROM h WHERE series_id = 'click') b ON a.ts = b.ts",
)
def outer_merge_worst_quality(spark: SparkSession, d: str) -> DataFrame:
    h = observations(spark, d).groupBy("series_id", exprs.floor_to("ts", HOUR).alias("ts")).agg(F.max("value").alias("value"), F.max("quality").alias("quality"))
    return ingest.outer_merge(h.filter("series_id = 'view'"), h.filter("series_id = 'click'"), "level", "temperature", ("ts",))


@query("last_of_duplicates", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_of_duplicates(table(spark, d, "events"), ("user_id", "event_type"), "event_id").select("user_id", "event_type", "value")


_DAYS = "days AS (SELECT event_type AS station, CAST(ts AS DATE) AS day, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2, 3)"


def _wide_days(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("station"), F.year("ts").alias("y"), F.month("ts").alias("m"), F.dayofmonth("ts").alias("d"), F.hour("ts").alias("h"))
    w = e.groupBy("station", "y", "m", "d").pivot("h", list(range(24))).count()
    return w.select("station", "y", "m", "d", F.lit("1").alias("p24"), *[F.coalesce(F.col(str(h)).cast("string"), F.lit("-")).alias(f"h{h + 1}") for h in range(24)])


@query(
    "wide_hours_expand",
    f"WITH {_DAYS}, k AS (SELECT DISTINCT station, day, unnest(range(24)) AS h FROM days) SELECT k.station AS series_id, CAST(k.day AS TIMESTAMP) + INTERVAL 1 HOUR * (k.h + 1) AS ts, round(n / 10, 4) AS value FROM k LEFT JOIN days USING (station, day, h)",
)
def wide_hours_expand(spark: SparkSession, d: str) -> DataFrame:
    return ingest.expand_days(_wide_days(spark, d), [f"h{h}" for h in range(1, 25)])


@query("days_without_hours", "SELECT event_type AS series_id, CAST(0 AS BIGINT) AS n_days FROM events GROUP BY 1")
def days_without_hours(spark: SparkSession, d: str) -> DataFrame:
    return ingest.days_without_hours(_wide_days(spark, d), "p24", [f"h{h}" for h in range(1, 25)])


@query("station_inventory", f"WITH {OBS} SELECT series_id, min(ts) AS t0, max(ts) AS t_end, count(*) AS total_rows, count(*) FILTER (WHERE coalesce(quality, 0) <> 0) AS quality_nonzero FROM obs GROUP BY 1")
def station_inventory(spark: SparkSession, d: str) -> DataFrame:
    return ingest.inventory(observations(spark, d))


@query(
    "registry_join",
    f"""WITH {OBS}, reg AS (SELECT DISTINCT event_type AS station_code, length(event_type) * 1000.0 AS x, ascii(event_type) * 500.0 AS y FROM events WHERE event_type <> 'error')
    SELECT o.series_id, count(*) AS total_rows, round(any_value(sqrt((x - 1000) * (x - 1000) + (y - 2000) * (y - 2000)) / 1000), 2) AS distance_km FROM obs o LEFT JOIN reg ON station_code = series_id GROUP BY 1""",
)
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    reg = obs.select("series_id").distinct().filter("series_id != 'error'").select(F.col("series_id").alias("station_code"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variable_code"), (F.length("series_id") * 1000.0).alias("x"), (F.ascii("series_id") * 500.0).alias("y"), F.lit(0.0).alias("z"))
    return ingest.inventory(obs, reg, (1000.0, 2000.0)).select("series_id", "total_rows", "distance_km")


@query("integrity_table", f"WITH {OBS}, s AS (SELECT series_id, make_timestamp(CAST(round_even(epoch_us(ts) / 60000000, 0) AS BIGINT) * 60000000) AS ts FROM obs) SELECT series_id, count(*) AS n_rows, count(*) FILTER (WHERE ts IS NULL) AS bad_ts, count(ts) - count(DISTINCT ts) AS duplicates, min(ts) AS t0, max(ts) AS t_end FROM s GROUP BY 1")
def integrity_table(spark: SparkSession, d: str) -> DataFrame:
    return qc.integrity(observations(spark, d).withColumn("ts", exprs.round_half_even("ts")))


@query(
    "sampling_periods",
    f"WITH {OBS}, p AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS prev FROM obs), s AS (SELECT *, CAST(round((epoch_us(ts) - epoch_us(prev)) / 60000000) AS INT) AS step_min FROM p) SELECT series_id, step_min, min(prev) AS from_ts, max(ts) AS to_ts, count(*) AS n FROM s WHERE step_min IN (10, 15) GROUP BY 1, 2",
)
def sampling_periods(spark: SparkSession, d: str) -> DataFrame:
    return qc.sampling_periods(observations(spark, d))


_STEPS = f"{OBS}, s AS (SELECT series_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series_id ORDER BY ts))) // 60000000 AS minutes FROM obs), c AS (SELECT series_id, minutes, count(*) AS n FROM s WHERE minutes IS NOT NULL GROUP BY 1, 2)"


@query("frequent_intervals", f"WITH {_STEPS} SELECT * FROM (SELECT series_id, minutes, n, CAST(row_number() OVER (PARTITION BY series_id ORDER BY n DESC, minutes) AS INT) AS rank FROM c) WHERE rank <= 3")
def frequent_intervals(spark: SparkSession, d: str) -> DataFrame:
    return qc.frequent_intervals(observations(spark, d))


@query("dominant_interval", f"WITH {_STEPS} SELECT series_id, arg_min(minutes, (-n, minutes)) AS minutes FROM c GROUP BY 1")
def dominant_interval(spark: SparkSession, d: str) -> DataFrame:
    return qc.frequent_intervals(observations(spark, d), 1).select("series_id", "minutes")


@query("metadata_lines", f"WITH {OBS} SELECT series_id || ': rows = ' || count(*) || '; flagged = ' || count(*) FILTER (WHERE coalesce(quality, 0) <> 0) AS value FROM obs GROUP BY series_id")
def metadata_lines(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.sources.writers import metadata_lines as lines

    full = lines(ingest.inventory(observations(spark, d)))
    return full.select(F.regexp_replace("value", "T0 = .*; rows", "rows").alias("value"))


# --- relational --------------------------------------------------------------------------------------------------------


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("top_events", "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 5")
def top_events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(5).select("event_id", "event_type", "value")


@query("describe_values", f"WITH {OBS} SELECT series_id, count(value) AS n, min(value) AS v_min, max(value) AS v_max, round(avg(value), 6) AS v_mean, round(median(value), 6) AS v_median, round(stddev_samp(value), 6) AS v_std FROM obs GROUP BY 1")
def describe_values(spark: SparkSession, d: str) -> DataFrame:
    return r6(observations(spark, d).groupBy("series_id").agg(F.count("value").alias("n"), F.min("value").alias("v_min"), F.max("value").alias("v_max"), F.avg("value").alias("v_mean"), F.percentile("value", 0.5).alias("v_median"), F.stddev_samp("value").alias("v_std")), "v_mean", "v_median", "v_std")


@query("first_peak", f"WITH {OBS} SELECT series_id, arg_min(ts, (-k, ts)) AS ts, max(k) AS k FROM obs GROUP BY 1")
def first_peak(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("series_id").agg(exprs.first_argmax("k", "ts").alias("ts"), F.max("k").alias("k"))


@query(
    "row_functions",
    f"WITH {sql_binned(60)}, w AS (SELECT ts, max(CASE WHEN series_id = 'click' THEN value END) AS a, max(CASE WHEN series_id = 'view' THEN value END) AS b, max(CASE WHEN series_id = 'error' THEN value END) AS c FROM grid GROUP BY ts) SELECT ts, round(CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) END, 6) AS total, round(list_avg([a, b, c]), 6) AS mean, round(greatest(a, b, c), 6) AS top FROM w",
)
def row_functions(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.operators.grid import wide

    w = wide(binned(spark, d, 60), SERIES)
    c = ("click", "view", "error")
    return r6(w.select("ts", exprs.row_sum(*c).alias("total"), exprs.row_mean(*c).alias("mean"), exprs.row_max(*c).alias("top")), "total", "mean", "top")


@query("semi_join_region", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name = 'EUROPE')")
def semi_join_region(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query("anti_join_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("union_intersect", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'any', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT 'first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def union_intersect(spark: SparkSession, d: str) -> DataFrame:
    part = lambda f: table(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select("l_partkey")
    count = lambda df, k: df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    a, r = part("A"), part("R")
    return count(a.intersect(r), "both").unionByName(count(a.union(r).distinct(), "any")).unionByName(count(a.subtract(r), "first"))


@query("order_summary", "SELECT n_name, o_orderpriority, count(*) AS n_orders, count(DISTINCT o_custkey) AS n_customers, round(sum(l_extendedprice * (1 - l_discount)) / 1000, 2) AS revenue_k FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def order_summary(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n_orders"), F.count_distinct("o_custkey").alias("n_customers"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 1000, 2).alias("revenue_k"))


@query("range_join", "WITH w AS (SELECT event_id AS wid, ts AS a, ts + INTERVAL 2 HOUR AS b FROM events WHERE event_type = 'error') SELECT wid, count(*) AS n, round(sum(value), 4) AS total FROM w JOIN events ON ts BETWEEN a AND b AND event_type = 'view' GROUP BY 1")
def range_join(spark: SparkSession, d: str) -> DataFrame:
    """Interval join by hour buckets: equal keys first, then the exact bounds."""
    e = table(spark, d, "events")
    us = exprs.micros("ts")
    w = e.filter("event_type = 'error'").select(F.col("event_id").alias("wid"), us.alias("a"), (us + 2 * HOUR).alias("b"), F.explode(F.sequence(F.floor(us / F.lit(HOUR)), F.floor((us + 2 * HOUR) / F.lit(HOUR)))).alias("h"))
    v = e.filter("event_type = 'view'").select(us.alias("t"), F.floor(us / F.lit(HOUR)).alias("h"), "value")
    return w.join(v, "h").filter("t BETWEEN a AND b").groupBy("wid").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- statistics --------------------------------------------------------------------------------------------------------


@query(
    "cross_correlation",
    f"""WITH {sql_binned(60)}, p AS (SELECT series_id, epoch_us(ts) // 3600000000 AS i, value FROM grid WHERE value IS NOT NULL), j AS (SELECT a.series_id AS x_id, b.series_id AS y_id, l AS lag, a.value AS x, b.value AS y FROM p a CROSS JOIN (SELECT unnest(range(-6, 25)) AS l) JOIN p b ON b.i = a.i + l WHERE a.series_id = 'click' AND b.series_id <> 'click')
    SELECT x_id, y_id, CAST(lag AS INT) AS lag, round(corr(x, y), 6) AS r, count(*) AS n FROM j GROUP BY 1, 2, 3""",
)
def cross_correlation(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d, 60)
    return r6(stats.cross_correlation(g.filter("series_id = 'click'"), g.filter("series_id != 'click'"), range(-6, 25), HOUR), "r")


@query(
    "best_lag",
    f"""WITH {sql_binned(60)}, p AS (SELECT series_id, epoch_us(ts) // 3600000000 AS i, value FROM grid WHERE value IS NOT NULL), j AS (SELECT a.series_id AS x_id, b.series_id AS y_id, l AS lag, corr(a.value, b.value) AS r FROM p a CROSS JOIN (SELECT unnest(range(-6, 25)) AS l) JOIN p b ON b.i = a.i + l WHERE a.series_id = 'click' AND b.series_id <> 'click' GROUP BY 1, 2, 3)
    SELECT x_id, y_id, CAST(arg_min(lag, (-r, lag)) AS INT) AS best_lag, round(max(r), 6) AS best_r, round(max(CASE WHEN lag = 0 THEN r END), 6) AS r0 FROM j GROUP BY 1, 2""",
)
def best_lag(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d, 60)
    return r6(stats.best_lag(stats.cross_correlation(g.filter("series_id = 'click'"), g.filter("series_id != 'click'"), range(-6, 25), HOUR)), "best_r", "r0")


@query("mad_spread", f"WITH {OBS} SELECT series_id, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM obs GROUP BY 1")
def mad_spread(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.mad(observations(spark, d)), "median", "mad")


@query("cv_sample", f"WITH {OBS} SELECT series_id, round(stddev_samp(value) / avg(value), 6) AS cv FROM obs GROUP BY 1")
def cv_sample(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.variation(observations(spark, d)), "cv")


@query("percentile_by_month", "SELECT o_orderstatus AS series_id, CAST(month(o_orderdate) AS INT) AS month, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.9), 4) AS quantile FROM orders GROUP BY 1, 2")
def percentile_by_month(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return stats.month_climatology(o).select("series_id", "month", F.round("mean", 4).alias("mean"), F.round("quantile", 4).alias("quantile"))


@query("log_histogram", "SELECT CAST(floor((log10(value) + 1) / 4 * 40) + 1 AS BIGINT) AS bin, count(*) AS n FROM events WHERE value > 0 AND log10(value) >= -1 AND log10(value) < 3 GROUP BY 1")
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.log_histogram(table(spark, d, "events"), "value", -1, 3, 40)


@query("dry_share", f"WITH {OBS} SELECT series_id, round(100.0 * count(*) FILTER (WHERE value <= 10) / count(value), 1) AS dry_pct FROM obs GROUP BY 1")
def dry_share(spark: SparkSession, d: str) -> DataFrame:
    return stats.dry_share(observations(spark, d), 10)


@query("areal_mean", f"WITH {OBS}, s AS (SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS value FROM obs GROUP BY 1, 2) SELECT ts, round(avg(value), 6) AS value FROM s GROUP BY 1")
def areal_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.areal_mean(stats.calendar_sum(observations(spark, d), DAY)), "value")


@query("rank_correlation", "WITH v AS (SELECT CAST(json_extract_string(props, '$.k') AS INT) AS x, value AS y FROM events), r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM v) SELECT round(corr(rx, ry), 6) AS rho FROM r")
def rank_correlation(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.rank_correlation(observations(spark, d).select(F.col("k").alias("x"), F.col("value").alias("y")), "x", "y"), "rho")


# --- interchange -------------------------------------------------------------------------------------------------------


@query(
    "dss_pathname",
    "SELECT event_id, '//' || upper(event_type) || '/PRECIP-INC/' || upper(strftime(ts, '%d%b%Y')) || '/10Minute/OBS/' AS path, event_type = 'view' AS matches, CAST((epoch_us(ts) + 2208988800000000) // 60000000 AS BIGINT) AS minute FROM events",
)
def dss_pathname(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    path = simulator.path_name(F.upper("event_type"), F.lit("PRECIP-INC"), F.upper(F.date_format("ts", "ddMMMyyyy")), 10, F.lit("OBS"))
    return e.select("event_id", path.alias("path"), simulator.path_matches(path, "/*/view/PRECIP-INC//*/OBS/").alias("m0"), simulator.path_matches(path, "//view/*/*/*/OBS/").alias("matches"), simulator.to_minutes(F.col("ts")).alias("minute")).drop("m0")


@query(
    "incremental_export",
    f"WITH {sql_binned(60)} SELECT '//' || series_id || '/PRECIP-INC/' || upper(strftime(ts, '%d%b%Y')) || '/1Hour/OBS/' AS path, CAST((epoch_us(ts) + 2208988800000000) // 60000000 AS BIGINT) AS minute, round(value, 6) AS value, 'PER-CUM' AS type, 'MM' AS units FROM grid WHERE value IS NOT NULL",
)
def incremental_export(spark: SparkSession, d: str) -> DataFrame:
    return r6(simulator.incremental_rows(binned(spark, d, 60), 60), "value")


@query(
    "inverse_distance",
    f"WITH {sql_binned(60)}, g AS (SELECT ts, value, length(series_id) * 1.0 AS gx, ascii(series_id) * 1.0 AS gy FROM grid WHERE value IS NOT NULL), w AS (SELECT ts, value, 1.0 / pow(sqrt((gx - 2) * (gx - 2) + (gy - 90) * (gy - 90)), 2) AS w FROM g), s AS (SELECT ts, sum(w * value) / sum(w) AS value FROM w GROUP BY 1) SELECT DISTINCT grid.ts, round(s.value, 6) AS value FROM grid LEFT JOIN s USING (ts)",
)
def inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d, 60).select("ts", "value", (F.length("series_id") * 1.0).alias("gx"), (F.ascii("series_id") * 1.0).alias("gy"))
    return r6(simulator.inverse_distance(g, 2.0, 90.0), "value")


