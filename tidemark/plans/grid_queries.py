"""Queries on regridding, gaps, quality control and curves."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, HOUR, MINUTE
from tidemark.operators import curves, gaps, grid, qc, stats
from tidemark.plans.base import CEIL_HOUR, LINEAR, OBS, SERIES, binned, observations, query, span, sql_binned, sql_bracket, sql_spine, sql_within, table


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("clip_window", f"WITH {OBS} SELECT series_id, ts, value FROM obs WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'")
def clip_window(spark: SparkSession, d: str) -> DataFrame:
    """The window is the feature."""
    return grid.clip(observations(spark, d), datetime(2024, 1, 10), datetime(2024, 1, 20, 12)).select("series_id", "ts", "value")


@query(
    "snap_dedupe",
    f"""WITH {OBS}, s AS (SELECT *, make_timestamp(CAST(round_even(epoch_us(ts) / 60000000, 0) AS BIGINT) * 60000000) AS m FROM obs),
    n AS (SELECT *, row_number() OVER (PARTITION BY series_id, m ORDER BY ts, event_id) AS r FROM s)
    SELECT series_id, m AS ts, value, quality FROM n WHERE r = 1""",
)
def snap_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return grid.snap_dedupe(observations(spark, d), order=("event_id",)).select("series_id", "ts", "value", "quality")


@query("regrid_linear_10min", f"WITH {OBS}, {sql_spine()}, {sql_bracket('obs')} SELECT series_id, ts, round(CASE WHEN {sql_within(30)} THEN {LINEAR} END, 6) AS value FROM near")
def regrid_linear_10min(spark: SparkSession, d: str) -> DataFrame:
    return r6(grid.regrid_linear(observations(spark, d), *span(spark, d), max_gap=30 * MINUTE), "value")


@query(
    "regrid_mean_10min",
    f"""WITH {OBS}, {sql_spine()}, m AS (SELECT series_id, make_timestamp(((epoch_us(ts) + 599999999) // 600000000) * 600000000) AS ts, avg(value) AS value FROM obs GROUP BY 1, 2)
    SELECT series_id, ts, round(m.value, 6) AS value FROM spine LEFT JOIN m USING (series_id, ts)""",
)
def regrid_mean_10min(spark: SparkSession, d: str) -> DataFrame:
    return r6(grid.regrid_linear(observations(spark, d), *span(spark, d), method="mean"), "value")


_CUM = f"""{OBS}, {sql_spine()}, one AS (SELECT series_id, ts, sum(value) AS value FROM obs WHERE value IS NOT NULL GROUP BY 1, 2),
    run AS (SELECT series_id, ts, sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM one), {sql_bracket("run")},
    inc AS (SELECT series_id, ts, CASE WHEN keep THEN coalesce(c - lag(c) OVER (PARTITION BY series_id ORDER BY ts), c) END AS value FROM (SELECT *, {LINEAR} AS c, {{}} AS keep FROM near))"""


@query("regrid_cumulative_10min", f"WITH {_CUM.format(sql_within(30))} SELECT series_id, ts, round(value, 6) AS value FROM inc")
def regrid_cumulative_10min(spark: SparkSession, d: str) -> DataFrame:
    return r6(grid.regrid_cumulative(observations(spark, d), *span(spark, d), max_gap=30 * MINUTE), "value")


@query(
    "mass_conservation",
    f"""WITH {_CUM.format(sql_within(180))}, f AS (SELECT series_id, {CEIL_HOUR} AS ts, coalesce(sum(value), 0) AS fine FROM inc GROUP BY 1, 2), c AS (SELECT series_id, {CEIL_HOUR} AS ts, coalesce(sum(value), 0) AS coarse FROM obs GROUP BY 1, 2)
    SELECT series_id, count(*) AS n, round(max(abs(fine - coarse)), 6) AS max_abs, round(avg(abs(fine - coarse)), 6) AS mean_abs FROM f JOIN c USING (series_id, ts) GROUP BY 1""",
)
def mass_conservation(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    fine = grid.regrid_cumulative(obs, *span(spark, d))
    return r6(grid.mass_check(fine, grid.right_closed_sum(obs)), "max_abs", "mean_abs")


@query("quality_ffill", f"WITH {OBS}, {sql_spine()}, {sql_bracket('obs', value='quality')} SELECT series_id, ts, CAST(pv AS INT) AS quality FROM near")
def quality_ffill(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    return grid.quality_on_grid(obs, grid.spine(obs, *span(spark, d)))


@query(
    "grid_build",
    f"""WITH {OBS}, snap AS (SELECT series_id, m AS ts, value, quality FROM (SELECT *, row_number() OVER (PARTITION BY series_id, m ORDER BY ts) AS r FROM (SELECT *, make_timestamp(CAST(round_even(epoch_us(ts) / 60000000, 0) AS BIGINT) * 60000000) AS m FROM (SELECT * REPLACE (CASE WHEN quality <> 2 THEN value END AS value) FROM obs))) WHERE r = 1),
    {sql_spine()}, {sql_bracket("snap", out="q", value="quality")}, {sql_bracket("snap")},
    run AS (SELECT series_id, ts, sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS value FROM snap WHERE value IS NOT NULL), {sql_bracket("run", out="cum")},
    inc AS (SELECT series_id, ts, CASE WHEN keep THEN coalesce(c - lag(c) OVER (PARTITION BY series_id ORDER BY ts), c) END AS value FROM (SELECT *, {LINEAR} AS c, {sql_within(180)} AS keep FROM cum)),
    v AS (SELECT series_id, ts, CASE WHEN {sql_within(180)} THEN {LINEAR} END AS value FROM near WHERE series_id NOT IN ('purchase', 'signup') UNION ALL SELECT * FROM inc WHERE series_id IN ('purchase', 'signup'))
    SELECT v.series_id, v.ts, round(v.value / pi(), 6) AS value, CAST(q.pv AS INT) AS quality, CASE WHEN v.series_id = 'signup' THEN 'derived' ELSE 'observed' END AS data_type FROM v LEFT JOIN q USING (series_id, ts)""",
)
def grid_build(spark: SparkSession, d: str) -> DataFrame:
    kinds = {s: "cumulative" if s in ("purchase", "signup") else "instant" for s in SERIES}
    built = grid.build_grid(observations(spark, d), kinds, *span(spark, d), good=F.col("quality") != 2, labels={"signup": "derived"})
    return r6(built.withColumn("value", F.col("value") / F.pi()), "value")  # no rounding ties


_DONORS = "donor AS (SELECT ts, max(CASE WHEN series_id = 'click' THEN value END) AS d1, max(CASE WHEN series_id = 'error' THEN value END) AS d2 FROM (SELECT series_id, time_bucket(INTERVAL 10 MINUTE, ts) AS ts, sum(value) AS value FROM obs GROUP BY 1, 2) GROUP BY ts)"


@query(
    "disaggregate_template",
    f"""WITH {OBS}, {sql_spine()}, coarse AS (SELECT series_id, {CEIL_HOUR} AS h, sum(value) AS total FROM obs WHERE series_id = 'view' GROUP BY 1, 2), {_DONORS},
    c AS (SELECT spine.*, {CEIL_HOUR} AS h, d1, d2 FROM spine LEFT JOIN donor USING (ts) WHERE series_id = 'view'),
    w AS (SELECT c.*, total, sum(coalesce(d1, 0)) OVER p AS s1, sum(coalesce(d2, 0)) OVER p AS s2, count(d1) OVER p AS n1, count(d2) OVER p AS n2, count(*) OVER p AS n FROM c JOIN coarse USING (series_id, h) WINDOW p AS (PARTITION BY series_id, h))
    SELECT series_id, ts, round(CASE WHEN n1 >= 2 THEN CASE WHEN s1 > 0 THEN total * coalesce(d1, 0) / s1 ELSE total / n END WHEN n2 >= 2 THEN CASE WHEN s2 > 0 THEN total * coalesce(d2, 0) / s2 ELSE total / n END ELSE total / n END, 6) AS value FROM w""",
)
def disaggregate_template(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    view = obs.filter("series_id = 'view'")
    coarse = grid.right_closed_sum(view)
    ten = stats.calendar_sum(obs, 10 * MINUTE)
    donors = ten.groupBy("ts").agg(F.max(F.when(F.col("series_id") == "click", F.col("value"))).alias("d1"), F.max(F.when(F.col("series_id") == "error", F.col("value"))).alias("d2"))
    return r6(grid.disaggregate(coarse, donors, grid.spine(view, *span(spark, d))), "value")


@query(
    "asof_lookup",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT p.event_id, p.user_id, p.ts, v.ts AS asof_ts, v.value AS asof_value FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts""",
)
def asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return grid.asof_backward(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'"), "user_id", "value")


@query(
    "asof_nearest_within",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view')
    SELECT event_id, user_id, ts, CASE WHEN ok THEN vts END AS asof_ts, CASE WHEN ok THEN value END AS asof_value FROM (SELECT p.*, v.ts AS vts, v.value, epoch_us(p.ts) - epoch_us(v.ts) <= 21600000000 AS ok FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts)""",
)
def asof_within(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return grid.asof_backward(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'view'"), "user_id", "value", tolerance=6 * HOUR)


@query("null_rate_by_series", f"WITH {sql_binned()} SELECT series_id, round(100.0 * avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 2) AS null_pct FROM grid GROUP BY 1")
def null_rate_by_series(spark: SparkSession, d: str) -> DataFrame:
    return qc.null_rates(binned(spark, d))


@query("monthly_null_rate", f"WITH {sql_binned()} SELECT series_id, date_trunc('month', ts)::TIMESTAMP AS month, round(100.0 * avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 2) AS null_pct FROM grid GROUP BY 1, 2")
def monthly_null_rate(spark: SparkSession, d: str) -> DataFrame:
    return qc.monthly_null_rates(binned(spark, d))


@query("daily_sum", f"WITH {OBS} SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 6) AS value FROM obs GROUP BY 1, 2")
def daily_sum(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.calendar_sum(observations(spark, d), DAY), "value")


@query("hourly_mean", f"WITH {OBS} SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(avg(value), 6) AS value FROM obs GROUP BY 1, 2")
def hourly_mean(spark: SparkSession, d: str) -> DataFrame:
    return r6(stats.calendar_mean(observations(spark, d), HOUR), "value")


@query("hourly_right_closed_sum", f"WITH {OBS} SELECT series_id, {CEIL_HOUR} AS ts, round(coalesce(sum(value), 0), 6) AS value FROM obs GROUP BY 1, 2")
def hourly_right_closed_sum(spark: SparkSession, d: str) -> DataFrame:
    return r6(grid.right_closed_sum(observations(spark, d)), "value")


@query(
    "monthly_complete_mean",
    """WITH day AS (SELECT o_orderstatus AS series_id, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
    m AS (SELECT series_id, date_trunc('month', ts) AS m, sum(value) AS s, count(value) AS n FROM day GROUP BY 1, 2)
    SELECT series_id, CAST(month(m) AS INT) AS month, round(avg(s) / 1000, 2) AS mean_sum, count(*) AS n_months FROM m WHERE n >= 20 GROUP BY 1, 2""",
)
def monthly_complete_mean(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderstatus").alias("series_id"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    out = stats.complete_month_means(stats.calendar_sum(orders, DAY), 20)
    return out.select("series_id", "month", F.round(F.col("mean_sum") / 1000, 2).alias("mean_sum"), "n_months")


@query("wide_grid", f"WITH {sql_binned(60)} SELECT ts, " + ", ".join(f"round(max(CASE WHEN series_id = '{s}' THEN value END), 6) AS \"{s}\"" for s in SERIES) + " FROM grid GROUP BY ts")
def wide_grid(spark: SparkSession, d: str) -> DataFrame:
    return r6(grid.wide(binned(spark, d, 60), SERIES), *SERIES)


@query(
    "long_measurements",
    f"WITH {sql_binned(60)} SELECT ts, upper(series_id) AS station, 'VALUE' AS variable, round(value, 6) AS value, CAST(NULL AS INT) AS quality, CASE WHEN series_id = 'signup' THEN 'derived' ELSE 'observed' END AS data_type FROM grid",
)
def long_measurements(spark: SparkSession, d: str) -> DataFrame:
    w = grid.wide(binned(spark, d, 60), SERIES).withColumn("signup_type", F.lit("derived"))
    return r6(grid.measurements(w, {s: (s.upper(), "VALUE") for s in SERIES}, types={"signup": "signup_type"}), "value")


_RUNS = """isl AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN (value IS NULL) IS NOT DISTINCT FROM lag(value IS NULL) OVER w THEN 0 ELSE 1 END AS c, lag(ts) OVER w AS prev, lead(ts) OVER w AS nxt FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY ts)))"""
_GAPS = "gaps AS (SELECT series_id, min(ts) AS gap_start, max(ts) AS gap_end, count(*) AS n_missing, arg_min(prev, ts) AS p, arg_max(nxt, ts) AS x, bool_or(prev IS NULL) AS np, bool_or(nxt IS NULL) AS nx FROM isl WHERE value IS NULL GROUP BY series_id, island)"


@query(
    "gap_catalogue",
    f"""WITH {sql_binned()}, {_RUNS}, {_GAPS}, g AS (SELECT series_id, gap_start, gap_end, n_missing, CASE WHEN NOT np THEN p END AS prev_valid, CASE WHEN NOT nx THEN x END AS next_valid FROM gaps)
    SELECT *, round((epoch_us(next_valid) - epoch_us(prev_valid)) / 3600000000, 6) AS span_h FROM g""",
)
def gap_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return r6(gaps.gap_catalogue(binned(spark, d)), "span_h")


@query("longest_gaps", f"WITH {sql_binned()}, {_RUNS}, {_GAPS} SELECT series_id, gap_start, n_missing FROM gaps ORDER BY n_missing DESC, series_id, gap_start LIMIT 10")
def longest_gaps(spark: SparkSession, d: str) -> DataFrame:
    return gaps.gap_catalogue(binned(spark, d)).orderBy(F.desc("n_missing"), "series_id", "gap_start").limit(10).select("series_id", "gap_start", "n_missing")


@query("long_gap_count", f"WITH {sql_binned()}, {_RUNS}, {_GAPS} SELECT series_id, count(*) FILTER (WHERE NOT np AND NOT nx AND epoch_us(x) - epoch_us(p) > 7200000000) AS n_long FROM gaps GROUP BY 1")
def long_gap_count(spark: SparkSession, d: str) -> DataFrame:
    return gaps.long_gaps(binned(spark, d), 2)


_IMPUTED = f"""{sql_binned()}, {_RUNS}, runs AS (SELECT series_id, ts, value, CASE WHEN value IS NULL THEN count(*) OVER (PARTITION BY series_id, island) ELSE 0 END AS run FROM isl),
    want AS (SELECT series_id, ts FROM runs WHERE run BETWEEN 1 AND 3), {sql_bracket("grid", "want")}, filled AS (SELECT runs.series_id, runs.ts, runs.value AS old, coalesce(runs.value, {LINEAR}) AS value FROM runs LEFT JOIN near USING (series_id, ts))"""


@query("impute_short_gaps", f"WITH {_IMPUTED} SELECT series_id, ts, round(value, 6) AS value, CASE WHEN old IS NULL AND value IS NOT NULL THEN 'imputed' ELSE 'observed' END AS data_type FROM filled")
def impute_short_gaps(spark: SparkSession, d: str) -> DataFrame:
    return r6(gaps.impute_gaps(binned(spark, d), 3), "value")


@query("missing_flags", f"WITH {_IMPUTED} SELECT series_id, ts, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS missing FROM filled")
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    return gaps.missing_flags(gaps.impute_gaps(binned(spark, d), 3)).select("series_id", "ts", "missing")


@query("fill_report", f"WITH {_IMPUTED} SELECT series_id, count(*) FILTER (WHERE old IS NULL) AS nulls_before, count(*) FILTER (WHERE value IS NULL) AS nulls_after, count(*) FILTER (WHERE old IS NULL AND value IS NOT NULL) AS filled FROM filled GROUP BY 1")
def fill_report(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d)
    return gaps.fill_report(g, gaps.impute_gaps(g, 3))


@query("provenance_share", f"WITH {_IMPUTED}, c AS (SELECT series_id, CASE WHEN old IS NULL AND value IS NOT NULL THEN 'imputed' ELSE 'observed' END AS data_type, count(*) AS n FROM filled GROUP BY 1, 2) SELECT series_id, data_type, n, round(n / sum(n) OVER (PARTITION BY series_id), 6) AS share FROM c")
def provenance_share(spark: SparkSession, d: str) -> DataFrame:
    return qc.provenance_share(gaps.impute_gaps(binned(spark, d), 3))


@query("null_rate_change", f"WITH {_IMPUTED} SELECT series_id, round(avg(CASE WHEN old IS NULL THEN 1 ELSE 0 END), 6) AS null_before, round(avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) AS null_after, round(avg(CASE WHEN old IS NULL THEN 1 ELSE 0 END) - avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END), 6) AS recovered FROM filled WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def null_rate_change(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d)
    return r6(stats.null_rate_change(g, gaps.impute_gaps(g, 3), "2024-01-15 00:00:00"), "null_before", "null_after", "recovered")


_BOUNDS = f"{sql_binned()}, b AS (SELECT series_id, ts, CASE WHEN value BETWEEN 1 AND 120 THEN value END AS value FROM grid)"
_RATE = f"{_BOUNDS}, r AS (SELECT series_id, ts, CASE WHEN n = 1 OR NOT abs(v - p) > 60 THEN value END AS value FROM (SELECT *, coalesce(value, 0) AS v, lag(coalesce(value, 0)) OVER w AS p, row_number() OVER w AS n FROM b WINDOW w AS (PARTITION BY series_id ORDER BY ts)))"
_BLOCK = f"{_RATE}, i AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN (value IS NULL) IS NOT DISTINCT FROM lag(value IS NULL) OVER (PARTITION BY series_id ORDER BY ts) THEN 0 ELSE 1 END AS c FROM r)), k AS (SELECT series_id, ts, CASE WHEN count(*) OVER (PARTITION BY series_id, g) >= 3 THEN value END AS value FROM i)"


def _layers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    b = qc.bounds_filter(binned(spark, d), 1, 120)
    r = qc.rate_filter(b, 60)
    return b, r, qc.block_filter(r, 3)


@query("bounds_filter", f"WITH {_BOUNDS} SELECT series_id, ts, round(value, 6) AS value FROM b")
def bounds_filter(spark: SparkSession, d: str) -> DataFrame:
    return r6(_layers(spark, d)[0], "value")


@query("rate_filter", f"WITH {_RATE} SELECT series_id, ts, round(value, 6) AS value FROM r")
def rate_filter(spark: SparkSession, d: str) -> DataFrame:
    return r6(_layers(spark, d)[1], "value")


@query("block_filter", f"WITH {_BLOCK} SELECT series_id, ts, round(value, 6) AS value FROM k")
def block_filter(spark: SparkSession, d: str) -> DataFrame:
    return r6(_layers(spark, d)[2], "value")


@query("layer_report", f"WITH {_BLOCK}, n AS (SELECT series_id, count(value) AS n_raw FROM grid GROUP BY 1) SELECT n.*, x.n_bounds, y.n_rate, z.n_block FROM n JOIN (SELECT series_id, count(value) AS n_bounds FROM b GROUP BY 1) x USING (series_id) JOIN (SELECT series_id, count(value) AS n_rate FROM r GROUP BY 1) y USING (series_id) JOIN (SELECT series_id, count(value) AS n_block FROM k GROUP BY 1) z USING (series_id)")
def layer_report(spark: SparkSession, d: str) -> DataFrame:
    return qc.layer_report(binned(spark, d), 1, 120, 60, 3)


@query("quality_screen", f"WITH {OBS} SELECT series_id, count(*) FILTER (WHERE value IS NOT NULL AND NOT value BETWEEN 5 AND 200) AS n_out, round(100.0 * count(*) FILTER (WHERE value IS NOT NULL AND NOT value BETWEEN 5 AND 200) / count(value), 6) AS pct_out FROM obs GROUP BY 1")
def quality_screen(spark: SparkSession, d: str) -> DataFrame:
    return qc.quality_screen(observations(spark, d), 5, 200)


_DRIFT = f"""{OBS}, f AS (SELECT *, ts >= TIMESTAMP '2024-01-15' AS e FROM obs), q AS (SELECT series_id, hour(ts) AS hour, e, avg(value) AS m, count(*) AS n FROM f WHERE value < 80 GROUP BY ALL),
    j AS (SELECT coalesce(a.series_id, b.series_id) AS series_id, coalesce(a.hour, b.hour) AS hour, a.m AS me, a.n AS ne, b.m AS mh, b.n AS nh FROM (SELECT * FROM q WHERE e) a FULL JOIN (SELECT * FROM q WHERE NOT e) b ON a.series_id = b.series_id AND a.hour = b.hour),
    x AS (SELECT *, me - mh - avg(me - mh) OVER (PARTITION BY series_id) AS drift FROM j),
    y AS (SELECT series_id, hour, drift, max(me) OVER w - min(me) OVER w AS rng_ext, max(mh) OVER w - min(mh) OVER w AS rng_hist, max(drift) OVER w - min(drift) OVER w AS drift_rng, sum(ne) OVER w AS n_ext, sum(nh) OVER w AS n_hist FROM x WINDOW w AS (PARTITION BY series_id)),
    t AS (SELECT *, CASE WHEN n_ext < 50 OR n_hist < 50 THEN 'few_quiet_rows' WHEN NOT coalesce(rng_hist > 0, false) THEN 'flat_history' WHEN drift_rng < 1 OR rng_ext < 1.0 * rng_hist THEN 'small_drift' END AS reason FROM y)"""


@query("diurnal_drift", f"WITH {_DRIFT} SELECT series_id, CAST(hour AS INT) AS hour, round(drift, 6) AS drift, round(rng_ext, 6) AS rng_ext, round(rng_hist, 6) AS rng_hist, round(drift_rng, 6) AS drift_rng, CAST(n_ext AS BIGINT) AS n_ext, CAST(n_hist AS BIGINT) AS n_hist, reason, reason IS NULL AS applied FROM t")
def diurnal_drift(spark: SparkSession, d: str) -> DataFrame:
    t = qc.drift_table(observations(spark, d), F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), 80, 50, 1, 1.0)
    return r6(t, "drift", "rng_ext", "rng_hist", "drift_rng")


@query(
    "drift_corrected",
    f"WITH {_DRIFT} SELECT f.event_id, round(CASE WHEN f.e AND f.value IS NOT NULL AND t.drift IS NOT NULL THEN f.value - t.drift ELSE f.value END, 6) AS value, CASE WHEN f.e AND f.value IS NOT NULL AND t.drift IS NOT NULL THEN 'corrected' ELSE 'observed' END AS data_type FROM f LEFT JOIN (SELECT * FROM t WHERE reason IS NULL) t ON t.series_id = f.series_id AND t.hour = hour(f.ts)",
)
def drift_corrected(spark: SparkSession, d: str) -> DataFrame:
    ext = F.col("ts") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    out = qc.correct_drift(observations(spark, d), ext, quiet=80, min_samples=50, min_drift=1, min_ratio=1.0)
    return r6(out.select("event_id", "value", "data_type"), "value")


#: An invented curve table: two sections with a gap for one series, one open section with two terms for another.
CURVES = [("view", "meters_to_flow", "1", "0", "50", "{2}", "{1.5}"), ("view", "meters_to_flow", "2", "60", "NULL", "{1,3}", "{1.2,0.5}"), ("click", "meters_to_flow", "1", "0", "NULL", "{0.5, 2}", "{1.1,1}")]
_CURVE_SQL = "curves(station, o, x0, x1, b, e) AS (VALUES ('view', 1, 0.0, 50.0, [2.0], [1.5]), ('view', 2, 60.0, NULL, [1.0, 3.0], [1.2, 0.5]), ('click', 1, 0.0, NULL, [0.5, 2.0], [1.1, 1.0]))"


def _curves(spark: SparkSession) -> DataFrame:
    return curves.parse_curves(spark.createDataFrame(CURVES, "station_code string, type string, section_order string, initial_x string, final_x string, bases string, exponents string"))


@query(
    "rating_forward",
    f"""WITH {OBS}, {_CURVE_SQL}, j AS (SELECT event_id, o, list_sum(list_transform(list_zip(b, e), lambda z: z[1] * pow(value, z[2]))) AS q FROM obs JOIN curves ON station = series_id AND value >= x0 AND (x1 IS NULL OR value < x1))
    SELECT obs.event_id, round(arg_max(q, o), 6) AS flow FROM obs LEFT JOIN j USING (event_id) GROUP BY 1""",
)
def rating_forward(spark: SparkSession, d: str) -> DataFrame:
    return r6(curves.apply_curve(observations(spark, d), _curves(spark)).select("event_id", "flow"), "flow")


@query(
    "rating_inverse",
    f"""WITH {OBS}, lv AS (SELECT i * (5.0::DOUBLE / 9999) AS h FROM (SELECT unnest(range(10000)) AS i)), s AS (SELECT 'view' AS series_id, 2 * pow(h, 1.5) AS q, h FROM lv UNION ALL SELECT 'click', 0.5 * pow(h, 1.1) + 2 * h, h FROM lv),
    n AS (SELECT *, lead(q) OVER w AS q2, lead(h) OVER w AS h2 FROM s WINDOW w AS (PARTITION BY series_id ORDER BY h)),
    o AS (SELECT event_id, series_id, value / 20 AS x FROM obs)
    SELECT event_id, round(CASE WHEN x = q THEN h WHEN x <= q2 THEN h + (h2 - h) * (x - q) / (q2 - q) END, 6) AS level FROM o ASOF LEFT JOIN n ON o.series_id = n.series_id AND o.x >= n.q""",
)
def rating_inverse(spark: SparkSession, d: str) -> DataFrame:
    v = observations(spark, d).select("event_id", "series_id", (F.col("value") / 20).alias("value"))
    return r6(curves.apply_inverse(v, _curves(spark)).select("event_id", "level"), "level")
