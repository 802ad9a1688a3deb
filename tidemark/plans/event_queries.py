"""Queries on event segmentation, enrichment and feature tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, HOUR
from tidemark.operators import events, features, gaps, grid, stats
from tidemark.plans.base import OBS, SERIES, binned, observations, query, span, sql_binned
from tidemark.plans.grid_queries import r6

# --- peaks over threshold ------------------------------------------------------------------------------------------------

#: Thresholds scaled to the surrogate series; cells without a reading count as 0.
_POT = {"peak": 150.0, "start": 40.0, "end": 60.0, "core_gap": 6, "inter_event": 12, "max_core": 48, "lookback": 24, "lookahead": 48, "quiet": 6, "min_level": 160.0}
_POT_SQL = f"""{sql_binned()}, g AS (SELECT series_id, ts, epoch_us(ts) // 600000000 AS idx, coalesce(value, 0) AS q FROM grid),
    m AS (SELECT *, last_value(CASE WHEN NOT q > {_POT["start"]} THEN idx END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_low,
      sum(CASE WHEN q <= {_POT["end"]} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) = 6 AS calm, min(idx) OVER (PARTITION BY series_id) AS i_min, max(idx) OVER (PARTITION BY series_id) AS i_max FROM g),
    n AS (SELECT *, first_value(CASE WHEN calm THEN idx END IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_calm FROM m),
    a AS (SELECT *, sum(b) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS core FROM (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) <= 11 THEN 0 ELSE 1 END AS b FROM n WHERE q > {_POT["peak"]})),
    c AS (SELECT series_id, min(idx) AS g0, least(max(idx), min(idx) + 48) AS g1, min(i_min) AS i_min, max(i_max) AS i_max FROM a GROUP BY series_id, core),
    e AS (SELECT c.series_id, g0, greatest(g0 - 24, x.last_low + 1, c.i_min) AS i0, CASE WHEN y.next_calm <= least(c.i_max, g1 + 48) THEN y.next_calm - 5 ELSE least(c.i_max, g1 + 48) END AS i1
      FROM c JOIN n x ON x.series_id = c.series_id AND x.idx = g0 LEFT JOIN n y ON y.series_id = c.series_id AND y.idx = g1 + 6),
    p AS (SELECT e.series_id, g0, i0, i1, arg_min(idx, (-q, idx)) AS peak_idx, max(q) AS q FROM e JOIN g ON g.series_id = e.series_id AND idx BETWEEN i0 AND i1 GROUP BY ALL),
    k AS (SELECT series_id, peak_idx, min(g0) AS g0, min(i0) AS start_idx, max(i1) AS end_idx, max(round_even(q, 4)) AS peak_q FROM p GROUP BY 1, 2),
    ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_id ORDER BY g0) AS INT) AS event_id FROM k WHERE peak_q >= {_POT["min_level"]})"""


def _pot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = binned(spark, d)
    g = g.select("series_id", "ts", F.coalesce("value", F.lit(0.0)).alias("q"), F.coalesce("value", F.lit(0.0)).alias("h"), F.coalesce(F.col("value") / F.pi(), F.lit(0.0)).alias("p1"), F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("p2"))
    return g, events.detect_pot(g, rains=("p1", "p2"), splits=("2024-01-15 00:00:00", "2024-01-22 00:00:00"), **_POT)


@query(
    "pot_events",
    f"""WITH {_POT_SQL}, r AS (SELECT ev.series_id, event_id, ((idx * 600000000 + 3599999999) // 3600000000) AS h, sum(q / pi()) AS p1, sum(CASE WHEN q > 50 THEN 1 ELSE 0 END) AS p2 FROM ev JOIN g ON g.series_id = ev.series_id AND idx BETWEEN start_idx AND end_idx GROUP BY 1, 2, 3),
    s AS (SELECT series_id, event_id, round(sum(p1 + p2), 4) AS acc_precip, round(greatest(max(greatest(p1, p2)), 0), 4) AS max_intensity FROM r GROUP BY 1, 2)
    SELECT ev.series_id, ev.event_id, make_timestamp(start_idx * 600000000) AS start_ts, make_timestamp(peak_idx * 600000000) AS peak_ts, make_timestamp(end_idx * 600000000) AS end_ts, round(peak_q, 3) AS peak_q, round((end_idx - start_idx) / 6, 2) AS duration_h, acc_precip, max_intensity,
      CASE WHEN make_timestamp(peak_idx * 600000000) <= TIMESTAMP '2024-01-15' THEN 'train' WHEN make_timestamp(peak_idx * 600000000) <= TIMESTAMP '2024-01-22' THEN 'validation' ELSE 'test' END AS split
    FROM ev LEFT JOIN s USING (series_id, event_id)""",
)
def pot_events(spark: SparkSession, d: str) -> DataFrame:
    e = _pot(spark, d)[1]
    return e.select("series_id", "event_id", "start_ts", "peak_ts", "end_ts", F.round("peak_q", 3).alias("peak_q"), "duration_h", "acc_precip", "max_intensity", "split")


@query(
    "event_row_assignment",
    f"""WITH {_POT_SQL}, b AS (SELECT g.series_id, g.ts, arg_min(event_id, (abs(idx - peak_idx), event_id)) AS event_id FROM ev JOIN g ON g.series_id = ev.series_id AND idx BETWEEN start_idx AND end_idx GROUP BY 1, 2)
    SELECT g.series_id, g.ts, b.event_id FROM g LEFT JOIN b USING (series_id, ts)""",
)
def event_row_assignment(spark: SparkSession, d: str) -> DataFrame:
    g, e = _pot(spark, d)
    return events.assign_rows(g, e).select("series_id", "ts", "event_id")


# --- rain events ---------------------------------------------------------------------------------------------------------

_RAIN = """rows AS (SELECT series_id, ts, value, h AS ietd_h, CASE WHEN value >= 100 THEN ts END AS wet FROM obs, (SELECT unnest([2, 4, 6, 12]) AS h) WHERE value IS NOT NULL),
    m AS (SELECT *, last_value(wet IGNORE NULLS) OVER (PARTITION BY series_id, ietd_h ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, count(wet) OVER (PARTITION BY series_id, ietd_h) AS wets FROM rows),
    n AS (SELECT *, sum(CASE WHEN wet IS NOT NULL AND (prev IS NULL OR epoch_us(wet) - epoch_us(prev) > ietd_h * 3600000000) THEN 1 ELSE 0 END) OVER (PARTITION BY series_id, ietd_h ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ev FROM m),
    i AS (SELECT * FROM (SELECT *, max(wet) OVER (PARTITION BY series_id, ietd_h, ev) AS fin FROM n WHERE ev > 0 AND wets >= 2) WHERE ts <= fin),
    hr AS (SELECT series_id, ietd_h, ev, date_trunc('hour', ts) AS hh, sum(value) AS v, min(ts) AS t0, max(fin) AS fin FROM i GROUP BY 1, 2, 3, 4),
    re AS (SELECT series_id, ietd_h, min(t0) AS start, max(fin) AS fin, sum(v) AS depth, max(v) AS max_1h FROM hr GROUP BY series_id, ietd_h, ev)"""


def _rain(spark: SparkSession, d: str) -> DataFrame:
    return events.rain_events(observations(spark, d), (2, 4, 6, 12), 100.0)


@query("ietd_events", f'WITH {OBS}, {_RAIN} SELECT series_id, ietd_h, start, fin AS "end", round(depth, 3) AS depth, round((epoch_us(fin) - epoch_us(start)) / 3600000000, 6) AS duration_h, round(max_1h, 3) AS max_1h FROM re')
def ietd_events(spark: SparkSession, d: str) -> DataFrame:
    return _rain(spark, d).select("series_id", "ietd_h", "start", "end", F.round("depth", 3).alias("depth"), F.round("duration_h", 6).alias("duration_h"), F.round("max_1h", 3).alias("max_1h"))


_SENS = f"{_RAIN}, s AS (SELECT series_id, ietd_h, count(*) AS n_events, round(stddev_samp(dry) / avg(dry), 3) AS cv_dry FROM (SELECT *, (epoch_us(start) - epoch_us(lag(fin) OVER (PARTITION BY series_id, ietd_h ORDER BY start))) / 3600000000 AS dry FROM re) GROUP BY 1, 2)"


@query("ietd_sensitivity", f"WITH {OBS}, {_SENS} SELECT * FROM s")
def ietd_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    return events.ietd_sensitivity(_rain(spark, d))


@query("ietd_selected", f"WITH {OBS}, {_SENS} SELECT series_id, arg_min(ietd_h, (abs(cv_dry - 1), ietd_h)) AS ietd_h FROM s WHERE cv_dry IS NOT NULL GROUP BY 1")
def ietd_selected(spark: SparkSession, d: str) -> DataFrame:
    return events.select_ietd(events.ietd_sensitivity(_rain(spark, d)))


# --- level events --------------------------------------------------------------------------------------------------------

_LEVEL_SQL = f"""{sql_binned()}, g AS (SELECT series_id, ts, epoch_us(ts) // 600000000 AS idx, value / pi() AS value, epoch_us(ts) AS t FROM grid),
    h AS (SELECT *, CASE WHEN count(value) OVER w >= 72 THEN quantile_cont(value, 0.2) OVER w END AS base, value - lag(value, 18) OVER (PARTITION BY series_id ORDER BY idx) AS dh, min(idx) OVER (PARTITION BY series_id) AS i_min, max(idx) OVER (PARTITION BY series_id) AS i_max
      FROM g WINDOW w AS (PARTITION BY series_id ORDER BY t RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)),
    th AS (SELECT series_id, k_mad, greatest(0.03, k_mad * 1.4826 * mad(dh)) AS thr FROM h, (SELECT unnest([2.0::DOUBLE, 3.0::DOUBLE]) AS k_mad) WHERE dh IS NOT NULL GROUP BY 1, 2),
    ca AS (SELECT h.series_id, k_mad, mit_h, idx, thr, i_min, i_max, CASE WHEN idx - lag(idx) OVER (PARTITION BY h.series_id, k_mad, mit_h ORDER BY idx) <= mit_h * 6 THEN 0 ELSE 1 END AS b FROM h JOIN th USING (series_id), (SELECT unnest([6, 12]) AS mit_h) WHERE dh > thr),
    gr AS (SELECT series_id, k_mad, mit_h, grp, min(idx) AS r0, max(idx) AS r1, any_value(thr) AS thr, any_value(i_min) AS i_min, any_value(i_max) AS i_max FROM (SELECT *, sum(b) OVER (PARTITION BY series_id, k_mad, mit_h ORDER BY idx ROWS UNBOUNDED PRECEDING) AS grp FROM ca) GROUP BY 1, 2, 3, 4),
    st AS (SELECT gr.*, (SELECT arg_min(idx, (value, idx)) FROM g WHERE g.series_id = gr.series_id AND idx BETWEEN greatest(r0 - 36, i_min) AND r0 AND value IS NOT NULL) AS s0, (SELECT arg_min(idx, (-value, idx)) FROM g WHERE g.series_id = gr.series_id AND idx BETWEEN r0 AND least(r1 + 144, i_max) AND value IS NOT NULL) AS pk FROM gr),
    s1 AS (SELECT st.*, s0 IS NULL AS uncertain, coalesce(s0, greatest(r0 - 18, i_min)) AS s FROM st WHERE pk IS NOT NULL),
    s2 AS (SELECT s1.*, coalesce(a.base, a.value) AS b0, b.value AS pv, least(pk + 1008, s1.i_max) AS jmax FROM s1 JOIN h a ON a.series_id = s1.series_id AND a.idx = s JOIN h b ON b.series_id = s1.series_id AND b.idx = pk WHERE coalesce(a.base, a.value) IS NOT NULL),
    s3 AS (SELECT s2.*, pv - b0 AS delta, (SELECT min(idx) FROM g WHERE g.series_id = s2.series_id AND idx BETWEEN pk AND jmax AND value <= b0 + 0.15 * (pv - b0)) AS e0 FROM s2),
    s4 AS (SELECT *, e0 IS NULL AS capped, coalesce(e0, jmax) AS e FROM s3),
    isl AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN (value IS NULL) IS NOT DISTINCT FROM lag(value IS NULL) OVER (PARTITION BY series_id ORDER BY idx) THEN 0 ELSE 1 END AS c FROM h)),
    gp AS (SELECT series_id, min(idx) AS a, max(idx) + 1 AS b, any_value(i_min) AS i_min, any_value(i_max) AS i_max FROM isl WHERE value IS NULL GROUP BY series_id, island),
    lg AS (SELECT * FROM gp WHERE (least(b, i_max) - greatest(a - 1, i_min)) * 600000000 > 10800000000),
    fl AS (SELECT s4.*, EXISTS (SELECT 1 FROM lg WHERE lg.series_id = s4.series_id AND a < e AND b > s) AS gap_flag FROM s4 WHERE delta >= 3 AND (e - s) / 6 >= 2),
    le AS (SELECT series_id, k_mad, mit_h, printf('E%03d', row_number() OVER (PARTITION BY series_id, k_mad, mit_h ORDER BY grp)) AS event_id, make_timestamp(s * 600000000) AS start, make_timestamp(e * 600000000) AS fin, make_timestamp(pk * 600000000) AS peak_time, b0, pv, delta, (e - s) / 6 AS hours, thr, gap_flag,
      array_to_string(list_filter([CASE WHEN uncertain THEN 'start_uncertain' END, CASE WHEN capped THEN 'recession_cap' END, CASE WHEN gap_flag THEN 'gap_inside' END], lambda x: x IS NOT NULL), ',') AS flags FROM fl)"""


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    return binned(spark, d).withColumn("value", F.col("value") / F.pi())  # no rounding ties


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return events.detect_level_events(_scaled(spark, d), (6, 12), (2.0, 3.0), min_rise=3.0)


@query(
    "level_events",
    f'WITH {_LEVEL_SQL} SELECT series_id, k_mad, mit_h, event_id, start, fin AS "end", peak_time, round(b0, 3) AS base_level, round(pv, 3) AS peak_level, round(delta, 3) AS delta, round(hours, 1) AS duration_h, round(thr, 4) AS rise_thr, gap_flag, flags FROM le',
)
def level_events(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d)


#: The events of one setting, at every station.
_ONE = "one AS (SELECT series_id, event_id, start, fin FROM le WHERE k_mad = 3 AND mit_h = 12)"
_KEY = ("series_id", "event_id")


def _stations(spark: SparkSession, d: str) -> DataFrame:
    return events.detect_level_events(_scaled(spark, d), (12,), (3.0,), min_rise=3.0)


@query(
    "event_rain",
    f"""WITH {_LEVEL_SQL}, {_ONE}, hs AS (SELECT s.series_id AS gauge, x.ts, v.value FROM (SELECT DISTINCT series_id FROM obs) s CROSS JOIN (SELECT unnest(generate_series(a - INTERVAL 7 DAY, z + INTERVAL 7 DAY, INTERVAL 1 HOUR)) AS ts FROM span) x LEFT JOIN (SELECT series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(value) / pi() AS value FROM obs GROUP BY 1, 2) v ON v.series_id = s.series_id AND v.ts = x.ts)
    SELECT one.series_id, event_id, gauge, CASE WHEN avg(CASE WHEN value IS NULL THEN 0 ELSE 1 END) >= 0.8 THEN round(coalesce(sum(value), 0), 1) END AS rain, round(max(value), 4) AS max_1h FROM one JOIN hs ON ts BETWEEN start - INTERVAL 24 HOUR AND fin GROUP BY 1, 2, 3""",
)
def event_rain(spark: SparkSession, d: str) -> DataFrame:
    obs = observations(spark, d)
    a, z = span(spark, d)
    cells = grid.spine(obs, a - timedelta(days=7), z + timedelta(days=7), HOUR)
    hourly = cells.join(stats.calendar_sum(obs, HOUR), ["series_id", "ts"], "left").select(F.col("series_id").alias("gauge"), "ts", (F.col("value") / F.pi()).alias("value"))
    return events.window_rain(_stations(spark, d), hourly, keys=_KEY).select(*_KEY, "gauge", "rain", F.round("max_1h", 4).alias("max_1h"))


@query(
    "upstream_response",
    f"""WITH {_LEVEL_SQL}, {_ONE}, r AS (SELECT one.series_id, event_id, g.series_id AS gauge, max(value) - min(value) AS r FROM one JOIN g ON idx BETWEEN epoch_us(start) // 600000000 - 72 AND epoch_us(fin) // 600000000 AND g.series_id <> one.series_id AND value IS NOT NULL GROUP BY 1, 2, 3)
    SELECT one.series_id, one.event_id, count(*) FILTER (WHERE r > 20) AS n_upstream FROM one LEFT JOIN r USING (series_id, event_id) GROUP BY 1, 2""",
)
def upstream_response(spark: SparkSession, d: str) -> DataFrame:
    return events.upstream_response(_stations(spark, d), _scaled(spark, d), rise=60 / 3, keys=_KEY)


@query("rain_driver_exists", f"WITH {_LEVEL_SQL}, {_ONE}, {_RAIN} SELECT series_id, event_id FROM one WHERE EXISTS (SELECT 1 FROM re WHERE ietd_h = 2 AND re.start <= one.start + INTERVAL 6 HOUR AND re.fin >= one.start - INTERVAL 24 HOUR)")
def rain_driver_exists(spark: SparkSession, d: str) -> DataFrame:
    rains = events.rain_events(observations(spark, d), (2,), 100.0)  # of all gauges
    return events.rain_driven(_stations(spark, d), rains, keys=_KEY).select(*_KEY)


@query("event_months", f"WITH {_LEVEL_SQL}, {_ONE}, {_RAIN}, mm AS (SELECT 'rain' AS kind, start FROM re WHERE ietd_h = 6 UNION ALL SELECT 'level', start FROM one) SELECT CAST(month(start) AS INT) AS month, count(*) FILTER (WHERE kind = 'rain') AS n_rain, count(*) FILTER (WHERE kind = 'level') AS n_level FROM mm GROUP BY 1")
def event_months(spark: SparkSession, d: str) -> DataFrame:
    return events.month_counts({"rain": events.rain_events(observations(spark, d), (6,), 100.0), "level": _stations(spark, d)})


@query("events_around_cut", f"WITH {_POT_SQL} SELECT series_id, count(*) FILTER (WHERE make_timestamp(peak_idx * 600000000) < TIMESTAMP '2024-01-20') AS n_before, count(*) FILTER (WHERE make_timestamp(peak_idx * 600000000) >= TIMESTAMP '2024-01-20') AS n_after, count(*) AS n FROM ev GROUP BY 1")
def events_around_cut(spark: SparkSession, d: str) -> DataFrame:
    return events.around_cut(_pot(spark, d)[1], "2024-01-20 00:00:00")


@query("event_seasons", f"WITH {_LEVEL_SQL} SELECT series_id, count(*) AS n, CASE WHEN month(start) IN (12, 1, 2) THEN 'DJF' ELSE 'MAM' END AS season, CAST(year(start) + (month(start) >= 10)::INT AS INT) AS hydro_year FROM le GROUP BY 1, 3, 4")
def event_seasons(spark: SparkSession, d: str) -> DataFrame:
    return events.seasons(_levels(spark, d)).groupBy("series_id", "season", F.col("hydro_year").cast("int").alias("hydro_year")).agg(F.count("*").alias("n"))


@query("events_per_year", "WITH c AS (SELECT year(o_orderdate) + (month(o_orderdate) >= 10)::INT AS y, count(*) AS n FROM orders GROUP BY 1) SELECT min(n) AS n_min, max(n) AS n_max, median(n) AS n_median FROM c")
def events_per_year(spark: SparkSession, d: str) -> DataFrame:
    return events.events_per_year(spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderdate", "start"))


@query(
    "antecedent_rain",
    f"WITH {OBS}, a AS (SELECT ts, avg(value) AS value FROM (SELECT series_id, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) AS value FROM obs GROUP BY 1, 2) GROUP BY 1) SELECT ts, round(CASE WHEN count(value) OVER w >= 5 THEN sum(value) OVER w END, 4) AS api FROM a WINDOW w AS (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
)
def antecedent_rain(spark: SparkSession, d: str) -> DataFrame:
    daily = stats.areal_mean(stats.calendar_sum(observations(spark, d), DAY))
    return events.antecedent_rain(daily).select("ts", F.round("api", 4).alias("api"))


@query(
    "rolling_time_quantile",
    f"WITH {sql_binned(60)} SELECT series_id, ts, round(CASE WHEN count(value) OVER w >= 24 THEN quantile_cont(value, 0.2) OVER w END, 5) AS q FROM grid WINDOW w AS (PARTITION BY series_id ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)",
)
def rolling_time_quantile(spark: SparkSession, d: str) -> DataFrame:
    g = binned(spark, d, 60)
    return events.rolling_quantile(g, 7, 0.2, 24).select("series_id", "ts", F.round("base", 5).alias("q"))


# --- features --------------------------------------------------------------------------------------------------------------

_W = "(PARTITION BY series_id ORDER BY ts)"


@query("lag_features", f"WITH {sql_binned()} SELECT series_id, ts, " + ", ".join(f"round(lag(value, {h * 6}) OVER {_W}, 6) AS value_lag_{h}h" for h in (1, 2, 3, 6, 12, 24)) + " FROM grid")
def lag_features(spark: SparkSession, d: str) -> DataFrame:
    df = binned(spark, d).select("series_id", "ts", *features.lags(["value"]))
    return r6(df, *[c for c in df.columns if "lag" in c])


@query("lead_targets", f"WITH {sql_binned()} SELECT series_id, ts, " + ", ".join(f"round(lead(value, {h * 6}) OVER {_W}, 6) AS target_{h}h" for h in (1, 6, 24)) + " FROM grid")
def lead_targets(spark: SparkSession, d: str) -> DataFrame:
    return r6(binned(spark, d).select("series_id", "ts", *features.leads("value")), "target_1h", "target_6h", "target_24h")


@query("rolling_sums", f"WITH {sql_binned()} SELECT series_id, ts, " + ", ".join(f"round(sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS {h * 6 - 1} PRECEDING), 4) AS value_cum_{h}h" for h in (3, 6, 12, 24, 48)) + " FROM grid")
def rolling_sums(spark: SparkSession, d: str) -> DataFrame:
    df = binned(spark, d).select("series_id", "ts", *features.rolling_sums(["value"]))
    return df.select("series_id", "ts", *[F.round(c, 4).alias(c) for c in df.columns if "cum" in c])


_WIDE = ", ".join(f'max(CASE WHEN series_id = \'{s}\' THEN value END) AS "{s}"' for s in SERIES)
_DIFF = 'view - CASE WHEN click IS NULL AND error IS NULL THEN NULL ELSE coalesce(click, 0) + coalesce(error, 0) END'
_SUM = "CASE WHEN purchase IS NULL AND signup IS NULL THEN NULL ELSE coalesce(purchase, 0) + coalesce(signup, 0) END"


@query("flow_differences", f"WITH {sql_binned()}, w AS (SELECT ts, {_WIDE} FROM grid GROUP BY ts) SELECT ts, round({_DIFF}, 6) AS lateral_q, round({_SUM}, 6) AS inflow FROM w")
def flow_differences(spark: SparkSession, d: str) -> DataFrame:
    w = grid.wide(binned(spark, d), SERIES)
    cols = features.flow_differences({"lateral_q": ("view", ("click", "error"))}, {"inflow": ("purchase", "signup")})
    return w.select("ts", *[F.round(c, 6).alias(k) for k, c in cols.items()])


def training(spark: SparkSession, d: str) -> DataFrame:
    """Wide hourly grid with gaps of up to 6 cells filled, and its training table."""
    g = gaps.impute_gaps(binned(spark, d, 60), 6)
    w = grid.wide(g, SERIES).select("ts", F.lit("all").alias("basin"), *SERIES, F.col("view").isNull().cast("int").alias("view_missing"))
    return features.training_table(w, "view", ["view", "click"], ["purchase", "error"], {"lateral_q": ("view", ("click", "error"))}, {"inflow": ("purchase", "signup")}, lag_hours=(1, 6, 24), cum_hours=(3, 24), per_hour=1, splits=("2024-01-18 00:00:00", "2024-01-24 00:00:00"))


_RUNS60 = "isl AS (SELECT *, sum(c) OVER (PARTITION BY series_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN (value IS NULL) IS NOT DISTINCT FROM lag(value IS NULL) OVER (PARTITION BY series_id ORDER BY ts) THEN 0 ELSE 1 END AS c FROM grid))"


def _training_sql() -> str:
    from tidemark.plans.base import LINEAR, sql_bracket

    lag = lambda c, n: ", ".join(f"lag({c}, {h}) OVER (ORDER BY ts) AS {n}_lag_{h}h" for h in (1, 6, 24))
    cum = lambda c: ", ".join(f"sum({c}) OVER (ORDER BY ts ROWS {h - 1} PRECEDING) AS {c}_cum_{h}h" for h in (3, 24))
    lead = ", ".join(f"lead(view, {h}) OVER (ORDER BY ts) AS target_{h}h" for h in (1, 6, 24))
    return f"""{sql_binned(60)}, {_RUNS60}, want AS (SELECT series_id, ts FROM (SELECT series_id, ts, value, count(*) OVER (PARTITION BY series_id, island) AS run FROM isl) WHERE value IS NULL AND run <= 6), {sql_bracket("grid", "want")},
    full_grid AS (SELECT grid.series_id, grid.ts, coalesce(grid.value, {LINEAR}) AS value FROM grid LEFT JOIN near USING (series_id, ts)),
    w AS (SELECT ts, {_WIDE} FROM full_grid GROUP BY ts), f AS (SELECT *, CASE WHEN view IS NULL THEN 1 ELSE 0 END AS view_missing, {_DIFF} AS lateral_q, {_SUM} AS inflow FROM w),
    t AS (SELECT *, {lag("view", "view")}, {lag("click", "click")}, {lag("view_missing", "view_missing")}, {lag("lateral_q", "lateral_q")}, {lag("inflow", "inflow")}, {cum("purchase")}, {cum("error")}, {lead} FROM f),
    tt AS (SELECT *, CASE WHEN ts <= TIMESTAMP '2024-01-18' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-24' THEN 'validation' ELSE 'test' END AS split FROM t WHERE target_1h IS NOT NULL AND target_6h IS NOT NULL AND target_24h IS NOT NULL)"""


_LAGGED = [f"{c}_lag_{h}h" for c in ("view", "click", "lateral_q", "inflow") for h in (1, 6, 24)] + [f"{c}_cum_{h}h" for c in ("purchase", "error") for h in (3, 24)] + ["lateral_q", "inflow", "target_1h", "target_6h", "target_24h"]


@query("training_table", f"WITH {_training_sql()} SELECT ts, split, " + ", ".join(f"round({c} / pi(), 5) AS {c}" for c in _LAGGED) + ", view_missing_lag_1h FROM tt")
def training_table(spark: SparkSession, d: str) -> DataFrame:
    t = training(spark, d)
    return t.select("ts", "split", *[F.round(F.col(c) / F.pi(), 5).alias(c) for c in _LAGGED], "view_missing_lag_1h")


@query("chronological_split", f"WITH {_training_sql()} SELECT split, count(*) AS n, min(ts) AS from_ts, max(ts) AS to_ts FROM tt GROUP BY 1")
def chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return training(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


TRAINING_SQL = _training_sql()
