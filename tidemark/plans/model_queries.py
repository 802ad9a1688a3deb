"""Queries on forecasts and their verification."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import events, features, metrics, models
from tidemark.plans.base import binned, query
from tidemark.plans.event_queries import TRAINING_SQL, training
from tidemark.plans.grid_queries import r6

HORIZONS = (1, 6, 24)
_PRED = f"{TRAINING_SQL}, pred AS (SELECT ts, split, h AS horizon_h, view AS sim, CASE h WHEN 1 THEN target_1h WHEN 6 THEN target_6h ELSE target_24h END AS obs FROM tt, (SELECT unnest([1, 6, 24]) AS h) WHERE view IS NOT NULL)"
_NSE = "CASE WHEN count(*) >= 2 AND stddev_pop(obs) > 0 THEN 1 - sum(pow(obs - sim, 2)) / (var_pop(obs) * count(*)) END"


def _persistence(spark: SparkSession, d: str) -> DataFrame:
    return models.persistence(training(spark, d), "view", HORIZONS)


@query(
    "skill_metrics",
    f"""WITH {_PRED} SELECT CAST(horizon_h AS INT) AS horizon_h, split, count(*) AS n, round({_NSE}, 5) AS nse, round(1 - sqrt(pow(corr(obs, sim) - 1, 2) + pow(stddev_pop(sim) / stddev_pop(obs) - 1, 2) + pow(avg(sim) / avg(obs) - 1, 2)), 5) AS kge,
    round(sqrt(avg(pow(obs - sim, 2))), 5) AS rmse, round(avg(abs(obs - sim)), 5) AS mae, round(100 * sum(sim - obs) / sum(obs), 5) AS pbias FROM pred GROUP BY 1, 2""",
)
def skill_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.skill(_persistence(spark, d), "horizon_h", "split")
    return s.select("horizon_h", "split", "n", *[F.round(c, 5).alias(c) for c in ("nse", "kge", "rmse", "mae", "pbias")])


@query("skill_pivot", f"WITH {_PRED}, s AS (SELECT horizon_h, {_NSE} AS nse FROM pred WHERE split = 'test' GROUP BY 1) SELECT 'persistence' AS model, " + ", ".join(f'round(max(CASE WHEN horizon_h = {h} THEN nse END), 5) AS "{h}"' for h in HORIZONS) + " FROM s")
def skill_pivot(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.skill(_persistence(spark, d).filter("split = 'test'"), "model", "horizon_h")
    return metrics.skill_pivot(s, list(HORIZONS)).select("model", *[F.round(str(h), 5).alias(str(h)) for h in HORIZONS])


@query(
    "threshold_scores",
    f"""WITH {_PRED}, c AS (SELECT CAST(horizon_h AS INT) AS horizon_h, split, count(*) FILTER (WHERE obs > 80 AND sim > 80) AS hits, count(*) FILTER (WHERE obs > 80 AND NOT sim > 80) AS misses, count(*) FILTER (WHERE NOT obs > 80 AND sim > 80) AS false_alarms FROM pred GROUP BY 1, 2)
    SELECT *, round(hits / nullif(hits + misses, 0), 6) AS pod, round(false_alarms / nullif(hits + false_alarms, 0), 6) AS far, round(hits / nullif(hits + misses + false_alarms, 0), 6) AS csi FROM c""",
)
def threshold_scores(spark: SparkSession, d: str) -> DataFrame:
    return r6(metrics.threshold_scores(_persistence(spark, d), 80.0, "horizon_h", "split"), "pod", "far", "csi")


@query(
    "peak_error",
    f"""WITH {_PRED}, p AS (SELECT CAST(horizon_h AS INT) AS horizon_h, split, arg_min(ts, (-obs, ts)) AS ot, arg_min(ts, (-sim, ts)) AS st, max(obs) AS o, max(sim) AS s FROM pred GROUP BY 1, 2)
    SELECT horizon_h, split, round((s - o) / pi(), 5) AS peak_mag_err, round((epoch_us(st) - epoch_us(ot)) / 3600000000, 4) AS peak_time_err_h FROM p""",
)
def peak_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.peak_errors(_persistence(spark, d), "horizon_h", "split").select("horizon_h", "split", F.round(F.col("peak_mag_err") / F.pi(), 5).alias("peak_mag_err"), F.round("peak_time_err_h", 4).alias("peak_time_err_h"))


@query("split_skill", f"WITH {_PRED}, x AS (SELECT *, unnest(['full', CASE WHEN ts < TIMESTAMP '2024-01-20' THEN 'before' ELSE 'after' END]) AS period FROM pred) SELECT CAST(horizon_h AS INT) AS horizon_h, period, count(*) AS n, round({_NSE}, 5) AS nse FROM x GROUP BY 1, 2")
def split_skill(spark: SparkSession, d: str) -> DataFrame:
    return metrics.by_period(_persistence(spark, d), "2024-01-20 00:00:00", "horizon_h").select("horizon_h", "period", "n", F.round("nse", 5).alias("nse"))


_WINDOWS = "windows AS (SELECT CAST(row_number() OVER (ORDER BY a) AS INT) AS event_id, a, a + INTERVAL 30 HOUR AS b FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-27', INTERVAL 2 DAY)) AS a))"
_PER = f"{_PRED}, {_WINDOWS}, j AS (SELECT CAST(horizon_h AS INT) AS horizon_h, event_id, obs, sim, ts FROM pred JOIN windows ON ts BETWEEN a AND b WHERE obs IS NOT NULL), e AS (SELECT horizon_h, event_id, count(*) AS n, {_NSE} AS nse, sqrt(avg(pow(obs - sim, 2))) AS rmse, arg_min(ts, (-obs, ts)) AS ot, arg_min(ts, (-sim, ts)) AS st, max(obs) AS o, max(sim) AS s FROM j GROUP BY 1, 2 HAVING count(*) >= 2)"


def _windows(spark: SparkSession) -> DataFrame:
    t = F.timestamp_micros((F.lit(1704153600) + F.col("id") * 172800) * 1_000_000).cast("timestamp_ntz")
    return spark.range(13).select((F.col("id") + 1).cast("int").alias("event_id"), t.alias("start_ts"), (t + F.expr("INTERVAL 30 HOURS")).alias("end_ts"))


@query("per_event_metrics", f"WITH {_PER} SELECT horizon_h, event_id, n, round(nse, 5) AS nse, round(rmse, 5) AS rmse, round((s - o) / pi(), 5) AS peak_mag_err, round((epoch_us(st) - epoch_us(ot)) / 3600000000, 4) AS peak_time_err_h FROM e")
def per_event_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.per_event(_persistence(spark, d), _windows(spark), "horizon_h", step=3_600_000_000)
    return p.select("horizon_h", "event_id", "n", F.round("nse", 5).alias("nse"), F.round("rmse", 5).alias("rmse"), F.round(F.col("peak_mag_err") / F.pi(), 5).alias("peak_mag_err"), F.round("peak_time_err_h", 4).alias("peak_time_err_h"))


@query("median_event_skill", f"WITH {_PER} SELECT 'persistence' AS model, horizon_h, round(median(nse), 5) AS median_nse, count(*) AS n_events FROM e GROUP BY 2")
def median_event_skill(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.per_event(_persistence(spark, d), _windows(spark), "model", "horizon_h", step=3_600_000_000)
    return metrics.median_event_skill(p).select("model", "horizon_h", F.round("median_nse", 5).alias("median_nse"), "n_events")


def _skill_of(df: DataFrame) -> DataFrame:
    return metrics.skill(df, "model", "horizon_h", "split")


@query("ridge_forecast")
def ridge_forecast(spark: SparkSession, d: str) -> DataFrame:
    t = training(spark, d)
    x = features.predictor_columns(t)
    return _skill_of(models.fit_predict(t, x, "target_6h", models.ridge, "ridge", 6))


@query("forest_forecast")
def forest_forecast(spark: SparkSession, d: str) -> DataFrame:
    t = training(spark, d)
    return _skill_of(models.fit_predict(t, features.predictor_columns(t), "target_6h", lambda x: models.forest(x, 100), "forest", 6, cap=60_000))


@query("boosted_forecast")
def boosted_forecast(spark: SparkSession, d: str) -> DataFrame:
    t = training(spark, d)
    return _skill_of(models.fit_predict(t, features.predictor_columns(t), "target_6h", lambda x: models.boosted(x, 10, 4), "boosted", 6))


def _arima(spark: SparkSession, d: str, exog: tuple[str, ...]) -> DataFrame:
    from tidemark.operators.gaps import impute_gaps

    g = impute_gaps(binned(spark, d), 144).select("series_id", "ts", "value", F.month("ts").cast("double").alias("month"), events.chronological_split("ts", "2024-01-18 00:00:00", "2024-01-24 00:00:00").alias("split"))
    return models.arima_forecasts(g, "value", HORIZONS, exog=exog)


@query("arima_forecast")
def arima_forecast(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skill(_arima(spark, d, ()), "series_id", "model", "horizon_h", "split")


@query("arimax_forecast")
def arimax_forecast(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skill(_arima(spark, d, ("month",)), "series_id", "model", "horizon_h", "split")


@query("model_benchmark")
def model_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Six models at all horizons: a row for each split, and for each event of the test split (``event_id``)."""
    t = training(spark, d).persist(StorageLevel.MEMORY_AND_DISK)  # a dozen fits read it
    estimators = {"ridge": (models.ridge, None), "forest": (lambda x: models.forest(x, 100), 60_000), "boosted": (lambda x: models.boosted(x, 10, 4), None)}
    exog = ("click", "error", "purchase", "click_lag_6h", "purchase_cum_3h", "error_cum_3h", "lateral_q")
    p = models.benchmark(t, features.predictor_columns(t), "view", HORIZONS, estimators, exog, per_hour=1, arima_window=360)
    tested = _windows(spark).filter(events.chronological_split("start_ts", "2024-01-18 00:00:00", "2024-01-24 00:00:00") == "test")
    each = metrics.per_event(p.filter("split = 'test'"), tested, "model", "horizon_h", step=3_600_000_000).drop("obs_peak", "sim_peak").withColumn("split", F.lit("test"))
    return metrics.evaluation(p, (50.0, 80.0), "model", "horizon_h", "split").unionByName(each, allowMissingColumns=True)
