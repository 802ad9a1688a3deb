"""Forecast baselines: persistence, ridge, random forest, boosted trees, ARIMA with rolling origins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def persistence(table: DataFrame, current: str, horizons: tuple[int, ...], keys: tuple[str, ...] = ("ts", "split")) -> DataFrame:
    """Long predictions in which the level stays what it is now: obs is the level h hours ahead."""
    each = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon_h"), F.col(f"target_{h}h").alias("obs")) for h in horizons]))
    return table.select(*keys, F.lit("persistence").alias("model"), F.col(current).alias("sim"), each)


def subsample(table: DataFrame, cap: int, event: str = "event_id", seed: int = SEED) -> DataFrame:
    """All rows of events, and of the others those of the smallest hashes up to ``cap`` rows in all; the same rows each time.
    The cap is this operator's purpose: a bound on what a model is fitted on."""
    inside, others = table.filter(F.col(event).isNotNull()), table.filter(F.col(event).isNull())
    left = max(0, cap - inside.count())
    return inside.unionByName(others.orderBy(F.xxhash64("ts", F.lit(seed)), "ts").limit(left)) if left else inside


def _stages(predictors: list[str], estimator: Estimator) -> Pipeline:
    filled = [f"__{k}" for k in range(len(predictors))]
    return Pipeline(stages=[Imputer(inputCols=predictors, outputCols=filled, strategy="median", relativeError=0.0), VectorAssembler(inputCols=filled, outputCol="__features"), estimator])


def fit_predict(table: DataFrame, predictors: list[str], target: str, estimator: Estimator | Callable[[DataFrame], Estimator], model: str, horizon: int, cap: int | None = None, keys: tuple[str, ...] = ("ts", "split")) -> DataFrame:
    """Fits on the train split (medians fill NULLs, learnt there too; predictors without any value are left out) and
    predicts every row, in long form."""
    doubles = table.select(*keys, *(["event_id"] if "event_id" in table.columns else []), *[F.col(c).cast("double").alias(c) for c in predictors], F.col(target).cast("double").alias("__y"))
    train = doubles.filter("split = 'train' AND __y IS NOT NULL")
    if cap:
        train = subsample(train if "event_id" in train.columns else train.withColumn("event_id", F.lit(None).cast("long")), cap)
    counts = train.agg(*[F.count(c).alias(c) for c in predictors]).first()
    known = [c for c in predictors if counts[c]]
    est = estimator(train) if callable(estimator) and not isinstance(estimator, Estimator) else estimator
    fitted = _stages(known, est).fit(train)
    return fitted.transform(doubles).select(*keys, F.lit(model).alias("model"), F.lit(horizon).alias("horizon_h"), F.col("__y").alias("obs"), F.col("prediction").alias("sim"))


def ridge(train: DataFrame, alpha: float = 1.0) -> LinearRegression:
    """Ridge with penalty ``alpha`` on unscaled coefficients and a free intercept, by the normal equations."""
    r = train.agg(F.stddev_pop("__y").alias("s"), F.count("__y").alias("n")).first()
    return LinearRegression(featuresCol="__features", labelCol="__y", elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * (r["s"] or 1.0) / max(r["n"], 1))


def forest(_: DataFrame, trees: int = 100, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="__features", labelCol="__y", numTrees=trees, maxDepth=depth, seed=SEED)


def boosted(_: DataFrame, trees: int = 300, depth: int = 8, rate: float = 0.1) -> GBTRegressor:
    return GBTRegressor(featuresCol="__features", labelCol="__y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED)


def fourier(position: np.ndarray, period: int = 144, pairs: int = 3) -> np.ndarray:
    """Sine and cosine pairs of a daily cycle by row position."""
    phase = 2 * np.pi * (position % period) / period
    return np.stack([f(k * phase) for k in range(1, pairs + 1) for f in (np.sin, np.cos)], 1)


@dataclass(frozen=True)
class Arima:
    """ARIMA(p, 1, q) with external columns, fitted by conditional least squares; immutable and small."""

    p: int
    q: int
    beta: np.ndarray
    phi: np.ndarray
    theta: np.ndarray
    aic: float

    @classmethod
    def fit(cls, y: np.ndarray, x: np.ndarray | None, p: int, q: int) -> Arima:
        """Differences are regressed on differenced columns; the rest is an ARMA started from a long autoregression."""
        d = np.diff(y)
        beta = np.zeros(0)
        if x is not None and x.shape[1]:
            dx = np.diff(x, axis=0)
            beta = np.linalg.lstsq(dx, d, rcond=None)[0]
            d = d - dx @ beta
        m = min(max(20, 2 * (p + q)), max(1, len(d) // 4))
        lagged = lambda a, k: np.stack([a[k - j - 1 : len(a) - j - 1] for j in range(k)], 1) if k else np.zeros((len(a), 0))
        e = np.concatenate([np.zeros(m), d[m:] - lagged(d, m) @ np.linalg.lstsq(lagged(d, m), d[m:], rcond=None)[0]])
        k = max(p, q)
        for _ in range(3):
            design = np.concatenate([lagged(d, k)[:, :p], lagged(e, k)[:, :q]], 1) if k else np.zeros((len(d), 0))
            coef = np.linalg.lstsq(design[m:], d[k:][m:], rcond=None)[0]
            phi, theta = _stationary(coef[:p]), _shrunk(coef[p:])
            e = cls._residuals(d, phi, theta)
        s2 = max(float(np.mean(e[m:] ** 2)), 1e-300)
        return cls(p, q, beta, phi, theta, len(d) * np.log(s2) + 2 * (p + q + len(beta) + 1))

    @staticmethod
    def _residuals(d: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
        e = np.zeros(len(d))
        p, q = len(phi), len(theta)
        for t in range(len(d)):
            a = sum(phi[j] * d[t - 1 - j] for j in range(min(p, t)))
            b = sum(theta[j] * e[t - 1 - j] for j in range(min(q, t)))
            e[t] = d[t] - a - b
        return e

    def forecast(self, y: np.ndarray, x: np.ndarray | None, steps: int, future: np.ndarray | None = None) -> np.ndarray:
        """Levels ahead from a window of history; without ``future`` the external columns keep their last values."""
        d = np.diff(y)
        ahead = np.zeros(steps)
        if len(self.beta) and x is not None:
            d = d - np.diff(x, axis=0) @ self.beta
            if future is not None:
                ahead = np.diff(np.concatenate([x[-1:], future[:steps]]), axis=0) @ self.beta
        e = self._residuals(d, self.phi, self.theta)
        dd, ee = list(d), list(e)
        out = np.zeros(steps)
        for s in range(steps):
            v = sum(self.phi[j] * dd[-1 - j] for j in range(min(self.p, len(dd)))) + sum(self.theta[j] * ee[-1 - j] for j in range(min(self.q, len(ee))))
            dd.append(v)
            ee.append(0.0)
            out[s] = v
        return y[-1] + np.cumsum(out + ahead)


def _stationary(phi: np.ndarray, limit: float = 0.99) -> np.ndarray:
    """``phi`` with its roots drawn in to ``limit`` if one lies beyond, so that forecasts cannot grow without bound."""
    if not len(phi):
        return phi
    radius = np.abs(np.roots(np.concatenate([[1.0], -phi]))).max(initial=0.0)
    return phi * (limit / radius) ** np.arange(1, len(phi) + 1) if radius > limit else phi


def _shrunk(theta: np.ndarray) -> np.ndarray:
    total = np.abs(theta).sum()
    return theta * (0.95 / total) if total > 0.95 else theta


def select_order(y: np.ndarray, x: np.ndarray | None, orders: tuple[tuple[int, int], ...] = ((2, 1), (1, 1)), tail: int = 4380) -> tuple[int, int]:
    """The order of least AIC on the last ``tail`` rows."""
    return min(orders, key=lambda o: Arima.fit(y[-tail:], None if x is None else x[-tail:], *o).aic)


def arima_forecasts(
    table: DataFrame, value: str, horizons: tuple[int, ...], per_hour: int = 6, fit_rows: int = 20_000, window: int = 360, every: int = 144, steps: int = 288, exog: tuple[str, ...] = (), advance_fourier: bool = False,
    key: str = "series_id",
) -> DataFrame:
    """Rolling-origin forecasts of each series: the model is fitted on the last ``fit_rows`` train rows, then every ``every``
    rows of the later splits a forecast of ``steps`` rows starts from a window of ``window`` rows. A row's forecast for h
    hours ahead comes from the latest origin at or before it; NULL beyond the lead. External columns stay at their origin
    values, the daily cycle too unless ``advance_fourier``. Their NULLs become the median of the series' train rows (0 if it
    has none); the order is chosen without them.

    Fits and windows are grouped pandas; each row is sent to the few windows that hold it, so no group is longer than a window.
    """
    w = Window.partitionBy(key).orderBy("ts")
    rows = table.select(key, "ts", "split", F.col(value).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in exog], (F.row_number().over(w) - 1).alias("pos"))
    train_last = F.max(F.when(F.col("split") == "train", F.col("pos"))).over(Window.partitionBy(key))
    first_later = F.min(F.when(F.col("split") != "train", F.col("pos"))).over(Window.partitionBy(key))
    rows = rows.withColumn("t1", train_last).withColumn("o0", first_later).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    names = list(exog)
    if names:
        medians = rows.filter("split = 'train'").groupBy(key).agg(*[F.percentile(c, 0.5).alias(f"__{c}") for c in names])
        filled = [F.coalesce(c, f"__{c}", F.lit(0.0)).alias(c) for c in names]
        rows = rows.join(medians, key, "left").select(*[c for c in rows.columns if c not in names], *filled)

    def cycle(pos: np.ndarray) -> np.ndarray:
        return fourier(pos, 24 * per_hour)

    def columns(f: pd.DataFrame) -> np.ndarray:
        four = cycle(f["pos"].to_numpy())
        return np.concatenate([four, f[names].to_numpy()], 1) if names else four

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos").dropna(subset=["y"])
        if len(f) < 300:
            return pd.DataFrame({key: [], "model": []})
        y, x = f["y"].to_numpy(), columns(f)
        m = Arima.fit(y, x, *select_order(y, cycle(f["pos"].to_numpy())))
        return pd.DataFrame({key: [f[key].iloc[0]], "model": [[float(m.p), float(m.q), float(len(m.beta)), *m.beta, *m.phi, *m.theta]]})

    kind = table.schema[key].dataType.simpleString()
    models = rows.filter((F.col("split") == "train") & (F.col("pos") > F.col("t1") - fit_rows)).groupBy(key).applyInPandas(fit, f"{key} {kind}, model array<double>")
    rel = F.col("pos") - F.col("o0")
    origins = F.filter(F.sequence(F.greatest(F.lit(0), F.ceil(rel / every)), F.greatest(F.lit(0), F.floor((rel + window - 1) / every))), lambda o: (o * every >= rel) & (o * every - rel < window) & (o * every + F.col("o0") < F.col("n")))
    windows = rows.filter("o0 IS NOT NULL").withColumn("origin", F.explode(origins)).join(models, key)

    def forecast(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("pos")
        o = int(f["origin"].iloc[0]) * every + int(f["o0"].iloc[0])
        f = f[f["pos"] <= o].dropna(subset=["y"])
        empty = pd.DataFrame({key: [], "origin_pos": [], "lead": [], "sim": []})
        if len(f) < 288:
            return empty
        v = f["model"].iloc[0]
        p, q, nb = int(v[0]), int(v[1]), int(v[2])
        rest = np.array(v[3:])
        m = Arima(p, q, rest[:nb], rest[nb : nb + p], rest[nb + p :], 0.0)
        x = columns(f)
        future = None
        if advance_fourier:
            four = cycle(o + 1 + np.arange(steps))
            future = np.concatenate([four, np.repeat(x[-1:, four.shape[1] :], steps, 0)], 1)
        return pd.DataFrame({key: f[key].iloc[0], "origin_pos": o, "lead": np.arange(1, steps + 1), "sim": m.forecast(f["y"].to_numpy(), x, steps, future)})

    fc = windows.groupBy(key, "origin").applyInPandas(forecast, f"{key} {kind}, origin_pos long, lead int, sim double")
    ask = rows.filter("o0 IS NOT NULL AND split != 'train'").select(key, "ts", "split", "pos", (F.floor((F.col("pos") - F.col("o0")) / every) * every + F.col("o0")).alias("origin_pos"), F.explode(F.array(*map(F.lit, horizons))).alias("horizon_h"))
    ask = ask.withColumn("lead", (F.col("pos") + F.col("horizon_h") * per_hour - F.col("origin_pos")).cast("int"))
    truth = rows.select(key, (F.col("pos")).alias("__p"), F.col("y").alias("obs"))
    out = ask.join(fc, [key, "origin_pos", "lead"], "left").withColumn("__p", F.col("pos") + F.col("horizon_h") * per_hour).join(truth, [key, "__p"], "left")
    return out.select(key, "ts", "split", F.lit("arimax" if exog else "arima").alias("model"), "horizon_h", "obs", "sim")


def benchmark(
    table: DataFrame, predictors: list[str], current: str, horizons: tuple[int, ...], estimators: dict[str, tuple[Callable[[DataFrame], Estimator], int | None]], exog: tuple[str, ...] = (), per_hour: int = 6,
    arima_window: int = 8640,
) -> DataFrame:
    """Long predictions ``ts, split, model, horizon_h, obs, sim`` of one site's training table by persistence, each of
    ``estimators`` (name: estimator, cap of train rows), ARIMA and, with ``exog``, ARIMAX; ``obs`` is the table's target for all.

    The table is read again for each fit: hand over one that is written or persisted. Only the fits run at once; predictions
    stay lazy. ARIMA predicts no train rows.
    """
    keys = ("ts", "split")
    parts = [persistence(table, current, horizons, keys)]
    for name, (estimator, cap) in estimators.items():
        parts += [fit_predict(table, predictors, f"target_{h}h", estimator, name, h, cap, keys) for h in horizons]
    truth = parts[0].select("ts", "horizon_h", "obs")
    site = table.withColumn("__site", F.lit(0))
    for columns in ((), exog) if exog else ((),):
        got = arima_forecasts(site, current, horizons, per_hour, window=arima_window, every=24 * per_hour, steps=48 * per_hour, exog=columns, key="__site")
        parts.append(got.drop("__site", "obs").join(truth, ["ts", "horizon_h"]))
    return reduce(DataFrame.unionByName, parts).select(*keys, "model", "horizon_h", "obs", "sim")
