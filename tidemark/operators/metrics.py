"""Forecast verification as grouped aggregates over long predictions ``..., obs, sim``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import HOUR, micros
from tidemark.operators.stats import safe_corr


def _pairs(df: DataFrame) -> DataFrame:
    return df.filter(F.col("obs").isNotNull() & F.col("sim").isNotNull())


def nse() -> Column:
    """1 - sum of squared errors over the observations' squares about their mean; NULL with fewer than 2 pairs or no variance."""
    v = F.var_pop("obs") * F.count("obs")
    return F.when((F.count("obs") >= 2) & (F.stddev_pop("obs") > 0), 1 - F.sum(F.pow(F.col("obs") - F.col("sim"), 2)) / F.nullif(v, F.lit(0.0)))


def kge() -> Column:
    so, ss, mo = F.stddev_pop("obs"), F.stddev_pop("sim"), F.nullif(F.avg("obs"), F.lit(0.0))
    r = safe_corr("obs", "sim")
    value = 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(ss / F.nullif(so, F.lit(0.0)) - 1, 2) + F.pow(F.avg("sim") / mo - 1, 2))
    return F.when((F.count("obs") >= 2) & (so > 0) & (ss > 0), value)


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("obs") - F.col("sim"), 2)))


def mae() -> Column:
    return F.avg(F.abs(F.col("obs") - F.col("sim")))


def pbias() -> Column:
    return 100 * F.sum(F.col("sim") - F.col("obs")) / F.nullif(F.sum("obs"), F.lit(0.0))


def skill(df: DataFrame, *keys: str) -> DataFrame:
    return _pairs(df).groupBy(*keys).agg(F.count("*").alias("n"), nse().alias("nse"), kge().alias("kge"), rmse().alias("rmse"), mae().alias("mae"), pbias().alias("pbias"))


def peak_errors(df: DataFrame, *keys: str) -> DataFrame:
    """Largest simulated less largest observed value, and the hours between their times; the first of equal values counts."""
    at = lambda c: F.min_by(F.struct("ts", c), F.struct(-F.col(c), "ts"))
    p = _pairs(df).groupBy(*keys).agg(at("obs").alias("o"), at("sim").alias("s"))
    return p.select(*keys, (F.col("s.sim") - F.col("o.obs")).alias("peak_mag_err"), ((micros(F.col("s.ts")) - micros(F.col("o.ts"))) / float(HOUR)).alias("peak_time_err_h"), F.col("o.obs").alias("obs_peak"), F.col("s.sim").alias("sim_peak"))


def threshold_scores(df: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Hits, misses and false alarms above ``threshold``; POD, FAR and CSI, each NULL without a denominator."""
    o, s = F.col("obs") > threshold, F.col("sim") > threshold
    c = _pairs(df).groupBy(*keys).agg(F.count_if(o & s).alias("hits"), F.count_if(o & ~s).alias("misses"), F.count_if(~o & s).alias("false_alarms"))
    ratio = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    h, m, f = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return c.select("*", ratio("hits", h + m).alias("pod"), ratio("false_alarms", h + f).alias("far"), ratio("hits", h + m + f).alias("csi"))


def evaluation(df: DataFrame, thresholds: tuple[float, ...], *keys: str) -> DataFrame:
    """Skill, peak errors and the scores of each threshold (``pod_<t>``, ``far_<t>``, ``csi_<t>``), in one pass over the predictions."""
    at = lambda c: F.min_by(F.struct("ts", c), F.struct(-F.col(c), "ts"))
    counts = []
    for k, t in enumerate(thresholds):
        o, s = F.col("obs") > t, F.col("sim") > t
        counts += [F.count_if(o & s).alias(f"__h{k}"), F.count_if(o & ~s).alias(f"__m{k}"), F.count_if(~o & s).alias(f"__f{k}")]
    basic = [F.count("*").alias("n"), nse().alias("nse"), kge().alias("kge"), rmse().alias("rmse"), mae().alias("mae"), pbias().alias("pbias")]
    g = _pairs(df).groupBy(*keys).agg(*basic, at("obs").alias("__o"), at("sim").alias("__s"), *counts)
    scores = []
    for k, t in enumerate(thresholds):
        h, m, f = (F.col(f"__{c}{k}") for c in "hmf")
        for name, of in (("pod", h + m), ("far", h + f), ("csi", h + m + f)):
            scores.append(((f if name == "far" else h) / F.nullif(of, F.lit(0))).alias(f"{name}_{t:g}"))
    hours = (micros(F.col("__s.ts")) - micros(F.col("__o.ts"))) / float(HOUR)
    return g.select(*keys, "n", "nse", "kge", "rmse", "mae", "pbias", (F.col("__s.sim") - F.col("__o.obs")).alias("peak_mag_err"), hours.alias("peak_time_err_h"), *scores)


def per_event(df: DataFrame, events: DataFrame, *keys: str, step: int = 600_000_000, shift_h: str | None = None) -> DataFrame:
    """Metrics inside event windows; events with fewer than 2 pairs are left out. Windows are in issue time; ``shift_h``
    names a column of hours that moves predictions to their valid time first. Windows are spread over grid positions and
    joined on equal keys."""
    t = micros("ts") + (F.col(shift_h) * HOUR if shift_h else F.lit(0))
    rows = _pairs(df).withColumn("idx", F.floor(t / F.lit(step)))
    spread = events.select("event_id", F.explode(F.sequence(F.ceil(micros("start_ts") / F.lit(step)), F.floor(micros("end_ts") / F.lit(step)))).alias("idx"))
    inside = rows.join(spread, "idx")
    group = [*keys, "event_id"]
    basic = inside.groupBy(*group).agg(F.count("*").alias("n"), nse().alias("nse"), rmse().alias("rmse")).filter("n >= 2")
    return basic.join(peak_errors(inside, *group), group)


def skill_pivot(summary: DataFrame, horizons: list[int], value: str = "nse") -> DataFrame:
    return summary.groupBy("model").pivot("horizon_h", horizons).agg(F.first(value))


def median_event_skill(events: DataFrame) -> DataFrame:
    return events.groupBy("model", "horizon_h").agg(F.percentile("nse", 0.5).alias("median_nse"), F.count("*").alias("n_events"))


def by_period(df: DataFrame, cut: str, *keys: str) -> DataFrame:
    """Skill over all rows, and before and from a cut date."""
    t = F.lit(cut).cast("timestamp_ntz")
    labels = F.explode(F.array(F.lit("full"), F.when(F.col("ts") < t, "before").otherwise("after"))).alias("period")
    return skill(df.select("*", labels), *keys, "period")
