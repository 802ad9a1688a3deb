"""Statistics: lagged correlation, robust spread, climatologies, calendar sums, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, HOUR, MINUTE, floor_to, micros


def safe_corr(x: str, y: str) -> Column:
    """Pearson correlation of pairs where both are known; NULL without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def cross_correlation(x: DataFrame, y: DataFrame, lags: range, step: int = 10 * MINUTE, pairs: DataFrame | None = None) -> DataFrame:
    """``x_id, y_id, lag, r, n``: correlation of x(t) with y(t + lag steps), of each x series with each y series, or of those
    that ``pairs`` (``x_id, y_id``) names. Lags are exploded on ``x``, which should be the side of fewer rows, and meet the
    other in one equi-join and one aggregation."""
    a = x.filter("value is not null").select(F.col("series_id").alias("x_id"), F.floor(micros("ts") / F.lit(step)).alias("i"), F.col("value").alias("x"), F.explode(F.sequence(F.lit(lags.start), F.lit(lags[-1]), F.lit(lags.step))).alias("lag"))
    b = y.filter("value is not null").select(F.col("series_id").alias("y_id"), F.floor(micros("ts") / F.lit(step)).alias("j"), F.col("value").alias("y"))
    a = a.withColumn("j", F.col("i") + F.col("lag"))
    met = a.join(b, "j") if pairs is None else a.join(pairs.select("x_id", "y_id").distinct(), "x_id").join(b, ["y_id", "j"])
    return met.groupBy("x_id", "y_id", "lag").agg(safe_corr("x", "y").alias("r"), F.count("*").alias("n"))


def best_lag(ccf: DataFrame) -> DataFrame:
    """Per pair the lag of the largest correlation (the first of ties) and the correlation at lag 0."""
    return ccf.filter("r is not null").groupBy("x_id", "y_id").agg(F.min_by(F.struct("lag", "r"), F.struct(-F.col("r"), "lag")).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("r0")).select("x_id", "y_id", F.col("b.lag").alias("best_lag"), F.col("b.r").alias("best_r"), "r0")


def mad(df: DataFrame, value: str = "value", key: str = "series_id") -> DataFrame:
    """Median and median absolute deviation."""
    m = df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.percentile(value, 0.5).alias("median"))
    return df.join(m, key).groupBy(key).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))


def variation(df: DataFrame, value: str = "value", key: str = "series_id") -> DataFrame:
    """Coefficient of variation with the sample deviation."""
    return df.groupBy(key).agg((F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"))


def calendar_sum(df: DataFrame, span: int = DAY, value: str = "value") -> DataFrame:
    """Left-closed sums per calendar span; NULL if all are NULL."""
    return df.groupBy("series_id", floor_to("ts", span).alias("ts")).agg(F.sum(value).alias("value"))


def calendar_mean(df: DataFrame, span: int = HOUR, value: str = "value") -> DataFrame:
    return df.groupBy("series_id", floor_to("ts", span).alias("ts")).agg(F.avg(value).alias("value"))


def complete_month_means(daily: DataFrame, min_days: int = 25) -> DataFrame:
    """Month-of-year means of monthly sums, over months with ``min_days`` or more daily values."""
    m = daily.groupBy("series_id", F.date_trunc("month", "ts").alias("m")).agg(F.sum("value").alias("s"), F.count("value").alias("n")).filter(F.col("n") >= min_days)
    return m.groupBy("series_id", F.month("m").alias("month")).agg(F.avg("s").alias("mean_sum"), F.count("*").alias("n_months"))


def month_climatology(df: DataFrame, q: float = 0.9, value: str = "value") -> DataFrame:
    """Month-of-year mean and quantile (linear between ranks)."""
    return df.groupBy("series_id", F.month("ts").alias("month")).agg(F.avg(value).alias("mean"), F.percentile(value, q).alias("quantile"))


def log_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in ``bins`` log-spaced bins of [10**low, 10**high); others are left out."""
    b = F.width_bucket(F.log10(F.col(value)), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.filter(F.col(value) > 0).select(b.alias("bin")).filter(F.col("bin").between(1, bins)).groupBy("bin").agg(F.count("*").alias("n"))


def dry_share(df: DataFrame, limit: float = 0.01, value: str = "value") -> DataFrame:
    """Percent of valid rows at or below ``limit``, one decimal."""
    return df.groupBy("series_id").agg(F.round(100.0 * F.count_if(F.col(value) <= limit) / F.nullif(F.count(value), F.lit(0)), 1).alias("dry_pct"))


def areal_mean(daily: DataFrame) -> DataFrame:
    """Mean over series of each day's value; NULLs are left out."""
    return daily.groupBy("ts").agg(F.avg("value").alias("value"))


def null_rate_change(before: DataFrame, after: DataFrame, cut: str) -> DataFrame:
    """Per series: NULL rates of two grids from ``cut`` on, and their difference."""
    t = F.lit(cut).cast("timestamp_ntz")
    rate = lambda d, n: d.filter(F.col("ts") >= t).groupBy("series_id").agg(F.avg(F.col("value").isNull().cast("double")).alias(n))
    return rate(before, "null_before").join(rate(after, "null_after"), "series_id", "full").withColumn("recovered", F.col("null_before") - F.col("null_after"))


def _average_ranks(both: DataFrame, c: str) -> DataFrame:
    """``c, r<c>``: the average rank of each distinct value. Values are ranked inside range buckets, to which the numbers of
    rows below them, one for each bucket, are added; so no task has to order everything."""
    n = both.groupBy(c).agg(F.count("*").alias("n"))
    k = 4 * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(n.agg(F.percentile_approx(c, [i / k for i in range(1, k)], 10 * k)).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, borders)), lambda x: x < F.col(c))) if borders else F.lit(0)
    n = n.withColumn("b", bucket)
    sums = n.groupBy("b").agg(F.sum("n").alias("s"))
    below = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inside = F.sum("n").over(Window.partitionBy("b").orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
    ranked = n.withColumn("before", F.coalesce(inside, F.lit(0))).join(F.broadcast(below), "b")  # a row for each bucket
    return ranked.select(c, (F.col("below") + F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks on ties."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return both.join(_average_ranks(both, "x"), "x").join(_average_ranks(both, "y"), "y").agg(safe_corr("rx", "ry").alias("rho"))
