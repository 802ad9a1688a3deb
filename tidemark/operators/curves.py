"""Rating curves: piecewise sums of power terms, forward and inverse.

A curve table has ``station, direction, section_order, x0, x1, bases array<double>, exponents array<double>``; a NULL upper
end is open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import braced_list


def parse_curves(raw: DataFrame) -> DataFrame:
    """Curve table from its text form: ``NULL`` upper ends, ``{a,b}`` lists."""
    return raw.select(
        F.col("station_code").alias("station"), F.col("type").alias("direction"), F.col("section_order").cast("int").alias("section_order"), F.col("initial_x").try_cast("double").alias("x0"),
        F.when(F.upper(F.trim("final_x")) == "NULL", None).otherwise(F.col("final_x").try_cast("double")).alias("x1"), braced_list("bases").alias("bases"), braced_list("exponents").alias("exponents"),
    )


def power_sum(bases: Column, exponents: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(bases, exponents, lambda b, e: b * F.pow(x, e)), F.lit(0.0), lambda a, t: a + t)


def apply_curve(values: DataFrame, curves: DataFrame, out: str = "flow", x: str = "value", key: str = "series_id", direction: str = "meters_to_flow") -> DataFrame:
    """``out`` = value of the section [x0, x1) that holds ``x``; NULL outside all of them; of overlapping sections the one of
    the highest order counts.

    Curve tables are dimensions of a few sections per station: they travel as one array per station, so that each row
    stays one row.
    """
    sections = curves.filter(F.col("direction") == direction).groupBy(F.col("station").alias("__s")).agg(F.sort_array(F.collect_list(F.struct("section_order", "x0", "x1", "bases", "exponents"))).alias("__c"))
    v = F.col(x)
    joined = values.join(sections, F.col(key) == F.col("__s"), "left")
    hit = F.try_element_at(F.filter("__c", lambda c: (v >= c["x0"]) & (c["x1"].isNull() | (v < c["x1"]))), F.lit(-1))
    return joined.withColumn("__h", hit).withColumn(out, F.when(F.col("__h").isNotNull(), power_sum(F.col("__h.bases"), F.col("__h.exponents"), v))).drop("__s", "__c", "__h")


def inverse_samples(curves: DataFrame, low: float = 0.0, high: float = 5.0, n: int = 10_000) -> DataFrame:
    """``station, q, h, q_next, h_next``: the forward curve sampled at ``n`` levels, as brackets of rising order."""
    spark = curves.sparkSession
    stations = curves.filter("direction = 'meters_to_flow'").select(F.col("station").alias("series_id")).distinct()
    levels = stations.crossJoin(spark.range(n).select((F.lit(low) + F.col("id") * ((high - low) / (n - 1))).alias("value")))
    q = apply_curve(levels, curves).filter("flow is not null")
    w = Window.partitionBy("series_id").orderBy("value")
    return q.select(F.col("series_id").alias("station"), F.col("flow").alias("q"), F.col("value").alias("h"), F.lead("flow").over(w).alias("q_next"), F.lead("value").over(w).alias("h_next"))


def apply_inverse(values: DataFrame, curves: DataFrame, out: str = "level", x: str = "value", key: str = "series_id", n: int = 10_000) -> DataFrame:
    """Level for a flow: explicit inverse sections where a station has them, else linear between samples of the forward
    curve; NULL outside the sampled range. Samples must not fall: a curve that does is refused by ``check_rising``.

    The as-of search runs as one sort per station over values and samples together, without a range join.
    """
    explicit = curves.filter("direction = 'flow_to_meters'").select(F.col("station").alias("__e")).distinct()
    base = apply_curve(values, curves, "__given", x, key, "flow_to_meters").withColumn("__id", F.monotonically_increasing_id()).join(explicit, F.col(key) == F.col("__e"), "left")
    s = inverse_samples(curves, n=n)
    names = values.columns
    left = base.select(F.col(key).alias("__k"), F.col(x).alias("__q"), F.lit(1).alias("__side"), F.struct(*names, "__given", "__e").alias("__row"), F.lit(None).cast("struct<q:double,h:double,q2:double,h2:double>").alias("__p"))
    right = s.select(F.col("station").alias("__k"), F.col("q").alias("__q"), F.lit(0).alias("__side"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.struct("q", "h", F.col("q_next").alias("q2"), F.col("h_next").alias("h2")).alias("__p"))
    w = Window.partitionBy("__k").orderBy("__q", "__side", F.col("__p.h")).rowsBetween(Window.unboundedPreceding, 0)
    hit = left.unionByName(right).withColumn("__p", F.last("__p", True).over(w)).filter("__side = 1")
    p, q = F.col("__p"), F.col("__q")
    between = F.when(q == p["q"], p["h"]).when(q <= p["q2"], p["h"] + (p["h2"] - p["h"]) * (q - p["q"]) / (p["q2"] - p["q"]))
    level = F.when(F.col("__row.__e").isNotNull(), F.col("__row.__given")).otherwise(between)
    return hit.select(*[F.col(f"__row.{c}").alias(c) for c in names], level.alias(out))


def check_rising(curves: DataFrame, n: int = 1000) -> DataFrame:
    """Stations whose sampled forward curve falls somewhere, with the number of such steps."""
    return inverse_samples(curves, n=n).groupBy("station").agg(F.count_if(F.col("q_next") < F.col("q")).alias("n_falls")).filter("n_falls > 0")
