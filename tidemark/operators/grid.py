"""Uniform grids from irregular series: snapping, regridding, gap rules, quality and provenance.

The canonical table is long: ``series_id, ts, value, quality, data_type``; all series are regridded in one plan that
shuffles once by series and time bucket.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import DAY, HOUR, MINUTE, ceil_to, from_micros, micros, round_half_even

#: Length of the time buckets in which neighbours are searched, so that a long series is many tasks.
BUCKET = 30 * DAY


def snap_dedupe(obs: DataFrame, step: int = MINUTE, order: tuple[str, ...] = ()) -> DataFrame:
    """Timestamps to the nearest ``step`` (half-even), invalid ones dropped, first row of each (series, step) kept in order
    of raw time, then of ``order``."""
    raw = obs.filter(F.col("ts").isNotNull()).withColumn("raw_ts", F.col("ts")).withColumn("ts", round_half_even("ts", step))
    w = Window.partitionBy("series_id", "ts").orderBy("raw_ts", *order)
    return raw.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "raw_ts")


def clip(obs: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return obs.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def spine(series: DataFrame, start: datetime, end: datetime, step: int = 10 * MINUTE) -> DataFrame:
    """``series_id, ts`` at every step, both ends included, of each distinct series."""
    a, b = (micros(F.lit(t).cast("timestamp_ntz")) for t in (start, end))
    day = step * max(1, DAY // step)
    days = series.select("series_id").distinct().select("series_id", F.explode(F.sequence(a, b, F.lit(day))).alias("__d"))
    # Days first, so that no row holds a long grid and the days of a series are spread over tasks.
    steps = F.sequence(F.col("__d"), F.least(F.col("__d") + (day - step), b), F.lit(step))
    return days.repartition("series_id", "__d").select("series_id", F.explode(steps).alias("__t")).select("series_id", from_micros(F.col("__t")).alias("ts"))


def bounds(obs: DataFrame, step: int = HOUR) -> tuple[datetime, datetime]:
    """First and last time of a table, rounded outwards to whole steps; what a grid over all of its rows begins and ends
    with. Two numbers reach the driver; a table without times has the epoch as both."""
    r = obs.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.floor(micros("a") / F.lit(step)).alias("a"), F.ceil(micros("b") / F.lit(step)).alias("b")).first()
    return tuple(datetime(1970, 1, 1) + timedelta(microseconds=(x or 0) * step) for x in r)


def with_halo(grid: DataFrame, before: int, after: int = 0, bucket: int = BUCKET) -> DataFrame:
    """Rows under their time bucket ``__b``, and as guests (``__guest``) under its neighbours where they are within ``before``
    or ``after`` micros of them: windows of bounded reach can then run inside buckets, so a long series is many tasks."""
    bucket = max(bucket, before, after)  # a reach never goes beyond the neighbours
    t = micros("ts")
    b = F.floor(t / F.lit(bucket))
    nxt = F.when(t >= (b + 1) * bucket - before, b + 1)
    prev = F.when(t < b * bucket + after, b - 1)
    return grid.withColumn("__own", b).withColumn("__b", F.explode(F.array_compact(F.array(b, nxt, prev)))).withColumn("__guest", F.col("__b") != F.col("__own")).drop("__own")


def bracket(points: DataFrame, targets: DataFrame, value: str = "value", bucket: int = BUCKET, carried: str | None = None) -> DataFrame:
    """Targets with their nearest non-null points at or before (``pt, pv``) and at or after (``nt, nv``), times in micros; with
    ``carried``, another column of the points, also its last known value, under its name.

    Neighbours are searched inside time buckets of a series; a small table of each bucket's first and last point carries
    them across bucket borders, so no task has to hold a whole series.
    """
    names = {"v": value} | ({"o": carried} if carried else {})
    pts = points.filter(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names.values()]))
    pts = pts.select("series_id", micros("ts").alias("t"), *[F.col(c).alias(n) for n, c in names.items()], F.lit(0).alias("target"))
    tgt = targets.select("series_id", micros("ts").alias("t"), F.lit(1).alias("target"))
    # One shuffle by series and bucket serves both aggregations and the windows.
    dealt = pts.unionByName(tgt, allowMissingColumns=True).withColumn("b", F.floor(F.col("t") / F.lit(bucket))).repartition("series_id", "b")
    rows = dealt.groupBy("series_id", "b", "t").agg(*[F.max(c).alias(c) for c in ("v", "target", "o") if c in dealt.columns])
    point = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    edges = rows.groupBy("series_id", "b").agg(F.min(point).alias("lo"), F.max(point).alias("hi"), *([F.max_by("o", F.when(F.col("o").isNotNull(), F.col("t"))).alias("o")] if carried else []))
    # What follows is looked up in falling order, with a frame that grows by a row at a time: one that reaches to the end
    # of the partition would be evaluated anew for every row.
    wb, ws = Window.partitionBy("series_id"), Window.partitionBy("series_id", "b")
    past = lambda w, order, end: w.orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    last_o = lambda w, at: [F.last("o", True).over(at).alias(w)] if carried else []
    edges = edges.select("series_id", "b", F.last("hi", True).over(past(wb, F.asc("b"), -1)).alias("before"), F.last("lo", True).over(past(wb, F.desc("b"), -1)).alias("after"), *last_o("o_before", past(wb, F.asc("b"), -1)))
    up = past(ws, F.asc("t"), 0)
    near = rows.select("*", F.last(point, True).over(up).alias("p"), *last_o("o_here", up)).withColumn("n", F.last(point, True).over(past(ws, F.desc("t"), 0)))
    out = near.filter("target = 1").join(edges, ["series_id", "b"])
    p, n = F.coalesce("p", "before"), F.coalesce("n", "after")
    also = [F.coalesce("o_here", "o_before").alias(carried)] if carried else []
    return out.select("series_id", from_micros(F.col("t")).alias("ts"), F.col("t"), p["t"].alias("pt"), p["v"].alias("pv"), n["t"].alias("nt"), n["v"].alias("nv"), *also)


def linear(t: str = "t", pt: str = "pt", pv: str = "pv", nt: str = "nt", nv: str = "nv") -> Column:
    """Time-linear value between the neighbours, constant beyond the ends."""
    a, b = F.col(pt), F.col(nt)
    between = F.when(b > a, F.col(pv) + (F.col(nv) - F.col(pv)) * ((F.col(t) - a) / (b - a)))
    return F.coalesce(between, F.col(pv), F.col(nv))


def within_gap(max_gap: int) -> Column:
    """True where either neighbour is within ``max_gap``; a gap of up to twice as long is so filled, and the flanks of
    longer ones."""
    return F.coalesce(F.col("nt") - F.col("t") <= max_gap, F.lit(False)) | F.coalesce(F.col("t") - F.col("pt") <= max_gap, F.lit(False))


def regrid_linear(obs: DataFrame, start: datetime, end: datetime, step: int = 10 * MINUTE, max_gap: int = 3 * HOUR, method: str = "linear") -> DataFrame:
    """Instantaneous variables on the grid. ``method='mean'`` averages the readings of each step instead."""
    source = clip(obs, start, end)
    grid = spine(obs, start, end, step)
    if method == "mean":
        means = source.groupBy("series_id", ceil_to("ts", step).alias("ts")).agg(F.avg("value").alias("value"))
        return grid.join(means, ["series_id", "ts"], "left").select("series_id", "ts", "value")
    return bracket(source, grid).select("series_id", "ts", F.when(within_gap(max_gap), linear()).alias("value"))


def regrid_cumulative(obs: DataFrame, start: datetime, end: datetime, step: int = 10 * MINUTE, max_gap: int = 3 * HOUR) -> DataFrame:
    """Increments on the grid, mass-conserving: the running sum is interpolated and differenced. The first cell holds its
    running sum; after the last reading increments are 0; the gap rule comes last. Sums run inside time buckets, onto which
    the sums of the buckets before are added; differences look one step back across bucket borders."""
    source = clip(obs, start, end).filter(F.col("value").isNotNull()).groupBy("series_id", "ts").agg(F.sum("value").alias("value"))
    cum = bracket(running_sum(source, "value"), spine(obs, start, end, step))
    return _increments(cum.select("series_id", "ts", linear().alias("c"), within_gap(max_gap).alias("keep")), step).select("series_id", "ts", "value")


def _increments(cum: DataFrame, step: int) -> DataFrame:
    """Adds ``value``: what the running sum ``c`` grew by since the step before, the sum itself in the first cell; NULL where
    not ``keep``. All steps must be there."""
    w = Window.partitionBy("series_id", "__b").orderBy("ts")
    d = F.coalesce(F.col("c") - F.lag("c").over(w), F.col("c"))
    return with_halo(cum, step).withColumn("value", F.when(F.col("keep"), d)).filter("NOT __guest").drop("__b", "__guest")


def running_sum(df: DataFrame, value: str, bucket: int = BUCKET) -> DataFrame:
    """``value`` as its running sum along each series, NULL counting as 0, by time buckets: a small table of their sums carries
    across borders."""
    rows = df.withColumn("__b", F.floor(micros("ts") / F.lit(bucket))).repartition("series_id", "__b")
    inside = F.sum(value).over(Window.partitionBy("series_id", "__b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("__s").over(Window.partitionBy("series_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("series_id", "__b").agg(F.sum(value).alias("__s")).select("series_id", "__b", F.coalesce(before, F.lit(0)).alias("__s"))
    return rows.withColumn(value, inside).join(sums, ["series_id", "__b"]).withColumn(value, F.coalesce(value, F.lit(0)) + F.col("__s")).drop("__b", "__s")


def quality_on_grid(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """Last known quality flag at or before each grid time."""
    return bracket(obs, grid, "quality").select("series_id", "ts", F.col("pv").cast("int").alias("quality"))


def asof_backward(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: int | None = None) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before its ``ts``, by ``key``; columns ``asof_ts`` and
    ``asof_value``. One sort per key; equal times count as before."""
    names = left.columns
    a = left.select(F.col(key).alias("__k"), micros("ts").alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.filter(F.col(value).isNotNull()).select(F.col(key).alias("__k"), micros("ts").alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy("__k").orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    hit = a.unionByName(b).withColumn("__p", F.last(F.when(F.col("__side") == 0, F.struct("__t", "__v")), True).over(w)).filter("__side = 1")
    if tolerance is not None:
        hit = hit.withColumn("__p", F.when(F.col("__t") - F.col("__p.__t") <= tolerance, F.col("__p")))
    return hit.select("__row.*", from_micros(F.col("__p.__t")).alias("asof_ts"), F.col("__p.__v").alias("asof_value"))


def disaggregate(coarse: DataFrame, donors: DataFrame, fine: DataFrame, span: int = HOUR) -> DataFrame:
    """Coarse totals at H, covering (H - span, H], shared out over the fine cells by a donor's pattern.

    ``donors(ts, d1, d2)``: the first donor with at least two values in the span gives the pattern; if its sum is not
    positive the total is shared out evenly, as it is without a donor.
    """
    cells = fine.select("series_id", "ts").withColumn("H", ceil_to("ts", span)).join(donors, "ts", "left")
    joined = cells.join(coarse.select("series_id", F.col("ts").alias("H"), F.col("value").alias("total")), ["series_id", "H"])
    w = Window.partitionBy("series_id", "H")
    s = {d: F.sum(F.coalesce(F.col(d), F.lit(0.0))).over(w) for d in ("d1", "d2")}
    n = {d: F.count(d).over(w) for d in ("d1", "d2")}
    wide = joined.select("*", s["d1"].alias("s1"), s["d2"].alias("s2"), n["d1"].alias("n1"), n["d2"].alias("n2"), F.count(F.lit(1)).over(w).alias("n"))
    even = F.col("total") / F.col("n")
    share = lambda d, k: F.when(F.col(f"s{k}") > 0, F.col("total") * F.coalesce(F.col(d), F.lit(0.0)) / F.col(f"s{k}")).otherwise(even)
    return wide.select("series_id", "ts", F.when(F.col("n1") >= 2, share("d1", 1)).when(F.col("n2") >= 2, share("d2", 2)).otherwise(even).alias("value"))


def right_closed_sum(obs: DataFrame, span: int = HOUR) -> DataFrame:
    """Sums over (H - span, H], labelled H; all NULL gives 0."""
    return obs.groupBy("series_id", ceil_to("ts", span).alias("ts")).agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))


def mass_check(fine: DataFrame, coarse: DataFrame, span: int = HOUR) -> DataFrame:
    """Per series: cells compared, largest and mean absolute difference between re-summed fine and coarse values."""
    both = right_closed_sum(fine, span).withColumnRenamed("value", "fine").join(coarse.filter("value is not null").select("series_id", "ts", F.col("value").alias("coarse")), ["series_id", "ts"])
    d = F.abs(F.col("fine") - F.col("coarse"))
    return both.groupBy("series_id").agg(F.count("*").alias("n"), F.max(d).alias("max_abs"), F.avg(d).alias("mean_abs"))


def with_provenance(grid: DataFrame, labels: dict[str, str] | None = None, default: str = "observed", filled: Column | None = None) -> DataFrame:
    """``data_type``: the series' constant label, ``imputed`` where ``filled``."""
    label = F.lit(default)
    for k, v in (labels or {}).items():
        label = F.when(F.col("series_id") == k, v).otherwise(label)
    return grid.withColumn("data_type", F.when(F.coalesce(filled, F.lit(False)), "imputed").otherwise(label) if filled is not None else label)


def build_grid(obs: DataFrame, kinds: dict[str, str], start: datetime, end: datetime, step: int = 10 * MINUTE, max_gap: int = 3 * HOUR, good: Column | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """The whole grid in long form: each series by its kind (``instant`` or ``cumulative``), quality and provenance beside
    the value. ``good`` is a predicate on observations; where it fails the value is taken out but the time stays. Series of
    both kinds, and their quality, find their neighbours in one pass."""
    if good is not None:
        obs = obs.withColumn("value", F.when(good, F.col("value")))
    snapped = snap_dedupe(obs)
    instant = [s for s, k in kinds.items() if k == "instant"]
    source = clip(snapped, start, end).filter(F.col("series_id").isin(*kinds)).select("series_id", "ts", "value", "quality")
    summed = running_sum(source.withColumn("run", F.when(~F.col("series_id").isin(instant), F.col("value"))), "run")
    points = summed.withColumn("value", F.when(F.col("series_id").isin(instant), F.col("value")).when(F.col("value").isNotNull(), F.col("run")))
    near = bracket(points, spine(obs.filter(F.col("series_id").isin(*kinds)), start, end, step), carried="quality")
    cells = near.select("series_id", "ts", linear().alias("c"), within_gap(max_gap).alias("keep"), F.col("quality").cast("int").alias("quality"))
    parts = _increments(cells, step).withColumn("value", F.when(~F.col("series_id").isin(instant), F.col("value")).when(F.col("keep"), F.col("c")))
    return with_provenance(parts, labels).select("series_id", "ts", "value", "quality", "data_type")


def wide(grid: DataFrame, series: list[str], value: str = "value") -> DataFrame:
    """One column per series; the list of series is given, so no extra job looks for it."""
    return grid.groupBy("ts").pivot("series_id", series).agg(F.first(value))


def measurements(wide_grid: DataFrame, stations: dict[str, tuple[str, str]], qualities: dict[str, str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Long table of a wide grid: ``ts, station, variable, value, quality, data_type``. ``stations`` maps a value column to
    station and variable; quality and type columns are looked up beside it, without a join."""
    qualities, types = qualities or {}, types or {}
    rows = [
        F.struct(F.lit(s).alias("station"), F.lit(v).alias("variable"), F.col(c).cast("double").alias("value"), (F.col(qualities[c]).cast("int") if c in qualities else F.lit(None).cast("int")).alias("quality"), F.coalesce(F.col(types[c]), F.lit("observed")).alias("data_type") if c in types else F.lit("observed").alias("data_type"))
        for c, (s, v) in stations.items()
    ]
    return wide_grid.select("ts", F.inline(F.array(*rows)))


