"""Event segmentation on uniform grids: peaks over threshold, rain events by dry time, level rises; rows by nearest peak.

Grids have ``series_id, ts`` and values at every step. Positions are whole steps since the epoch, so no global numbering is
needed; searches around an event explode its bounded range of positions and meet the grid in an equi-join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import DAY, HOUR, MINUTE, ceil_to, floor_to, hydro_year, micros, season
from tidemark.operators.gaps import gap_overlaps, islands
from tidemark.operators.grid import BUCKET, with_halo

STEP = 10 * MINUTE


def with_position(grid: DataFrame, step: int = STEP) -> DataFrame:
    return grid.withColumn("idx", F.floor(micros("ts") / F.lit(step)).cast("long"))


def _at(events: DataFrame, lo: Column, hi: Column, grid: DataFrame, *cols: str) -> DataFrame:
    """Each event with the grid rows of positions lo to hi."""
    spread = events.withColumn("idx", F.explode(F.sequence(lo, hi)))
    return spread.join(grid.select("series_id", "idx", *cols), ["series_id", "idx"])


def detect_pot(
    grid: DataFrame, peak: float = 0.2, start: float = 0.05, end: float = 0.05, core_gap: int = 18, inter_event: int = 36, max_core: int = 432, lookback: int = 72, lookahead: int = 144,
    quiet: int = 6, min_level: float = 0.10, rains: tuple[str, ...] = (), splits: tuple[str, str] | None = None, step: int = STEP,
) -> DataFrame:
    """Events of discharge ``q`` with level ``h``: one row each with positions, times, peak, duration, rain and split.

    Exceedances closer than ``core_gap`` or ``inter_event`` steps are one core, cut at ``max_core`` steps. It is extended
    back while q stays above ``start`` (``lookback`` at most), and forward to the first run of ``quiet`` steps at or below
    ``end`` within ``lookahead`` (else that far). Events with the same peak are merged; peaks below ``min_level`` go. NULL
    compares as neither above nor below. Of equal peak values the first counts.
    """
    g = with_position(grid, step)
    by = Window.partitionBy("series_id").orderBy("idx")
    low = F.when(~F.coalesce(F.col("q") > start, F.lit(False)), F.col("idx"))
    calm = F.sum(F.when(F.col("q") <= end, 1).otherwise(0)).over(by.rowsBetween(-(quiet - 1), 0)) == quiet
    marks = g.select(
        "series_id", "idx", "q", F.last(low, True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("last_low"), calm.alias("calm"),
        F.min("idx").over(Window.partitionBy("series_id")).alias("i_min"), F.max("idx").over(Window.partitionBy("series_id")).alias("i_max"),
    )
    # The next calm run, looked up in falling order: a frame to the end of the series would be evaluated anew for every row.
    falling = Window.partitionBy("series_id").orderBy(F.desc("idx"))
    marks = marks.withColumn("next_calm", F.last(F.when(F.col("calm"), F.col("idx")), True).over(falling.rowsBetween(Window.unboundedPreceding, 0)))
    # A grid has every step, so a position so many steps ahead is a row so many rows ahead.
    marks = marks.withColumn("calm_last", F.lead("next_calm", quiet).over(by)).withColumn("calm_cut", F.lead("next_calm", max_core + quiet).over(by))
    above = marks.filter(F.col("q") > peak)
    new = F.when(F.col("idx") - F.lag("idx").over(by) <= max(core_gap, inter_event) - 1, 0).otherwise(1)
    cores = above.withColumn("__n", new).withColumn("core", F.sum("__n").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    e = cores.groupBy("series_id", "core").agg(
        F.min("idx").alias("g0"), F.max("idx").alias("g1"), F.min("i_min").alias("i_min"), F.max("i_max").alias("i_max"), F.min_by("last_low", "idx").alias("last_low"), F.max_by("calm_last", "idx").alias("calm_last"), F.min_by("calm_cut", "idx").alias("calm_cut")
    )
    e = e.withColumn("next_calm", F.when(F.col("g1") > F.col("g0") + max_core, F.col("calm_cut")).otherwise(F.col("calm_last"))).withColumn("g1", F.least("g1", F.col("g0") + max_core))
    limit = F.least("i_max", F.col("g1") + lookahead)
    e = e.select(
        "series_id", "g0", F.greatest(F.col("g0") - lookback, F.col("last_low") + 1, "i_min").alias("i0"), F.when(F.col("next_calm") <= limit, F.col("next_calm") - (quiet - 1)).otherwise(limit).alias("i1")
    )
    best = _at(e, F.col("i0"), F.col("i1"), g, "q", "h").filter("q is not null").groupBy("series_id", "g0", "i0", "i1").agg(F.min_by(F.struct("idx", "q", "h"), F.struct(-F.col("q"), "idx")).alias("p"))
    merged = best.groupBy("series_id", F.col("p.idx").alias("peak_idx")).agg(F.min("g0").alias("g0"), F.min("i0").alias("start_idx"), F.max("i1").alias("end_idx"), F.max(F.bround("p.q", 4)).alias("peak_q"), F.max(F.bround("p.h", 4)).alias("peak_h"))
    kept = merged.filter(F.col("peak_h") >= min_level) if min_level > 0 else merged
    kept = kept.withColumn("event_id", F.row_number().over(Window.partitionBy("series_id").orderBy("g0")))
    ts = lambda i: F.timestamp_micros((F.col(i) * step).cast("long")).cast("timestamp_ntz")
    out = kept.select("series_id", "event_id", "start_idx", "peak_idx", "end_idx", ts("start_idx").alias("start_ts"), ts("peak_idx").alias("peak_ts"), ts("end_idx").alias("end_ts"), "peak_q", "peak_h", F.round((F.col("end_idx") - F.col("start_idx")) * (step / HOUR), 2).alias("duration_h"))
    if rains:
        rows = _at(out.select("series_id", "event_id", "start_idx", "end_idx"), F.col("start_idx"), F.col("end_idx"), g, "ts", *rains)
        hourly = rows.groupBy("series_id", "event_id", ceil_to("ts", HOUR).alias("hour")).agg(*[F.coalesce(F.sum(r), F.lit(0.0)).alias(r) for r in rains])
        most = F.greatest(*[F.col(r) for r in rains]) if len(rains) > 1 else F.col(rains[0])
        wet = hourly.groupBy("series_id", "event_id").agg(F.round(F.sum(sum([F.col(r) for r in rains], F.lit(0.0))), 4).alias("acc_precip"), F.round(F.greatest(F.max(most), F.lit(0.0)), 4).alias("max_intensity"))
        out = out.join(wet, ["series_id", "event_id"], "left")
    return out.withColumn("split", chronological_split("peak_ts", *splits)) if splits else out


def chronological_split(ts: Column | str, train_end: str = "2020-12-31 00:00:00", validation_end: str = "2022-06-30 00:00:00") -> Column:
    """Up to ``train_end`` (that instant included) train, up to ``validation_end`` validation, later test."""
    t = F.col(ts) if isinstance(ts, str) else ts
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return F.when(t <= at(train_end), "train").when(t <= at(validation_end), "validation").otherwise("test")


def assign_rows(grid: DataFrame, events: DataFrame, step: int = STEP) -> DataFrame:
    """``event_id`` for each grid row: of the events whose window holds it the one of the nearest peak, the earlier of ties."""
    spread = events.select("series_id", "event_id", "peak_idx", F.explode(F.sequence("start_idx", "end_idx")).alias("idx"))
    best = spread.groupBy("series_id", "idx").agg(F.min(F.struct(F.abs(F.col("idx") - F.col("peak_idx")).alias("d"), "event_id")).alias("b"))
    return with_position(grid, step).join(best.select("series_id", "idx", F.col("b.event_id").alias("event_id")), ["series_id", "idx"], "left").drop("idx")


def rain_events(p: DataFrame, ietd: tuple[int, ...] = (6,), wet: float = 0.2) -> DataFrame:
    """Wet rows (value of at least ``wet``) no more than ``ietd`` hours apart are one event; one set of events for each
    ``ietd``. Depth sums all values between its first and last wet row; series with fewer than two wet rows have none."""
    spans = F.explode(F.array(*[F.lit(int(h)) for h in ietd])).alias("ietd_h")
    rows = p.filter("value is not null").select("series_id", "ts", "value", spans)
    w = Window.partitionBy("series_id", "ietd_h").orderBy("ts")
    wet_ts = F.when(F.col("value") >= wet, F.col("ts"))
    rows = rows.withColumn("wet_ts", wet_ts).withColumn("prev", F.last("wet_ts", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("wet_ts").isNotNull() & (F.col("prev").isNull() | (micros("wet_ts") - micros("prev") > F.col("ietd_h") * F.lit(HOUR))), 1).otherwise(0)
    rows = rows.withColumn("__n", new).withColumn("ev", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("wets", F.count("wet_ts").over(Window.partitionBy("series_id", "ietd_h")))
    inside = rows.filter("ev > 0 AND wets >= 2").withColumn("end", F.max("wet_ts").over(Window.partitionBy("series_id", "ietd_h", "ev"))).filter("ts <= end")
    hourly = inside.groupBy("series_id", "ietd_h", "ev", floor_to("ts", HOUR).alias("hour")).agg(F.sum("value").alias("v"), F.min("ts").alias("t0"), F.max("end").alias("end"))
    e = hourly.groupBy("series_id", "ietd_h", "ev").agg(F.min("t0").alias("start"), F.max("end").alias("end"), F.sum("v").alias("depth"), F.max("v").alias("max_1h"))
    return e.select("series_id", "ietd_h", "start", "end", "depth", ((micros("end") - micros("start")) / float(HOUR)).alias("duration_h"), "max_1h")


def ietd_sensitivity(events: DataFrame) -> DataFrame:
    """Per series and ``ietd_h``: events and the coefficient of variation (sample) of the dry times between them."""
    w = Window.partitionBy("series_id", "ietd_h").orderBy("start")
    dry = events.withColumn("dry", (micros("start") - micros(F.lag("end").over(w))) / float(HOUR))
    return dry.groupBy("series_id", "ietd_h").agg(F.count("*").alias("n_events"), F.round(F.stddev_samp("dry") / F.nullif(F.avg("dry"), F.lit(0.0)), 3).alias("cv_dry"))


def select_ietd(sensitivity: DataFrame) -> DataFrame:
    """Per series the ``ietd_h`` whose CV is closest to 1; the smaller of ties."""
    return sensitivity.filter("cv_dry is not null").groupBy("series_id").agg(F.min(F.struct(F.abs(F.col("cv_dry") - 1).alias("d"), "ietd_h")).alias("b")).select("series_id", F.col("b.ietd_h").alias("ietd_h"))


def rolling_quantile(grid: DataFrame, days: float = 7, q: float = 0.2, min_rows: int = 72, value: str = "value", out: str = "base", bucket: int = BUCKET) -> DataFrame:
    """Adds ``out``: the quantile (linear between ranks) over the time window (t - days, t], NULL with fewer than ``min_rows``
    values. Times of a series are distinct.

    Spark sorts such a frame anew for every row; here a sorted window slides in pandas, over time buckets that also hold
    what lies within reach of them, so a group is no longer than a bucket and one window.
    """
    names = grid.columns
    at, kind = names.index(value), grid.schema
    span = pd.Timedelta(microseconds=int(days * DAY))

    def slide(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("ts")
        v = pd.Series(f.iloc[:, at].to_numpy(float), index=pd.DatetimeIndex(f["ts"]))
        f = f.assign(**{out: v.rolling(span, min_periods=max(1, min_rows)).quantile(q).to_numpy()})
        return f.loc[~f["__guest"], [*names, out]]

    dealt = with_halo(grid, int(days * DAY), bucket=bucket)
    return dealt.groupBy("series_id", "__b").applyInPandas(slide, T.StructType([*kind.fields, T.StructField(out, T.DoubleType())]))


def level_parameters(grid: DataFrame, rise: int = 18, k_mad: tuple[float, ...] = (3.0,), least: float = 0.03) -> DataFrame:
    """Per series and k: rise threshold max(least, k * 1.4826 * MAD of the rise over ``rise`` steps)."""
    w = Window.partitionBy("series_id").orderBy("ts")
    d = grid.select("series_id", (F.col("value") - F.lag("value", rise).over(w)).alias("dh")).filter("dh is not null")
    med = d.groupBy("series_id").agg(F.percentile("dh", 0.5).alias("m"))
    mad = d.join(med, "series_id").groupBy("series_id").agg(F.percentile(F.abs(F.col("dh") - F.col("m")), 0.5).alias("mad"))
    return mad.select("series_id", F.explode(F.array(*map(F.lit, k_mad))).alias("k_mad"), "mad").withColumn("thr", F.greatest(F.lit(least), F.col("k_mad") * 1.4826 * F.col("mad")))


def detect_level_events(
    grid: DataFrame, mit_h: tuple[int, ...] = (24,), k_mad: tuple[float, ...] = (3.0,), min_rise: float = 0.10, min_hours: float = 2.0, end_frac: float = 0.15, max_recession_days: int = 7,
    gap_hours: float = 3.0, base_days: float = 7, base_rows: int = 72, rise: int = 18, least: float = 0.03, step: int = STEP,
) -> DataFrame:
    """Rises of a level: candidates whose rise over ``rise`` steps exceeds the threshold, merged within ``mit_h`` hours; one
    set of events for each ``mit_h`` and ``k_mad``. Start is the lowest level in the 6 hours before, peak the highest up to
    24 hours after, end the return to base + ``end_frac`` of the rise (``recession_cap`` if not within the days given)."""
    per_h = HOUR // step
    g = with_position(grid.select("series_id", "ts", "value"), step)
    by = Window.partitionBy("series_id").orderBy("idx")
    bounds = g.groupBy("series_id").agg(F.min("idx").alias("i_min"), F.max("idx").alias("i_max"))
    params = level_parameters(grid, rise, k_mad, least).select("series_id", "k_mad", "thr", F.explode(F.array(*map(F.lit, mit_h))).alias("mit_h"))
    risen = g.select("series_id", "idx", (F.col("value") - F.lag("value", rise).over(by)).alias("dh"))
    cand = risen.join(params, "series_id").filter(F.col("dh") > F.col("thr"))  # a row per series and setting
    run = Window.partitionBy("series_id", "k_mad", "mit_h").orderBy("idx")
    new = F.when(F.col("idx") - F.lag("idx").over(run) <= F.col("mit_h") * per_h, 0).otherwise(1)
    groups = cand.withColumn("__n", new).withColumn("grp", F.sum("__n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    keys = ["series_id", "k_mad", "mit_h", "grp"]
    e = groups.groupBy(*keys).agg(F.min("idx").alias("r0"), F.max("idx").alias("r1"), F.first("thr").alias("thr")).join(bounds, "series_id")
    # Start, peak and the base at the start are read off one join with the rows around the rise.
    based = rolling_quantile(g, base_days, 0.2, base_rows)
    seg = _at(e, F.greatest(F.col("r0") - max(6 * per_h, rise), "i_min"), F.least(F.col("r1") + 24 * per_h, "i_max"), based, "value", "base")
    known, here = F.col("value").isNotNull(), F.struct("idx", "value", "base")
    before, after = known & (F.col("idx") <= F.col("r0")) & (F.col("idx") >= F.col("r0") - 6 * per_h), known & (F.col("idx") >= F.col("r0"))
    e = seg.groupBy(*keys).agg(
        F.first("r0").alias("r0"), F.first("thr").alias("thr"), F.first("i_min").alias("i_min"), F.first("i_max").alias("i_max"),
        F.min_by(here, F.when(before, F.struct("value", "idx"))).alias("s"), F.min_by(here, F.when(after, F.struct(-F.col("value"), "idx"))).alias("p"),
        F.max(F.when(F.col("idx") == F.greatest(F.col("r0") - rise, "i_min"), here)).alias("s0"),
    ).filter("p is not null")
    e = e.withColumn("uncertain", F.col("s").isNull()).withColumn("s", F.coalesce("s", "s0"))
    e = e.withColumn("b0", F.coalesce("s.base", "s.value")).withColumn("s", F.col("s.idx")).filter("b0 is not null")
    e = e.withColumn("delta", F.col("p.value") - F.col("b0")).withColumn("jmax", F.least(F.col("p.idx") + max_recession_days * 24 * per_h, "i_max"))
    back = _at(e, F.col("p.idx"), F.col("jmax"), g, "value").filter(F.col("value") <= F.col("b0") + end_frac * F.col("delta")).groupBy(*keys).agg(F.min("idx").alias("e"))
    e = e.join(back, keys, "left").withColumn("capped", F.col("e").isNull()).withColumn("e", F.coalesce("e", "jmax"))
    hours = (F.col("e") - F.col("s")) * (step / HOUR)
    e = e.filter((F.col("delta") >= min_rise) & (hours >= min_hours))
    isl = islands(g.select("series_id", "ts", "idx", "value"), F.col("value").isNull()).filter("value is null").groupBy("series_id", "island").agg(F.min("idx").alias("a"), (F.max("idx") + 1).alias("b"))
    gaps = isl.join(bounds, "series_id").filter((F.least("b", "i_max") - F.greatest(F.col("a") - 1, "i_min")) * step > gap_hours * HOUR).select("series_id", "a", "b")
    hit = gap_overlaps(e.select(*keys, F.col("s").alias("start_idx"), F.col("e").alias("end_idx")), gaps, tuple(keys)).withColumn("gap_flag", F.lit(True))
    e = e.join(hit, keys, "left").withColumn("gap_flag", F.coalesce("gap_flag", F.lit(False)))
    # The names of the flags.
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("uncertain"), F.lit("start_uncertain")), F.when(F.col("capped"), F.lit("recession_cap")), F.when(F.col("gap_flag"), F.lit("gap_inside")))), ",")
    ts = lambda i: F.timestamp_micros((F.col(i) * step).cast("long")).cast("timestamp_ntz")
    number = F.row_number().over(Window.partitionBy("series_id", "k_mad", "mit_h").orderBy("grp"))
    return e.select(
        "series_id", "k_mad", "mit_h", F.format_string("E%03d", number).alias("event_id"), ts("s").alias("start"), ts("e").alias("end"), ts("p.idx").alias("peak_time"), F.round("b0", 3).alias("base_level"),
        F.round("p.value", 3).alias("peak_level"), F.round("delta", 3).alias("delta"), F.round((F.col("e") - F.col("s")) * (step / HOUR), 1).alias("duration_h"), F.round("thr", 4).alias("rise_thr"), "gap_flag", flags.alias("flags"),
    )


def window_rain(events: DataFrame, hourly: DataFrame, before_h: int = 24, coverage: float = 0.8, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Per event (told apart by ``keys``) and gauge: rain from ``before_h`` hours before the start to the end, NULL below the
    coverage of valid hours, and the largest hourly value. ``hourly(gauge, ts, value)`` has a row for every hour."""
    e = events.select(*keys, F.explode(F.sequence(micros(floor_to("start", HOUR)) - before_h * HOUR, micros("end"), F.lit(HOUR))).alias("t"), (micros("start") - before_h * HOUR).alias("t0"))
    rows = e.filter("t >= t0").join(hourly.select("gauge", micros("ts").alias("t"), "value"), "t")
    return rows.groupBy(*keys, "gauge").agg(F.when(F.avg(F.col("value").isNotNull().cast("double")) >= coverage, F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 1)).alias("rain"), F.max("value").alias("max_1h"))


def antecedent_rain(daily: DataFrame, days: int = 7, min_days: int = 5, keys: tuple[str, ...] = ()) -> DataFrame:
    """``*keys, ts, api``: rain of the ``days`` days before each day, NULL with fewer than ``min_days`` values. One row per
    day (midnight) and area, if ``keys`` names one. Each value is sent to the days that it counts for, so that a single area
    is many tasks."""
    t = micros("ts")
    ahead = daily.select(*keys, F.explode(F.sequence(t + DAY, t + days * DAY, F.lit(DAY))).alias("t"), "value").filter("value is not null")
    sums = ahead.groupBy(*keys, "t").agg(F.count("value").alias("n"), F.sum("value").alias("s"))
    return daily.select(*keys, "ts", t.alias("t")).join(sums, [*keys, "t"], "left").select(*keys, "ts", F.when(F.col("n") >= min_days, F.col("s")).alias("api"))


def upstream_response(events: DataFrame, levels: DataFrame, before_h: int = 12, rise: float = 0.05, step: int = STEP, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Per event (told apart by ``keys``): gauges whose level ranges over more than ``rise`` from ``before_h`` hours before the
    start to the end; an event's own series, if among the keys, is none of them."""
    e = events.select(*keys, F.explode(F.sequence(F.floor(micros("start") / F.lit(step)) - before_h * (HOUR // step), F.floor(micros("end") / F.lit(step)))).alias("idx"))
    g = with_position(levels, step).filter("value is not null").select(F.col("series_id").alias("gauge"), "idx", "value")
    met = e.join(g, "idx")
    r = (met.filter("gauge != series_id") if "series_id" in keys else met).groupBy(*keys, "gauge").agg((F.max("value") - F.min("value")).alias("range"))
    return events.select(*keys).join(r.groupBy(*keys).agg(F.count_if(F.col("range") > rise).alias("n")), list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n_upstream"))


def rain_driven(events: DataFrame, rains: DataFrame, before_h: int = 24, after_h: int = 6, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events for which some rain event overlaps [start - before, start + after]. Overlap is found by day: both sides are
    listed under the days they touch, so the join has equal keys."""
    days = lambda a, b: F.explode(F.sequence(F.floor(a / F.lit(DAY)), F.floor(b / F.lit(DAY)))).alias("day")
    lo, hi = micros("start") - before_h * HOUR, micros("start") + after_h * HOUR
    e = events.select(*keys, lo.alias("lo"), hi.alias("hi"), days(lo, hi))
    r = rains.select(micros("start").alias("a"), micros("end").alias("b"), days(micros("start"), micros("end")))
    hit = e.join(r, "day").filter("a <= hi AND b >= lo").select(*keys).distinct()
    return events.join(hit, list(keys), "left_semi")


def seasons(events: DataFrame) -> DataFrame:
    return events.withColumn("season", season("start")).withColumn("hydro_year", hydro_year("start"))


def events_per_year(events: DataFrame) -> DataFrame:
    """Fewest, most and median number of events in a hydrological year."""
    per = events.groupBy(hydro_year("start").alias("y")).agg(F.count("*").alias("n"))
    return per.agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.percentile("n", 0.5).alias("n_median"))


def month_counts(kinds: dict[str, DataFrame], ts: str = "start") -> DataFrame:
    """``month`` and a column ``n_<kind>`` for each kind of events, pooled over gauges: how many begin in that month of any
    year."""
    rows = None
    for k, e in kinds.items():
        part = e.select(F.month(ts).alias("month"), F.lit(k).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("month").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])


def around_cut(events: DataFrame, cut: str, ts: str = "peak_ts", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Per series: events before a cut date, from it on, and in all."""
    t = F.lit(cut).cast("timestamp_ntz")
    return events.groupBy(*keys).agg(F.count_if(F.col(ts) < t).alias("n_before"), F.count_if(F.col(ts) >= t).alias("n_after"), F.count("*").alias("n"))
