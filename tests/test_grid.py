from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions.exprs import HOUR, MINUTE
from tidemark.operators import gaps, grid, qc

T0 = datetime(2024, 3, 1)


def frame(spark, rows, schema="series_id string, ts timestamp_ntz, value double, quality int"):
    return spark.createDataFrame(rows, schema)


def at(minutes, seconds=0):
    return T0 + timedelta(minutes=minutes, seconds=seconds)


def test_snap_is_half_even_keeps_the_first_and_is_idempotent(spark):
    rows = [("a", at(0, 30), 1.0, 0), ("a", at(1, 30), 2.0, 0), ("a", at(2, 14), 3.0, 0), ("a", at(1, 59), 9.0, 0), ("a", None, 5.0, 0), ("b", at(0, 29), 4.0, 1)]
    once = grid.snap_dedupe(frame(spark, rows))
    got = sorted((r.series_id, r.ts, r.value) for r in once.collect())
    assert got == [("a", at(0), 1.0), ("a", at(2), 2.0), ("b", at(0), 4.0)]
    assert sorted((r.series_id, r.ts, r.value) for r in grid.snap_dedupe(once).collect()) == got


def random_series(seed=0, n=400, span=6000):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.choice(span, n, replace=False))
    keep = (t < 2000) | (t > 2900)
    return [("a", at(int(m)), float(v), int(v) % 3) for m, v in zip(t[keep], rng.gamma(2, 3, n)[keep])]


def test_linear_regrid_equals_pandas(spark):
    rows = random_series()
    end = at(6000)
    got = {r.ts: r.value for r in grid.regrid_linear(frame(spark, rows), T0, end, max_gap=2 * HOUR).collect()}
    s = pd.Series([r[2] for r in rows], index=pd.DatetimeIndex([r[1] for r in rows]))
    target = pd.date_range(T0, end, freq="10min")
    full = s.reindex(s.index.union(target)).interpolate("time", limit_direction="both").reindex(target)
    src = s.index.values
    for t, v in full.items():
        i = np.searchsorted(src, np.datetime64(t))
        near = min((abs((pd.Timestamp(src[j]) - t).total_seconds()) for j in (i - 1, i) if 0 <= j < len(src)), default=1e9)
        if near <= 7200:
            assert abs(got[t.to_pydatetime()] - v) < 1e-9
        else:
            assert got[t.to_pydatetime()] is None
    assert len(got) == len(target)


def test_buckets_change_nothing(spark):
    rows = random_series(3)
    g = grid.spine(frame(spark, rows), T0, at(6000))
    a, b = (sorted(map(tuple, grid.bracket(frame(spark, rows), g, bucket=k).collect())) for k in (30 * 24 * HOUR, 7 * HOUR))
    assert a == b


def test_cumulative_regrid_conserves_mass(spark):
    rows = random_series(5)
    df = frame(spark, rows)
    fine = grid.regrid_cumulative(df, T0, at(6000), max_gap=10_000 * HOUR)
    assert abs(fine.agg(F.sum("value")).first()[0] - sum(r[2] for r in rows)) < 1e-6
    capped = grid.regrid_cumulative(df, T0, at(6000), max_gap=HOUR)
    assert capped.filter("value is null").count() > 0 and capped.filter("value < 0").count() == 0


def test_mean_method_and_quality_fill(spark):
    rows = [("a", at(5), 2.0, None), ("a", at(10), 4.0, 2), ("a", at(25), 6.0, 1)]
    df = frame(spark, rows)
    m = {r.ts: r.value for r in grid.regrid_linear(df, T0, at(30), method="mean").collect()}
    assert m == {at(0): None, at(10): 3.0, at(20): None, at(30): 6.0}
    q = {r.ts: r.quality for r in grid.quality_on_grid(df, grid.spine(df, T0, at(30))).collect()}
    assert q == {at(0): None, at(10): 2, at(20): 2, at(30): 1}


def test_disaggregation_rules(spark):
    coarse = frame(spark, [("c", at(60), 6.0, 0), ("c", at(120), 12.0, 0), ("c", at(180), 3.0, 0), ("c", at(240), 9.0, 0)])
    donors = [(at(10), 1.0, None), (at(20), 3.0, None), (at(70), None, 2.0), (at(80), None, 2.0), (at(90), 5.0, None), (at(130), 0.0, 4.0), (at(140), 0.0, 4.0)]
    d = spark.createDataFrame(donors, "ts timestamp_ntz, d1 double, d2 double")
    fine = spark.createDataFrame([("c", at(10 * k)) for k in range(1, 25)], "series_id string, ts timestamp_ntz")
    got = {r.ts: r.value for r in grid.disaggregate(coarse, d, fine).collect()}
    assert got[at(10)] == 1.5 and got[at(20)] == 4.5 and got[at(30)] == 0
    assert got[at(70)] == 6 and got[at(80)] == 6 and got[at(90)] == 0  # the first donor has one value only
    assert all(abs(got[at(120 + 10 * k)] - 0.5) < 1e-12 for k in range(1, 7))  # the first donor's sum is 0
    assert all(abs(got[at(180 + 10 * k)] - 1.5) < 1e-12 for k in range(1, 7))
    check = grid.mass_check(spark.createDataFrame([("c", t, v) for t, v in got.items()], "series_id string, ts timestamp_ntz, value double"), coarse).first()
    assert check.n == 4 and check.max_abs < 1e-9


def test_asof_is_backward_and_skips_null(spark):
    left = spark.createDataFrame([("k", at(10), 1), ("k", at(5), 2), ("j", at(10), 3)], "g string, ts timestamp_ntz, id int")
    right = spark.createDataFrame([("k", at(5), 1.5), ("k", at(9), None), ("k", at(11), 9.0)], "g string, ts timestamp_ntz, v double")
    assert {r.id: r.asof_value for r in grid.asof_backward(left, right, "g", "v").collect()} == {1: 1.5, 2: 1.5, 3: None}
    assert {r.id: r.asof_value for r in grid.asof_backward(left, right, "g", "v", 3 * MINUTE).collect()} == {1: None, 2: 1.5, 3: None}


def cells(spark, values, sid="a"):
    return spark.createDataFrame([(sid, at(10 * k), v, None) for k, v in enumerate(values)], "series_id string, ts timestamp_ntz, value double, quality int")


def test_gaps_and_imputation(spark):
    v = [None, 1.0, None, None, 4.0, None, None, None, 8.0, None]
    g = cells(spark, v).unionByName(cells(spark, [None, None], "empty"))
    cat = sorted((r.series_id, r.n_missing, r.prev_valid is None, r.next_valid is None, r.span_h) for r in gaps.gap_catalogue(g).collect())
    assert cat == sorted([("a", 1, True, False, None), ("a", 2, False, False, 0.5), ("a", 3, False, False, 4 / 6), ("a", 1, False, True, None), ("empty", 2, True, True, None)], key=lambda r: (r[0], r[1], r[2]))
    out = gaps.impute_gaps(g, 2)
    got = [r.value for r in out.filter("series_id = 'a'").orderBy("ts").collect()]
    assert got == [1.0, 1.0, 2.0, 3.0, 4.0, None, None, None, 8.0, 8.0]
    assert out.filter("data_type = 'imputed'").count() == 4
    again = gaps.impute_gaps(out, 2).filter("series_id = 'a'").orderBy("ts").collect()
    assert [r.value for r in again] == got
    rep = {r.series_id: (r.nulls_before, r.nulls_after, r.filled) for r in gaps.fill_report(g, out).collect()}
    assert rep == {"a": (7, 3, 4), "empty": (2, 2, 0)}
    assert [r.missing for r in gaps.missing_flags(out).filter("series_id = 'a'").orderBy("ts").collect()] == [0, 0, 0, 0, 0, 1, 1, 1, 0, 0]


def test_filters(spark):
    g = cells(spark, [0.4, 1.2, None, 0.3, 0.9, 6.0, -0.6, 0.2])
    b = qc.bounds_filter(g)
    assert [r.value for r in b.orderBy("ts").collect()] == [0.4, 1.2, None, 0.3, 0.9, None, None, 0.2]
    r = qc.rate_filter(b, 0.5)
    assert [x.value for x in r.orderBy("ts").collect()] == [0.4, None, None, 0.3, None, None, None, 0.2]
    k = qc.block_filter(cells(spark, [1.0, 2.0, None, 3.0, None, 4.0, 5.0, 6.0]), 2)
    assert [x.value for x in k.orderBy("ts").collect()] == [1.0, 2.0, None, None, None, 4.0, 5.0, 6.0]


def test_drift_is_taken_out_once(spark):
    rows = []
    for day in range(20):
        for h in range(24):
            ext = day >= 10
            rows.append(("a", T0 + timedelta(days=day, hours=h), float(0.05 + (0.03 * np.sin(2 * np.pi * h / 24) if ext else 0.001 * (h % 2))), 0))
    df = frame(spark, rows)
    ext = F.col("ts") >= F.lit(str(T0 + timedelta(days=10))).cast("timestamp_ntz")
    t = qc.drift_table(df, ext).first()
    assert t.applied and t.reason is None
    out = qc.correct_drift(df, ext)
    spread = out.filter("data_type = 'corrected'").groupBy(F.hour("ts").alias("h")).agg(F.avg("value").alias("m")).agg(F.max("m") - F.min("m")).first()[0]
    assert spread < 0.002 and out.filter("data_type = 'corrected'").count() == 240
    small = qc.drift_table(df, ext, min_samples=1000).first()
    assert not small.applied and small.reason == "few_quiet_rows"


def test_measurements_round_trip(spark):
    w = spark.createDataFrame([(at(0), 1.0, None, "x"), (at(10), None, 2.0, None)], "ts timestamp_ntz, a double, b double, a_type string")
    m = grid.measurements(w, {"a": ("A", "LEVEL"), "b": ("B", "RAIN")}, types={"a": "a_type"})
    assert m.columns == ["ts", "station", "variable", "value", "quality", "data_type"]
    assert sorted((r.station, r.value, r.data_type) for r in m.filter("value is not null").collect()) == [("A", 1.0, "x"), ("B", 2.0, "observed")]
    assert m.count() == 4
