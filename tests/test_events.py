from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import curves, events, features, metrics, stats

T0 = datetime(2020, 1, 1)


def make(spark, q, h=None, p=None):
    rows = [("s", T0 + timedelta(minutes=10 * k), None if v is None else float(v), None if v is None else float(v if h is None else h[k]), float(0 if p is None else p[k])) for k, v in enumerate(q)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, q double, h double, p double")


def pot_loop(q, peak=0.2, low=0.05, end=0.05):
    """Plain loops over positions, for comparison."""
    n = len(q)
    num = [-1e9 if v is None else v for v in q]
    above = [i for i in range(n) if q[i] is not None and q[i] > peak]
    cores = []
    for i in above:
        if cores and i - cores[-1][1] < 36:
            cores[-1][1] = i
        else:
            cores.append([i, i])
    found = {}
    for a, b in cores:
        b = min(b, a + 432)
        s = a
        while s > max(0, a - 72) and q[s - 1] is not None and q[s - 1] > low:
            s -= 1
        limit, run, e = min(n - 1, b + 144), 0, None
        for i in range(b + 1, limit + 1):
            run = run + 1 if q[i] is not None and q[i] <= end else 0
            if run == 6:
                e = i - 5
                break
        e = limit if e is None else e
        top = max(range(s, e + 1), key=lambda i: (num[i], -i))
        if top in found:
            o = found[top]
            found[top] = (min(o[0], s), max(o[1], e))
        else:
            found[top] = (s, e)
    return [(s, t, e) for t, (s, e) in found.items() if num[t] >= 0.10]


def test_pot_equals_loops(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        q = np.zeros(4000)
        for c in rng.integers(0, 4000, 40):
            w = rng.integers(3, 200)
            q[c : c + w] += rng.gamma(1, 0.4) * np.exp(-np.arange(min(w, 4000 - c)) / 30)
        q = [None if rng.random() < 0.02 else float(x) for x in q]
        e = events.detect_pot(make(spark, q)).orderBy("event_id").collect()
        base = e[0].start_idx - pot_loop(q)[0][0]
        assert [(r.start_idx - base, r.peak_idx - base, r.end_idx - base) for r in e] == pot_loop(q)
        assert [r.event_id for r in e] == list(range(1, len(e) + 1))


def test_pot_edges_rain_and_rows(spark):
    q = [0.01] * 100 + [0.3] * 3 + [0.01] * 17 + [0.5] + [0.01] * 200 + [0.09, 0.25, 0.09] + [0.01] * 50
    h = [x if x != 0.25 else 0.0999 for x in q]
    p = [0.1] * len(q)
    g = make(spark, q, h, p)
    e = events.detect_pot(g, rains=("p",), splits=("2020-01-01 12:00:00", "2020-01-02 00:00:00")).collect()
    assert len(e) == 1 and e[0].peak_q == 0.5 and e[0].split == "validation"
    n = e[0].end_idx - e[0].start_idx + 1
    assert abs(e[0].acc_precip - 0.1 * n) < 1e-3 and e[0].max_intensity <= 0.6 + 1e-9
    rows = events.assign_rows(g, events.detect_pot(g))
    assert rows.count() == len(q) and rows.filter("event_id = 1").count() == n
    overlap = spark.createDataFrame([("s", 1, 10, 12, 20), ("s", 2, 11, 18, 25)], "series_id string, event_id int, start_idx long, peak_idx long, end_idx long")
    tiny = spark.createDataFrame([("s", datetime(1970, 1, 1) + timedelta(minutes=10 * k)) for k in range(30)], "series_id string, ts timestamp_ntz")
    got = [r.event_id for r in events.assign_rows(tiny, overlap).orderBy("ts").collect()]
    assert got[10:26] == [1] * 6 + [2] * 10 and got[9] is None
    assert events.detect_pot(make(spark, [0.0] * 50)).count() == 0


def test_rain_events(spark):
    t = lambda h: T0 + timedelta(hours=h)
    rows = [("a", t(0), 0.3), ("a", t(1), 0.1), ("a", t(2), 0.2), ("a", t(9), 1.0), ("a", t(9.5), 1.0), ("a", t(10), 0.0), ("b", t(0), 5.0)]
    e = events.rain_events(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double"), (6, 12)).orderBy("ietd_h", "start").collect()
    assert [(r.series_id, r.ietd_h, round(r.depth, 6), r.duration_h, r.max_1h) for r in e] == [("a", 6, 0.6, 2.0, 0.3), ("a", 6, 2.0, 0.5, 2.0), ("a", 12, 2.6, 9.5, 2.0)]


def test_level_event_of_a_known_shape(spark):
    rng = np.random.default_rng(0)
    h = 0.2 + 0.001 * rng.standard_normal(3000)
    h[1500:1530] += np.linspace(0, 1, 30)
    h[1530:1800] += np.exp(-np.arange(270) / 60)
    h[1600:1603] = np.nan
    rows = [("s", T0 + timedelta(minutes=10 * k), None if np.isnan(v) else float(v)) for k, v in enumerate(h)]
    e = events.detect_level_events(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")).collect()
    assert len(e) == 1
    r = e[0]
    assert abs(r.delta - 1.0) < 0.05 and r.peak_time in {T0 + timedelta(minutes=10 * k) for k in (1529, 1530)} and r.flags == "" and not r.gap_flag and r.event_id == "E001"
    assert T0 + timedelta(minutes=14640) <= r.start <= T0 + timedelta(minutes=15060) and r.end > r.peak_time


def test_drivers_and_response(spark):
    t = lambda h: T0 + timedelta(hours=h)
    ev = spark.createDataFrame([("E1", t(30), t(40)), ("E2", t(200), t(210))], "event_id string, start timestamp_ntz, end timestamp_ntz")
    rains = spark.createDataFrame([(t(0), t(6)), (t(160), t(175.9)), (t(206.1), t(300))], "start timestamp_ntz, end timestamp_ntz")
    assert [r.event_id for r in events.rain_driven(ev, rains).collect()] == ["E1"]
    lv = spark.createDataFrame([("u", t(20), 0.1), ("u", t(31), 0.2), ("w", t(20), 0.1), ("w", t(31), 0.12)], "series_id string, ts timestamp_ntz, value double")
    assert {r.event_id: r.n_upstream for r in events.upstream_response(ev, lv).collect()} == {"E1": 1, "E2": 0}


def test_curves(spark):
    raw = [("a", "meters_to_flow", "1", "0", "1", "{2}", "{1}"), ("a", "meters_to_flow", "2", "1.5", "NULL", "{1, 1}", "{2,0}"), ("a", "meters_to_flow", "3", "2", "3", "{7}", "{0}"), ("b", "meters_to_flow", "1", "0", "NULL", "{3}", "{1.5}")]
    c = curves.parse_curves(spark.createDataFrame(raw, "station_code string, type string, section_order string, initial_x string, final_x string, bases string, exponents string"))
    v = spark.createDataFrame([("a", 0.5), ("a", 1.2), ("a", 1.5), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("z", 1.0), ("a", None)], "series_id string, value double")
    got = [r.flow for r in curves.apply_curve(v, c).orderBy("series_id", "value").collect()]
    assert got == [None, 1.0, None, 3.25, 7.0, 10.0, 24.0, None]
    flows = curves.apply_curve(spark.createDataFrame([("b", x / 7) for x in range(1, 30)], "series_id string, value double"), c).select("series_id", F.col("value").alias("h"), F.col("flow").alias("value"))
    back = curves.apply_inverse(flows, c).collect()
    assert all(abs(r.level - r.h) < 1e-3 for r in back) and len(back) == 29
    assert curves.apply_inverse(spark.createDataFrame([("b", 1e9), ("b", -1.0)], "series_id string, value double"), c).filter("level is not null").count() == 0
    assert curves.check_rising(c.filter("station = 'b'")).count() == 0


def test_features_against_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    n = 400
    df = pd.DataFrame({"ts": pd.date_range(T0, periods=n, freq="10min"), "basin": "x", "a": rng.random(n), "b": np.where(rng.random(n) < 0.2, np.nan, rng.random(n))})
    s = spark.createDataFrame([(r.ts.to_pydatetime(), r.basin, r.a, None if np.isnan(r.b) else r.b) for r in df.itertuples()], "ts timestamp_ntz, basin string, a double, b double")
    t = features.training_table(s, "a", ["a"], ["b"], {"d": ("a", ("b",))}, splits=("2020-01-01 10:00:00", "2020-01-01 20:00:00")).toPandas().sort_values("ts").reset_index(drop=True)
    df["lag"], df["cum"], df["tgt"] = df.a.shift(6), df.b.rolling(18, min_periods=1).sum(), df.a.shift(-144)
    w = df.dropna(subset=["tgt"]).reset_index(drop=True)
    assert len(t) == len(w)
    assert np.allclose(t.a_lag_1h, w.lag, equal_nan=True) and np.allclose(t.b_cum_3h, w["cum"], equal_nan=True) and np.allclose(t.target_24h, w.tgt) and np.allclose(t.d, w.a - w.b, equal_nan=True)
    small = features.training_table(s, "a", ["a"], ["b"], {"d": ("a", ("b",))}, splits=("2020-01-01 10:00:00", "2020-01-01 20:00:00"), bucket=7 * 3_600_000_000).toPandas().sort_values("ts").reset_index(drop=True)
    pd.testing.assert_frame_equal(small[t.columns], t)
    edge = t[t.ts == pd.Timestamp("2020-01-01 10:00:00")].split.iloc[0], t[t.ts == pd.Timestamp("2020-01-01 10:10:00")].split.iloc[0]
    assert edge == ("train", "validation")
    assert "split" not in features.predictor_columns(spark.createDataFrame(t.head(1))) and not any(c.startswith("target") for c in features.predictor_columns(spark.createDataFrame(t.head(1))))


def test_metric_edges(spark):
    rows = [("const", 1.0, 2.0), ("const", 1.0, 3.0), ("one", 1.0, 1.0), ("zero", -1.0, 1.0), ("zero", 1.0, 2.0), ("nulls", None, 1.0), ("nulls", 2.0, None), ("simconst", 1.0, 5.0), ("simconst", 2.0, 5.0)]
    df = spark.createDataFrame([(k, T0 + timedelta(hours=i), o, s) for i, (k, o, s) in enumerate(rows)], "m string, ts timestamp_ntz, obs double, sim double")
    got = {r.m: r for r in metrics.skill(df, "m").collect()}
    assert got["const"].nse is None and got["const"].kge is None and got["const"].rmse is not None
    assert got["one"].nse is None and got["zero"].pbias is None and "nulls" not in got
    assert got["simconst"].nse is not None and got["simconst"].kge is None
    s = metrics.threshold_scores(df.filter("m = 'const'"), 5.0, "m").first()
    assert s.pod is None and s.far is None and s.csi is None
    tie = spark.createDataFrame([("x", T0, 3.0, 1.0), ("x", T0 + timedelta(hours=2), 3.0, 4.0), ("x", T0 + timedelta(hours=5), 1.0, 4.0)], "m string, ts timestamp_ntz, obs double, sim double")
    p = metrics.peak_errors(tie, "m").first()
    assert p.peak_time_err_h == 2.0 and p.peak_mag_err == 1.0


def test_statistics(spark):
    rows = [("c", T0 + timedelta(minutes=10 * k), 1.0) for k in range(20)]
    flat = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    assert stats.cross_correlation(flat, flat, range(0, 2)).filter("r is not null").count() == 0
    x = np.random.default_rng(3).standard_normal(300)
    a = spark.createDataFrame([("x", T0 + timedelta(minutes=10 * k), float(v)) for k, v in enumerate(x)], "series_id string, ts timestamp_ntz, value double")
    b = spark.createDataFrame([("y", T0 + timedelta(minutes=10 * (k + 7)), float(v)) for k, v in enumerate(x)], "series_id string, ts timestamp_ntz, value double")
    best = stats.best_lag(stats.cross_correlation(a, b, range(-12, 20))).first()
    assert best.best_lag == 7 and best.best_r > 0.999
