import io
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs
from tidemark.operators import ingest, metrics, models
from tidemark.sources import readers, simulator, writers
from tidemark.streaming import online


def test_clean_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/ST01.csv").write_text("TIMESTAMP,HEIGHT_m,WATER_TEMP_C,QUALITY,DATA_TYPE\n2020-01-01 00:00:14,1.5,,0,observed\nbad,2,3,,observed\n2020-01-01 00:10:00+00,nan,9.5,,observed\n")
    df = readers.clean_files(spark, str(tmp_path / "in"), "hydro")
    got = sorted((r.series_id, r.ts, r.value) for r in df.filter("ts is not null and value is not null").collect())
    assert got == [("ST01_HEIGHT_m", datetime(2020, 1, 1, 0, 0, 14), 1.5), ("ST01_WATER_TEMP_C", datetime(2020, 1, 1, 0, 10), 9.5)]
    writers.to_parquet(df, str(tmp_path / "p"), "series_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == df.count()
    writers.to_csv(df, str(tmp_path / "c"), gzip=True)
    assert list((tmp_path / "c").glob("*.csv.gz"))
    base = df.filter("ts is not null").select("series_id", "ts", "value")
    writers.rewrite_sorted(base, str(tmp_path / "v"))
    later = base.withColumn("ts", F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"))
    n = base.count()
    writers.append_new(base.unionByName(later), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2 * n
    writers.to_notes(ingest.inventory(df), str(tmp_path / "n"))
    notes = readers.metadata_notes(spark, str(tmp_path / "n"), {"rows": r"rows = (\d+)"})
    assert notes.filter("rows = '3'").count() >= 1


def test_export_and_wide_days(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,code_id,station_name,x_utm,y_utm,variable,quality,timestamp,value\n1,A,n,0,0,WaterLevel,0,2020-01-01 00:00:00+00:00,123\n2,A,n,0,0,WaterLevel,2,2020-01-01 00:10:00+00,5\n3,A,n,0,0,Rain10m,1,2020-01-01 00:10:00+00,-\n4,A,n\n5,A,n,0,0,Other,0,2020-01-01 00:10:00,1\n")
    rows = ingest.export_rows(readers.export_csv(spark, str(tmp_path / "e.csv")), {"WaterLevel": 100.0, "Rain10m": 1.0}).collect()
    assert sorted((r.variable, r.value) for r in rows) == sorted([("Rain10m", None), ("WaterLevel", 1.23)])
    assert readers.export_csv(spark, str(tmp_path / "e.csv"), "Other").count() == 1
    head = ";".join(["station", "y", "m", "d", "a", "b", "c", "e", "P24", *[f"PH{k:02d}" for k in range(1, 25)]])
    line = lambda d, cells: ";".join(["B1", "2020", "12", str(d), "", "", "", "", "10", *cells])
    (tmp_path / "w.txt").write_bytes((head + "\n" + line(31, ["5"] + ["-"] * 22 + ["20"]) + "\n" + line(30, [""] * 24) + "\nB2;2020;1;1\n").encode("latin-1"))
    days = readers.wide_days(spark, str(tmp_path / "w.txt"), "B1")
    hours = [f"h{k}" for k in range(1, 25)]
    got = {r.ts: r.value for r in ingest.expand_days(days, hours).filter("value is not null").collect()}
    assert got == {datetime(2020, 12, 31, 1): 0.5, datetime(2021, 1, 1): 2.0}
    assert ingest.days_without_hours(days, "p24", hours).first().n_days == 1


def test_strict_workbook(spark, tmp_path):
    ns = "http://purl.oclc.org/ooxml/spreadsheetml/main"
    rel = "http://purl.oclc.org/ooxml/officeDocument/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="rId1"/><sheet name="Two" r:id="rId2"/></sheets><externalReferences><x/></externalReferences></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>head</t></si><si><t>abc</t></si></sst>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2"><v>1.5</v></c><c r="C2"><f>0.2*3</f><v>0.6</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "S7.xlsx").write_bytes(buf.getvalue())
    df = readers.workbooks(spark, str(tmp_path / "S7.xlsx"), 3)
    assert [tuple(r) for r in df.collect()] == [("S7", "1.5", None, "=0.2*3")]
    assert readers.sheet_rows(buf.getvalue(), "Two") == [["abc"]] and readers.sheet_rows(buf.getvalue(), "None") == []
    tip = df.select(exprs.tipping_bucket("c2").alias("t")).first().t
    assert tip.value == 0.6 and tip.corrected
    assert readers.positional(df, {"level": 1}).columns == ["level"]


def test_tipping_bucket_cells(spark):
    cells = ["=0.2*3", "=3*0.2", "=AVERAGE(A1)", "NAN", "1.2", "abc", None, "=0.2*x"]
    got = [r.t.value for r in spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "k int, c string").select("k", exprs.tipping_bucket("c").alias("t")).orderBy("k").collect()]
    assert got == [0.6, 0.6, None, None, 1.2, None, None, None]


def test_simulator_interchange(spark):
    df = spark.range(1).select(simulator.path_name(F.lit("G"), F.lit("P"), F.lit("01JAN2020"), 120, F.lit("T")).alias("p"), simulator.from_minutes(F.lit(62_588_160 * 1)).alias("t"))
    r = df.select("p", "t", simulator.path_matches(F.col("p"), "//g/*//2Hour/T/").alias("m"), simulator.path_matches(F.col("p"), "//X/*/*/*/T/").alias("n"), simulator.to_minutes(F.col("t")).alias("back")).first()
    assert r.p == "//G/P/01JAN2020/2Hour/T/" and r.m and not r.n and r.back == 62_588_160
    text = spark.sql("SELECT TIMESTAMP_NTZ'2020-01-02 03:00:00' AS a, TIMESTAMP_NTZ'2020-01-05 00:00:00' AS b").select(simulator.control_text(F.col("a"), F.col("b")).alias("t")).first().t
    assert "Start: 2 January 2020, 03:00" in text and "Time Interval: 15" in text


def test_merge_rules(spark):
    t = lambda h: datetime(2020, 1, 1, h)
    old = spark.createDataFrame([("a", t(1), None), ("a", t(2), 2.0)], "series_id string, ts timestamp_ntz, value double")
    new = spark.createDataFrame([("a", t(1), 9.0), ("a", t(3), 3.0), ("b", t(0), 1.0)], "series_id string, ts timestamp_ntz, value double")
    assert sorted((r.series_id, r.ts.hour, r.value) for r in ingest.merge_precedence(old, new).collect() if r.value) == [("a", 2, 2.0), ("a", 3, 3.0), ("b", 0, 1.0)]
    assert ingest.overlap(old, new).first().n_overlap == 1
    assert sorted((r.series_id, r.ts.hour) for r in ingest.append_after(old, new).collect()) == [("a", 3), ("b", 0)]


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 4))
    y = x @ [1.0, -2.0, 0.5, 0.0] + 3 + 0.1 * rng.standard_normal(300)
    split = ["train"] * 200 + ["test"] * 100
    df = spark.createDataFrame([(i, split[i], *map(float, x[i]), float(y[i])) for i in range(300)], "ts int, split string, a double, b double, c double, d double, y double")
    got = np.array([r.sim for r in models.fit_predict(df, ["a", "b", "c", "d"], "y", models.ridge, "ridge", 1).orderBy("ts").collect()])
    xm, ym = x[:200].mean(0), y[:200].mean()
    beta = np.linalg.solve((x[:200] - xm).T @ (x[:200] - xm) + np.eye(4), (x[:200] - xm).T @ (y[:200] - ym))
    assert np.allclose(got, (x - xm) @ beta + ym, atol=1e-6)


def test_arima_recovers_and_forecasts():
    rng = np.random.default_rng(2)
    d = np.zeros(4000)
    e = rng.standard_normal(4000)
    for t in range(2, 4000):
        d[t] = 0.5 * d[t - 1] - 0.2 * d[t - 2] + e[t] + 0.3 * e[t - 1]
    m = models.Arima.fit(np.cumsum(d), None, 2, 1)
    assert np.allclose(m.phi, [0.5, -0.2], atol=0.1) and np.allclose(m.theta, [0.3], atol=0.1)
    f = m.forecast(np.cumsum(d), None, 50)
    assert len(f) == 50 and abs(f[-1] - f[-2]) < 1e-3
    assert models.Arima.fit(np.cumsum(d), None, 2, 1).aic < models.Arima.fit(np.cumsum(d), None, 0, 0).aic


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    rows = [("a", datetime(2020, 1, 1, 0, m), float(m)) for m in range(0, 60, 5)] + [("a", datetime(2020, 1, 1, 12), 1.0), ("a", datetime(2020, 1, 1, 0, 0, 10), 7.0)]
    spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema("series_id string, ts timestamp_ntz, value double").parquet(str(src))

    def run(df, name, mode="complete"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
        return spark.table(name).collect()

    got = {r.start.minute: r.n for r in run(online.binned(read()), "binned") if r.start.hour == 0}
    assert got[10] == 2 and len(got) == 6
    assert len(run(online.wet_sessions(read(), wet=1.0), "sessions")) == 2
    assert sum(r.n_above for r in run(online.exceedances(read(), 30.0), "above")) == 5
    assert len(run(online.snapped(read()), "snapped", "append")) == 13


def test_arima_forecasts_stay_bounded():
    for phi in ([1.4, 0.2], [-1.7], [0.3, 0.9]):
        assert np.abs(np.roots([1.0, *-models._stationary(np.array(phi))])).max() <= 0.99 + 1e-9
    assert list(models._stationary(np.array([0.5, 0.2]))) == [0.5, 0.2] and not len(models._stationary(np.zeros(0)))
    for seed in range(10):
        y = np.random.default_rng(seed).normal(50, 20, 2000)
        assert np.abs(models.Arima.fit(y, None, 2, 1).forecast(y[-360:], None, 288) - 50).max() < 200


def test_evaluation_equals_its_parts(spark):
    rows = [("m", k % 3, datetime(2024, 1, 1) + timedelta(hours=k), None if k % 7 == 0 else float(k * 37 % 101), float(k * 53 % 97)) for k in range(60)]
    df = spark.createDataFrame(rows, "model string, g int, ts timestamp_ntz, obs double, sim double")
    got = {r.g: r for r in metrics.evaluation(df, (30.0, 1000.0), "model", "g").collect()}
    skill = {r.g: r for r in metrics.skill(df, "g").collect()}
    peaks = {r.g: r for r in metrics.peak_errors(df, "g").collect()}
    over = {r.g: r for r in metrics.threshold_scores(df, 30.0, "g").collect()}
    assert set(got) == {0, 1, 2}
    for g, r in got.items():
        assert all(r[c] == pytest.approx(skill[g][c]) for c in ("n", "nse", "kge", "rmse", "mae", "pbias"))
        assert (r.peak_mag_err, r.peak_time_err_h) == (peaks[g].peak_mag_err, peaks[g].peak_time_err_h)
        assert (r.pod_30, r.far_30, r.csi_30, r.pod_1000) == (over[g].pod, over[g].far, over[g].csi, None)


def test_benchmark_gives_every_model_the_table_s_targets(spark):
    rng = np.random.default_rng(5)
    y = 50 + np.cumsum(rng.normal(0, 1, 760))
    rows = [(datetime(2024, 1, 1) + timedelta(hours=k), float(y[k]), float(rng.normal()) if k % 5 else None, float(y[k + 1]), float(y[k + 6]), "train" if k < 500 else "validation" if k < 620 else "test") for k in range(740)]
    table = spark.createDataFrame(rows, "ts timestamp_ntz, level double, x double, target_1h double, target_6h double, split string").persist()
    got = models.benchmark(table, ["level", "x"], "level", (1, 6), {"ridge": (models.ridge, None)}, ("x",), per_hour=1, arima_window=360).toPandas()
    assert set(got.model) == {"persistence", "ridge", "arima", "arimax"} and not got.duplicated(["ts", "model", "horizon_h"]).any()
    truth = {(r[0], h): r[3 if h == 1 else 4] for r in rows for h in (1, 6)}
    assert all(truth[t.to_pydatetime(), h] == o for t, h, o in zip(got.ts, got.horizon_h, got.obs))
    assert set(got[got.model == "arima"].split) == {"validation", "test"} and set(got[got.model == "ridge"].split) == {"train", "validation", "test"}
    assert got[got.split != "train"].dropna(subset=["sim"]).groupby("model").size().min() >= 2 * 200
    near = got[(got.horizon_h == 1) & (got.split != "train")].dropna(subset=["sim"])
    assert (near.sim - near.obs).abs().max() < 30
    table.unpersist()


def test_round_binary_equals_a_language_s_rounding(spark):
    rng = np.random.default_rng(3)
    values = [0.125, 2.675, 1.005, -0.125, -2.675, 0.0, -0.0, 0.5, 1.5, 2.5, -0.5, 1e17, -3e300, 0.015, 1e-300, None]
    values += [float(v) for v in rng.normal(0, 100, 3000)] + [float(k) / 8 for k in range(-400, 400)] + [(k * 10 + 5) / 1000 for k in range(-2000, 2000)] + [float(np.nextafter(k / 8, np.inf)) for k in range(-99, 99)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(2)
    got = df.select("v", *[exprs.round_binary("v", d).alias(f"r{d}") for d in range(5)]).collect()
    for r in got:
        for d in range(5):
            assert r[f"r{d}"] == (None if r.v is None else round(r.v, d)), (r.v, d)


def test_series_are_written_and_read_by_pattern(spark, tmp_path):
    rows = [(g, datetime(2024, 1, 1, h), None if h == 2 else float(h)) for g in ("g1", "g2", 'a<"&') for h in range(5)]
    rain = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    simulator.write_series(simulator.incremental_rows(rain, 60), str(tmp_path / "s"))
    assert simulator.read_series(spark, str(tmp_path / "s")).count() == 12
    got = simulator.read_series(spark, str(tmp_path / "s"), "//G1/*//1Hour/*/").collect()
    assert sorted((r.ts.hour, r.value) for r in got) == [(h, float(h)) for h in (0, 1, 3, 4)] and {r.units for r in got} == {"MM"}
    assert simulator.read_series(spark, str(tmp_path / "s"), "//g1/FLOW/*/*/*/").count() == 0
    inside = simulator.event_rows(rain.filter("series_id = 'g2'"), F.lit(datetime(2024, 1, 1, 1)).cast("timestamp_ntz"), F.lit(datetime(2024, 1, 1, 3)).cast("timestamp_ntz"), 60)
    assert sorted(r.value for r in inside.collect()) == [1.0, 3.0]
    text = simulator.gauges_xml(rain, "series_id", "f").first().text
    names = [g.get("name") for g in ElementTree.fromstring(text)]
    assert names == ['a<"&', "g1", "g2"]
    control = rain.limit(1).select(simulator.control_xml(F.lit("a&b"), F.col("ts"), F.col("ts")).alias("x")).first().x
    assert ElementTree.fromstring(control).get("name") == "a&b"
