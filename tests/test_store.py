"""A whole run on a store of raw tables: incremental ingestion, layers, backtest and reports."""

from __future__ import annotations

import io
import json
import re
from dataclasses import replace
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from tidegrid import __main__ as cli
from tidegrid.params import Settings, load_tuned
from tidegrid.plans import build, report
from tidegrid.sources import tables as K
from tidegrid.sources.payloads import HttpClient

HALF = timedelta(minutes=30)


def server(calls):
    """Answers like an API that selects half-hours by their ends."""

    def opener(url):
        a, b = (datetime.strptime(x, "%Y-%m-%dT%H:%MZ") for x in re.findall(r"\d{4}-\d\d-\d\dT\d\d:\d\dZ", url))
        calls.append((a, b))
        assert a.year == b.year and b - a < timedelta(days=31)
        stamp, out = "%Y-%m-%dT%H:%MZ", []
        end = a
        while end <= b:
            v = int((end - datetime(2024, 1, 1)) / HALF) % 97 + 100
            out.append({"from": (end - HALF).strftime(stamp), "to": end.strftime(stamp), "intensity": {"forecast": v + 7, "actual": v, "index": "low"}})
            end += HALF
        return io.BytesIO(json.dumps({"data": out}).encode())

    return HttpClient(interval=0, opener=opener, sleep=lambda s: None)


def test_ingestion_asks_only_for_what_is_missing(spark, tmp_path):
    store, calls = str(tmp_path), []
    source, a, b = build.intensity_source("http://x/{start}/{end}"), datetime(2023, 12, 30), datetime(2024, 1, 2, 23, 30)
    assert build.ingest(spark, store, source, server(calls), a, b, dry_run=True) == {"requests": 2, "rows": 0} and not calls
    assert build.ingest(spark, store, source, server(calls), a, b) == {"requests": 2, "rows": 4 * 48}
    assert build.ingest(spark, store, source, server(calls), a, b) == {"requests": 0, "rows": 0}
    build.ingest(spark, store, source, server(calls), a, b + timedelta(days=1))
    assert calls[-1] == (datetime(2024, 1, 3, 0, 30), datetime(2024, 1, 4)) and K.read(spark, store, "raw_intensity").count() == 5 * 48


def weather_server(calls, hole=None):
    """Hourly arrays for whole days, or for previous runs of them."""

    def opener(url):
        a, b, lat, names = re.fullmatch(r"http://w/(\S+)/(\S+)/(\S+)/\S+\?(\S+)", url).groups()
        calls.append((a, b, float(lat), names))
        first, last = (datetime.fromisoformat(x) for x in (a, b))
        hours = [first + timedelta(hours=h) for h in range(((last - first).days + 1) * 24)]
        out = {"time": [t.strftime("%Y-%m-%dT%H:%M") for t in hours]}
        for n in names.split(","):
            out[n] = [None if t == hole else float(lat) + t.hour for t in hours]
        return io.BytesIO(json.dumps({"hourly": out}).encode())

    return HttpClient(interval=0, opener=opener, sleep=lambda s: None)


def test_weather_is_asked_by_site_and_lead_day(spark, tmp_path):
    store, calls, s = str(tmp_path), [], Settings()
    a, b = datetime(2024, 3, 9), datetime(2024, 3, 11, 23)
    url = "http://w/{start}/{end}/{latitude}/{longitude}?{hourly}"
    urls = {"weather_archive": url, "weather_prev_runs": url}
    plan = build.ingest_all(spark, store, urls, s, weather_server(calls), a, b, dry_run=True)
    assert len(plan) == 12 and all(x == {"requests": 1, "rows": 0} for x in plan.values()) and not calls
    assert K.read(spark, store, "raw_weather_locations").count() == 0
    made = build.ingest_all(spark, store, urls, s, weather_server(calls, hole=datetime(2024, 3, 10, 5)), a, b)
    assert sum(x["rows"] for x in made.values()) == 6 * 71 * 4 and len(calls) == 12
    assert sorted(r.location_id for r in K.read(spark, store, "raw_weather_locations").collect()) == sorted(x[0] for x in s.sites)
    assert len(calls[-1][3].split(",")) == 12 and "temperature_2m_previous_day3" in calls[-1][3]
    K.put(K.read(spark, store, "raw_weather_prev_runs").where("not (location_id = 'london' and lead_days = 2 and hour(time_utc) = 7)"), store, "raw_weather_prev_runs")
    again = build.ingest_all(spark, store, urls, s, weather_server(calls), a, b)
    assert again["weather_prev_runs/london"]["requests"] == 1 and again["weather_archive/london"]["requests"] == 1
    got = K.read(spark, store, "raw_weather_prev_runs")
    assert got.count() == 6 * 72 * 3 and got.where("location_id = 'london' and wind_speed_100m >= 51.5").count() == 72 * 3
    done = build.ingest_all(spark, store, urls, s, weather_server(calls), a, b)
    assert not any(x["requests"] for x in done.values())
    with pytest.raises(ValueError):
        build.ingest_all(spark, store, {"tides": url}, s, weather_server(calls), a, b)


def test_build_backtest_and_reports(spark, tmp_path, capsys):
    store, s = str(tmp_path / "store"), tmp_path / "settings.yaml"
    own = Settings(start=datetime(2024, 1, 1), n_search=1, max_rounds=5, early_stopping=5, variants=tuple(replace(v, train_start=datetime(2024, 1, 1)) for v in Settings().variants))
    own.dump(s)
    assert Settings.load(s) == own
    n = 75 * 48
    slots = spark.range(n).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 1800).cast("timestamp_ntz").alias("period_start_utc"), "id")
    now = F.lit(datetime(2024, 6, 1)).cast("timestamp_ntz").alias("ingested_at_utc")
    end = (F.col("period_start_utc") + F.expr("interval 30 minutes")).alias("period_end_utc")
    K.put(slots.where("id not between 700 and 705").select("period_start_utc", end, (F.col("id") % 97 + 107).cast("int").alias("forecast_gco2"), F.when(F.col("id") != 900, F.col("id") % 97 + 100).otherwise(0).cast("int").alias("actual_gco2"), F.lit("low").alias("intensity_index"), now), store, "raw_intensity")
    K.put(slots.select("period_start_utc", end, F.explode(F.array(*map(F.lit, build.FUELS))).alias("fuel"), (F.col("id") % 11).cast("double").alias("perc"), now), store, "raw_generation")
    sites = spark.createDataFrame([("a", "A", "wind", 1.0, 1.0), ("b", "B", "solar", 2.0, 2.0), ("c", "C", "demand", 3.0, 3.0)], K.RAW["raw_weather_locations"][0])
    assert K.load(spark, store, "raw_weather_locations", sites) == 3
    w = slots.where("id % 2 = 0").crossJoin(sites.select("location_id")).select("location_id", F.col("period_start_utc").alias("time_utc"), *[(F.col("id") % k).cast("double").alias(c) for k, c in ((13, "wind_speed_100m"), (400, "shortwave_radiation"), (20, "temperature_2m"), (100, "cloud_cover"))], now)
    K.put(w, store, "raw_weather_archive")
    K.put(w.withColumn("wind_speed_100m", F.col("wind_speed_100m") + 1), store, "raw_weather_hist_forecast")
    K.put(w.withColumn("lead_days", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select(K.read(spark, store, "raw_weather_prev_runs").columns), store, "raw_weather_prev_runs")
    base = ["--store", store, "--settings", str(s)]
    cli.main(["features", *base])
    counts = {name: spark.read.parquet(f"{store}/{name}").count() for name in build.LAYERS}
    assert counts["feat_history"] == n and counts["calendar"] == n + 96 and counts["training_set"] % 49 == 0 and counts["training_set"] > 0
    t = build.training_set(spark, store, datetime(2024, 1, 20), datetime(2024, 1, 25), labelled=True)
    assert not [c for c in t.columns if c.startswith("asof_")] and t.agg(F.min("origin_time_utc")).first()[0] == datetime(2024, 1, 20)
    assert "origin_month" in t._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]
    cli.main(["quality", *base, "--out", str(tmp_path / "q.md")])
    text = (tmp_path / "q.md").read_text()
    assert "actual = 0" in text and "| 6 |" in text
    with pytest.raises(FileNotFoundError):
        cli.main(["backtest", *base, "--start", "2024-03-04", "--end", "2024-03-14"])
    cli.main(["tune", *base, "--start", "2024-02-20", "--end", "2024-03-01", "--n-search", "2"])
    tuned = load_tuned(f"{store}/tuned.yaml")
    assert set(tuned) == {"no_weather", "weather_forecast"} and all(1 <= t["rounds"] <= 5 for t in tuned.values())
    assert spark.read.parquet(f"{store}/tuning_trials").count() == 4
    cli.main(["backtest", *base, "--start", "2024-03-04", "--end", "2024-03-14"])
    doc = tmp_path / "doc.md"
    doc.write_text("before\n<!-- overall:start -->\nold\n<!-- overall:end -->\nafter\n")
    for _ in range(2):
        cli.main(["evaluate", *base, "--out", str(tmp_path / "e.md"), "--figures", str(tmp_path / "f"), "--document", str(doc)])
        assert "old" not in doc.read_text() and "weather_forecast" in doc.read_text() and doc.read_text().endswith("after\n")
    text = (tmp_path / "e.md").read_text()
    wanted = ("weather_forecast", "oracle_weather", "no_weather_short", "seasonal_naive_day", "stored_forecast", "coverage conformal by fold", "by wind regime", "by local hour", "calibration", "months won", "importance", "residuals")
    assert [x for x in wanted if x not in text] == []
    figures = {f.name: f.read_text() for f in (tmp_path / "f").iterdir()}
    assert {"mae_by_horizon.svg", "residuals.svg", "error_by_hour.svg", "error_by_season.svg", "error_by_wind_regime.svg", "feature_importance_weather_forecast.svg"} <= set(figures)
    assert all(ElementTree.fromstring(x).tag.endswith("svg") for x in figures.values())
    folds = spark.read.parquet(f"{store}/backtest_interval_calibration").collect()
    assert folds and all(r.variant == "weather_forecast" and r.calibration_start < r.fold_start for r in folds)
    cli.main(["explore", *base, "--start", "2024-03-06", "--out", str(tmp_path / "x.html")])
    assert all(x in (tmp_path / "x.html").read_text() for x in ("<svg", "Scores in the window", "conformal"))
    assert K.missing(spark, store, [*report.REQUIRED, "other"]) == ["other"]
    with pytest.raises(ValueError):
        report.explorer(spark, str(tmp_path / "none"), datetime(2024, 1, 1), datetime(2024, 1, 2), 12, [])
    got = spark.read.parquet(f"{store}/backtest_results")
    a, b = report.target_range(got)
    assert a < b and report.window(got.select("target_time_utc", "y_actual", "p"), a, b, ["p"]).first().n > 0
    with pytest.raises(SystemExit):
        cli.main(["ingest", *base])
