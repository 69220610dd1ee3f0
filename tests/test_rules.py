"""Golden values of calendars, gaps, upserts, payloads, conformal ranks and the training set's promises."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions.columns import bank_holidays, bin_start, wind_power
from tidegrid.operators import metrics as M
from tidegrid.operators import series as S
from tidegrid.operators import training as T
from tidegrid.params import Settings, feature_columns
from tidegrid.plans import backtest as B
from tidegrid.plans.gbm import Booster, Params
from tidegrid.sources import payloads as P
from tidegrid.sources import tables as K


@pytest.mark.parametrize("day,n", [(date(2019, 3, 31), 46), (date(2019, 10, 27), 50), (date(2026, 3, 29), 46), (date(2026, 10, 25), 50), (date(2024, 1, 10), 48)])
def test_periods_of_a_local_day(spark, day, n):
    d = datetime(day.year, day.month, day.day)
    c = S.calendar(S.spine(spark, d - timedelta(hours=2), d + timedelta(hours=26))).where(F.col("uk_date") == day).orderBy("period").collect()
    assert len(c) == n and {r.periods_in_uk_day for r in c} == {n} and [r.settlement_period for r in c] == list(range(1, n + 1))


def test_holidays():
    h = {(d, r) for d, r, _ in bank_holidays(2024, 2024)}
    assert {(date(2024, 3, 29), "ENG"), (date(2024, 3, 29), "SCT"), (date(2024, 4, 1), "ENG")} <= h
    assert (date(2024, 4, 1), "SCT") not in h and not {(date(2024, 4, 3), r) for r in ("ENG", "SCT")} & h


def test_missing_ranges(spark):
    day = datetime(2020, 1, 1)
    holes = {20, 21, *range(41, 48)}
    present = spark.createDataFrame([(day + timedelta(minutes=30 * i),) for i in range(48) if i not in holes], "ts timestamp_ntz")
    for chunk in (4096, 7, 1):
        got = sorted(S.missing_ranges(present, day, day + timedelta(hours=23, minutes=30), chunk_slots=chunk).collect())
        assert [(r.first.hour, r.last.hour, r.n) for r in got] == [(10, 10, 2), (20, 23, 7)]


def test_chunks():
    step, day = timedelta(minutes=30), datetime(2020, 1, 1)
    out = S.plan_chunks([(day, day + timedelta(days=100) - step)], step, timedelta(days=30))
    assert len(out) == 4 and all(b + step == c for (_, b), (c, _) in zip(out, out[1:]))
    near = S.plan_chunks([(day, day), (day + timedelta(days=1), day + timedelta(days=1)), (day + timedelta(days=200), day + timedelta(days=200))], step, timedelta(days=30))
    assert len(near) == 2
    assert S.split_at_year_end([(datetime(2019, 12, 27), datetime(2020, 1, 25, 23, 30))]) == [(datetime(2019, 12, 27), datetime(2019, 12, 31, 23)), (datetime(2019, 12, 31, 23, 30), datetime(2020, 1, 25, 23, 30))]


def test_upsert_keeps_values(spark, tmp_path):
    at = datetime(2024, 1, 1)
    row = lambda v, hour: (at, at + timedelta(minutes=30), 5, v, "low", at + timedelta(hours=hour))
    schema = K.RAW["raw_intensity"][0]
    for v, hour, expected in ((7, 1, 7), (None, 2, 7), (999, 3, 999)):
        assert K.load(spark, str(tmp_path), "raw_intensity", spark.createDataFrame([row(v, hour)], schema)) == 1
        got = K.read(spark, str(tmp_path), "raw_intensity").collect()
        assert len(got) == 1 and got[0].actual_gco2 == expected and got[0].ingested_at_utc == at + timedelta(hours=hour)
    twice = spark.createDataFrame([row(1, 4), row(2, 5)], schema)
    K.load(spark, str(tmp_path), "raw_intensity", twice)
    assert [r.actual_gco2 for r in K.read(spark, str(tmp_path), "raw_intensity").collect()] == [2]


def test_payload_without_data_is_an_error(spark):
    with pytest.raises(Exception, match="payload without data"):
        P.intensity(spark.createDataFrame([('{"error": 1}',)], "payload string")).collect()


def test_http_client_repeats():
    import io
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"}, None), OSError("gone"), io.BytesIO(b"not json"), io.BytesIO(b'{"a": 1}')]

    def opener(url):
        assert url.endswith("?v=a,b")
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    c = P.HttpClient(interval=0, opener=opener, sleep=waits.append, clock=lambda: 0.0)
    assert c.get_json("http://x", {"v": "a,b"}) == {"a": 1} and waits[0] == 7 and len(waits) == 3


def test_report_text():
    assert K.markdown_table(["a", "b"], [(1234, True), (None, 0.5)]).splitlines()[2:] == ["| 1,234 | True |", "|  | 0.500 |"]
    text = "x\n<!-- t:start -->\nold\n<!-- t:end -->\n"
    once = K.replace_block(text, "t", "new")
    assert "new" in once and "old" not in once and K.replace_block(once, "t", "new") == once
    with pytest.raises(ValueError):
        K.replace_block(text, "u", "")


def test_feature_guards():
    cols = ["y_a", "f_a", "wxf_b", "oracle_c", "asof_d"]
    assert feature_columns(cols, ["f_", "wxf_"]) == ["f_a", "wxf_b"]
    for bad in (["y_"], ["asof_"], ["oracle_"], ["nothing_"]):
        with pytest.raises(ValueError):
            feature_columns(cols, bad)
    assert feature_columns(cols, ["oracle_"], allow_leaky=True) == ["oracle_c"]


def test_power_curve(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 3.0, 7.5, 12.0, 24.9, 25.0)], "v double")
    got = [r[0] for r in df.select(wind_power(F.col("v"), 3.0, 12.0, 25.0)).collect()]
    assert got[0] is None and got[1] == 0 and got[2] == 0 and 0 < got[3] < 1 and got[4:] == [1, 1, 0]


def test_rules_of_the_grid(spark):
    s = Settings()
    g = {r.horizon_h: r for r in T.grid(S.spine(spark, datetime(2024, 3, 20), datetime(2024, 4, 12, 23, 30)), s).where(F.col("origin_time_utc") == datetime(2024, 4, 5, 12)).collect()}
    assert len(g) == 49 and all(r.cutoff_utc == datetime(2024, 4, 5, 10, 30) for r in g.values())
    assert {h for h, r in g.items() if r.seasonal_days == 2} == {h for h in g if h <= 46.5}
    assert {h for h, r in g.items() if r.lead == 2} == {h for h in g if h <= 39.5}


def _world(spark, after=None):
    """A small synthetic database; with ``after`` everything published later than that origin is corrupted."""
    s = Settings(start=datetime(2024, 3, 20))
    slots = S.spine(spark, s.start, datetime(2024, 4, 12, 23, 30))
    n = F.expr("unix_seconds(cast(period as timestamp)) div 1800")
    gap = F.col("period").between(datetime(2024, 4, 4, 13), datetime(2024, 4, 4, 15, 30))
    late = F.lit(False) if after is None else F.col("period") > F.lit(after - timedelta(minutes=90)).cast("timestamp_ntz")
    raw = slots.where(~gap).select("period", F.when(F.col("period") == F.lit(datetime(2024, 4, 4, 20)).cast("timestamp_ntz"), 0.0).otherwise(100 + n % 97 + F.when(late, 300).otherwise(0)).alias("actual"), (107.0 + n % 97).alias("forecast"))
    staged = T.stage_intensity(raw, s.suspect_max)
    kinds = ("gas", "wind", "solar", "nuclear", "imports")
    mix = slots.select("period", *[(F.lit(float(10 * i)) + n % 11 + F.when(late, 5).otherwise(0)).alias(f"{k}_pct") for i, k in enumerate(kinds)])
    hist = S.history(slots.join(staged.select("period", F.col("actual").alias("intensity")), "period", "left").join(mix, "period", "left"))
    hours = slots.where("minute(period) = 0").select(F.col("period").alias("time")).crossJoin(spark.createDataFrame([(f"L{i}", r, i) for i, r in enumerate(("wind", "wind", "solar", "demand"))], "location_id string, role string, k int"))
    h = F.expr("unix_seconds(cast(time as timestamp)) div 3600")
    x = hours.withColumn("lead_days", F.explode(F.array(*map(F.lit, range(4)))))
    seen = F.lit(False) if after is None else F.when(F.col("lead_days") == 0, F.col("time") > F.lit(after - timedelta(minutes=90)).cast("timestamp_ntz")).otherwise(
        F.col("time") - F.make_dt_interval(F.col("lead_days")) + F.expr("interval 8 hours") > F.lit(after).cast("timestamp_ntz"))
    bad = F.when(seen, 50.0).otherwise(0.0)
    w = x.select("lead_days", "location_id", "time", (5 + h % 13 + F.col("k") + F.col("lead_days") + bad).cast("double").alias("wind"), (h % 24 * 10 + bad).cast("double").alias("ghi"), (8 + h % 7 + bad).cast("double").alias("temp"), (h % 100 * 1.0).alias("cloud"))
    weather = T.weather_by_role(T.align_weather(slots, w), hours.select("location_id", "role").distinct(), s)
    spine = S.spine(spark, *S.bounds(slots, "period", s.start))
    assert spine.count() == 1248 and hist.count() == 1152
    cal = S.calendar(spine, S.holidays(spark, 2024, 2024))
    return T.training_set(cal, staged, hist, weather, s), hist


def test_nothing_later_than_the_origin_is_seen(spark):
    origin = datetime(2024, 4, 5, 12)
    at = F.col("origin_time_utc") == F.lit(origin).cast("timestamp_ntz")
    clean, hist = _world(spark)
    dirty, _ = _world(spark, origin)
    a, b = (x.where(at).orderBy("horizon_h").toPandas() for x in (clean, dirty))
    assert len(a) == 49 and clean.count() == 64 * 49
    for c in a.columns:
        same = a[c].equals(b[c])
        assert same if c.startswith(("f_", "wxf_", "asof_")) else True, c
    assert not a.y_actual.equals(b.y_actual) and not a.oracle_wind_mean.equals(b.oracle_wind_mean)
    assert all(r.late == 0 and r.missing == 0 for r in T.violations(clean).collect())
    r = hist.where(F.col("period") == F.lit(datetime(2024, 4, 5, 10, 30)).cast("timestamp_ntz")).first()
    assert r.intensity_obs_24h == 41


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (0.0, 5.0)], "y double, p double")
    r = df.agg(*M.errors(F.col("y"), F.col("p"))).first()
    assert r.n == 3 and r.mae == pytest.approx(35 / 3) and r.rmse == pytest.approx(175**0.5) and r.mape == pytest.approx(10)
    assert B.conformal_adjustment(np.arange(1.0, 10), 0.2) == 8 and B.conformal_adjustment(np.arange(1.0, 10), 0.5) == 5
    assert B.conformal_adjustment(np.arange(1.0, 10), 0.05) == float("inf") == B.conformal_adjustment(np.zeros(0), 0.2)
    cov = spark.createDataFrame([(24.0, 5.0, 2.0, 10.0), (24.0, 0.0, 2.0, 10.0), (30.0, 12.0, 2.0, 10.0), (30.0, None, 0.0, 1.0)], "horizon_h double, y_actual double, lo double, hi double")
    rows = {r.horizons: r for r in M.coverage(cov, "lo", "hi").collect()}
    assert rows["all"].n == 3 and rows["24-30"].coverage == 50 and rows["30-36"].above == 100
    assert M.window_coverage(cov.where("y_actual is null"), "lo", "hi").first().coverage is None
    with pytest.raises(ValueError):
        M.day_ahead(df, 5, ["p"])


def test_month_edges():
    assert T.month_starts(datetime(2025, 10, 1), datetime(2026, 1, 15, 18))[-1] == datetime(2026, 2, 1)
    assert T.month_offset(datetime(2025, 10, 1), -6) == datetime(2025, 4, 1) and T.month_offset(datetime(2025, 2, 1), -3) == datetime(2024, 11, 1)


def test_trees_learn_and_repeat():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    x[::7, 2] = np.nan
    y = 3 * x[:, 0] + np.where(np.isnan(x[:, 2]), 5, 0) + rng.normal(size=1500) * 0.1
    a, b = (Booster(Params(rounds=80)).fit(x, y) for _ in range(2))
    assert np.array_equal(a.predict(x), b.predict(x)) and np.abs(a.predict(x) - y).mean() < 0.5
    assert a.gain(4).argmax() == 0 and np.abs(a.contributions(x)).mean(0).argmax() == 0
    lo, hi = (Booster(Params(objective="quantile", alpha=q, rounds=80)).fit(x, y).predict(x) for q in (0.1, 0.9))
    assert 0.7 < ((y >= lo) & (y <= hi)).mean() < 0.95
    stopped = Booster(Params(rounds=500, rate=0.3)).fit(x[:200], y[:200], x[200:], y[200:], patience=10)
    assert stopped.best < 500


def test_backtest_protocol(spark):
    t, _ = _world(spark)
    edges = [(datetime(2024, 4, 8), datetime(2024, 4, 12))]
    v = [B.Variant("plain", ("f_",), datetime(2024, 3, 20), quantiles=True)]
    s = Settings(calibration_months=0)
    got = B.run(t, edges, v, {"plain": Params(rounds=5, depth=2)}, s).toPandas()
    assert (got.origin_time_utc >= "2024-04-08").all() and got.p.notna().all()
    dealt = B.dealt(t, edges, v, ["f_intensity_latest"])
    assert dealt.where("is_train and target_time_utc >= fold_start").count() == 0


def test_streams(spark, tmp_path):
    from tidegrid.streaming import ingest as I

    at = datetime(2024, 1, 1)
    rows = [(at + timedelta(minutes=10 * i), float(i)) for i in range(12)]
    spark.createDataFrame(rows, "ts timestamp_ntz, value double").select(F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("ts timestamp, value double").parquet(f"{tmp_path}/events")
    q = I.half_hours(stream).writeStream.outputMode("complete").format("memory").queryName("halves").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.mean) for r in spark.table("halves").collect()) == [(3, 1.0), (3, 4.0), (3, 7.0), (3, 10.0)]
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.json").write_text('{"data": [{"from": "2024-10-27T00:30Z", "to": "2024-10-27T01:00Z", "intensity": {"forecast": 1, "actual": 2, "index": "low"}}]}')
    for _ in range(2):
        I.ingest_payloads(spark, f"{tmp_path}/land", f"{tmp_path}/store", f"{tmp_path}/ck").awaitTermination()
    got = K.read(spark, f"{tmp_path}/store", "raw_intensity").collect()
    assert len(got) == 1 and got[0].period_start_utc == datetime(2024, 10, 27, 0, 30) and got[0].actual_gco2 == 2


def test_bins(spark):
    r = spark.createDataFrame([(datetime(2024, 1, 1, 10, 44, 59),)], "t timestamp_ntz").select(bin_start(F.col("t"), 1800)).first()
    assert r[0] == datetime(2024, 1, 1, 10, 30)
