"""Rules that hold at any size: order statistics by counting, gaps across chunks, the last row of a batch, replaced tables, the calendar."""

from __future__ import annotations

import itertools
import math
import random
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import metrics as M
from tidegrid.operators import series as S
from tidegrid.plans import figures as G
from tidegrid.plans.gbm import Booster, Params
from tidegrid.sources import tables as K
from tidegrid.streaming import ingest as I


@pytest.mark.parametrize("passes,buckets", [(2, 4096), (1, 3), (0, 1)])
def test_kth_smallest(spark, passes, buckets):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1) for _ in range(200)], "b": [5.0] * 50, "c": [1.0], "d": [0.0] * 30 + [1e9, -1e9] + [rng.random() for _ in range(40)]}
    rows = spark.createDataFrame([(g, v) for g, xs in groups.items() for v in [*xs, None]], "g string, v double")
    wanted = [(g, str(k), k) for g, xs in groups.items() for k in {1, 2, len(xs) // 2, len(xs), len(xs) + 1} if k > 0]
    got = M.kth(rows, "v", spark.createDataFrame(wanted, "g string, tag string, k long"), ["g"], passes, buckets).collect()
    assert {(r.g, r.tag): r.v for r in got} == {(g, t): sorted(groups[g])[k - 1] for g, t, k in wanted if k <= len(groups[g])}


def test_quantiles(spark):
    xs = [float(x * x % 101) for x in range(77)]
    rows = spark.createDataFrame([(i % 2, x) for i, x in enumerate(xs)] + [(2, None)], "g int, v double")
    r = M.quantiles(rows, "v", {"q1": 1 / 3, "q2": 0.5, "q3": 1.0}).first()
    assert [r.q1, r.q2, r.q3] == pytest.approx(list(np.quantile(xs, [1 / 3, 0.5, 1])))
    assert {r.g: r.m for r in M.quantiles(rows, "v", {"m": 0.5}, ["g"]).collect()} == {g: pytest.approx(np.median(xs[g::2])) for g in (0, 1)}
    assert M.quantiles(rows.where("v is null"), "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("chunk", [1, 4, 7, 4096])
def test_gaps_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    start, step = datetime(2024, 1, 1), timedelta(minutes=30)
    have = {k: {i for i in range(100) if rng.random() < p} for k, p in (("a", 0.5), ("b", 0.05), ("c", 0.97))}
    rows = spark.createDataFrame([(k, start + i * step) for k, xs in have.items() for i in xs for _ in (0, 1)] + [("d", start - step)], "k string, ts timestamp_ntz")

    def plain(xs):
        out = []
        for i in range(100):
            if i not in xs:
                if out and out[-1][1] == i - 1:
                    out[-1][1] = i
                else:
                    out.append([i, i])
        return {(start + a * step, start + b * step, b - a + 1) for a, b in out}

    got = S.missing_ranges(rows, start, start + 99 * step, keys=["k"], chunk_slots=chunk).collect()
    for k in "abcd":
        assert {(r.first, r.last, r.n) for r in got if r.k == k} == plain(have.get(k, set()))
    one = S.missing_ranges(rows.where("k = 'a'").select("ts"), start, start + 99 * step, chunk_slots=chunk).collect()
    assert {(r.first, r.last, r.n) for r in one} == plain(have["a"])


def test_last_of_equals_wins(spark):
    rows = [(1, "a", 5), (1, "b", 5), (2, "x", None), (2, "y", None), (3, "late", 9), (3, "early", 1), (4, None, 2), (4, "z", None)]
    df = spark.createDataFrame(rows, "k int, v string, at int").coalesce(1)
    assert {r.k: r.v for r in K.latest(df, ["k"], "at").collect()} == {1: "b", 2: "y", 3: "late", 4: None}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    store = str(tmp_path)
    K.write(spark.range(5), store, "t", ["id"])
    with pytest.raises(Exception):
        K.write(spark.range(3).select(F.raise_error(F.lit("broken")).alias("id")), store, "t")
    assert spark.read.parquet(f"{store}/t").count() == 5
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that ended between both renames
    K.write(spark.range(7), store, "t")
    assert spark.read.parquet(f"{store}/t").count() == 7 and not (tmp_path / "t.old").exists()
    assert K.missing(spark, store, ["t", "u"]) == ["u"]


def test_calendar_equals_plain_python(spark):
    """Every half-hour of 2019 to 2026 against the time zone database of Python."""
    zone, utc = ZoneInfo("Europe/London"), timezone.utc
    rows = S.calendar(S.spine(spark, datetime(2019, 1, 1), datetime(2026, 12, 31, 23, 30))).select("period", "uk_date", "settlement_period", "periods_in_uk_day", "local_hour", "is_dst").collect()
    day = lambda d: datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(utc)
    bounds = {}
    for r in rows:
        local = r.period.replace(tzinfo=utc).astimezone(zone)
        if local.date() not in bounds:
            bounds[local.date()] = day(local.date()), day(local.date() + timedelta(days=1))
        a, b = bounds[local.date()]
        assert r.uk_date == local.date() and r.settlement_period == (r.period.replace(tzinfo=utc) - a) // timedelta(minutes=30) + 1
        assert r.periods_in_uk_day == (b - a) // timedelta(minutes=30) and r.local_hour == local.hour + local.minute / 60 and r.is_dst == bool(local.dst())
    assert len(bounds) >= 365 * 8 and bounds[date(2024, 3, 31)][1] - bounds[date(2024, 3, 31)][0] == timedelta(hours=23)


def test_contributions_are_shapley_values():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    x[::9, 1] = np.nan
    y = x[:, 0] * 2 + np.nan_to_num(x[:, 1]) * x[:, 2] + rng.normal(size=300) * 0.1
    for objective in ("l2", "l1", "quantile"):
        m = Booster(Params(rounds=4, depth=3, min_leaf=5, objective=objective, alpha=0.9)).fit(x, y)
        b, got = m._bin(x[:6]), m.contributions(x[:6])

        def value(t, node, row, known):
            f = t.feature[node]
            if f < 0:
                return t.value[node]
            left, right = 2 * node + 1, 2 * node + 2
            if f in known:
                v = b[row, f]
                return value(t, left if (t.missing_left[node] if v == 0 else v <= t.cut[node]) else right, row, known)
            return (value(t, left, row, known) * t.count[left] + value(t, right, row, known) * t.count[right]) / t.count[node]

        for row, f in itertools.product(range(6), range(4)):
            rest = [g for g in range(4) if g != f]
            want = sum(
                math.factorial(k) * math.factorial(3 - k) / 24 * sum(value(t, 0, row, {*c, f}) - value(t, 0, row, set(c)) for t in m.trees)
                for k in range(4) for c in itertools.combinations(rest, k)
            )
            assert got[row, f] == pytest.approx(want, abs=1e-9)
        assert got.sum(1) + m.base() == pytest.approx(m.predict(x[:6]))


def test_streams_of_statistics_and_first_rows(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(i % 9, at + timedelta(minutes=20 * i), float(i % 7)) for i in range(150)]
    spark.createDataFrame(rows, "id int, ts timestamp_ntz, value double").select("id", F.col("ts").cast("timestamp").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema("id int, ts timestamp, value double").parquet(f"{tmp_path}/events")
    for name, df, mode in (("days", I.day_statistics(stream), "complete"), ("firsts", I.first_of_each(stream, ["id"], late="10 days"), "append")):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    got = {r.start: r for r in spark.table("days").collect()}
    for k in (0, 10, 40):
        start = at + timedelta(hours=k)
        inside = [v for _, t, v in rows if start <= t < start + timedelta(days=1)]
        r = got[start]
        assert (r.n, r.min, r.max) == (len(inside), min(inside), max(inside)) and r.mean == pytest.approx(sum(inside) / len(inside))
    assert sorted(r.id for r in spark.table("firsts").collect()) == list(range(9))


def test_ticks():
    assert G.ticks(0, 10, 5) == [0, 2, 4, 6, 8, 10] and G.ticks(3, 3) == [3] and 3 <= len(G.ticks(-0.013, 0.04)) <= 10 and 3 <= len(G.ticks(0, 54321)) <= 10
