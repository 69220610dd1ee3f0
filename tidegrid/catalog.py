"""The catalogue of queries over the driver's tables, each with DuckDB SQL where SQL can express it.

Events stand in for measured series: half-hour means of ``value`` for intensity, shares of event types for the mix, hourly
means by user_id % 6 for weather at six sites. Doubles are rounded to 6 digits on both sides, whole numbers are BIGINT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.columns import bank_holidays, bin_start, wind_power
from tidegrid.operators import metrics as M
from tidegrid.operators import series as S
from tidegrid.operators import training as T
from tidegrid.params import Settings
from tidegrid.plans import backtest as B
from tidegrid.plans.gbm import Params
from tidegrid.sources import payloads as P
from tidegrid.sources import tables as K

SET = Settings(start=datetime(2024, 1, 1), suspect_max=300.0)
KINDS = {"gas": "click", "wind": "view", "solar": "purchase", "nuclear": "signup", "imports": "error"}
ROLES = ["wind", "wind", "wind", "solar", "solar", "demand"]
MODELS = ["persistence", "seasonal_naive_day", "seasonal_naive_week", "stored_forecast"]
HOLIDAYS = (1995, 2024)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def finish(df: DataFrame) -> DataFrame:
    """Doubles to 6 digits (ties up), whole numbers to BIGINT."""
    shown = {"double": lambda c: (F.round(c + 1e-9, 6) + F.lit(0.0)), "int": lambda c: c.cast("long"), "tinyint": lambda c: c.cast("long"), "smallint": lambda c: c.cast("long")}
    return df.select(*[shown.get(t, lambda c: c)(F.col(c)).alias(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = lambda spark, sf_dir: finish(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


class Tables:
    """The stand-in tables of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.read("events").select("event_id", "user_id", "event_type", "value", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), bin_start(F.col("ts"), 1800).alias("period"))

    def parts(self) -> DataFrame:
        """(period, parts): each half-hour's sums by event type and site. Mix, weather and intensity are all made of it, so that one
        exchange serves all branches of a plan and events are scanned once."""
        even = F.sum(F.when(F.col("event_id") % 2 == 0, F.col("cents"))).alias("even")
        fine = self.events().groupBy("period", "event_type", (F.col("user_id") % 6).alias("site")).agg(F.sum("cents").alias("cents"), even, F.count("*").alias("n"))
        return fine.groupBy("period").agg(F.collect_list(F.struct("event_type", "site", "cents", "even", "n")).alias("parts"))

    def raw(self) -> DataFrame:
        total = lambda f: F.aggregate(F.transform(F.filter("parts", lambda x: f(x).isNotNull()), f), F.lit(0).cast("long"), lambda a, x: a + x)
        n = F.lit(100.0) * total(lambda x: x.n)
        even = F.when(F.exists("parts", lambda x: x.even.isNotNull()), total(lambda x: x.even))
        return self.parts().select("period", (total(lambda x: x.cents) / n).alias("actual"), (even / n).alias("forecast"))

    def mix(self) -> DataFrame:
        kind = F.coalesce(*[F.when(F.col("x.event_type") == v, F.lit(k)) for k, v in KINDS.items()])
        all_ = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x.n)
        by = self.parts().select("period", all_.alias("n"), F.explode("parts").alias("x")).groupBy("period", "n", kind.alias("fuel")).agg(F.sum("x.n").alias("k"))
        return by.select("period", "fuel", (F.lit(100.0) * F.col("k") / F.col("n")).alias("perc"))

    def slots(self) -> DataFrame:
        last = self.read("events").agg(bin_start(F.max("ts"), 1800)).first()[0]
        return S.spine(self.spark, SET.start, last)

    def calendar(self) -> DataFrame:
        return S.calendar(self.slots(), S.holidays(self.spark, *HOLIDAYS))

    def staged(self) -> DataFrame:
        return T.stage_intensity(self.raw(), SET.suspect_max)

    def series(self) -> DataFrame:
        s = self.slots().join(self.staged(), "period", "left").join(T.stage_mix(self.mix(), list(KINDS)), "period", "left")
        return s.withColumnRenamed("actual", "intensity").drop("forecast", "actual_is_suspect", "forecast_is_suspect")

    def history(self) -> DataFrame:
        return S.history(self.series())

    def weather(self) -> DataFrame:
        w = self.parts().select("period", F.explode("parts").alias("x")).groupBy(F.concat(F.lit("L"), F.col("x.site")).alias("location_id"), bin_start(F.col("period"), 3600).alias("time"))
        w = w.agg((F.sum("x.cents") / (F.lit(100.0) * F.sum("x.n"))).alias("v"), F.sum("x.n").alias("n"))
        w = w.select("location_id", "time", (F.col("v") / 20).alias("wind"), F.col("v").alias("ghi"), (F.col("v") / 10 - 5).alias("temp"), (F.col("n") * 10 % 100).cast("double").alias("cloud"))
        ahead = w.withColumn("lead_days", F.explode(F.array(*map(F.lit, SET.lead_days))))
        ahead = ahead.withColumns({c: F.col(c) + F.col("lead_days") for c in ("wind", "ghi", "temp")})
        return T.stage_weather(w, ahead)

    def locations(self) -> DataFrame:
        return self.spark.createDataFrame([(f"L{i}", r) for i, r in enumerate(ROLES)], "location_id string, role string")

    def aligned(self) -> DataFrame:
        return T.align_weather(self.slots(), self.weather())

    def by_role(self) -> DataFrame:
        return T.weather_by_role(self.aligned(), self.locations(), SET)

    def training(self) -> DataFrame:
        return T.training_set(self.calendar(), self.staged(), self.history(), self.by_role(), SET)

    def light(self) -> DataFrame:
        """Grid, targets and baselines: the part of the training set that the metrics need."""
        empty = self.spark.createDataFrame([], "period timestamp_ntz, lead_days int, " + ", ".join(f"{c} double" for c in T.WEATHER))
        past = self.series()
        past = past.select("*", *[F.lit(None).cast("double").alias(c) for c in T.HISTORY if c not in past.columns])
        return T.training_set(S.calendar(self.slots(), S.holidays(self.spark, *HOLIDAYS)), self.staged(), past, empty, SET)

    def baselines(self) -> DataFrame:
        return T.baselines(self.light())

    def banded(self) -> DataFrame:
        b = self.baselines()
        return b.withColumns({"lo": F.col("persistence") - 60, "hi": F.col("persistence") + 40, "fold": F.date_trunc("week", "origin_time_utc").cast("timestamp_ntz")})


def cols(names: str) -> str:
    """Output columns: name, name:d (double) or name:i (whole number)."""
    out = []
    for n in names.split():
        c, _, kind = n.partition(":")
        out.append(f"round({c} + 1e-9, 6) + 0.0 AS {c}" if kind == "d" else f"{c}::BIGINT AS {c}" if kind == "i" else c)
    return ", ".join(out)


def sql(names: str, frm: str, *ctes: str) -> str:
    return ("WITH " + ", ".join(ctes) if ctes else "") + f" SELECT {cols(names)} FROM {frm}"


EV = """ev AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) AS period,
 make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS hour FROM events)"""
RAW = """raw AS (SELECT period, sum(cents) / (100.0::DOUBLE * count(*)) AS actual, sum(CASE WHEN event_id % 2 = 0 THEN cents END) / (100.0::DOUBLE * count(*)) AS forecast FROM ev GROUP BY period)"""
STG = """stg AS (SELECT period, CASE WHEN NOT (actual = 0 OR actual > 300) THEN actual END AS actual, CASE WHEN NOT (forecast = 0 OR forecast > 300) THEN forecast END AS forecast,
 coalesce(actual = 0 OR actual > 300, false) AS actual_is_suspect, coalesce(forecast = 0 OR forecast > 300, false) AS forecast_is_suspect FROM raw)"""
SLOTS = "slots AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', (SELECT max(period) FROM raw), INTERVAL 30 MINUTE)) AS period)"
_CASE = " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in KINDS.items())
MIX = f"""mix AS (SELECT period, CASE event_type {_CASE} END AS fuel, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY period) AS perc FROM ev GROUP BY period, event_type)"""
WIDE = "wide AS (SELECT period, " + ", ".join(f"max(perc) FILTER (WHERE fuel = '{k}') AS {k}_pct" for k in KINDS) + " FROM mix GROUP BY period)"
SERIES = "series AS (SELECT slots.period, stg.actual AS intensity, wide.* EXCLUDE (period) FROM slots LEFT JOIN stg USING (period) LEFT JOIN wide USING (period))"
_DAY, _WEEK = ("RANGE BETWEEN INTERVAL '23 hours 30 minutes' PRECEDING AND CURRENT ROW", "RANGE BETWEEN INTERVAL '167 hours 30 minutes' PRECEDING AND CURRENT ROW")
HIST = f"""hist AS (SELECT *, lag(intensity, 48) OVER o AS intensity_minus_24h, lag(intensity, 336) OVER o AS intensity_minus_168h,
 avg(intensity) OVER d AS intensity_mean_24h, stddev_samp(intensity) OVER d AS intensity_std_24h, min(intensity) OVER d AS intensity_min_24h, max(intensity) OVER d AS intensity_max_24h, count(intensity) OVER d AS intensity_obs_24h,
 avg(intensity) OVER w AS intensity_mean_7d, stddev_samp(intensity) OVER w AS intensity_std_7d, count(intensity) OVER w AS intensity_obs_7d,
 wind_pct - lag(wind_pct, 48) OVER o AS wind_pct_change_24h, solar_pct - lag(solar_pct, 48) OVER o AS solar_pct_change_24h, gas_pct - lag(gas_pct, 48) OVER o AS gas_pct_change_24h,
 avg(wind_pct) OVER d AS wind_pct_mean_24h, avg(solar_pct) OVER d AS solar_pct_mean_24h
 FROM series WINDOW o AS (ORDER BY period), d AS (ORDER BY period {_DAY}), w AS (ORDER BY period {_WEEK}))"""
HOL = "hol(d, region) AS (VALUES " + ", ".join(f"(DATE '{d}', '{r}')" for d, r, _ in bank_holidays(*HOLIDAYS)) + ")"


def cal_sql(slots: str = "slots", name: str = "cal") -> str:
    return f"""{name}_l AS (SELECT period, timezone('Europe/London', period AT TIME ZONE 'UTC') AS local_ts FROM {slots}),
{name}_d AS (SELECT *, CAST(local_ts AS DATE) AS uk_date, epoch(timezone('UTC', timezone('Europe/London', CAST(CAST(local_ts AS DATE) AS TIMESTAMP)))) AS b,
 epoch(timezone('UTC', timezone('Europe/London', CAST(CAST(local_ts AS DATE) + 1 AS TIMESTAMP)))) AS e FROM {name}_l),
{name} AS (SELECT period, local_ts, uk_date, CAST((epoch(period) - b) / 1800 AS INTEGER) + 1 AS settlement_period, CAST((e - b) / 1800 AS INTEGER) AS periods_in_uk_day,
 hour(local_ts) + minute(local_ts) / 60.0::DOUBLE AS local_hour, isodow(uk_date) AS day_of_week, isodow(uk_date) >= 6 AS is_weekend, month(uk_date) AS month, dayofyear(uk_date) AS day_of_year,
 local_ts <> period AS is_dst, EXISTS (SELECT 1 FROM hol WHERE d = uk_date AND region = 'ENG') AS is_bank_holiday_ew, EXISTS (SELECT 1 FROM hol WHERE d = uk_date AND region = 'SCT') AS is_bank_holiday_scot FROM {name}_d)"""


WX = """obs AS (SELECT 'L' || (user_id % 6) AS location_id, hour AS time, sum(cents) / (100.0::DOUBLE * count(*)) AS v, count(*) AS n FROM ev GROUP BY ALL),
wx0 AS (SELECT location_id, time, v / 20 AS wind, v AS ghi, v / 10 - 5 AS temp, CAST(n * 10 % 100 AS DOUBLE) AS cloud FROM obs),
wx AS (SELECT 0 AS lead_days, * FROM wx0 UNION ALL SELECT l, location_id, time, wind + l, ghi + l, temp + l, cloud FROM wx0, (VALUES (1), (2), (3)) AS leads(l))"""
ALIGN = """align AS (SELECT s.period, a.lead_days, a.location_id, (1 - w) * a.wind + w * b.wind AS wind, b.ghi AS ghi, (1 - w) * a.temp + w * b.temp AS temp, (1 - w) * a.cloud + w * b.cloud AS cloud
 FROM (SELECT period, CASE WHEN minute(period) = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS w FROM slots) s JOIN wx a ON a.time = date_trunc('hour', s.period)
 JOIN wx b ON b.time = a.time + INTERVAL 1 HOUR AND b.location_id = a.location_id AND b.lead_days = a.lead_days)"""
_POWER = "CASE WHEN wind < 3 OR wind >= 25 THEN 0.0::DOUBLE WHEN wind >= 12 THEN 1.0::DOUBLE ELSE (pow(wind, 3) - 27) / (1728 - 27) END"
ROLE = f"""loc(location_id, role) AS (VALUES {", ".join(f"('L{i}', '{r}')" for i, r in enumerate(ROLES))}),
role AS (SELECT period, lead_days, avg(wind ORDER BY location_id) FILTER (WHERE role = 'wind') AS wind_mean, min(wind) FILTER (WHERE role = 'wind') AS wind_min, max(wind) FILTER (WHERE role = 'wind') AS wind_max,
 avg({_POWER} ORDER BY location_id) FILTER (WHERE role = 'wind') AS wind_power_frac_mean, avg(ghi ORDER BY location_id) FILTER (WHERE role = 'solar') AS solar_radiation_mean,
 avg(cloud ORDER BY location_id) FILTER (WHERE role = 'solar') AS solar_cloud_cover_mean, avg(temp ORDER BY location_id) FILTER (WHERE role = 'demand') AS demand_temperature, count(DISTINCT location_id) AS n_locations
 FROM align JOIN loc USING (location_id) GROUP BY period, lead_days)"""
GRID = """grid0 AS (SELECT p.period AS origin_time_utc, h.i / 2.0::DOUBLE AS horizon_h, p.period + to_minutes(h.i * 30) AS target_time_utc, p.period - INTERVAL 90 MINUTE AS cutoff_utc, CAST(ceil((h.i * 30 + 90) / 1440.0::DOUBLE) AS INTEGER) AS seasonal_days
 FROM slots p, (SELECT unnest(generate_series(48, 96)) AS i) h WHERE minute(p.period) = 0 AND hour(p.period) IN (0, 6, 12, 18)
 AND p.period >= (SELECT min(period) FROM slots) + INTERVAL 8 DAY AND p.period + INTERVAL 48 HOUR <= (SELECT max(period) FROM slots)),
grid AS (SELECT *, date_trunc('hour', target_time_utc) + INTERVAL 1 HOUR AS h1, CAST(ceil(((epoch(date_trunc('hour', target_time_utc) + INTERVAL 1 HOUR) - epoch(origin_time_utc)) / 3600.0::DOUBLE + 8) / 24.0::DOUBLE) AS INTEGER) AS lead FROM grid0)"""
_CAL = ", ".join([f"c.{x} AS f_target_{x}" for x in T.CALENDAR_FEATURES] + [f"c.{x}::INTEGER AS f_target_{x}" for x in T.CALENDAR_FLAGS])
TRAIN = f"""train AS (SELECT g.origin_time_utc, g.horizon_h, g.target_time_utc, y.actual AS y_actual, y.forecast AS ref_forecast, {_CAL}, h.intensity AS f_intensity_latest, {", ".join(f"h.{x} AS f_{x}" for x in T.HISTORY)},
 sd.actual AS f_intensity_target_seasonal_day, sw.actual AS f_intensity_target_minus_168h, {", ".join(f"wf.{x} AS wxf_{x}" for x in T.WEATHER)}, {", ".join(f"wo.{x} AS oracle_{x}" for x in T.WEATHER)},
 hour(g.origin_time_utc) AS f_origin_hour, g.horizon_h AS f_horizon_h, g.seasonal_days AS f_seasonal_days, g.cutoff_utc + INTERVAL 90 MINUTE AS asof_history,
 g.target_time_utc - to_days(g.seasonal_days) + INTERVAL 90 MINUTE AS asof_seasonal_day, g.target_time_utc - INTERVAL 168 HOUR + INTERVAL 90 MINUTE AS asof_seasonal_week, g.h1 - to_days(g.lead) + INTERVAL 8 HOUR AS asof_weather_forecast
 FROM grid g JOIN cal c ON c.period = g.target_time_utc LEFT JOIN stg y ON y.period = g.target_time_utc LEFT JOIN hist h ON h.period = g.cutoff_utc
 LEFT JOIN stg sd ON sd.period = g.target_time_utc - to_days(g.seasonal_days) LEFT JOIN stg sw ON sw.period = g.target_time_utc - INTERVAL 168 HOUR
 LEFT JOIN role wf ON wf.period = g.target_time_utc AND wf.lead_days = g.lead LEFT JOIN role wo ON wo.period = g.target_time_utc AND wo.lead_days = 0)"""
ALL = (EV, RAW, STG, SLOTS, MIX, WIDE, SERIES, HIST, HOL, cal_sql(), WX, ALIGN, ROLE, GRID, TRAIN)
BASE = """base AS (SELECT g.origin_time_utc, g.horizon_h, g.target_time_utc, y.actual AS y_actual, h.actual AS persistence, sd.actual AS seasonal_naive_day, sw.actual AS seasonal_naive_week, y.forecast AS stored_forecast
 FROM grid g LEFT JOIN stg y ON y.period = g.target_time_utc LEFT JOIN stg h ON h.period = g.cutoff_utc LEFT JOIN stg sd ON sd.period = g.target_time_utc - to_days(g.seasonal_days)
 LEFT JOIN stg sw ON sw.period = g.target_time_utc - INTERVAL 168 HOUR)"""
SHORT = (EV, RAW, STG, SLOTS, GRID, BASE)
LONG = """common AS (SELECT * FROM base WHERE y_actual IS NOT NULL AND persistence IS NOT NULL AND seasonal_naive_day IS NOT NULL AND seasonal_naive_week IS NOT NULL AND stored_forecast IS NOT NULL),
long AS (SELECT * FROM common UNPIVOT (p FOR model IN (persistence, seasonal_naive_day, seasonal_naive_week, stored_forecast)))"""
ERR = "count(*) AS n, avg(abs(p - y_actual)) AS mae, sqrt(avg((p - y_actual) * (p - y_actual))) AS rmse, avg(CASE WHEN y_actual <> 0 THEN abs((p - y_actual) / y_actual) END) * 100 AS mape"


def scored(by: str) -> str:
    keys = f"{by}, " if by else ""
    on = f"PARTITION BY {by}" if by else ""
    return f"m AS (SELECT {keys}model, {ERR} FROM long GROUP BY {keys}model), sc AS (SELECT *, 1 - mae / nullif(max(CASE WHEN model = 'seasonal_naive_day' THEN mae END) OVER ({on}), 0) AS skill FROM m)"


SCORES = "model n:i mae:d rmse:d mape:d skill:d"
BAND = "band AS (SELECT *, persistence - 60 AS lo, persistence + 40 AS hi, date_trunc('week', origin_time_utc) AS fold FROM base)"
CTX = f"""q AS (SELECT quantile_cont(f_wind_pct, 1/3.0::DOUBLE) AS a, quantile_cont(f_wind_pct, 2/3.0::DOUBLE) AS b FROM (SELECT target_time_utc, any_value(t_wind) AS f_wind_pct FROM ctx0 GROUP BY 1)),
ctx AS (SELECT * REPLACE (y_actual AS y_actual), CASE WHEN month IN (12, 1, 2) THEN 'winter' WHEN month IN (3, 4, 5) THEN 'spring' WHEN month IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
 CASE WHEN local_hour < 6 THEN 'night' WHEN local_hour < 12 THEN 'morning' WHEN local_hour < 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day, CASE WHEN t_wind < a THEN 'low' WHEN t_wind < b THEN 'medium' WHEN t_wind IS NOT NULL THEN 'high' END AS wind_regime FROM ctx0, q)"""


@query("spine_densify", sql("period intensity:d observed", "x", EV, RAW, STG, SLOTS, "x AS (SELECT period, actual AS intensity, actual IS NOT NULL AS observed FROM slots LEFT JOIN stg USING (period))"))
def _(t):
    return t.slots().join(t.staged(), "period", "left").select("period", F.col("actual").alias("intensity"), F.col("actual").isNotNull().alias("observed"))


_GAPS = """ab AS (SELECT {k} s.ts, epoch_us(s.ts) // {us} AS slot FROM {grid} s ANTI JOIN {p} p ON s.ts = p.ts {on}),
isl AS (SELECT *, slot - row_number() OVER ({part} ORDER BY ts) AS island FROM ab), g AS (SELECT {k} min(ts) AS first, max(ts) AS last, count(*) AS n FROM isl GROUP BY {k} island)"""


@query(
    "gaps_and_islands",
    sql("first last n:i", "g", EV, "p AS (SELECT DISTINCT make_timestamp(epoch_us(ts) // 300000000 * 300000000) AS ts FROM events)",
        "gr AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:55', INTERVAL 5 MINUTE)) AS ts)", _GAPS.format(k="", us=300000000, grid="gr", p="p", on="", part="")),
)
def _(t):
    present = t.read("events").select(bin_start(F.col("ts"), 300).alias("ts"))
    return S.missing_ranges(present, datetime(2024, 1, 1), datetime(2024, 1, 30, 23, 55), 300)


@query(
    "top_gaps_per_series",
    sql("kind first last n:i rank:i", "(SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, first) AS rank FROM g) WHERE rank <= 10",
        "p AS (SELECT DISTINCT event_type AS kind, make_timestamp(epoch_us(ts) // 1800000000 * 1800000000) AS ts FROM events)",
        "gr AS (SELECT kind, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:30', INTERVAL 30 MINUTE)) AS ts FROM (SELECT DISTINCT kind FROM p))",
        _GAPS.format(k="kind, ", us=1800000000, grid="gr", p="p", on="AND s.kind = p.kind", part="PARTITION BY kind").replace("SELECT kind, s.ts", "SELECT s.kind, s.ts")),
)
def _(t):
    from pyspark.sql.window import Window

    present = t.events().select(F.col("event_type").alias("kind"), F.col("period").alias("ts"))
    gaps = S.missing_ranges(present, datetime(2024, 1, 1), datetime(2024, 1, 30, 23, 30), 1800, keys=["kind"])
    return gaps.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "first"))).where("rank <= 10")


_BATCH = """old AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 < 2),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice * 2 END AS price, 'N' AS status FROM orders WHERE o_orderkey % 3 > 0)"""


def _batches(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderstatus")
    old = o.where("k % 3 < 2").select("k", F.when(F.col("k") % 5 != 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"))
    new = o.where("k % 3 > 0").select("k", F.when(F.col("k") % 7 != 0, F.col("o_totalprice") * 2).alias("price"), F.lit("N").alias("status"))
    return old, new


@query("upsert_null_preserving", sql("k price:d status", "x", _BATCH, "x AS (SELECT k, coalesce(new.price, old.price) AS price, CASE WHEN new.status IS NOT NULL THEN new.status ELSE old.status END AS status FROM old FULL JOIN new USING (k))"))
def _(t):
    return K.upsert(*_batches(t), ["k"], ["price"])


@query("upsert_latest_wins", sql("k price:d status", "x", _BATCH, "x AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE k NOT IN (SELECT k FROM new))"))
def _(t):
    return K.upsert_plain(*_batches(t), ["k"])


@query("batch_latest_per_key", sql("l_orderkey l_quantity:d l_linenumber:i", "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_quantity DESC) AS r FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)) WHERE r = 1"))
def _(t):
    x = t.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    return K.latest(x, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_quantity", "l_linenumber")


@query("json_flatten_props", sql("event_id k:i", "(SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)"))
def _(t):
    return t.read("events").select("event_id", F.from_json("props", "k bigint").k.alias("k"))


def _payload(t, with_type: bool = False):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm'Z'")
    e = t.events()
    end = F.col("period") + F.expr("interval 30 minutes")
    if with_type:
        one = F.struct(stamp("period").alias("from"), stamp(end).alias("to"), F.array(F.struct(F.col("event_type").alias("fuel"), F.col("value").alias("perc")), F.struct(F.lit("rest").alias("fuel"), (100 - F.col("value")).alias("perc"))).alias("generationmix"))
    else:
        one = F.struct(stamp("period").alias("from"), stamp(end).alias("to"), F.struct(F.col("cents").cast("int").alias("forecast"), F.when(F.col("event_id") % 2 == 0, F.col("cents").cast("int")).alias("actual"), F.col("event_type").alias("index")).alias("intensity"))
    return e.groupBy(F.floor(F.col("event_id") / 256).alias("file")).agg(F.to_json(F.struct(F.collect_list(one).alias("data"))).alias("payload"))


@query("json_nested_flatten", sql("period_start_utc period_end_utc forecast_gco2:i actual_gco2:i intensity_index", "x", EV, "x AS (SELECT period AS period_start_utc, period + INTERVAL 30 MINUTE AS period_end_utc, cents AS forecast_gco2, CASE WHEN event_id % 2 = 0 THEN cents END AS actual_gco2, event_type AS intensity_index FROM ev)"))
def _(t):
    return P.intensity(_payload(t))


@query("json_double_unnest", sql("period_start_utc period_end_utc fuel perc:d", "x", EV, "x AS (SELECT period AS period_start_utc, period + INTERVAL 30 MINUTE AS period_end_utc, event_type AS fuel, value AS perc FROM ev UNION ALL SELECT period, period + INTERVAL 30 MINUTE, 'rest', 100 - value FROM ev)"))
def _(t):
    return P.generation(_payload(t, True))


def _hourly_payload(t, suffixes=("",)):
    w = t.weather().where("lead_days = 0")
    stamp = F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("time")
    named = dict(zip(P.WEATHER, T.VARIABLES))
    rows = F.array_sort(F.collect_list(F.struct(stamp, *[(F.when((F.hour("time") != 5), F.col(v)) + i).alias(f"{n}{s}") for i, s in enumerate(suffixes) for n, v in named.items()])))
    pick = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    arrays = [pick(c) for c in ("time", *[f"{n}{s}" for s in suffixes for n in named])]
    return w.groupBy("location_id", F.to_date("time").alias("day")).agg(rows.alias("r")).select(F.to_json(F.struct(F.struct(*arrays).alias("hourly")), {"ignoreNullFields": "false"}).alias("payload"))


@query("json_array_zip", sql("time_utc wind_speed_100m:d shortwave_radiation:d temperature_2m:d cloud_cover:d", "x", EV, WX, "x AS (SELECT time AS time_utc, wind AS wind_speed_100m, ghi AS shortwave_radiation, temp AS temperature_2m, cloud AS cloud_cover FROM wx0 WHERE hour(time) <> 5)"))
def _(t):
    return P.hourly(_hourly_payload(t))


@query("json_previous_runs", sql("time_utc lead_days:i wind_speed_100m:d cloud_cover:d", "x", EV, WX, "x AS (SELECT time AS time_utc, d AS lead_days, wind + d - 1 AS wind_speed_100m, cloud + d - 1 AS cloud_cover FROM wx0, (VALUES (1), (2), (3)) AS l(d) WHERE hour(time) <> 5)"))
def _(t):
    return P.previous_runs(_hourly_payload(t, tuple(f"_previous_day{d}" for d in (1, 2, 3)))).select("time_utc", "lead_days", "wind_speed_100m", "cloud_cover")


@query("stage_suspect_nullout", sql("period actual:d forecast:d actual_is_suspect forecast_is_suspect", "stg", EV, RAW, STG))
def _(t):
    return t.staged()


@query("long_to_wide_mix", sql("period " + " ".join(f"{k}_pct:d" for k in KINDS), "wide", EV, MIX, WIDE))
def _(t):
    return T.stage_mix(t.mix(), list(KINDS))


@query("union_lead_days", sql("lead_days:i location_id time wind:d ghi:d temp:d cloud:d", "wx", EV, WX))
def _(t):
    return t.weather()


_OD = "slots AS (SELECT DISTINCT make_timestamp(epoch_us(o_orderdate) // 1800000000 * 1800000000) + to_minutes(CAST(o_orderkey % 48 * 30 AS INTEGER)) AS period FROM orders)"


def _order_slots(t):
    return t.read("orders").select((bin_start(F.col("o_orderdate"), 1800) + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("o_orderkey") % 48 * 30).cast("int"))).alias("period")).distinct()


@query("settlement_calendar", sql("period local_ts uk_date settlement_period:i periods_in_uk_day:i local_hour:d day_of_week:i is_weekend month:i day_of_year:i is_dst", "cal", _OD, HOL, cal_sql()))
def _(t):
    return S.calendar(_order_slots(t)).select("period", "local_ts", "uk_date", "settlement_period", "periods_in_uk_day", "local_hour", "day_of_week", "is_weekend", "month", "day_of_year", "is_dst")


@query("holiday_flags", sql("period uk_date is_bank_holiday_ew is_bank_holiday_scot", "cal", _OD, HOL, cal_sql()))
def _(t):
    return S.calendar(_order_slots(t), S.holidays(t.spark, *HOLIDAYS)).select("period", "uk_date", "is_bank_holiday_ew", "is_bank_holiday_scot")


_Y99 = "slots AS (SELECT unnest(generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '1999-12-31 23:30', INTERVAL 30 MINUTE)) AS period)"
_HOLE = "kept AS (SELECT period FROM slots WHERE CAST(period AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 97 = 0) OR minute(period) = 0)"


@query("dst_day_check", sql("uk_date n:i expected:i", "x", _Y99, _HOLE, HOL, cal_sql("kept"), "d AS (SELECT uk_date, count(*) AS n, max(periods_in_uk_day) AS expected FROM cal GROUP BY uk_date), x AS (SELECT * FROM d WHERE uk_date > (SELECT min(uk_date) FROM d) AND uk_date < (SELECT max(uk_date) FROM d) AND n <> expected)"))
def _(t):
    slots = S.spine(t.spark, datetime(1999, 1, 1), datetime(1999, 12, 31, 23, 30)).withColumn("day", F.to_date("period"))
    odd = t.read("orders").where("o_orderkey % 97 = 0").select(F.to_date("o_orderdate").alias("day"), F.lit(True).alias("odd")).distinct()
    kept = slots.join(odd, "day", "left").where("odd is null or minute(period) = 0").select("period")
    return S.dst_check(kept).where("n <> expected")


@query("lag_features", sql("period intensity_minus_24h:d intensity_minus_168h:d wind_pct_change_24h:d solar_pct_change_24h:d gas_pct_change_24h:d", "hist", EV, RAW, STG, SLOTS, MIX, WIDE, SERIES, HIST))
def _(t):
    return t.history().select("period", "intensity_minus_24h", "intensity_minus_168h", "wind_pct_change_24h", "solar_pct_change_24h", "gas_pct_change_24h")


_R24 = "intensity_mean_24h:d intensity_std_24h:d intensity_min_24h:d intensity_max_24h:d intensity_obs_24h:i wind_pct_mean_24h:d solar_pct_mean_24h:d"


@query("rolling_24h", sql(f"period {_R24}", "hist", EV, RAW, STG, SLOTS, MIX, WIDE, SERIES, HIST))
def _(t):
    return t.history().select("period", *[c.partition(":")[0] for c in _R24.split()])


@query("rolling_7d", sql("period intensity_mean_7d:d intensity_std_7d:d intensity_obs_7d:i", "hist", EV, RAW, STG, SLOTS, MIX, WIDE, SERIES, HIST))
def _(t):
    return t.history().select("period", "intensity_mean_7d", "intensity_std_7d", "intensity_obs_7d")


@query("weather_align_half_hour", sql("period lead_days:i location_id wind:d ghi:d temp:d cloud:d", "align", EV, RAW, SLOTS, WX, ALIGN))
def _(t):
    return t.aligned()


@query("wind_power_curve", sql("event_id power:d", f"(SELECT event_id, {_POWER} AS power FROM (SELECT event_id, value / 15 AS wind FROM events))"))
def _(t):
    return t.read("events").select("event_id", wind_power(F.col("value") / 15, 3.0, 12.0, 25.0).alias("power"))


_ROLE = " ".join(f"{c}:d" for c in T.WEATHER) + " n_locations:i"


@query("ordered_mean_by_role", sql(f"period lead_days:i {_ROLE}", "role", EV, RAW, SLOTS, WX, ALIGN, ROLE))
def _(t):
    return t.by_role()


@query("origin_horizon_grid", sql("origin_time_utc horizon_h:d target_time_utc cutoff_utc seasonal_days:i h1 lead:i", "grid", EV, RAW, SLOTS, GRID))
def _(t):
    return T.grid(t.slots(), SET)


@query("asof_history_join", sql("origin_time_utc horizon_h:d persistence:d", "base", *SHORT))
def _(t):
    return t.baselines().select("origin_time_utc", "horizon_h", "persistence")


@query("asof_seasonal_join", sql("origin_time_utc horizon_h:d seasonal_naive_day:d seasonal_naive_week:d", "base", *SHORT))
def _(t):
    return t.baselines().select("origin_time_utc", "horizon_h", "seasonal_naive_day", "seasonal_naive_week")


_TS = ("origin_time_utc horizon_h:d target_time_utc y_actual:d ref_forecast:d " + " ".join(f"f_target_{x}:{'d' if x == 'local_hour' else 'i'}" for x in (*T.CALENDAR_FEATURES, *T.CALENDAR_FLAGS)) + " f_intensity_latest:d "
       + " ".join(f"f_{x}:{'i' if '_obs_' in x else 'd'}" for x in T.HISTORY) + " f_intensity_target_seasonal_day:d f_intensity_target_minus_168h:d " + " ".join(f"{p}_{x}:d" for p in ("wxf", "oracle") for x in T.WEATHER)
       + " f_origin_hour:i f_horizon_h:d f_seasonal_days:i asof_history asof_seasonal_day asof_seasonal_week asof_weather_forecast")


@query("asof_vintage_join", sql("origin_time_utc horizon_h:d " + " ".join(f"wxf_{x}:d" for x in T.WEATHER), "train", *ALL))
def _(t):
    return t.training().select("origin_time_utc", "horizon_h", *[f"wxf_{x}" for x in T.WEATHER])


@query("training_set", sql(_TS, "train", *ALL))
def _(t):
    return t.training()


@query("availability_audit", "WITH " + ", ".join((EV, RAW, SLOTS, GRID)) + """, a AS (SELECT origin_time_utc o, unnest([{'name': 'asof_history', 'v': cutoff_utc + INTERVAL 90 MINUTE}, {'name': 'asof_seasonal_day', 'v': target_time_utc - to_days(seasonal_days) + INTERVAL 90 MINUTE},
 {'name': 'asof_seasonal_week', 'v': target_time_utc - INTERVAL 168 HOUR + INTERVAL 90 MINUTE}, {'name': 'asof_weather_forecast', 'v': h1 - to_days(lead) + INTERVAL 8 HOUR}]) AS s FROM grid)
 SELECT s.name AS name, sum((s.v > o)::INTEGER)::BIGINT AS late, sum((s.v IS NULL)::INTEGER)::BIGINT AS missing FROM a GROUP BY s.name""")  # fmt: skip
def _(t):
    return T.violations(t.light())


@query("baselines_overall", sql(SCORES, "sc", *SHORT, LONG, scored("")))
def _(t):
    return M.score_by(t.baselines(), MODELS)


@query("baselines_by_horizon", sql(f"horizon_h:d {SCORES}", "sc", *SHORT, LONG, scored("horizon_h")))
def _(t):
    return M.score_by(t.baselines(), MODELS, ["horizon_h"])


_CTX0 = "ctx0 AS (SELECT base.*, c.month, c.local_hour, w.wind_pct AS t_wind FROM base JOIN cal c ON c.period = base.target_time_utc LEFT JOIN wide w ON w.period = base.target_time_utc)"
_CTXLONG = LONG.replace("FROM base", "FROM ctx")


@query("metrics_by_season_tod_regime", sql(f"season time_of_day wind_regime {SCORES}", "sc", EV, RAW, STG, SLOTS, MIX, WIDE, HOL, cal_sql(), GRID, BASE, _CTX0, CTX, _CTXLONG, scored("season, time_of_day, wind_regime")))
def _(t):
    cal = t.calendar().select(F.col("period").alias("target_time_utc"), F.col("month").alias("f_target_month"), F.col("local_hour").alias("f_target_local_hour"))
    wind = T.stage_mix(t.mix(), list(KINDS)).select(F.col("period").alias("target_time_utc"), F.col("wind_pct").alias("t_wind"))
    x = M.with_context(t.baselines().join(cal, "target_time_utc").join(wind, "target_time_utc", "left"), "t_wind")
    return M.score_by(x, MODELS, ["season", "time_of_day", "wind_regime"]).select("season", "time_of_day", "wind_regime", "model", "n", "mae", "rmse", "mape", "skill")


_LAGS = (1, 2, 4, 12, 48, 96)


@query("persistence_lead_check", sql("model n:i mae:d", "x", EV, RAW, STG, SLOTS, "l AS (SELECT s.period, actual, forecast, " + ", ".join(f"lag(actual, {n}) OVER (ORDER BY s.period) AS lag_{n}" for n in _LAGS) + " FROM slots s LEFT JOIN stg USING (period))",
       "c AS (SELECT * FROM l WHERE actual IS NOT NULL AND forecast IS NOT NULL AND " + " AND ".join(f"lag_{n} IS NOT NULL" for n in _LAGS) + ")", "u AS (SELECT actual, model, p FROM c UNPIVOT (p FOR model IN (forecast, " + ", ".join(f"lag_{n}" for n in _LAGS) + ")))", "x AS (SELECT model, count(*) AS n, avg(abs(p - actual)) AS mae FROM u GROUP BY model)"))
def _(t):
    x = S.day_ago_features(t.slots().join(t.staged(), "period", "left").select("period", "actual", "forecast"), "period", "actual", list(_LAGS))
    x = x.withColumnsRenamed({f"actual_lag_{n}": f"lag_{n}" for n in _LAGS})
    return M.lead_check(x, list(_LAGS))


_BUCKET = "CASE WHEN horizon_h < 30 THEN '24-30' WHEN horizon_h < 36 THEN '30-36' WHEN horizon_h < 42 THEN '36-42' ELSE '42-48' END"
_COV = "count(*) AS n, avg((y_actual BETWEEN lo AND hi)::INTEGER) * 100 AS coverage, avg((y_actual < lo)::INTEGER) * 100 AS below, avg((y_actual > hi)::INTEGER) * 100 AS above, avg(hi - lo) AS mean_width"


@query("interval_coverage", sql("horizons n:i coverage:d below:d above:d mean_width:d", "x", *SHORT, BAND, f"ok AS (SELECT * FROM band WHERE y_actual IS NOT NULL AND lo IS NOT NULL), x AS (SELECT {_BUCKET} AS horizons, {_COV} FROM ok GROUP BY 1 UNION ALL SELECT 'all', {_COV} FROM ok)"))
def _(t):
    return M.coverage(t.banded(), "lo", "hi")


@query("conformal_adjustment", sql("fold n:i raw_coverage:d adjustment:d", "x", *SHORT, BAND, """ok AS (SELECT fold, greatest(lo - y_actual, y_actual - hi) AS score FROM band WHERE y_actual IS NOT NULL AND lo IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score) AS rank, ceil((count(*) OVER (PARTITION BY fold) + 1) * 0.8::DOUBLE) AS k FROM ok),
 x AS (SELECT fold, count(*) AS n, avg((score <= 0)::INTEGER) AS raw_coverage, coalesce(max(score) FILTER (WHERE rank = k), 'inf'::DOUBLE) AS adjustment FROM r GROUP BY fold)"""))  # fmt: skip
def _(t):
    return M.conformal(t.banded(), "lo", "hi", 0.2, ["fold"])


@query("quantile_crossing_repair", sql("origin_time_utc horizon_h:d lo:d hi:d crossed", "x", *SHORT, "x AS (SELECT origin_time_utc, horizon_h, least(persistence, seasonal_naive_day) AS lo, greatest(persistence, seasonal_naive_day) AS hi, persistence > seasonal_naive_day AS crossed FROM base WHERE persistence IS NOT NULL AND seasonal_naive_day IS NOT NULL)"))
def _(t):
    b = t.baselines().dropna(subset=["persistence", "seasonal_naive_day"]).select("origin_time_utc", "horizon_h", F.col("persistence").alias("lo"), F.col("seasonal_naive_day").alias("hi"))
    return M.repair_crossing(b, "lo", "hi")


@query("time_split_purge_counts", sql("part n:i", "x", *SHORT, "x AS (SELECT CASE WHEN target_time_utc < TIMESTAMP '2024-01-20' THEN 'train' WHEN origin_time_utc >= TIMESTAMP '2024-01-20' THEN 'test' ELSE 'purged' END AS part, count(*) AS n FROM base GROUP BY 1)"))
def _(t):
    b = t.baselines()
    train, test = T.time_split(b, datetime(2024, 1, 20))
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    purged = b.where((F.col("target_time_utc") >= F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")) & (F.col("origin_time_utc") < F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz")))
    return part(train, "train").unionByName(part(test, "test")).unionByName(part(purged, "purged"))


@query(
    "sample_week",
    sql("week n:i mae:d", "x", *SHORT, """wk AS (SELECT date_trunc('week', target_time_utc)::TIMESTAMP AS week, count(*) AS n, avg(abs(coalesce(persistence, 0) - coalesce(y_actual, 0))) AS mae
 FROM base WHERE horizon_h < 48 AND hour(origin_time_utc) = 12 GROUP BY 1),
 f AS (SELECT * FROM wk WHERE n = 336), x AS (SELECT * FROM f ORDER BY round(abs(mae - (SELECT median(mae) FROM f)), 9), week LIMIT 1)"""),
)
def _(t):
    return M.sample_week(t.baselines().fillna(0.0, ["persistence", "y_actual"]), "persistence")


@query("day_ahead_long", sql("target_time_utc model value:d", "x", *SHORT, "d AS (SELECT target_time_utc, persistence, seasonal_naive_day, seasonal_naive_week, stored_forecast FROM base WHERE hour(origin_time_utc) = 6 AND horizon_h < 48), x AS (FROM d UNPIVOT (value FOR model IN (persistence, seasonal_naive_day, seasonal_naive_week, stored_forecast)))"))
def _(t):
    return M.day_ahead(t.baselines(), 6, MODELS)


@query("pivot_metrics_wide", sql("horizon_h:d persistence:d seasonal_naive_day:d seasonal_naive_week:d stored_forecast:d", "x", *SHORT, LONG, scored("horizon_h"), "x AS (SELECT horizon_h, " + ", ".join(f"max(mae) FILTER (WHERE model = '{m}') AS {m}" for m in MODELS) + " FROM sc GROUP BY horizon_h)"))
def _(t):
    return M.score_by(t.baselines(), MODELS, ["horizon_h"]).groupBy("horizon_h").pivot("model", MODELS).agg(F.first("mae"))


_WIN = "win AS (SELECT * FROM common WHERE target_time_utc >= TIMESTAMP '2024-01-15' AND target_time_utc < TIMESTAMP '2024-01-22'), wl AS (SELECT * FROM win UNPIVOT (p FOR model IN (persistence, seasonal_naive_day, seasonal_naive_week, stored_forecast)))"


@query("window_scores", sql("model n:i mae:d bias:d", "x", *SHORT, LONG, _WIN, "x AS (SELECT model, count(*) AS n, avg(abs(p - y_actual)) AS mae, avg(p - y_actual) AS bias FROM wl GROUP BY model)"))
def _(t):
    return M.window_scores(t.baselines(), datetime(2024, 1, 15), datetime(2024, 1, 22), MODELS)


@query("window_coverage", sql("coverage:d n:i", "x", *SHORT, BAND, "x AS (SELECT avg((y_actual BETWEEN lo AND hi)::INTEGER) AS coverage, count(y_actual BETWEEN lo AND hi) AS n FROM band)"))
def _(t):
    return M.window_coverage(t.banded(), "lo", "hi")


@query("series_quality", sql("n_rows:i n_keys:i first last duplicate_keys:i nulls_value:i expected:i missing:i", "x", EV, """d AS (SELECT event_type, period, count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nv FROM ev GROUP BY ALL),
 o AS (SELECT sum(n) AS n_rows, count(*) AS n_keys, min(period) AS first, max(period) AS last, count(*) FILTER (WHERE n > 1) AS duplicate_keys, sum(nv) AS nulls_value, count(DISTINCT event_type) AS k FROM d),
 x AS (SELECT *, ((epoch(last) - epoch(first)) / 1800 + 1) * k AS expected, ((epoch(last) - epoch(first)) / 1800 + 1) * k - n_keys AS missing FROM o)"""))  # fmt: skip
def _(t):
    return M.series_quality(t.events(), "period", 1800, ["event_type"], ["value"])


@query("suspect_values", sql("period actual:d forecast:d reasons", "x", EV, RAW, "x AS (SELECT *, concat_ws('; ', CASE WHEN actual = 0 THEN 'actual = 0' END, CASE WHEN actual > 60 THEN 'actual > 60' END, CASE WHEN forecast = 0 THEN 'forecast = 0' END, CASE WHEN forecast > 60 THEN 'forecast > 60' END) AS reasons FROM raw) , y AS (SELECT 1)").replace("FROM x", "FROM x WHERE reasons <> ''"))
def _(t):
    return M.suspects(t.raw(), "actual", "forecast", 60.0)


@query("duplicate_keys", sql("l_orderkey l_linenumber:i n:i", "(SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)"))
def _(t):
    return t.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("residual_histogram", sql("bin:i n:i", "(SELECT least(floor((greatest(least(persistence - y_actual, 160), -160) + 160) / 5) * 5 - 160, 155) AS bin, count(*) AS n FROM base WHERE persistence IS NOT NULL AND y_actual IS NOT NULL GROUP BY 1)", *SHORT))
def _(t):
    return t.baselines().dropna(subset=["persistence", "y_actual"]).groupBy(M.histogram(F.col("persistence") - F.col("y_actual")).alias("bin")).agg(F.count("*").alias("n"))


@query("product_agreement", sql("lead_days:i n:i same:d mae:d", "x", EV, WX, "x AS (SELECT b.lead_days, count(*) AS n, avg(CASE WHEN a.cloud = b.cloud THEN 100.0::DOUBLE ELSE 0 END) AS same, avg(abs(a.wind - b.wind)) AS mae FROM wx a JOIN wx b USING (location_id, time) WHERE a.lead_days = 0 AND b.lead_days > 0 GROUP BY b.lead_days)"))
def _(t):
    w = t.weather()
    a = w.where("lead_days = 0").select("location_id", "time", F.col("wind").alias("a_wind"), F.col("cloud").alias("a_cloud"))
    x = w.where("lead_days > 0").join(a, ["location_id", "time"])
    return x.groupBy("lead_days").agg(F.count("*").alias("n"), F.avg(F.when(F.col("cloud") == F.col("a_cloud"), 100.0).otherwise(0.0)).alias("same"), F.avg(F.abs(F.col("wind") - F.col("a_wind"))).alias("mae"))


@query("lead_day_skill", sql("lead_days:i r:d mae:d", "x", EV, RAW, SLOTS, WX, ALIGN, ROLE, "x AS (SELECT f.lead_days, corr(f.wind_mean, o.wind_mean) AS r, avg(abs(f.wind_mean - o.wind_mean)) AS mae FROM role f JOIN role o USING (period) WHERE o.lead_days = 0 AND f.lead_days > 0 GROUP BY f.lead_days)"))
def _(t):
    r = t.by_role()
    o = r.where("lead_days = 0").select("period", F.col("wind_mean").alias("o"))
    return r.where("lead_days > 0").join(o, "period").groupBy("lead_days").agg(F.corr("wind_mean", "o").alias("r"), F.avg(F.abs(F.col("wind_mean") - F.col("o"))).alias("mae"))


@query("autocorrelation", sql("lag:i r:d n:i", "x", EV, RAW, STG, SLOTS, "x AS (" + " UNION ALL ".join(f"SELECT {n} AS lag, corr(actual, l) AS r, count(CASE WHEN actual IS NOT NULL AND l IS NOT NULL THEN 1 END) AS n FROM (SELECT actual, lag(actual, {n}) OVER (ORDER BY s.period) AS l FROM slots s LEFT JOIN stg USING (period))" for n in (1, 48, 336)) + ")"))
def _(t):
    x = S.day_ago_features(t.slots().join(t.staged(), "period", "left").select("period", "actual"), "period", "actual", [1, 48, 336])
    parts = [x.agg(F.corr("actual", f"actual_lag_{n}").alias("r"), F.count(F.col("actual") + F.col(f"actual_lag_{n}")).alias("n")).select(F.lit(n).alias("lag"), "r", "n") for n in (1, 48, 336)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("month_year_means", sql("month year:i n:i mean:d", "(SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, year(o_orderdate) AS year, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY ALL)"))
def _(t):
    return t.read("orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean"))


_HOURLY = "x AS (SELECT floor(c.local_hour) AS hour, model, count(*) AS n, avg(abs(p - y_actual)) AS mae FROM long JOIN cal c ON c.period = target_time_utc GROUP BY ALL)"


@query("error_by_local_hour", sql("hour:i model n:i mae:d", "x", EV, RAW, STG, SLOTS, HOL, cal_sql(), GRID, BASE, LONG, _HOURLY))
def _(t):
    cal = t.calendar().select(F.col("period").alias("target_time_utc"), F.col("local_hour").alias("f_target_local_hour"))
    return M.by_local_hour(t.baselines().join(cal, "target_time_utc"), MODELS)


def _wins(unit: str) -> str:
    return sql(
        "model wins:i n:i", "x", *SHORT, LONG,
        f"g AS (SELECT date_trunc('{unit}', origin_time_utc) AS g, model, avg(abs(p - y_actual)) AS mae FROM long GROUP BY ALL)",
        "x AS (SELECT a.model, sum((a.mae < b.mae)::INTEGER) AS wins, count(*) AS n FROM g a JOIN g b USING (g) WHERE a.model <> b.model AND b.model = 'seasonal_naive_day' GROUP BY a.model)",
    )


def _won(unit: str):
    by = lambda t: t.baselines().withColumn("g", F.date_trunc(unit, "origin_time_utc"))
    return lambda t: M.wins(by(t), [m for m in MODELS if m != "seasonal_naive_day"], "seasonal_naive_day", ["g"])


query("wins_per_month", _wins("month"))(_won("month"))
query("wins_per_week", _wins("week"))(_won("week"))


@query("least_mae", sql("mae:d model", "x", *SHORT, LONG, scored("horizon_h"), "x AS (SELECT min(mae) AS mae, arg_min(model, (mae, model)) AS model FROM sc WHERE model <> 'stored_forecast')"))
def _(t):
    return M.least_mae(M.score_by(t.baselines(), MODELS, ["horizon_h"]), ["stored_forecast"])


@query(
    "top_errors_by_model",
    sql("model horizon_h:d mae:d rank:i", "x", *SHORT, LONG, scored("horizon_h"),
        "x AS (SELECT * FROM (SELECT model, horizon_h, mae, row_number() OVER (PARTITION BY model ORDER BY mae DESC, horizon_h) AS rank FROM sc) WHERE rank <= 15)"),
)
def _(t):
    scores = M.score_by(t.baselines(), MODELS, ["horizon_h"]).select("model", "horizon_h", "mae")
    return M.top(scores, "mae", 15, ["model"], ["horizon_h"])


@query(
    "residual_density",
    sql("model bin:i n:i density:d median:d", "x", *SHORT, LONG,
        "e AS (SELECT model, greatest(least(p - y_actual, 160), -160) AS e FROM long)",
        "b AS (SELECT model, least(floor((e + 160) / 5) * 5 - 160, 155) AS bin, count(*) AS n FROM e GROUP BY ALL)",
        "m AS (SELECT model, median(e) AS median FROM e GROUP BY model)",
        "x AS (SELECT b.*, n / (sum(n) OVER (PARTITION BY model)) / 5 AS density, median FROM b JOIN m USING (model))"),
)
def _(t):
    return M.residuals(t.baselines(), MODELS)


@query(
    "calibration_by_fold",
    sql("fold n:i raw_coverage:d adjustment:d coverage_raw:d coverage_conformal:d", "y", *SHORT, BAND,
        """ok AS (SELECT * FROM band WHERE y_actual IS NOT NULL AND lo IS NOT NULL),
 r AS (SELECT fold, greatest(lo - y_actual, y_actual - hi) AS score, row_number() OVER (PARTITION BY fold ORDER BY greatest(lo - y_actual, y_actual - hi)) AS rank, ceil((count(*) OVER (PARTITION BY fold) + 1) * 0.8::DOUBLE) AS k FROM ok),
 q AS (SELECT fold, count(*) AS n, avg((score <= 0)::INTEGER) AS raw_coverage, coalesce(max(score) FILTER (WHERE rank = k), 'inf'::DOUBLE) AS adjustment FROM r GROUP BY fold),
 y AS (SELECT q.*, c.raw AS coverage_raw, c.conformal AS coverage_conformal FROM q JOIN (SELECT fold, 100 * avg((y_actual BETWEEN lo AND hi)::INTEGER) AS raw,
  100 * avg((y_actual BETWEEN lo - adjustment AND hi + adjustment)::INTEGER) AS conformal FROM ok JOIN q USING (fold) GROUP BY fold) c USING (fold))"""),
)
def _(t):
    b = t.banded()
    q = M.conformal(b, "lo", "hi", 0.2, ["fold"])
    x = b.join(q.select("fold", "adjustment"), "fold").withColumns({"clo": F.col("lo") - F.col("adjustment"), "chi": F.col("hi") + F.col("adjustment")})
    return M.calibration(q, x, "fold", {"raw": ("lo", "hi"), "conformal": ("clo", "chi")})


_ENRICHED = "x AS (SELECT base.*, c.uk_date AS target_uk_date, c.local_hour AS target_local_hour, c.month AS target_month, w.wind_pct AS target_actual_wind_pct FROM base JOIN cal c ON c.period = target_time_utc LEFT JOIN wide w ON w.period = target_time_utc)"


@query("result_enrichment", sql("origin_time_utc horizon_h:d persistence:d target_uk_date target_local_hour:d target_month:i target_actual_wind_pct:d", "x", EV, RAW, STG, SLOTS, MIX, WIDE, HOL, cal_sql(), GRID, BASE, _ENRICHED))
def _(t):
    x = T.with_target_context(t.baselines(), t.calendar(), T.stage_mix(t.mix(), list(KINDS)))
    return x.select("origin_time_utc", "horizon_h", "persistence", "target_uk_date", "target_local_hour", "target_month", "target_actual_wind_pct")


@query(
    "calendar_profile",
    sql("local_hour:d is_weekend n:i mean:d", "x", EV, RAW, STG, SLOTS, HOL, cal_sql(),
        "x AS (SELECT local_hour, is_weekend, count(actual) AS n, avg(actual) AS mean FROM cal JOIN stg USING (period) GROUP BY ALL)"),
)
def _(t):
    return t.calendar().join(t.staged(), "period").groupBy("local_hour", "is_weekend").agg(F.count("actual").alias("n"), F.avg("actual").alias("mean"))


@query("boolean_aggregates", sql("event_type any_late all_priced one_type n:i", "(SELECT event_type, bool_or(hour(ts) >= 20) AS any_late, bool_and(value >= 0) AS all_priced, any_value(event_type) AS one_type, count(*) AS n FROM events GROUP BY ALL)"))
def _(t):
    text = "SELECT event_type, bool_or(hour(ts) >= 20) AS any_late, bool_and(value >= 0) AS all_priced, any_value(event_type) AS one_type, count(*) AS n FROM {e} GROUP BY ALL"
    return t.spark.sql(text, e=t.read("events"))


@query(
    "weather_completeness",
    sql("location_id time", "x", EV, WX, "x AS (SELECT location_id, time FROM (SELECT * FROM wx WHERE NOT (lead_days = 2 AND hour(time) = 7)) WHERE lead_days > 0 GROUP BY ALL HAVING count(DISTINCT lead_days) = 3)"),
)
def _(t):
    return K.complete(t.weather().where("not (lead_days = 2 and hour(time) = 7)"), ["location_id", "time"], SET.lead_days)


#: The models over the stand-in series; EDGES are its folds.
VARIANTS = [replace(v, train_start=SET.start) for v in SET.variants]
EDGES = [(datetime(2024, 1, 22), datetime(2024, 1, 25)), (datetime(2024, 1, 25), datetime(2024, 1, 31))]
_FIT = {v.name: Params() for v in VARIANTS}


@query("backtest_gbt")
def _(t):
    return B.run(t.training(), EDGES, VARIANTS, _FIT, SET)


@query("feature_importance")
def _(t):
    return B.importance(t.training(), EDGES[-1], VARIANTS[:2], _FIT)


@query("tune_random_search")
def _(t):
    return B.tune(t.training(), datetime(2024, 1, 22), datetime(2024, 1, 31), [v for v in VARIANTS if not v.params_from], SET)
