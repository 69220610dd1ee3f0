"""Staging, weather alignment and the point-in-time training set."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.columns import at_epoch, bin_start, days, epoch, minutes, ordered_mean, suspect, trusted, wind_power
from tidegrid.params import Settings

VARIABLES = ("wind", "ghi", "temp", "cloud")
CALENDAR_FEATURES = ("settlement_period", "periods_in_uk_day", "local_hour", "day_of_week", "month", "day_of_year")
CALENDAR_FLAGS = ("is_weekend", "is_dst", "is_bank_holiday_ew", "is_bank_holiday_scot")
HISTORY = (
    "intensity_minus_24h", "intensity_minus_168h", "intensity_mean_24h", "intensity_std_24h", "intensity_min_24h", "intensity_max_24h", "intensity_obs_24h",
    "intensity_mean_7d", "intensity_std_7d", "gas_pct", "nuclear_pct", "imports_pct", "wind_pct", "wind_pct_change_24h", "wind_pct_mean_24h",
    "solar_pct", "solar_pct_change_24h", "solar_pct_mean_24h", "gas_pct_change_24h",
)
WEATHER = ("wind_mean", "wind_min", "wind_max", "wind_power_frac_mean", "solar_radiation_mean", "solar_cloud_cover_mean", "demand_temperature")


def stage_intensity(raw: DataFrame, most: float) -> DataFrame:
    """Suspect values (0 or above the limit) become null, with a flag that is never null."""
    flag = lambda c: F.coalesce(suspect(F.col(c), most), F.lit(False))
    return raw.select(
        "period", trusted(F.col("actual"), most).alias("actual"), trusted(F.col("forecast"), most).alias("forecast"), flag("actual").alias("actual_is_suspect"), flag("forecast").alias("forecast_is_suspect")
    )


def stage_mix(raw: DataFrame, kinds: list[str]) -> DataFrame:
    """(period, <kind>_pct, ...) from (period, fuel, perc): one aggregation with conditions, no list of kinds to find first."""
    return raw.groupBy("period").agg(*[F.max(F.when(F.col("fuel") == k, F.col("perc"))).alias(f"{k}_pct") for k in kinds])


def stage_weather(archive: DataFrame, previous: DataFrame) -> DataFrame:
    """Observed hours (lead 0) and forecasts by lead day in one table."""
    cols = ["lead_days", "location_id", "time", *VARIABLES]
    return archive.withColumn("lead_days", F.lit(0)).select(cols).unionByName(previous.select(cols))


def align_weather(slots: DataFrame, weather: DataFrame) -> DataFrame:
    """Hourly weather at half-hours: values at the middle of the slot between both hours, radiation that of the hour it belongs to.

    A slot needs both hours. Hours carry the next hour's values by an equi-join of the table with itself, shifted.
    """
    nxt = weather.select("lead_days", "location_id", at_epoch(epoch(F.col("time")) - 3600).alias("time"), *[F.col(v).alias(f"{v}_1") for v in VARIABLES])
    both = weather.join(nxt, ["lead_days", "location_id", "time"])
    at = slots.select("period", bin_start(F.col("period"), 3600).alias("time"))
    w = F.when(F.minute("period") == 0, 0.25).otherwise(0.75)
    between = lambda v: ((1 - w) * F.col(v) + w * F.col(f"{v}_1")).alias(v)
    return at.join(both, "time").select("period", "lead_days", "location_id", between("wind"), F.col("ghi_1").alias("ghi"), between("temp"), between("cloud"))


def weather_by_role(aligned: DataFrame, locations: DataFrame, s: Settings) -> DataFrame:
    """Sites of a role combined for each slot and lead day; means add up in the order of the sites. Sites are a small dimension."""
    x = aligned.join(F.broadcast(locations.select("location_id", "role")), "location_id")
    of = lambda role, c: F.when(F.col("role") == role, c)
    power = wind_power(F.col("wind"), s.cut_in, s.rated, s.cut_out)
    key = F.col("location_id")
    return x.groupBy("period", "lead_days").agg(
        ordered_mean(key, of("wind", F.col("wind"))).alias("wind_mean"),
        F.min(of("wind", F.col("wind"))).alias("wind_min"),
        F.max(of("wind", F.col("wind"))).alias("wind_max"),
        ordered_mean(key, of("wind", power)).alias("wind_power_frac_mean"),
        ordered_mean(key, of("solar", F.col("ghi"))).alias("solar_radiation_mean"),
        ordered_mean(key, of("solar", F.col("cloud"))).alias("solar_cloud_cover_mean"),
        ordered_mean(key, of("demand", F.col("temp"))).alias("demand_temperature"),
        F.countDistinct("location_id").alias("n_locations"),
    )


def grid(calendar: DataFrame, s: Settings) -> DataFrame:
    """Origins by horizons with the availability rules as columns.

    Origins are whole hours of the configured list with 8 days before them and 48 hours after. The newest usable slot, the
    same slot of the latest usable day and the latest usable weather run follow from the horizon alone, so every later
    as-of join is an equi-join.
    """
    ends = calendar.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    origins = calendar.crossJoin(F.broadcast(ends)).where(
        (F.minute("period") == 0) & F.hour("period").isin(*s.origin_hours) & (F.col("period") >= F.col("lo") + F.expr("interval 8 days")) & (F.col("period") + F.expr("interval 48 hours") <= F.col("hi"))
    )
    steps = int((s.horizon_max_h - s.horizon_min_h) * 60 / s.step_minutes)
    h = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: s.horizon_min_h + i * (s.step_minutes / 60)))
    g = origins.select(F.col("period").alias("origin_time_utc"), h.alias("horizon_h"))
    lag = s.step_minutes + s.availability_lag_minutes
    g = g.withColumn("target_time_utc", F.col("origin_time_utc") + minutes(F.col("horizon_h") * 60))
    g = g.withColumn("cutoff_utc", F.col("origin_time_utc") - F.expr(f"interval {lag} minutes"))
    g = g.withColumn("seasonal_days", F.ceil((F.col("horizon_h") * 60 + lag) / F.lit(1440.0)).cast("int"))
    h1 = F.floor(epoch(F.col("target_time_utc")) / 3600) * 3600 + 3600
    return g.withColumn("h1", at_epoch(h1)).withColumn(
        "lead", F.ceil(((h1 - epoch(F.col("origin_time_utc"))) / F.lit(3600.0) + s.weather_availability_hours) / F.lit(24.0)).cast("int")
    )


def training_set(calendar: DataFrame, staged: DataFrame, history: DataFrame, weather: DataFrame, s: Settings) -> DataFrame:
    """One row an origin and horizon: target, features known at the origin, and the instant each became known.

    Prefixes say what a column is: y_ target, ref_ published forecast, f_ and wxf_ features, oracle_ observed weather at the
    target (leaky), asof_ provenance (never later than the origin).
    """
    g = grid(calendar, s)
    cal = calendar.select(F.col("period").alias("target_time_utc"), *[F.col(c).cast("int" if c in CALENDAR_FLAGS else dict(calendar.dtypes)[c]).alias(f"f_target_{c}") for c in (*CALENDAR_FEATURES, *CALENDAR_FLAGS)])
    y = staged.select(F.col("period").alias("target_time_utc"), F.col("actual").alias("y_actual"), F.col("forecast").alias("ref_forecast"))
    past = history.select(F.col("period").alias("cutoff_utc"), F.col("intensity").alias("f_intensity_latest"), *[F.col(c).alias(f"f_{c}") for c in HISTORY])
    same = staged.select("period", "actual")
    day = same.select(F.col("period").alias("day_period"), F.col("actual").alias("f_intensity_target_seasonal_day"))
    week = same.select(F.col("period").alias("week_period"), F.col("actual").alias("f_intensity_target_minus_168h"))
    wxf = weather.select(F.col("period").alias("target_time_utc"), F.col("lead_days").alias("lead"), *[F.col(c).alias(f"wxf_{c}") for c in WEATHER])
    seen = weather.where("lead_days = 0").select(F.col("period").alias("target_time_utc"), *[F.col(c).alias(f"oracle_{c}") for c in WEATHER])
    x = g.withColumn("day_period", F.col("target_time_utc") - days(F.col("seasonal_days"))).withColumn("week_period", F.col("target_time_utc") - F.expr("interval 168 hours"))
    x = x.join(cal, "target_time_utc")
    for right, on in ((y, ["target_time_utc"]), (past, ["cutoff_utc"]), (day, ["day_period"]), (week, ["week_period"]), (wxf, ["target_time_utc", "lead"]), (seen, ["target_time_utc"])):
        x = x.join(right, on, "left")
    known = F.expr(f"interval {s.step_minutes + s.availability_lag_minutes} minutes")
    x = x.withColumns({
        "f_origin_hour": F.hour("origin_time_utc"), "f_horizon_h": F.col("horizon_h"), "f_seasonal_days": F.col("seasonal_days"),
        "asof_history": F.col("cutoff_utc") + known, "asof_seasonal_day": F.col("day_period") + known, "asof_seasonal_week": F.col("week_period") + known,
        "asof_weather_forecast": F.col("h1") - days(F.col("lead")) + F.expr(f"interval {s.weather_availability_hours} hours"),
    })
    return x.drop("cutoff_utc", "seasonal_days", "h1", "lead", "day_period", "week_period")


def violations(training: DataFrame) -> DataFrame:
    """For each provenance column how often it is later than the origin and how often null: both must be 0."""
    cols = [c for c in training.columns if c.startswith("asof_")]
    one = training.agg(
        *[F.sum((F.col(c) > F.col("origin_time_utc")).cast("long")).alias(f"late_{c}") for c in cols], *[F.sum(F.col(c).isNull().cast("long")).alias(f"null_{c}") for c in cols]
    )
    return one.select(F.expr("stack({}, {}) as (name, late, missing)".format(len(cols), ", ".join(f"'{c}', late_{c}, null_{c}" for c in cols))))


def baselines(training: DataFrame) -> DataFrame:
    """The naive forecasts beside the keys and the target."""
    return training.select(
        "origin_time_utc", "horizon_h", "target_time_utc", "y_actual", F.col("f_intensity_latest").alias("persistence"), F.col("f_intensity_target_seasonal_day").alias("seasonal_naive_day"),
        F.col("f_intensity_target_minus_168h").alias("seasonal_naive_week"), F.col("ref_forecast").alias("stored_forecast"),
    )


def with_target_context(results: DataFrame, calendar: DataFrame, mix: DataFrame) -> DataFrame:
    """results with the target's local date, hour and month and the observed share of wind, for slicing errors only."""
    c = calendar.select(F.col("period").alias("target_time_utc"), F.col("uk_date").alias("target_uk_date"), F.col("local_hour").alias("target_local_hour"), F.col("month").alias("target_month"))
    w = mix.select(F.col("period").alias("target_time_utc"), F.col("wind_pct").alias("target_actual_wind_pct"))
    return results.join(c, "target_time_utc").join(w, "target_time_utc", "left")


def time_split(df: DataFrame, boundary, train_start=None) -> tuple[DataFrame, DataFrame]:
    """(train, test): targets before the boundary, origins from it on; rows across it are in neither."""
    b = F.lit(boundary).cast("timestamp_ntz")
    train = df.where(F.col("target_time_utc") < b)
    if train_start is not None:
        train = train.where(F.col("origin_time_utc") >= F.lit(train_start).cast("timestamp_ntz"))
    return train, df.where(F.col("origin_time_utc") >= b)


def month_starts(first, last) -> list:
    """First instants of months from ``first`` to just past ``last``."""
    out = [first.replace(day=1, hour=0, minute=0, second=0, microsecond=0)]
    while out[-1] <= last:
        out.append((out[-1] + timedelta(days=32)).replace(day=1))
    return out


def month_offset(t, months: int):
    y, m = divmod(t.year * 12 + t.month - 1 + months, 12)
    return t.replace(year=y, month=m + 1)
