"""Reports as Markdown over small results: data quality and forecast evaluation; accessors for an explorer."""

from __future__ import annotations

from datetime import datetime, timedelta
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import metrics as M
from tidegrid.operators import series as S
from tidegrid.operators.training import baselines
from tidegrid.params import Settings
from tidegrid.plans import figures as G
from tidegrid.sources import tables as K

NAIVE = ["persistence", "seasonal_naive_day", "seasonal_naive_week"]
SERIES = {
    "raw_intensity": ("period_start_utc", 1800, [], ["actual_gco2", "forecast_gco2"]),
    "raw_generation": ("period_start_utc", 1800, ["fuel"], ["perc"]),
    "raw_weather_archive": ("time_utc", 3600, ["location_id"], ["wind_speed_100m", "temperature_2m"]),
    "raw_weather_prev_runs": ("time_utc", 3600, ["location_id", "lead_days"], ["wind_speed_100m", "temperature_2m"]),
}


def _table(df: DataFrame, **kw) -> str:
    return K.markdown_table(df.columns, [tuple(r) for r in df.collect()], **kw)


def quality(spark: SparkSession, store: str, s: Settings, most_gaps: int = 10, most_days: int = 20) -> str:
    """Counts, gaps, clock-change days, suspects, percentages that do not add up and products compared, as one text."""
    parts = ["# Data quality"]
    for name, (time, step, keys, values) in SERIES.items():
        raw = K.read(spark, store, name)
        one = M.series_quality(raw, time, step, keys, values)
        row = one.first()
        parts += [f"## {name}", _table(one)]
        if row["n_rows"]:
            gaps = S.missing_ranges(raw.select(*keys, F.col(time).alias("ts")), row["first"], row["last"], step, keys=keys)
            parts += [f"Longest gaps (at most {most_gaps}):", _table(gaps.orderBy(F.desc("n"), "first").limit(most_gaps))]
    raw = K.read(spark, store, "raw_intensity")
    days = S.dst_check(raw.select(F.col("period_start_utc").alias("period")), s.time_zone)
    parts += ["## Local days", _table(days.agg(F.count("*").alias("days"), F.coalesce(F.sum((F.col("n") != F.col("expected")).cast("long")), F.lit(0)).alias("mismatched")))]
    parts += [f"Mismatches (at most {most_days}):", _table(days.where("n <> expected").orderBy("uk_date").limit(most_days))]
    odd = M.suspects(raw.select("period_start_utc", "actual_gco2", "forecast_gco2"), "actual_gco2", "forecast_gco2", s.suspect_max)
    parts += ["## Suspect values", _table(odd.orderBy("period_start_utc").limit(most_days))]
    mix = K.read(spark, store, "raw_generation").groupBy("period_start_utc").agg(F.round(F.sum("perc"), 1).alias("total"))
    parts += ["## Shares that do not add up", _table(mix.where(~F.col("total").between(99, 101)).agg(F.count("*").alias("periods"), F.min("total").alias("least"), F.max("total").alias("most")))]
    seen, ahead = (K.read(spark, store, n).select("location_id", "time_utc", F.col("wind_speed_100m").alias(a)) for n, a in (("raw_weather_archive", "a"), ("raw_weather_hist_forecast", "f")))
    same = seen.join(ahead, ["location_id", "time_utc"]).groupBy(F.year("time_utc").alias("year"))
    parts += ["## Archive against forecast", _table(same.agg(F.avg(F.when(F.col("a") == F.col("f"), 100.0).otherwise(0.0)).alias("identical_%"), F.avg(F.abs(F.col("a") - F.col("f"))).alias("mean_abs_difference")).orderBy("year"))]
    return "\n\n".join(parts) + "\n"


#: Groups in the order in which they are shown.
ORDERS = {"season": ["winter", "spring", "summer", "autumn"], "time_of_day": ["night", "morning", "afternoon", "evening"], "wind_regime": ["low", "medium", "high"]}
BANDS = {"raw": ("p10", "p90"), "conformal": ("cp10", "cp90")}
#: Slots back in time of the persistence that a stored forecast is held against.
LAGS = (1, 2, 4, 12, 48, 96)


def joined(spark: SparkSession, store: str) -> tuple[DataFrame, list[str]]:
    """One row a target and origin with all forecasts, bands and the targets' context, and the names of the models."""
    got = spark.read.parquet(f"{store}/backtest_results")
    names = sorted(r.variant for r in got.select("variant").distinct().collect())
    context = [c for c in got.columns if c.startswith("target_")]
    keys = ["fold_start", "origin_time_utc", "horizon_h", "y_actual", *context]
    bands = [F.max(F.when(F.col("p10").isNotNull(), F.col(c))).alias(c) for band in BANDS.values() for c in band]
    wide = got.groupBy(*keys).agg(*[F.max(F.when(F.col("variant") == v, F.col("p"))).alias(v) for v in names], *bands)
    naive = baselines(spark.read.parquet(f"{store}/training_set")).select("origin_time_utc", "horizon_h", *NAIVE, "stored_forecast")
    x = wide.join(naive, ["origin_time_utc", "horizon_h"], "left")
    if "target_actual_wind_pct" in x.columns:
        x = M.with_context(x, "target_actual_wind_pct", hour="target_local_hour", month="target_month")
    return x, names


def evaluation(results: DataFrame, models: list[str], reference: str = "seasonal_naive_day", extra: list[str] = ()) -> dict[str, DataFrame]:
    """The tables of an evaluation, on rows that all models, the ``extra`` forecasts and the bands have: overall, by horizon (long and
    wide), season, time of day, wind regime and local hour; interval coverage in all and by fold; months won; residuals."""
    ends = [c for band in BANDS.values() for c in band if c in results.columns]
    if ends and not results.agg(F.count(ends[0])).first()[0]:
        ends = []  # too little history for any band
    common = results.dropna(subset=["y_actual", *models, *extra, *ends])
    e = {"overall": M.score_by(common, [*models, *extra], reference=reference).orderBy("mae")}
    by = M.score_by(common, [*models, *extra], ["horizon_h"], reference).orderBy("horizon_h", "model")
    e["by_horizon"] = by
    e["by_horizon_wide"] = by.groupBy("horizon_h").pivot("model", [*models, *extra]).agg(F.first("mae")).orderBy("horizon_h")
    for c in ORDERS:
        if c in results.columns:
            e[f"by_{c}"] = M.score_by(common.where(F.col(c).isNotNull()), models, [c], reference).orderBy(c, "model")
    if "target_local_hour" in results.columns:
        e["by_local_hour"] = M.by_local_hour(common, models, "target_local_hour").orderBy("hour", "model")
    for name, (lo, hi) in BANDS.items():
        if lo in ends:
            e[f"coverage_{name}"] = M.coverage(common, lo, hi).orderBy("horizons")
            e[f"coverage_{name}_by_fold"] = M.coverage(common, lo, hi, by=F.col("fold_start").cast("string")).orderBy("horizons")
    if "fold_start" in results.columns and reference in models:
        e["months_won"] = M.wins(common, [m for m in models if m != reference], reference, ["fold_start"]).orderBy("model")
    e["least_error"] = M.least_mae(by, list(extra))
    e["residuals"] = M.residuals(common, models).orderBy("model", "bin")
    return e


def stored_forecast_check(spark: SparkSession, store: str, start: datetime, end: datetime) -> DataFrame:
    """The stored forecast beside persistence at growing lags, for slots of [start, end]."""
    x = spark.read.parquet(f"{store}/calendar").select("period").join(spark.read.parquet(f"{store}/stg_intensity").select("period", "actual", "forecast"), "period", "left")
    x = S.day_ago_features(x, "period", "actual", list(LAGS)).withColumnsRenamed({f"actual_lag_{n}": f"lag_{n}" for n in LAGS})
    return M.lead_check(x.where(F.col("period").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))), list(LAGS)).orderBy("mae")


def evaluate(spark: SparkSession, store: str, s: Settings) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of an evaluation of the store's backtest and its figures (name to SVG)."""
    results, names = joined(spark, store)
    models = [*names, *NAIVE]
    tables = evaluation(results, models, extra=["stored_forecast"])
    if not K.missing(spark, store, ["backtest_interval_calibration"]):
        folds = spark.read.parquet(f"{store}/backtest_interval_calibration")
        tables["calibration"] = M.calibration(folds, results, "fold_start", BANDS).orderBy("fold_start")
    a, b = target_range(results)
    if a is not None:
        tables["stored_forecast_check"] = stored_forecast_check(spark, store, a, b)
    figures = {"mae_by_horizon": G.lines(tables["by_horizon"].collect(), "horizon_h", models, "Error by forecast horizon", "hours ahead")}
    for c, order in ORDERS.items():
        if f"by_{c}" in tables:
            figures[f"error_by_{c}"] = G.grouped_bars(tables[f"by_{c}"].collect(), c, order, models, f"Error by {c.replace('_', ' ')}")
    if "by_local_hour" in tables:
        figures["error_by_hour"] = G.lines(tables["by_local_hour"].collect(), "hour", models, "Error by time of day", "local hour")
    figures["residuals"] = G.steps(tables["residuals"].collect(), models, "Residuals, all horizons")
    if not K.missing(spark, store, ["backtest_feature_importance"]):
        imp = spark.read.parquet(f"{store}/backtest_feature_importance")
        tables["importance"] = M.top(imp, "mean_abs_contribution", 15, ["variant"], ["feature"]).orderBy("variant", "rank")
        best = tables["importance"].collect()
        for v in sorted({r.variant for r in best}):
            figures[f"feature_importance_{v}"] = G.ranked([r for r in best if r.variant == v], "feature", "mean_abs_contribution", f"What drives {v}")
    shown = next((n for n in ("weather_forecast", *names) if n in names), None)
    week = M.sample_week(results, shown).first() if shown else None
    if week:
        end = week.week + timedelta(days=7)
        rows = issued(results, 12, week.week, end, [shown, *NAIVE]).collect()
        figures["sample_week"] = G.series(rows, "target_time_utc", "y_actual", [shown, "seasonal_naive_day"], BANDS["conformal"], f"Forecasts of {shown} issued at 12:00")
    return tables, figures


def text(tables: dict[str, DataFrame]) -> str:
    return "\n\n".join(f"## {n.replace('_', ' ')}\n\n{_table(t)}" for n, t in tables.items()) + "\n"


def blocks(document: str, tables: dict[str, DataFrame]) -> str:
    """A document with each marked block (<!-- name:start --> ... <!-- name:end -->) that has a table of its name brought up to date."""
    for name, t in tables.items():
        if f"<!-- {name}:start -->" in document:
            document = K.replace_block(document, name, _table(t))
    return document


#: What an explorer reads.
REQUIRED = ["backtest_results", "backtest_metrics_by_horizon", "backtest_metrics_overall", "backtest_interval_coverage", "training_set"]


def target_range(results: DataFrame) -> tuple[datetime, datetime]:
    """First and last target with an actual value."""
    r = results.where("y_actual is not null").agg(F.min("target_time_utc").alias("a"), F.max("target_time_utc").alias("b")).first()
    return r.a, r.b


def metrics_by_horizon(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/backtest_metrics_by_horizon").orderBy("model", "horizon_h")


def overall(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/backtest_metrics_overall").orderBy("mae")


def interval_coverage(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/backtest_interval_coverage").orderBy("band", "horizons")


def window(results: DataFrame, start: datetime, end: datetime, models: list[str]) -> DataFrame:
    """MAE and bias of models for targets in [start, end), on common rows."""
    return M.window_scores(results, start, end, models)


def issued(results: DataFrame, hour: int, start: datetime, end: datetime, models: list[str]) -> DataFrame:
    """Forecasts issued at one hour for less than 48 hours ahead, for targets in [start, end): each target once, a column a model."""
    M.day_ahead(results, hour, models)  # refuses hours and models that aren't there
    t = F.col("target_time_utc")
    at = (F.hour("origin_time_utc") == hour) & (F.minute("origin_time_utc") == 0) & (F.col("horizon_h") < 48)
    inside = (t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))
    extra = [c for band in BANDS.values() for c in band if c in results.columns]
    return results.where(at & inside).select("target_time_utc", "origin_time_utc", "horizon_h", "y_actual", *models, *extra).orderBy("target_time_utc")


def explorer(spark: SparkSession, store: str, start: datetime, end: datetime, hour: int, models: list[str]) -> str:
    """A read-only page over a store: day-ahead forecasts of a window as a chart, their scores and coverage, and the stored metrics."""
    lacking = K.missing(spark, store, REQUIRED)
    if lacking:
        raise ValueError(f"the store lacks {lacking}: run the backtest and evaluate commands")
    results, _ = joined(spark, store)
    rows = issued(results, hour, start, end, models)
    lo, hi = BANDS["conformal"]
    inside = M.window_coverage(rows, lo, hi).first()
    a, b = target_range(results)
    chart = G.series(rows.collect(), "target_time_utc", "y_actual", models, (lo, hi), f"Issued at {hour:02d}:00, targets from {start:%Y-%m-%d} to {end:%Y-%m-%d}")
    parts = {"Scores in the window": M.window_scores(rows, start, end, models), "By horizon": metrics_by_horizon(spark, store), "Overall": overall(spark, store), "Interval coverage": interval_coverage(spark, store)}
    share = "-" if inside.coverage is None else f"{100 * inside.coverage:.1f} % of {inside.n}"
    body = "".join(f"<h2>{name}</h2>{_html(t)}" for name, t in parts.items())
    return f"<!doctype html><meta charset='utf-8'><title>Forecasts</title><h1>Forecasts</h1><p>Targets from {a} to {b}. Inside the interval: {share}.</p>{chart}{body}"


def _html(df: DataFrame) -> str:
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else escape(str(v))
    rows = "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r) + "</tr>" for r in df.collect())
    return "<table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in df.columns) + f"</tr>{rows}</table>"
