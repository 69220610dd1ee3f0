"""Scores of forecasts, interval coverage, conformal adjustment and data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidegrid.functions.columns import cut_points, safe_div, season


def errors(y: Column, p: Column) -> list[Column]:
    """n, mae, rmse and mape (percent, where the actual isn't 0)."""
    return [
        F.count("*").alias("n"), F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"), (F.avg(F.when(y != 0, F.abs((p - y) / y))) * 100).alias("mape"),
    ]


def long(df: DataFrame, models: list[str], target: str = "y_actual") -> DataFrame:
    """Rows where the target and all models have a value, one for each model (columns model, p)."""
    return df.dropna(subset=[target, *models]).unpivot([c for c in df.columns if c not in models], models, "model", "p")


def score_by(df: DataFrame, models: list[str], by: list[str] = (), reference: str = "seasonal_naive_day", target: str = "y_actual") -> DataFrame:
    """Errors of each model on common rows, by group, and its skill against the reference in the same group."""
    by = list(by)
    m = long(df, models, target).groupBy(*by, "model").agg(*errors(F.col(target), F.col("p")))
    ref = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(Window.partitionBy(*(by or [F.lit(0)])))  # over scores, a row for each model
    return m.withColumn("skill", 1 - safe_div(F.col("mae"), F.nullif(ref, F.lit(0.0))))


def kth(rows: DataFrame, value: str, wanted: DataFrame, by: list[str] = (), passes: int = 2, buckets: int = 4096) -> DataFrame:
    """(by, tag, value): the k-th smallest value (from 1) of each group, for wanted(by, tag, k). No group is sorted by one task.

    Each pass counts the rows of equal parts of the range that is left and keeps the part with the k-th; only what is
    left after the last pass, a share of 1 in ``buckets`` to the ``passes`` of evenly spread values, is ranked. Nulls don't count.
    """
    by = list(by)
    x = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    none = F.lit(0).cast("long")
    ends = x.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_all"))
    s = (wanted.join(ends, by) if by else wanted.crossJoin(F.broadcast(ends))).where("k between 1 and _all").withColumn("_before", none).drop("_all")

    def inside(state: DataFrame) -> DataFrame:
        both = x.join(state, by) if by else x.crossJoin(F.broadcast(state))  # without groups the state is a row for each tag
        return both.where("_v between _lo and _hi")

    for _ in range(passes):
        width = (F.col("_hi") - F.col("_lo")) / buckets
        at = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).otherwise(none)
        n = inside(s).groupBy(*by, "tag", "k", "_before", at.alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "tag").orderBy("_b"))
        s = n.withColumn("_upto", upto).where("_upto >= k and _upto - _n < k").select(*by, "tag", "k", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*by, "tag").orderBy("_v"))
    ranked = inside(s.where("_lo < _hi")).withColumn("_r", rank + F.col("_before")).where("_r = k").select(*by, "tag", F.col("_v").alias(value))
    return s.where("_lo = _hi").select(*by, "tag", F.col("_lo").alias(value)).unionByName(ranked)


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] = ()) -> DataFrame:
    """(by, and a column for each name in ``shares``): exact quantiles, between the two nearest values by interpolation."""
    by = list(by)
    n = rows.groupBy(*by).agg(F.count(value).alias("_n")).where("_n > 0")
    place = {c: (F.col("_n") - 1) * F.lit(float(q)) for c, q in shares.items()}
    tags = [F.struct(F.lit(f"{c}{side}").alias("tag"), (f(p) + 1).cast("long").alias("k")) for c, p in place.items() for side, f in (("<", F.floor), (">", F.ceil))]
    found = kth(rows, value, n.select(*by, F.inline(F.array(*tags))), by)
    at = lambda tag: F.max(F.when(F.col("tag") == tag, F.col(value)))
    ends = found.groupBy(*by).agg(*[at(f"{c}{side}").alias(f"{c}{side}") for c in shares for side in "<>"])
    ends = ends.join(n, by) if by else ends.crossJoin(F.broadcast(n))
    between = lambda c, p: F.col(f"{c}<") + (F.col(f"{c}>") - F.col(f"{c}<")) * (p - F.floor(p))
    return ends.select(*by, *[between(c, p).alias(c) for c, p in place.items()])


def with_context(df: DataFrame, wind: str, time: str = "target_time_utc", hour: str = "f_target_local_hour", month: str = "f_target_month") -> DataFrame:
    """df with season, time_of_day and wind_regime: thirds of the distinct targets' wind, null where wind is null."""
    q = quantiles(df.groupBy(time).agg(F.max(wind).alias(wind)), wind, {"_low": 1 / 3, "_high": 2 / 3})
    x = df.join(F.broadcast(q), how="left")  # one row, or none without any wind
    regime = F.when(F.col(wind) < F.col("_low"), "low").when(F.col(wind) < F.col("_high"), "medium").when(F.col(wind).isNotNull(), "high")
    tod = cut_points(F.col(hour), [0, 6, 12, 18, 24], ["night", "morning", "afternoon", "evening"])
    return x.withColumns({"season": season(F.col(month)), "time_of_day": tod, "wind_regime": regime}).drop("_low", "_high")


def horizon_bucket(h: Column) -> Column:
    return cut_points(h, [24, 30, 36, 42, 48.01], ["24-30", "30-36", "36-42", "42-48"])


def coverage(df: DataFrame, lo: str, hi: str, target: str = "y_actual", by: Column | None = None) -> DataFrame:
    """Share of targets inside, below and above a band and its mean width, by horizon bucket and in all (one pass, rollup)."""
    y, a, b = F.col(target), F.col(lo), F.col(hi)
    x = df.dropna(subset=[target, lo, hi]).withColumn("horizons", horizon_bucket(F.col("horizon_h")) if by is None else by)
    share = lambda c: F.avg(c.cast("double")) * 100
    out = x.rollup("horizons").agg(F.grouping("horizons").alias("_all"), F.count("*").alias("n"), share((y >= a) & (y <= b)).alias("coverage"), share(y < a).alias("below"), share(y > b).alias("above"), F.avg(b - a).alias("mean_width"))
    return out.withColumn("horizons", F.when(F.col("_all") == 1, "all").otherwise(F.col("horizons"))).drop("_all")


def window_coverage(df: DataFrame, lo: str, hi: str, target: str = "y_actual") -> DataFrame:
    """One row: the share inside the band, null if there is nothing to count."""
    inside = ((F.col(target) >= F.col(lo)) & (F.col(target) <= F.col(hi))).cast("double")
    return df.agg(F.avg(inside).alias("coverage"), F.count(inside).alias("n"))


def repair_crossing(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """Bounds in order, and a flag where they were not."""
    return df.withColumns({lo: F.least(lo, hi), hi: F.greatest(lo, hi), "crossed": F.col(lo) > F.col(hi)})


def conformal(df: DataFrame, lo: str, hi: str, alpha: float, by: list[str], target: str = "y_actual") -> DataFrame:
    """(by, n, raw_coverage, adjustment): the k-th smallest of max(lo - y, y - hi), k = ceil((n + 1)(1 - alpha)); infinite if k > n.

    A group without rows has no row here; its adjustment is infinite too. The k-th score is found by counting, not by ranking a group.
    """
    y = F.col(target)
    x = df.dropna(subset=[target, lo, hi]).select(*by, F.greatest(F.col(lo) - y, y - F.col(hi)).alias("score"))
    some = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col("score") <= 0).cast("double")).alias("raw_coverage"))
    k = F.ceil((F.col("n") + 1) * F.lit(1 - alpha)).cast("long")
    found = kth(x, "score", some.select(*by, F.lit("k").alias("tag"), k.alias("k")).where("k > 0"), by)
    return some.join(found.select(*by, F.col("score").alias("adjustment")), by, "left").withColumn("adjustment", F.coalesce("adjustment", F.lit(float("inf"))))


def sample_week(df: DataFrame, model: str, n: int = 336, target: str = "y_actual", time: str = "target_time_utc", hour: int = 12) -> DataFrame:
    """The week (from Monday) of ``n`` targets, forecast at one hour for less than 48 hours ahead, whose MAE is nearest the median of
    all such weeks; the earliest of equals."""
    issued = df.where((F.hour("origin_time_utc") == hour) & (F.col("horizon_h") < 48)).dropna(subset=[target, model])
    weekly = issued.groupBy(F.date_trunc("week", time).cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col(model) - F.col(target))).alias("mae"))
    full = weekly.where(F.col("n") == n)
    mid = full.agg(F.percentile("mae", F.lit(0.5)).alias("mid"))  # over weeks: a few numbers a year
    return full.crossJoin(F.broadcast(mid)).orderBy(F.round(F.abs(F.col("mae") - F.col("mid")), 9), "week").limit(1).select("week", "n", "mae")


def window_scores(df: DataFrame, start, end, models: list[str], target: str = "y_actual", time: str = "target_time_utc") -> DataFrame:
    """n, MAE and bias of models for targets in [start, end), on common rows."""
    t, e = F.col(time), F.col("p") - F.col(target)
    x = long(df.where((t >= F.lit(start).cast("timestamp_ntz")) & (t < F.lit(end).cast("timestamp_ntz"))), models, target)
    return x.groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"))


def by_local_hour(df: DataFrame, models: list[str], hour: str = "f_target_local_hour", target: str = "y_actual") -> DataFrame:
    """(hour, model, n, mae) by the local hour of the target, on common rows."""
    x = long(df, models, target)
    return x.groupBy(F.floor(hour).alias("hour"), "model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col(target))).alias("mae"))


def wins(df: DataFrame, models: list[str], reference: str, by: list[str], target: str = "y_actual") -> DataFrame:
    """(model, wins, n): in how many of the groups ``by`` (months, folds) each model's MAE is below the reference's."""
    x = long(df, [*models, reference], target).groupBy(*by, "model").agg(F.avg(F.abs(F.col("p") - F.col(target))).alias("mae"))
    ref = x.where(F.col("model") == reference).select(*by, F.col("mae").alias("_ref"))
    return x.where(F.col("model") != reference).join(ref, by).groupBy("model").agg(F.sum((F.col("mae") < F.col("_ref")).cast("long")).alias("wins"), F.count("*").alias("n"))


def least_mae(scores: DataFrame, without: list[str] = ()) -> DataFrame:
    """One row: the least MAE over models and groups of score_by(), some models left out, and whose it is."""
    x = scores.where(~F.col("model").isin(*without)) if without else scores
    return x.agg(F.min("mae").alias("mae"), F.min_by("model", F.struct("mae", "model")).alias("model"))


def top(df: DataFrame, value: str, n: int, by: list[str] = (), order: list[str] = ()) -> DataFrame:
    """The ``n`` rows of greatest value (of each group); ties by ``order``."""
    if not by:
        return df.orderBy(F.desc(value), *order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), *order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def residuals(df: DataFrame, models: list[str], target: str = "y_actual", lo: int = -160, hi: int = 160, step: int = 5) -> DataFrame:
    """(model, bin, n, density, median) of clipped errors on common rows; densities of a model times ``step`` add up to 1."""
    e = long(df, models, target).select("model", F.greatest(F.least(F.col("p") - F.col(target), F.lit(float(hi))), F.lit(float(lo))).alias("e"))
    bins = e.groupBy("model", histogram(F.col("e"), lo, hi, step).alias("bin")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("model"))  # over a model's bins
    return bins.withColumn("density", F.col("n") / total / step).join(quantiles(e, "e", {"median": 0.5}, ["model"]), "model")


def lead_check(series: DataFrame, lags: list[int], actual: str = "actual", forecast: str = "forecast") -> DataFrame:
    """(model, n, mae) of a stored forecast and of persistence at each lag (columns lag_<n>), where all are known."""
    models = [forecast, *[f"lag_{n}" for n in lags]]
    return long(series, models, actual).groupBy("model").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col(actual))).alias("mae"))


def day_ahead(df: DataFrame, hour: int, models: list[str], hours: tuple[int, ...] = (0, 6, 12, 18)) -> DataFrame:
    """Long view (target, model, value) of forecasts issued at one hour for less than 48 hours ahead: each target once."""
    if hour not in hours:
        raise ValueError(f"forecasts are issued at {hours}")
    unknown = set(models) - set(df.columns)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    x = df.where((F.hour("origin_time_utc") == hour) & (F.col("horizon_h") < 48)).select("target_time_utc", *models)
    return x.unpivot(["target_time_utc"], models, "model", "value").where("value is not null")


def histogram(e: Column, lo: int = -160, hi: int = 160, step: int = 5) -> Column:
    """Left edge of the bin of a clipped value; the last bin includes its right end."""
    return F.least((F.floor((F.greatest(F.least(e, F.lit(float(hi))), F.lit(float(lo))) - lo) / step) * step + lo), F.lit(hi - step)).cast("long")


def series_quality(df: DataFrame, time: str, step_s: int, keys: list[str], values: list[str]) -> DataFrame:
    """One row: rows, distinct keys, first, last, expected and missing slots, duplicate keys and nulls by column, in one pass over the table."""
    d = df.groupBy(*keys, time).agg(F.count("*").alias("_n"), *[F.sum(F.col(v).isNull().cast("long")).alias(f"nulls_{v}") for v in values])
    one = d.agg(
        F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"), F.min(time).alias("first"), F.max(time).alias("last"), F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_keys"),
        *[F.sum(f"nulls_{v}").alias(f"nulls_{v}") for v in values], *([F.countDistinct(*keys).alias("_series")] if keys else [F.lit(1).alias("_series")]),
    )
    slots = (F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))) / step_s + 1
    one = one.withColumn("expected", (slots * F.col("_series")).cast("long"))
    return one.withColumn("missing", F.col("expected") - F.col("n_keys")).drop("_series")


def suspects(df: DataFrame, actual: str, forecast: str, most: float) -> DataFrame:
    """Rows with a suspect value and the reasons, joined in order."""
    why = lambda c, name: [F.when(F.col(c) == 0, F.lit(f"{name} = 0")), F.when(F.col(c) > most, F.lit(f"{name} > {most:g}"))]
    x = df.withColumn("reasons", F.concat_ws("; ", *why(actual, "actual"), *why(forecast, "forecast")))
    return x.where("reasons <> ''")


def calibration(adjustments: DataFrame, results: DataFrame, fold: str, bands: dict[str, tuple[str, str]], target: str = "y_actual") -> DataFrame:
    """adjustments (a row a fold) with the share of the fold's test targets that each band covers, in percent (coverage_<band>)."""
    inside = lambda lo, hi: F.avg(((F.col(target) >= F.col(lo)) & (F.col(target) <= F.col(hi))).cast("double")) * 100
    ends = [c for band in bands.values() for c in band]
    found = results.dropna(subset=[target, *ends]).groupBy(fold).agg(*[inside(*band).alias(f"coverage_{name}") for name, band in bands.items()])
    return adjustments.join(found, fold)
