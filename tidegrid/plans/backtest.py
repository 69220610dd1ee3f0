"""Rolling-origin backtests: each fold and variant is fitted as one group, in parallel."""

from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.training import month_offset, month_starts
from tidegrid.params import Settings, Variant, feature_columns
from tidegrid.plans.gbm import Booster, Params

KEYS = ["origin_time_utc", "horizon_h"]


def folds(df: DataFrame, test_start: datetime, months: int | None = None) -> list[tuple[datetime, datetime]]:
    """(start, end) of monthly folds from test_start to the last origin."""
    last = df.agg(F.max("origin_time_utc")).first()[0]
    if last is None or last < test_start:
        return []
    starts = month_starts(test_start, last)
    starts[0] = test_start
    out = list(zip(starts, starts[1:]))
    return out[:months] if months else out


def dealt(df: DataFrame, edges: list[tuple[datetime, datetime]], variants: list[Variant], columns: list[str]) -> DataFrame:
    """Rows for each fold and variant with their part: train (target before the fold) or test (origin in it); others go nowhere.

    Folds and variants are a handful of numbers, joined by conditions; a group is what one model is fitted on and must fit
    one task, as the model itself does.
    """
    spark = df.sparkSession
    plan = spark.createDataFrame(
        [(f"{a:%Y-%m-%d %H:%M:%S}", f"{b:%Y-%m-%d %H:%M:%S}", v.name, f"{v.train_start:%Y-%m-%d %H:%M:%S}") for a, b in edges for v in variants], "a string, b string, variant string, since string"
    ).select(*[F.to_timestamp_ntz(c).alias(c) for c in ("a", "b", "since")], "variant")
    x = df.dropna(subset=["y_actual"]).select(*KEYS, "target_time_utc", "y_actual", *columns).crossJoin(F.broadcast(plan))
    train = (F.col("target_time_utc") < F.col("a")) & (F.col("origin_time_utc") >= F.col("since"))
    test = (F.col("origin_time_utc") >= F.col("a")) & (F.col("origin_time_utc") < F.col("b"))
    return x.where(train | test).withColumn("is_train", train).withColumnRenamed("a", "fold_start").drop("b", "since")


def run(df: DataFrame, edges: list[tuple[datetime, datetime]], variants: list[Variant], params: dict[str, Params], s: Settings) -> DataFrame:
    """(fold_start, variant, keys, target, y_actual, p, p10, p90, cp10, cp90, adjustment, n_calibration, calibration_coverage, crossed) of all test rows.

    Point forecasts are fitted on everything before the fold. Bands are fitted on what lies before the calibration month and widened
    by the conformal adjustment of that month.
    """
    by_name = {v.name: (feature_columns(df.columns, list(v.prefixes), v.leaky), v) for v in variants}
    columns = sorted({c for cols, _ in by_name.values() for c in cols})
    alpha, months = s.interval_alpha, s.calibration_months

    def one(key, pdf):
        cols, variant = by_name[key[1]]
        p = params[variant.name]
        pdf = pdf.sort_values(KEYS, kind="stable")
        train, test = pdf[pdf.is_train], pdf[~pdf.is_train]
        out = test[["fold_start", "variant", *KEYS, "target_time_utc", "y_actual"]].copy()
        for c in ("p", "p10", "p90", "cp10", "cp90", "adjustment", "calibration_coverage"):
            out[c] = np.nan
        out["n_calibration"], out["crossed"] = 0, False
        if len(train) and len(test):
            x = lambda d: d[cols].to_numpy(float)
            out["p"] = Booster(p).fit(x(train), train.y_actual.to_numpy()).predict(x(test))
            since = month_offset(pd.Timestamp(key[0]), -months)
            fit, cal = train[train.target_time_utc < since], train[train.origin_time_utc >= since]
            if variant.quantiles and len(fit):
                bands = [Booster(Params(**{**vars(p), "objective": "quantile", "alpha": a})).fit(x(fit), fit.y_actual.to_numpy()) for a in (alpha / 2, 1 - alpha / 2)]
                raw = np.array([b.predict(x(test)) for b in bands])
                lo, hi = raw.min(0), raw.max(0)
                q = np.inf
                if len(cal):
                    c = np.array([b.predict(x(cal)) for b in bands])
                    y = cal.y_actual.to_numpy()
                    out["calibration_coverage"] = ((y >= c.min(0)) & (y <= c.max(0))).mean()
                    q = conformal_adjustment(np.maximum(c.min(0) - y, y - c.max(0)), alpha)
                out["p10"], out["p90"], out["cp10"], out["cp90"], out["adjustment"] = lo, hi, lo - q, hi + q, q
                out["n_calibration"], out["crossed"] = len(cal), raw[0] > raw[1]
        return out

    schema = "fold_start timestamp_ntz, variant string, origin_time_utc timestamp_ntz, horizon_h double, target_time_utc timestamp_ntz, y_actual double, p double, p10 double, p90 double, cp10 double, cp90 double, adjustment double, calibration_coverage double, n_calibration long, crossed boolean"
    return dealt(df, edges, variants, columns).groupBy("fold_start", "variant").applyInPandas(one, schema)


def calibration(results: DataFrame, s: Settings) -> DataFrame:
    """(fold_start, variant, calibration_start, n_calibration, calibration_raw_coverage, conformal_adjustment, test_rows_crossed) of
    run()'s folds with bands."""
    x = results.where("p10 is not null").groupBy("fold_start", "variant")
    one = x.agg(F.max("n_calibration").alias("n_calibration"), F.max("calibration_coverage").alias("calibration_raw_coverage"), F.max("adjustment").alias("conformal_adjustment"), F.sum(F.col("crossed").cast("long")).alias("test_rows_crossed"))
    start = F.add_months("fold_start", -s.calibration_months).cast("timestamp_ntz")
    return one.select("fold_start", "variant", start.alias("calibration_start"), "n_calibration", "calibration_raw_coverage", "conformal_adjustment", "test_rows_crossed")


def conformal_adjustment(scores: np.ndarray, alpha: float) -> float:
    """The ceil((n + 1)(1 - alpha))-th smallest score; infinite where there are too few."""
    k = int(np.ceil((len(scores) + 1) * (1 - alpha)))
    return float(np.sort(scores)[k - 1]) if 0 < k <= len(scores) else float("inf")


def wide(results: DataFrame, variants: list[str]) -> DataFrame:
    """One row an origin and horizon, a column for each variant's forecast."""
    return results.groupBy("fold_start", *KEYS, "target_time_utc", "y_actual").pivot("variant", variants).agg(F.first("p"))


def importance(df: DataFrame, edge: tuple[datetime, datetime], variants: list[Variant], params: dict[str, Params]) -> DataFrame:
    """(variant, fold_start, feature, mean_abs_contribution, gain) of the models of one fold."""
    by_name = {v.name: feature_columns(df.columns, list(v.prefixes), v.leaky) for v in variants}
    columns = sorted({c for cols in by_name.values() for c in cols})

    def one(key, pdf):
        cols = by_name[key[1]]
        pdf = pdf.sort_values(KEYS, kind="stable")
        train, test = pdf[pdf.is_train], pdf[~pdf.is_train]
        if not len(train) or not len(test):
            return pd.DataFrame({"variant": [], "fold_start": [], "feature": [], "mean_abs_contribution": [], "gain": []})
        b = Booster(params[key[1]]).fit(train[cols].to_numpy(float), train.y_actual.to_numpy())
        c = np.abs(b.contributions(test[cols].to_numpy(float))).mean(0)
        return pd.DataFrame({"variant": key[1], "fold_start": key[0], "feature": cols, "mean_abs_contribution": c, "gain": b.gain(len(cols))})

    return dealt(df, [edge], variants, columns).groupBy("fold_start", "variant").applyInPandas(one, "variant string, fold_start timestamp_ntz, feature string, mean_abs_contribution double, gain double")


#: What random search draws from.
SPACE = {"rate": (0.02, 0.05, 0.1), "depth": (3, 4, 5, 6), "min_leaf": (10, 20, 50), "l2": (0.0, 1.0, 5.0), "columns": (0.5, 0.8, 1.0), "rows": (0.6, 0.8, 1.0), "objective": ("l2", "l1")}


def tune(df: DataFrame, boundary: datetime, end: datetime, variants: list[Variant], s: Settings) -> DataFrame:
    """(variant, trial, params, rounds, mae) of random configurations, best first: trained before the boundary, scored after it.

    The same distinct configurations for all variants, drawn with the settings' seed; each trial is one group.
    """
    rng, drawn = np.random.default_rng(s.seed), []
    while len(drawn) < s.n_search:
        c = {k: v[int(rng.integers(len(v)))] for k, v in SPACE.items()}
        if c not in drawn:
            drawn.append(c)
    by_name = {v.name: feature_columns(df.columns, list(v.prefixes), v.leaky) for v in variants}
    columns = sorted({c for cols in by_name.values() for c in cols})
    trials = df.sparkSession.range(len(drawn)).select(F.col("id").cast("int").alias("trial"))

    def one(key, pdf):
        cols, config = by_name[key[0]], drawn[key[1]]
        pdf = pdf.sort_values(KEYS, kind="stable")
        a, b = pdf[pdf.is_train], pdf[~pdf.is_train]
        if not len(a) or not len(b):
            return pd.DataFrame({"variant": [], "trial": [], "params": [], "rounds": [], "mae": []})
        m = Booster(Params(**config, rounds=s.max_rounds, seed=s.seed)).fit(a[cols].to_numpy(float), a.y_actual.to_numpy(), b[cols].to_numpy(float), b.y_actual.to_numpy(), s.early_stopping)
        mae = float(np.abs(m.predict(b[cols].to_numpy(float)) - b.y_actual.to_numpy()).mean())
        return pd.DataFrame({"variant": [key[0]], "trial": [key[1]], "params": [json.dumps(config)], "rounds": [m.best], "mae": [mae]})

    x = dealt(df, [(boundary, end)], variants, columns).crossJoin(F.broadcast(trials))
    return x.groupBy("variant", "trial").applyInPandas(one, "variant string, trial int, params string, rounds int, mae double").orderBy("variant", "mae", "trial")


def winners(trials: DataFrame) -> dict[str, dict]:
    """Each tuned variant's best configuration: params, rounds and validation error. Trials are a few rows."""
    out: dict[str, dict] = {}
    for r in trials.orderBy("variant", "mae", "trial").collect():
        out.setdefault(r.variant, {"params": json.loads(r.params), "rounds": int(r.rounds), "validation_mae": round(r.mae, 4)})
    return out


def fitted_with(variants: list[Variant], tuned: dict[str, dict], s: Settings) -> dict[str, Params]:
    """Each variant's parameters: those tuned for it or for the variant that it names; KeyError says which are missing."""
    lacking = sorted({v.source for v in variants} - set(tuned))
    if lacking:
        raise KeyError(f"no tuned parameters of {lacking}: run the tune command")
    return {v.name: Params(**tuned[v.source]["params"], rounds=tuned[v.source]["rounds"], seed=s.seed) for v in variants}
