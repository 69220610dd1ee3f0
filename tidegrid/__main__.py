"""python -m tidegrid COMMAND --store DIR [--settings FILE] ...: ingest, quality, features, tune, backtest, evaluate, explore."""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timedelta
from functools import reduce
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.training import month_offset
from tidegrid.params import Settings, dump_tuned, load_tuned
from tidegrid.plans import backtest as B
from tidegrid.plans import build, report
from tidegrid.plans.gbm import Params
from tidegrid.sources import tables as K
from tidegrid.sources.payloads import HttpClient


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegrid", description=__doc__)
    p.add_argument("command", choices=["ingest", "quality", "features", "tune", "backtest", "evaluate", "explore"])
    p.add_argument("--store", required=True)
    p.add_argument("--settings")
    p.add_argument("--out", help="where a report goes (else it is printed)")
    p.add_argument("--source", action="append", choices=build.SOURCES, help="ingest: may be given several times, each with its --url")
    p.add_argument("--url", action="append", help="ingest: of the source before it, with {start} and {end}; of weather also {latitude}, {longitude} and {hourly}")
    p.add_argument("--start", type=datetime.fromisoformat, help="first instant; tune and backtest: of the test period (else the settings')")
    p.add_argument("--end", type=datetime.fromisoformat)
    p.add_argument("--dry-run", action="store_true", help="ingest: plan requests, make none")
    p.add_argument("--tuned", help="parameters that tune writes and backtest reads (STORE/tuned.yaml)")
    p.add_argument("--n-search", type=int, help="tune: configurations to try for each variant")
    p.add_argument("--rounds", type=int, help="backtest: this many rounds with default parameters, tuned ones aside")
    p.add_argument("--figures", help="evaluate: folder for SVG files")
    p.add_argument("--document", help="evaluate: a text whose marked blocks are brought up to date")
    p.add_argument("--hour", type=int, default=12, help="explore: when forecasts were issued")
    p.add_argument("--models", default="weather_forecast,seasonal_naive_day", help="explore: comma-separated")
    return p


def tune(spark: SparkSession, a: argparse.Namespace, s: Settings, tuned: str) -> str:
    """Searches on the months before the test period, which is never read; writes the winners."""
    test_start = a.start or s.test_start
    boundary = month_offset(test_start, -s.validation_months) if a.end is None else a.start
    end = a.end or test_start
    s = Settings(**{**vars(s), "n_search": a.n_search or s.n_search})
    trials = B.tune(build.training_set(spark, a.store, end=end), boundary, end, s.tuned, s)
    K.write(trials, a.store, "tuning_trials")
    trials = spark.read.parquet(f"{a.store}/tuning_trials")
    dump_tuned(B.winners(trials), tuned, f"Validation origins from {boundary:%Y-%m-%d} to {end:%Y-%m-%d}; training targets end before them.")
    return K.markdown_table(trials.columns, [tuple(r) for r in trials.orderBy("variant", "mae", "trial").collect()])


def backtest(spark: SparkSession, a: argparse.Namespace, s: Settings, tuned: str) -> dict[str, int]:
    """Monthly folds from the start of the test period; writes results with context, calibration and feature importance."""
    t = build.training_set(spark, a.store, end=a.end)
    variants = list(s.variants)
    fit = {v.name: Params(rounds=a.rounds, seed=s.seed) for v in variants} if a.rounds else B.fitted_with(variants, load_tuned(tuned), s)
    edges = B.folds(t, a.start or s.test_start)
    if not edges:
        raise SystemExit("no origins in the test period")
    K.write(B.run(t, edges, variants, fit, s), a.store, "backtest_raw")
    results = spark.read.parquet(f"{a.store}/backtest_raw")
    K.write(build.result_context(spark, a.store, results), a.store, "backtest_results", ["origin_time_utc", "horizon_h"])
    K.write(B.calibration(results, s), a.store, "backtest_interval_calibration")
    K.write(B.importance(t, edges[-1], s.tuned, fit), a.store, "backtest_feature_importance")
    return {r.variant: r["count"] for r in results.groupBy("variant").count().collect()}


def evaluate(spark: SparkSession, a: argparse.Namespace, s: Settings) -> str:
    """Writes the metric tables, the figures and the marked blocks of a document; the report's text."""
    tables, figures = report.evaluate(spark, a.store, s)
    for name in ("overall", "by_horizon"):
        K.write(tables[name], a.store, f"backtest_metrics_{name}")
    bands = [tables[f"coverage_{b}"].withColumn("band", F.lit(b)) for b in report.BANDS if f"coverage_{b}" in tables]
    if bands:
        K.write(reduce(lambda x, y: x.unionByName(y), bands), a.store, "backtest_interval_coverage")
    K.write_csv(tables["by_horizon"], f"{a.store}/metrics_by_horizon.csv")
    if a.figures:
        Path(a.figures).mkdir(parents=True, exist_ok=True)
        for name, svg in figures.items():
            (Path(a.figures) / f"{name}.svg").write_text(svg)
    if a.document:
        path = Path(a.document)
        path.write_text(report.blocks(path.read_text(), tables))
    return report.text(tables)


def main(args: list[str] | None = None) -> None:
    p = arguments()
    a = p.parse_args(args)
    s = Settings.load(a.settings) if a.settings else Settings()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    tuned = a.tuned or f"{a.store}/tuned.yaml"

    def put(text: str) -> None:
        Path(a.out).write_text(text) if a.out else print(text)

    if a.command == "ingest":
        names = a.source or ["intensity"]
        if not (a.url and a.start and a.end) or len(a.url) != len(names):
            p.error("ingest needs a --url for each --source, --start and --end")
        if a.end < a.start:
            p.error("--end is before --start")
        print(json.dumps(build.ingest_all(spark, a.store, dict(zip(names, a.url)), s, HttpClient(), a.start, a.end, a.dry_run)))
    elif a.command == "quality":
        put(report.quality(spark, a.store, s))
    elif a.command == "features":
        print(build.build(spark, a.store, s))
    elif a.command == "tune":
        put(tune(spark, a, s, tuned))
    elif a.command == "backtest":
        print(backtest(spark, a, s, tuned))
    elif a.command == "evaluate":
        put(evaluate(spark, a, s))
    else:
        if not a.start:
            p.error("explore needs --start")
        put(report.explorer(spark, a.store, a.start, a.end or a.start + timedelta(days=7), a.hour, a.models.split(",")))


if __name__ == "__main__":
    main()
