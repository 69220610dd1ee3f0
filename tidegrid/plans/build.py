"""From raw tables to feature layers, and incremental ingestion of what is missing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import series as S
from tidegrid.operators import training as T
from tidegrid.params import Settings
from tidegrid.sources import payloads as P
from tidegrid.sources import tables as K

FUELS = ["gas", "coal", "nuclear", "wind", "solar", "hydro", "biomass", "imports", "other"]
LAYERS = ["stg_intensity", "stg_generation", "stg_weather_hourly", "calendar", "feat_history", "feat_weather", "training_set"]


def _weather(raw: DataFrame) -> DataFrame:
    named = {n: v for n, v in zip(P.WEATHER, T.VARIABLES)}
    return raw.withColumnsRenamed({"time_utc": "time", **named})


def layers(spark: SparkSession, store: str, s: Settings) -> dict[str, DataFrame]:
    """The layers as plans over a store's raw tables, in the order in which they build on each other."""
    raw = K.read(spark, store, "raw_intensity").select(F.col("period_start_utc").alias("period"), F.col("actual_gco2").alias("actual"), F.col("forecast_gco2").alias("forecast"))
    staged = T.stage_intensity(raw, s.suspect_max)
    mix = T.stage_mix(K.read(spark, store, "raw_generation").withColumnRenamed("period_start_utc", "period"), FUELS)
    weather = T.stage_weather(_weather(K.read(spark, store, "raw_weather_archive")), _weather(K.read(spark, store, "raw_weather_prev_runs")))
    slots = S.spine(spark, *S.bounds(raw, "period", s.start))
    last = raw.agg(F.max("period").alias("last"))
    calendar = S.calendar(slots, S.holidays(spark, s.start.year, datetime.now().year + 1), s.time_zone)
    past = slots.crossJoin(F.broadcast(last)).where("period <= last").drop("last")
    series = past.join(staged.select("period", F.col("actual").alias("intensity")), "period", "left").join(mix, "period", "left")
    history = S.history(series)
    by_role = T.weather_by_role(T.align_weather(slots, weather), K.read(spark, store, "raw_weather_locations"), s)
    return dict(zip(LAYERS, [staged, mix, weather, calendar, history, by_role, T.training_set(calendar, staged, history, by_role, s)]))


def build(spark: SparkSession, store: str, s: Settings) -> dict[str, int]:
    """Writes all layers, each read back by those after it; their numbers of rows. The training set is partitioned by month of origin."""
    plan = layers(spark, store, s)
    for name in LAYERS[:-1]:
        K.write(plan[name], store, name, [c for c in ("period", "time", "lead_days", "location_id") if c in plan[name].columns])
    read = {name: spark.read.parquet(f"{store}/{name}") for name in LAYERS[:-1]}
    t = T.training_set(read["calendar"], read["stg_intensity"], read["feat_history"], read["feat_weather"], s)
    t = t.withColumn("origin_month", F.date_format("origin_time_utc", "yyyy-MM"))
    t = t.hint("rebalance", "origin_month").sortWithinPartitions("origin_month", "origin_time_utc", "horizon_h")
    t.write.mode("overwrite").partitionBy("origin_month").parquet(f"{store}/training_set")
    return {name: spark.read.parquet(f"{store}/{name}").count() for name in LAYERS}


def training_set(spark: SparkSession, store: str, start: datetime | None = None, end: datetime | None = None, labelled: bool = False) -> DataFrame:
    """Rows of origins in [start, end) without provenance columns; the months outside are never read."""
    t = spark.read.parquet(f"{store}/training_set")
    for bound, op in ((start, "__ge__"), (end, "__lt__")):
        if bound is not None:
            t = t.where(getattr(F.col("origin_time_utc"), op)(F.lit(bound).cast("timestamp_ntz")))
            t = t.where(F.col("origin_month") >= f"{bound:%Y-%m}" if op == "__ge__" else F.col("origin_month") <= f"{bound:%Y-%m}")
    if labelled:
        t = t.where("y_actual is not null")
    return t.drop(*[c for c in t.columns if c.startswith("asof_")], "origin_month")


@dataclass(frozen=True)
class Source:
    """One API: where to ask, how to read the answer, which raw table it fills and how long a request may span."""

    name: str
    table: str
    url: str  # with {start} and {end}
    parse: Callable[[DataFrame], DataFrame]
    present: Callable[[DataFrame], DataFrame]
    most: timedelta = timedelta(days=30)
    step: timedelta = timedelta(minutes=30)
    by_end: bool = True  # the API selects slots by their end
    columns: dict[str, object] = field(default_factory=dict)  # of every row of this source, as its site


def intensity_source(url: str) -> Source:
    return Source("intensity", "raw_intensity", url, P.intensity, K.settled)


def generation_source(url: str) -> Source:
    return Source("generation", "raw_generation", url, P.generation, lambda raw: raw.select("period_start_utc").distinct())


#: Weather products and the raw tables that they fill.
WEATHER_TABLES = {"weather_archive": "raw_weather_archive", "weather_hist_forecast": "raw_weather_hist_forecast", "weather_prev_runs": "raw_weather_prev_runs"}
SOURCES = ("intensity", "generation", *WEATHER_TABLES)


def weather_source(product: str, url: str, site: tuple, lead_days: tuple[int, ...] = (1, 2, 3)) -> Source:
    """A product of one site; the URL has {latitude}, {longitude} and {hourly} beside {start} and {end}.

    An hour of previous runs is there when all its lead days are.
    """
    location, _, _, latitude, longitude = site
    mine = lambda raw: raw.where(F.col("location_id") == location)
    if product == "weather_prev_runs":
        hourly = ",".join(f"{v}_previous_day{n}" for v in P.WEATHER for n in lead_days)
        parse = lambda df: P.previous_runs(df, lead_days)
        present = lambda raw: K.complete(mine(raw), ["time_utc"], lead_days)
    else:
        hourly, parse, present = ",".join(P.WEATHER), P.hourly, lambda raw: mine(raw).select("time_utc")
    filled = url.replace("{latitude}", str(latitude)).replace("{longitude}", str(longitude)).replace("{hourly}", hourly)
    return Source(f"{product}/{location}", WEATHER_TABLES[product], filled, parse, present, timedelta(days=366), timedelta(hours=1), by_end=False, columns={"location_id": location})


def planned(spark: SparkSession, store: str, source: Source, start: datetime, end: datetime) -> list[tuple[datetime, datetime]]:
    """Requests for the slots from start to end that the store lacks or holds unsettled."""
    have = source.present(K.read(spark, store, source.table)).withColumnsRenamed({"period_start_utc": "ts", "time_utc": "ts"})
    gaps = [(r.first, r.last) for r in S.missing_ranges(have, start, end, int(source.step.total_seconds())).collect()]  # runs, not slots
    chunks = S.plan_chunks(gaps, source.step, source.most)
    return S.split_at_year_end(chunks, source.step) if source.by_end else chunks


def ingest(spark: SparkSession, store: str, source: Source, client: P.HttpClient, start: datetime, end: datetime, dry_run: bool = False) -> dict[str, int]:
    """Fetches and upserts what is missing; the numbers of requests and of rows. A repeated call asks only for what is still missing.

    Sources that select by a slot's end are asked by minute, the others by whole days.
    """
    chunks, rows = planned(spark, store, source, start, end), 0
    if not dry_run:
        import json

        for a, b in chunks:
            first, last = (f"{t + source.step:%Y-%m-%dT%H:%MZ}" if source.by_end else f"{t:%Y-%m-%d}" for t in (a, b))
            answer = client.get_json(source.url.format(start=first, end=last))
            batch = source.parse(spark.createDataFrame([(json.dumps(answer),)], "payload string"))
            own = {c: F.lit(v) for c, v in source.columns.items()}
            rows += K.load(spark, store, source.table, batch.withColumns({**own, "ingested_at_utc": F.current_timestamp().cast("timestamp_ntz")}))
    return {"requests": len(chunks), "rows": rows}


def ingest_all(
    spark: SparkSession, store: str, urls: dict[str, str], s: Settings, client: P.HttpClient, start: datetime, end: datetime, dry_run: bool = False
) -> dict[str, dict[str, int]]:
    """Every source with a URL: the requests and rows of each, weather by site. Sites are stored first."""
    unknown = set(urls) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}; there are {list(SOURCES)}")
    made = {"intensity": intensity_source, "generation": generation_source}
    todo = [made[n](u) for n, u in urls.items() if n in made]
    todo += [weather_source(n, u, site, s.lead_days) for n, u in urls.items() if n in WEATHER_TABLES for site in s.sites]
    if not dry_run and set(urls) & set(WEATHER_TABLES):
        K.locations(spark, store, s.sites)
    return {x.name: ingest(spark, store, x, client, start, end, dry_run) for x in todo}


def result_context(spark: SparkSession, store: str, results: DataFrame) -> DataFrame:
    """Backtest results with the context of their targets, from the store's layers."""
    return T.with_target_context(results, spark.read.parquet(f"{store}/calendar"), spark.read.parquet(f"{store}/stg_generation"))
