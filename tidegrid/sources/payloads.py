"""JSON payloads to rows, and the paced HTTP client that fetches them."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTENSITY = "struct<data:array<struct<`from`:string,`to`:string,intensity:struct<forecast:int,actual:int,index:string>>>>"
GENERATION = "struct<data:array<struct<`from`:string,`to`:string,generationmix:array<struct<fuel:string,perc:double>>>>>"
#: Names of the hourly variables in payloads.
WEATHER = ("wind_speed_100m", "shortwave_radiation", "temperature_2m", "cloud_cover")


class HttpClient:
    """GET of JSON with a minimum interval between requests; repeats after 429, 5xx, broken connections and bad JSON.

    Waits double from ``backoff`` with jitter, or as long as Retry-After says. Clock, sleep and opener can be replaced.
    """

    def __init__(self, interval: float = 0.5, tries: int = 5, backoff: float = 1.0, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep, clock: Callable = time.monotonic):
        self.interval, self.tries, self.backoff = interval, tries, backoff
        self.opener, self.sleep, self.clock = opener, sleep, clock
        self.last: float | None = None

    def get_json(self, url: str, params: dict | None = None):
        if params:
            url += "?" + urllib.parse.urlencode(params, safe=",")
        error: Exception | None = None
        for attempt in range(self.tries):
            if self.last is not None and (wait := self.last + self.interval - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            pause = self.backoff * 2**attempt * (1 + random.random() / 4)
            try:
                with self.opener(url) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise
                error, after = e, (e.headers or {}).get("Retry-After", "")
                pause = float(after) if str(after).isdigit() else pause
            except (OSError, ValueError) as e:
                error = e
            if attempt + 1 < self.tries:
                self.sleep(pause)
        raise RuntimeError(f"no answer from {url} after {self.tries} tries") from error


def landing(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one JSON document each, as column ``payload``."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload")


def _minute(c: str) -> Column:
    return F.to_timestamp_ntz(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm"))


def _parsed(df: DataFrame, schema: str, field: str, col: str) -> DataFrame:
    """The payload's struct; a payload without the field is an error, not an empty result."""
    p = df.select(F.from_json(col, schema).alias("p"))
    return p.select(F.when(F.col(f"p.{field}").isNull(), F.raise_error(F.lit(f"payload without {field}"))).otherwise(F.col(f"p.{field}")).alias(field))


def intensity(df: DataFrame, col: str = "payload") -> DataFrame:
    rows = _parsed(df, INTENSITY, "data", col).select(F.inline("data"))
    return rows.select(_minute("from").alias("period_start_utc"), _minute("to").alias("period_end_utc"), F.col("intensity.forecast").alias("forecast_gco2"), F.col("intensity.actual").alias("actual_gco2"), F.col("intensity.index").alias("intensity_index"))


def generation(df: DataFrame, col: str = "payload") -> DataFrame:
    rows = _parsed(df, GENERATION, "data", col).select(F.inline("data"))
    rows = rows.select(_minute("from").alias("period_start_utc"), _minute("to").alias("period_end_utc"), F.explode("generationmix").alias("m"))
    return rows.select("period_start_utc", "period_end_utc", "m.fuel", "m.perc")


def _zip_hours(df: DataFrame, names: dict[str, str], col: str) -> DataFrame:
    schema = "struct<hourly:struct<time:array<string>," + ",".join(f"`{n}`:array<double>" for n in names) + ">>"
    h = _parsed(df, schema, "hourly", col)
    rows = h.select(F.inline(F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{n}").alias(a) for n, a in names.items()])))
    return rows.select(_minute("time").alias("time_utc"), *names.values()).dropna("all", subset=list(names.values()))


def hourly(df: DataFrame, col: str = "payload") -> DataFrame:
    """Parallel arrays zipped by position; hours without any value are dropped."""
    return _zip_hours(df, {n: n for n in WEATHER}, col)


def previous_runs(df: DataFrame, lead_days: tuple[int, ...] = (1, 2, 3), col: str = "payload") -> DataFrame:
    """One row an hour and lead day from <variable>_previous_day<n> arrays."""
    parts = [_zip_hours(df, {f"{n}_previous_day{d}": n for n in WEATHER}, col).withColumn("lead_days", F.lit(d)) for d in lead_days]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
