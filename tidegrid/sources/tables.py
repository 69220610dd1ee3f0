"""Raw tables and writes that can be repeated: keyed upserts, overwrites, text and YAML reports."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "wind_speed_100m double, shortwave_radiation double, temperature_2m double, cloud_cover double, ingested_at_utc timestamp_ntz"
#: Schemas of the raw tables and their keys.
RAW = {
    "raw_intensity": ("period_start_utc timestamp_ntz, period_end_utc timestamp_ntz, forecast_gco2 int, actual_gco2 int, intensity_index string, ingested_at_utc timestamp_ntz", ["period_start_utc"]),
    "raw_generation": ("period_start_utc timestamp_ntz, period_end_utc timestamp_ntz, fuel string, perc double, ingested_at_utc timestamp_ntz", ["period_start_utc", "fuel"]),
    "raw_weather_locations": ("location_id string, name string, role string, latitude double, longitude double", ["location_id"]),
    "raw_weather_archive": (f"location_id string, time_utc timestamp_ntz, {_W}", ["location_id", "time_utc"]),
    "raw_weather_hist_forecast": (f"location_id string, time_utc timestamp_ntz, {_W}", ["location_id", "time_utc"]),
    "raw_weather_prev_runs": (f"location_id string, time_utc timestamp_ntz, lead_days int, {_W}", ["location_id", "time_utc", "lead_days"]),
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def _month(name: str):
    """A raw table's partition: the month of its time key; None for dimensions."""
    times = [k for k in RAW[name][1] if k.endswith("_utc")]
    return F.date_format(times[0], "yyyy-MM") if times else None


def read(spark: SparkSession, path: str, name: str, months: list[str] | None = None) -> DataFrame:
    """A raw table (of some months), or an empty one of its schema where nothing has been written."""
    schema = spark.createDataFrame([], RAW[name][0])
    if not _exists(spark, f"{path}/{name}"):
        return schema
    if _month(name) is None:
        return spark.read.schema(RAW[name][0]).parquet(f"{path}/{name}")
    t = spark.read.schema(f"{RAW[name][0]}, month string").parquet(f"{path}/{name}")
    return (t if months is None else t.where(F.col("month").isin(months))).select(schema.columns)


def missing(spark: SparkSession, path: str, names: list[str]) -> list[str]:
    """Which of the tables a store lacks."""
    return [n for n in names if not _exists(spark, f"{path}/{n}")]


def put(df: DataFrame, path: str, name: str) -> None:
    """Writes a raw table, or replaces the months of it that df has, all rows of which df must hold.

    The rows are written aside first: they may have been read from the very files that they replace. Adaptive execution
    deals a month to as many tasks as its size asks for; rows lie in the order of the key inside a file.
    """
    if _month(name) is None:
        return write(df, path, name)
    spark, aside = df.sparkSession, f"{path}/{name}.new"
    dealt = df.withColumn("month", _month(name)).hint("rebalance", "month")
    dealt.write.mode("overwrite").parquet(aside)
    rows = spark.read.parquet(aside).hint("rebalance", "month").sortWithinPartitions("month", *RAW[name][1])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(f"{path}/{name}")
    p = spark._jvm.org.apache.hadoop.fs.Path(aside)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def latest(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order`` (nulls first), of equals the last in the order of the input.

    An aggregation, not a window, so a frequent key is combined where it is read.
    """
    rest = [c for c in batch.columns if c not in keys]
    at = F.struct(F.col(order), F.col("_at"))
    last = batch.withColumn("_at", F.monotonically_increasing_id()).groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """old with new's rows: a null in ``keep`` columns doesn't replace a value, all other columns take the new row's.

    A full outer join on the key; new must have one row a key (see latest()).
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    took = F.coalesce("_new", F.lit(False))
    value = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep or c in keys else F.when(took, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*[value(c).alias(c) for c in old.columns])


def upsert_plain(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Last write wins."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def write(df: DataFrame, path: str, name: str, by: list[str] = ()) -> None:
    """Replaces a table as a whole, rows ordered ``by`` inside its files.

    It is written aside; then the old one is renamed out of the way and comes back if the new one can't take its name. A table is thus
    never lost, and one that a broken run left out of the way is put back by the next.
    """
    spark = df.sparkSession
    at = lambda suffix="": spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}{suffix}")
    fs = at().getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(at(".old")) and not fs.exists(at()):
        fs.rename(at(".old"), at())
    (df.sortWithinPartitions(*by) if by else df).write.mode("overwrite").parquet(f"{path}/{name}.new")
    fs.delete(at(".old"), True)
    if fs.exists(at()) and not fs.rename(at(), at(".old")):
        raise OSError(f"{path}/{name} could not be moved")
    if not fs.rename(at(".new"), at()):
        fs.rename(at(".old"), at())
        raise OSError(f"{path}/{name} could not be replaced")
    fs.delete(at(".old"), True)


def load(spark: SparkSession, path: str, name: str, batch: DataFrame) -> int:
    """Upserts a batch (with ingested_at_utc) into a raw table; the number of rows it had. Only the months that it touches are read and written."""
    keys = RAW[name][1]
    columns = spark.createDataFrame([], RAW[name][0]).columns
    batch = latest(batch.select(columns), keys, "ingested_at_utc" if "ingested_at_utc" in columns else keys[0])
    keep = [c for c in columns if c not in {"period_end_utc", "ingested_at_utc", *keys}]
    month = _month(name)
    n = batch.count()
    if month is None:
        put(upsert_plain(read(spark, path, name), batch, keys), path, name)
    elif n:
        months = [r[0] for r in batch.select(month).distinct().collect()]  # as many as a request spans
        put(upsert(read(spark, path, name, months), batch, keys, keep), path, name)
    return n


def settled(raw: DataFrame) -> DataFrame:
    """Periods that need no second fetch: the actual is known, or it was asked for two days or more after the period's end."""
    return raw.where(F.col("actual_gco2").isNotNull() | (F.col("ingested_at_utc") >= F.col("period_end_utc") + F.expr("interval 2 days"))).select("period_start_utc")


def complete(raw: DataFrame, keys: list[str], lead_days: tuple[int, ...]) -> DataFrame:
    """Keys of which all these lead days are there."""
    found = F.count_distinct(F.when(F.col("lead_days").isin(*lead_days), F.col("lead_days")))
    return raw.groupBy(*keys).agg(found.alias("n")).where(F.col("n") == len(set(lead_days))).select(*keys)


def locations(spark: SparkSession, path: str, sites: list[tuple]) -> int:
    """Upserts the sites (id, name, role, latitude, longitude) into raw_weather_locations; their number."""
    return load(spark, path, "raw_weather_locations", spark.createDataFrame([tuple(x) for x in sites], RAW["raw_weather_locations"][0]))


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """One file with rounded doubles; for small reports."""
    cols = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def markdown_table(columns: list[str], rows: list, float_format: str = "{:.3f}") -> str:
    """Rows as a Markdown table: booleans as words, whole numbers with thousands, missing values empty."""

    def cell(x) -> str:
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool):
            return str(x)
        return float_format.format(x) if isinstance(x, float) else f"{x:,}" if isinstance(x, int) else str(x)

    lines = [columns, ["---"] * len(columns), *[[cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def replace_block(text: str, name: str, content: str) -> str:
    """The text between <!-- name:start --> and <!-- name:end --> replaced; doing it again changes nothing."""
    pattern = re.compile(rf"(<!-- {re.escape(name)}:start -->\n).*?(<!-- {re.escape(name)}:end -->)", re.S)
    if not pattern.search(text):
        raise ValueError(f"no markers of {name}")
    return pattern.sub(lambda m: f"{m[1]}{content}\n{m[2]}", text)
