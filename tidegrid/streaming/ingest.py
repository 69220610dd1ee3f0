"""The same ingestion and statistics on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.sources import payloads, tables


def ingest_payloads(spark: SparkSession, landing: str, store: str, checkpoint: str, name: str = "raw_intensity"):
    """Payload files that arrive in ``landing`` are parsed and upserted into a raw table, batch by batch; a repeated batch changes nothing."""
    parse = {"raw_intensity": payloads.intensity, "raw_generation": payloads.generation}[name]

    def upsert(batch: DataFrame, _: int) -> None:
        tables.load(spark, store, name, parse(batch).withColumn("ingested_at_utc", F.current_timestamp().cast("timestamp_ntz")))

    files = spark.readStream.format("text").option("wholetext", True).load(landing).withColumnRenamed("value", "payload")
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def half_hours(events: DataFrame, time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Tumbling half-hour means; rows later than ``late`` are left out."""
    return _windowed(events, time, value, late, F.window(time, "30 minutes"))


def day_statistics(events: DataFrame, time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Sliding 24-hour statistics every half-hour; a window's last slot is the one that ends with it."""
    return _windowed(events, time, value, late, F.window(time, "24 hours", "30 minutes"))


def _windowed(events: DataFrame, time: str, value: str, late: str, window) -> DataFrame:
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "min", "max")


def first_of_each(events: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """Repeated deliveries of a row dropped while its key can still come."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
