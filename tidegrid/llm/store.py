"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below spark.checkpoint.dir. Where that is unset (tests, a single machine) one is made for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("tidegrid.shared.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="tidegrid-")
            spark.conf.set("tidegrid.shared.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and a lost executor costs no recomputation."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidegrid_path = path
    return out


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """From now on the session hands rows to Python in batches of at most ``rows``, no more than the operators work on at a time.

    Spark's 10,000 texts a batch are tens of MB for each task in the executor's direct memory, and as much in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def drop(df: DataFrame) -> None:
    """Removes a table made by cut() that nothing reads any more."""
    path = getattr(df, "_tidegrid_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def id_filter(ids: DataFrame, *cols: str, names: tuple[str, ...] = (), bits: int = 1 << 23) -> Column:
    """A condition on columns ``cols`` (called ``names`` in ids, if otherwise; of the same types) that holds for every row of ``ids`` and few others.

    It is a bit map of fixed size (``bits``/8 bytes, 1 MB, whatever the number of ids), a scalar subquery of the plan; it spares
    the exchange of rows that a following join would drop. When it is full it only stops sparing, so results never depend on it.
    """
    place = lambda xs: F.pmod(F.xxhash64(*xs), F.lit(bits))
    rows = (
        ids.select(place(names or cols).alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("m"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("m").to_numpy()
    table = ids.sparkSession.createDataFrame(pa.table({"m": pa.array([words], pa.list_(pa.int64()))})).scalar()
    at = place(cols)
    return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1
