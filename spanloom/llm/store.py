"""Shared storage: cutting lineage in a folder that driver and executors both see."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows`` rows from now on: a batch is in memory several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def tasks_for(*tables: DataFrame) -> int:
    """As many tasks as Spark takes to read the largest of some written tables, one for each core at least.

    A table of no more rows than these is written by so many: small ones do not become a file for each partition of a shuffle.
    """
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, *(t.rdd.getNumPartitions() for t in tables))


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: later reads don't recompute it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Delete what ``materialize`` has written, once nothing reads it any more."""
    for df in written:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
