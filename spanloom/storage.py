"""Cutting lineage: a frame written to the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str = "step", codec: str | None = None) -> DataFrame:
    """``df`` as Parquet under ``spark.checkpoint.dir`` (a local folder only where that is unset and all runs on one machine), read back. ``codec`` compresses it other than the session's setting."""
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "spanloom-shared")
    target = f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(target, compression=codec)
    return spark.read.schema(df.schema).parquet(target)
