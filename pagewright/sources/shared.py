"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir, or in the session's checkpoint folder. Only a session on one machine that has
    neither gets a temporary folder of its own."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        sc.setCheckpointDir(folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df, written as Parquet and read again: its rows and their numbers are the same however often they are read."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
