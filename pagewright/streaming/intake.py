"""Incremental intake: a folder as a stream of files, identified as they come, and progress by file kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..plans.build import routed


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder with format and decoder, as a stream. Names that aren't accepted are dropped before contents are read on."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return routed(files.where(scalars.accepted(F.col("path"))))


def counts(files: DataFrame, late: str = "10 minutes", step: str = "1 hour") -> DataFrame:
    """Files by format and hour of change, with a watermark, so state is bounded."""
    return files.withWatermark("modificationTime", late).groupBy(F.window("modificationTime", step), "format").agg(F.count("*").alias("n"))


def new_only(requests: DataFrame, late: str = "1 hour") -> DataFrame:
    """Preview requests (key, ts) that weren't made before within the watermark: concurrent ones share one decode."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])
