"""Reading whole files with a row for each listed path, missing and empty ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _plain(path):
    """A path as the file source writes it, without scheme."""
    return F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:/{1,3}(?=[^/])", "/")


def listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list of files as (pos, path), in the order given; a path may come twice."""
    return spark.createDataFrame(list(enumerate(paths)), "pos int, path string")


def stat_scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and modificationTime of a folder's files; contents are pruned from the scan."""
    return spark.read.format("binaryFile").load(folder).select(_plain(F.col("path")).alias("path"), "length", "modificationTime")


def read_listed(manifest: DataFrame, folder: str) -> DataFrame:
    """manifest (path, ...) with content, length, modificationTime and error of the files below folder.

    The file source drops empty files and fails on missing ones, so the folder is scanned and joined to the list: a path
    without a row is missing or empty, and stays as a row with an error."""
    found = manifest.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = found.select(_plain(F.col("path")).alias("path"), "content", "length", "modificationTime")
    joined = manifest.join(found, "path", "left")
    return joined.withColumn("error", F.when(F.col("length").isNull(), "ENOENT: missing or empty").when(F.col("length") == 0, "empty"))
