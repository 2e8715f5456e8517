"""Ordered file lists. Rows have no order of their own: `pos` is always an explicit column, and lists are kept apart by a
key, so numbering and moving shuffle by list and never gather all files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars


def folder_scan(files: DataFrame, tie: str, path: str = "path") -> DataFrame:
    """Accepted files with name, extension, kind and their place in the folder's natural order. An empty table gives none."""
    p = F.col(path)
    rows = files.where(scalars.accepted(p)).withColumns({"name": scalars.basename(p), "ext": scalars.extension(p), "is_pdf": scalars.is_pdf(p), "kind": scalars.kind(p)})
    order = Window.partitionBy(scalars.directory(p)).orderBy(scalars.natural_key(F.col("name")), "name", tie)
    return rows.withColumn("place", F.row_number().over(order))


def intake(files: DataFrame, list_key: str, path: str = "path", pos: str = "pos") -> DataFrame:
    """Accepted dropped files of each list: the first of each exact path, numbered by pos from 1."""
    first = files.where(scalars.accepted_when_dropped(F.col(path))).groupBy(list_key, path).agg(F.min(pos).alias(pos))
    return numbered(first, list_key, pos, path)


def numbered(files: DataFrame, list_key: str, *order: str) -> DataFrame:
    """files with num, their place in the list from 1."""
    return files.withColumn("num", F.row_number().over(Window.partitionBy(list_key).orderBy(*(order or ("pos",)))))


def moved(files: DataFrame, list_key: str, source: Column, target: Column, pos: str = "pos") -> DataFrame:
    """new_pos after the file at `source` is taken out and put in at `target`; nothing moves if a place isn't in the list."""
    n = F.count("*").over(Window.partitionBy(list_key))
    p = F.col(pos)
    new = (
        F.when((source == target) | (source < 0) | (target < 0) | (source >= n) | (target >= n), p)
        .when(p == source, target)
        .when((source < target) & (p > source) & (p <= target), p - 1)
        .when((target < source) & (p >= target) & (p < source), p + 1)
        .otherwise(p)
    )
    return files.withColumn("new_pos", new)


def reordered(files: DataFrame, order: DataFrame, list_key: str, path: str = "path") -> DataFrame:
    """files in the order of `order` (list key, path, pos); files that it leaves out are dropped, with what belongs to them."""
    return files.drop("pos").join(order.select(list_key, path, "pos"), [list_key, path])


def removed(files: DataFrame, list_key: str, place: Column, pos: str = "pos") -> DataFrame:
    """files without the one at `place`; pos closes up."""
    return files.where(F.col(pos) != place).withColumn(pos, F.when(F.col(pos) > place, F.col(pos) - 1).otherwise(F.col(pos)))


def without_left(turns: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Turns of paths that are still in the list, and only those that turn."""
    return turns.where(F.col("deg") != 0).join(files.select(path).distinct(), path, "left_semi")


def with_turns(files: DataFrame, turns: DataFrame, path: str = "path") -> DataFrame:
    """files with `turn`, a quarter turn by path; 0 for paths without one. One turn per path is expected; the join strategy
    is left to the optimizer, as the table of turns grows with the list."""
    return files.join(turns, path, "left").withColumn("turn", scalars.norm_rotation(F.coalesce("deg", F.lit(0))))
