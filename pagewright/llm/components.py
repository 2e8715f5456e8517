"""Connected components of a distributed graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one edge down, to a node that has none: then edges are stars around their least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    of_node = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return of_node.where("down > 1 OR down = 1 AND up = 1").isEmpty()


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for each node of an edge; component is the least node of its component.

    edges: columns u and v of one ordered type, any direction, repeats allowed. Each round sends every node's larger
    neighbours, then its smaller ones, to its least neighbour, by a grouped minimum with map-side partials and a join;
    it ends when only stars are left. Edges are written out each round; no node's neighbours are ever gathered.
    rows: how many edges there are at most, if that is known; no round has more."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges", rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", rows)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
