"""Hits and misses of a least-recently-used cache over all requests, in order of time.

What the cache holds at a moment is the `entries` distinct keys used last. So requests are cut into ranges of time, each
range is told the keys that were used last before it (at most `entries`, however long the past is), and replays its own
requests from there in a task. The keys before a range are put together by doubling: those of the range before, of the
two before, the four before, until each range has enough or nothing is left."""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.build import CACHE_ENTRIES
from ..sources.shared import settled

#: Requests of a range, about.
RANGE_ROWS = 250_000


def _last(rows: DataFrame, entries: int) -> DataFrame:
    """range, key, at: the keys of each range that were used last."""
    used = rows.groupBy("range", "key").agg(F.max("at").alias("at"))
    order = Window.partitionBy("range").orderBy(F.desc("at"))
    return used.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= entries).drop("_n")


def keys_before(ranged: DataFrame, ranges: int, entries: int) -> DataFrame:
    """range, key, at: the keys used last before each range."""
    moved = lambda rows, by: rows.withColumn("range", F.col("range") + by).where(F.col("range") < ranges)
    held, reach = settled(moved(_last(ranged.where(F.col("key").isNotNull()).select("range", "key", "at"), entries), 1), "last-used"), 1
    while reach < ranges:
        full = held.groupBy("range").count().where((F.col("count") == entries) | (F.col("range") <= reach)).count()
        if full >= ranges - 1:  # the first range has nothing before it
            break
        held, reach = settled(_last(held.unionByName(moved(held, reach)), entries), "last-used"), 2 * reach
    return held


def hits(requests: DataFrame, number: str, entries: int = CACHE_ENTRIES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """number, key, ts, hit of each request (number, key, ts), in order of ts, then number. A request without a key (its file
    is missing) is never kept and never a hit."""
    rows = requests.select(number, "key", "ts")
    ranges = max(1, -(-rows.count() // range_rows))
    placed = rows.repartitionByRange(ranges, "ts", number).sortWithinPartitions("ts", number).withColumn("at", F.monotonically_increasing_id())
    ranged = settled(placed.withColumn("range", F.shiftright("at", 33).cast("int")), "requests")
    before = keys_before(ranged, ranges, entries) if ranges > 1 else None
    told = ranged.withColumn("asked", F.lit(True))
    if before is not None:
        told = told.unionByName(before.withColumn("asked", F.lit(False)), allowMissingColumns=True)

    def run(batches):
        held, here = OrderedDict(), None
        for batch in batches:
            found = []
            for range_, key in zip(batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if range_ != here:
                    held, here = OrderedDict(), range_
                found.append(key is not None and key in held)
                if key is not None:
                    held[key] = True
                    held.move_to_end(key)
                    if len(held) > entries:
                        held.popitem(last=False)
            kept = batch.column(5)
            out = pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found)], [number, "key", "ts", "hit"])
            yield out.filter(kept)

    schema = rows.withColumn("hit", F.lit(True)).schema
    return told.select(number, "key", "ts", "at", "range", "asked").repartition("range").sortWithinPartitions("range", "at").mapInArrow(run, schema)
