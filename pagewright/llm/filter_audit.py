"""Filter interaction audit: what each of a few filters removes, at each place of each order they can run in.

A document's failures are one mask, so a part of the corpus is 2^k counts, a cell a mask. A Gray-code walk over the sets of
active filters toggles one filter a step: it keeps, for each cell, how many active filters the cell fails, and the
survivors (documents, good ones, toxic ones) as running sums that change by the cells whose counter leaves or reaches 0.
The survivors of all 2^k sets are kept; a step of an order is the difference of two of them.

Masks are made where texts are read; only digests, masks and ids move. Copies are found by the least id of each text's
digest and a join back on digest and id, so a text with many copies is no hot key. Python sees a row of at most 2^k cells
for each part.

Defined results: a null text or lang is empty; texts are equal if their sha256 is; a row without an id fails nothing as a
copy and makes no copy of others, and has no labels; repeated rows count each, and rows that share the least id are no
copies; of several labels of an id any that is 1 counts; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

#: The filters on a text, by letter; a document fails where the condition holds. COPY is that on equal texts.
COPY = "E"
#: Rows of parts that a task walks at once, so that their results stay small.
PARTS_AT_ONCE = 256
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def words(text: Column) -> Column:
    """Maximal runs without space and \\t\\n\\v\\f\\r."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def text_filters(text: Column) -> dict[str, Column]:
    """A: under 200 words, B: under half of the words distinct, C: over 3 % capitals, D: holds a sign."""
    found = words(text)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return {"A": F.size(found) < 200, "B": F.size(F.array_distinct(found)) * 100 < F.size(found) * 50, "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 3, "D": text.rlike("[#$%&*|]")}


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part (lang) and mask. Bit i of a mask is the i-th filter; the last
    is COPY."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tests = filters(text)
    mask = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests.values())), F.lit(0))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "masks")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    counted = rows.groupBy("digest", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n")).join(least, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    held = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # rows without an id meet no labels, and are spread by their digest
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    found = counted.select("doc_id", "part", "n", (F.col("mask") + F.when(copy, 1 << len(tests)).otherwise(0)).alias("mask"), spread.alias("spread"))
    found = found.join(held.withColumn("spread", F.lit(0).cast("long")), ["doc_id", "spread"], "left")
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def survivors(counts):
    """counts: parts x 2^k masks x sums. The same sums over what survives each set of active filters (parts x 2^k sets)."""
    import numpy as np

    size = counts.shape[1]
    masks, failures = np.arange(size), np.zeros(size, np.int64)
    states, running, active = np.empty_like(counts), counts.sum(axis=1), 0
    states[:, 0] = running
    for i in range(1, size):
        bit = i & -i  # the Gray code's toggled filter
        active ^= bit
        hit = (masks & bit) != 0
        if active & bit:
            running = running - counts[:, hit & (failures == 0)].sum(axis=1)
            failures[hit] += 1
        else:
            failures[hit] -= 1
            running = running + counts[:, hit & (failures == 0)].sum(axis=1)
        states[:, active] = running
    return states


def steps(counts, letters: str):
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; and the orders."""
    import numpy as np

    orders = np.array(list(permutations(range(len(letters)))))
    after = np.cumsum(1 << orders, axis=1)
    before = after - (1 << orders)
    states, masks = survivors(counts), np.arange(counts.shape[1])
    failing = np.stack([counts[:, (masks >> i) & 1 == 1, 0].sum(axis=1) for i in range(len(letters))], axis=1)
    lost = states[:, before] - states[:, after]
    removed = lost[..., 0]
    shapley = np.stack([removed[:, orders == i].sum(axis=1) for i in range(len(letters))], axis=1)
    alone = counts[:, 1 << np.arange(len(letters)), 0]
    return [states[:, after, 0], removed, failing[:, orders] - removed, alone[:, orders], lost[..., 1], lost[..., 2], shapley[:, orders]], ["".join(letters[i] for i in o) for o in orders]


def audit(found: DataFrame, letters: str) -> DataFrame:
    """found: what cells() gives. A row per part, order and step; the filter of a row is the order's letter at that step."""
    k = len(letters)

    def run(batches):
        import numpy as np

        for batch in batches:
            for start in range(0, batch.num_rows, PARTS_AT_ONCE):
                piece = batch.slice(start, PARTS_AT_ONCE)
                counts = np.zeros((piece.num_rows, 1 << k, 3), np.int64)
                for i, held in enumerate(piece.column(1).to_pylist()):
                    for c in held:
                        counts[i, c["mask"]] = c["n"], c["good"], c["toxic"]
                columns, orders = steps(counts, letters)
                each = len(orders) * k
                parts = piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), each)))
                names = pa.array(np.tile(np.repeat(np.array(orders, object), k), piece.num_rows), pa.string())
                at = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), piece.num_rows * len(orders)))
                yield pa.RecordBatch.from_arrays([parts, names, at, *(pa.array(np.ascontiguousarray(c).reshape(-1)) for c in columns)], SCHEMA_NAMES)

    rows = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 2^k a part
    return rows.mapInArrow(run, SCHEMA)


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op12_filter_audit(spark, sf_dir):
    """The audit of five filters over all documents, by lang."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(cells(docs, labels), "ABCD" + COPY)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT doc_id, part, d.text, least, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words FROM d JOIN firsts ON d.text = firsts.text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
places AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
           FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (SELECT part, filter_order, step, letter,
           sum(CASE WHEN translate(fails, before || letter, '') = fails THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN contains(fails, letter) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
         FROM cells, places GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM rows
"""
