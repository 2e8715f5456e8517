"""What the corpus operators share: tables, the shared folder, written intermediate tables, ordered buckets."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session, or its checkpoint folder.

    Without either, a session on one machine (master local) gets a temporary folder of its own; on a cluster that would
    lose data, so an error says what to set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        sc.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows that a task takes at least of a table whose rows are known beforehand.
TASK_ROWS = 20_000


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, whose last stage has no more tasks than cores, or a task for each TASK_ROWS of `rows`, if that is more. What is
    small is else dealt out over all shuffle partitions, a file each, and for a local file Hadoop starts processes to set
    its permissions. Meant for stages dealt by a key that repeats seldom, as neighbouring partitions go to one task."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def written(df: DataFrame, what: str = "table", rows: int | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends here and survives lost executors.

    rows: how many df has at most, if that is known (in_tasks)."""
    path = new_path(df.sparkSession, what)
    if rows is not None:
        df = in_tasks(df, rows)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch on its way to a Python worker: Spark's own 64 MB are held in the JVM (twice while they grow) and
#: in the worker, for each task of an executor.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have BATCH_BYTES and a row more at most; a smaller setting stays. Rows aren't
    cut: one above the bound goes whole."""
    said = re.fullmatch(r"(\d+)([bkmgt]?)b?", spark.conf.get(_BATCH_CONF).lower())
    if not said or int(said[1]) << 10 * "bkmgt".index(said[2] or "b") > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def texts(column: pa.Array) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes and row offsets of an Arrow string column; a null counts as an empty text."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20, rows: int = 1 << 14):
    """Slices of batch whose texts hold about `limit` bytes, of one row at least and `rows` at most, so that memory doesn't
    follow the batch size."""
    import numpy as np

    if not batch.num_rows:
        return
    _, offs = texts(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        end = min(start + rows, max(start + 1, int(np.searchsorted(offs, offs[start] + limit, "right")) - 1))
        yield batch.slice(start, end - start)
        start = end


def id_buckets(df: DataFrame, key: str, n: int) -> list[int]:
    """Ascending lower bounds (without the first bucket's) that cut the values of `key` into about n even ranges, by Spark's
    own range partitioning of that column alone. n bounds how many come to the driver."""
    if n < 2:
        return []
    keys = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull()).repartitionByRange(n, "k")
    return sorted(r.k for r in keys.groupBy(F.spark_partition_id().alias("b")).agg(F.min("k").alias("k")).collect())[1:]


def bucket_of(key: str, bounds: list):
    """The range that a key falls in, 0 for null: how many bounds (values or constant columns) are not above it, found in two
    steps of about the square root of their number each."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    not_above = lambda values: F.size(F.filter(values, lambda b: b <= F.col(key)))
    tops = F.array(*[F.lit(g[-1]) for g in groups])
    before = not_above(tops)  # groups that lie wholly at or below the key
    fine = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups], F.slice(F.array(F.lit(bounds[0])), 1, 0))
    return F.coalesce(F.least(before * step, F.lit(len(bounds))) + not_above(F.element_at(fine, before + 1)), F.lit(0))


def bytes_of(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.length(F.col(column).cast("binary")))).first()[0] or 0


def labelled_sample(labelled: DataFrame, most: int) -> DataFrame:
    """h, label, text: at most `most` distinct texts of labelled (text, label 0 or 1), those of least hash h, with their mean
    label; the same rows in each run. Only hashes meet in one task, and rows beyond the sample end where texts are read."""
    rows = labelled.where(F.col("label").isin(0, 1)).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("label").cast("double").alias("label")).withColumn("h", F.xxhash64("text"))
    total = rows.count()
    if total > most:  # a share of the hashes a little above the bound, then a cut-off among them
        rows = rows.where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 1.2 * most / total))))
        last = rows.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
        rows = rows.where(F.col("h") <= F.lit(last))
    return rows.groupBy("h").agg(F.avg("label").alias("label"), F.first("text").alias("text")).select("h", "label", "text")
