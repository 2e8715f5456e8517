"""The build: files to pages, summary and skipped files, with each file's errors kept to itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, scalars, sniff
from ..operators import decode

CACHE_ENTRIES = 400
#: Formats by the decoder that alone judges them; the rest try the base codec first.
ROUTES = {"heic": "heif", "avif": "heif", "webp": "webp", "raw": "raw", "cr3": "raw", "tiff": "tiff", "psd": "psd", "tga": "simple", "qoi": "simple", "pnm": "simple", "ico": "simple"}
REFUSED = ("jxl", "jp2", "svg")


def routed(files: DataFrame) -> DataFrame:
    """files (path, content) with format and decoder: refused, one that alone judges, or base with its fallbacks."""
    routes = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    named = files.withColumn("format", sniff.sniff(F.col("content"), F.col("path")))
    return named.withColumn("decoder", F.when(F.col("format").isin(*REFUSED), "refused").otherwise(F.coalesce(routes[F.col("format")], F.lit("base"))))


def progress(files: DataFrame, list_key: str) -> DataFrame:
    """Index, total and kind of every input, failing ones too."""
    by_list = Window.partitionBy(list_key)
    return files.withColumns({"index": F.row_number().over(by_list.orderBy("pos")), "total": F.count("*").over(by_list), "kind": scalars.kind(F.col("path"))})


def reasons(files: DataFrame) -> DataFrame:
    """files (path, error, user_facing) with reason, null for files without an error."""
    code = scalars.reason_code(F.col("error"), scalars.is_pdf(F.col("path")), F.coalesce("user_facing", F.lit(False)))
    return files.withColumn("reason", F.when(F.col("error").isNotNull(), code))


def summary(files: DataFrame, list_key: str) -> DataFrame:
    """Counters of each list's build, its skipped files in input order, and the first reason."""
    judged = reasons(files).withColumn("pdf", scalars.is_pdf(F.col("path")))
    used, skipped = F.col("reason").isNull(), F.col("reason").isNotNull()
    entry = F.struct("pos", scalars.basename(F.col("path")).alias("name"), "reason")
    out = judged.groupBy(list_key).agg(
        F.count_if(used).alias("used"), F.count_if(used & ~F.col("pdf")).alias("images"), F.count_if(used & F.col("pdf")).alias("pdfs"),
        F.coalesce(F.sum(F.when(used, F.col("frames"))), F.lit(0)).cast("long").alias("pages"), F.count_if(skipped).alias("n_skipped"),
        F.array_sort(F.collect_list(F.when(skipped, entry))).alias("s"), F.min(F.when(skipped, entry)).alias("f"),
    )
    text = F.array_join(F.transform("s", lambda e: F.concat(e["name"], F.lit(" ("), e["reason"], F.lit(")"))), ", ")
    return out.withColumns({"skipped": text, "first_reason": F.col("f.reason")}).drop("s", "f")


def usable(summaries: DataFrame) -> DataFrame:
    """summaries, failing if a list has no usable file."""
    return summaries.withColumn("used", F.when(F.col("used") > 0, F.col("used")).otherwise(F.raise_error(F.lit("no usable file"))))


def cache_after(requests: DataFrame, entries: int = CACHE_ENTRIES) -> DataFrame:
    """What a least-recently-used cache of that many entries holds after the requests (key, ts); missing files aren't kept."""
    used = requests.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("ts").alias("last_used"), F.count("*").alias("requests"))
    return used.orderBy(F.desc("last_used"), "key").limit(entries)


def to_fetch(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requested keys that the cache doesn't hold."""
    return requests.where(F.col("key").isNotNull()).select("key").distinct().join(cache, "key", "left_anti")


def grey_map_pages(files: DataFrame, key: str, quality: str = scalars.DEFAULT_PRESET) -> DataFrame:
    """Pages of the Netpbm files among `files` (key, path, content): identified, decoded, laid out, with the sum of a channel."""
    images = routed(files).where(F.col("format") == "pnm")
    sizes = decode.pnm_pixels(images, key).groupBy(key).agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.sum("r").alias("pixel_sum"))
    laid = sizes.withColumn("l", geometry.page_layout(F.col("mx") + 1, F.col("my") + 1, F.lit(False)))
    return laid.select(key, "l.*", "pixel_sum")
