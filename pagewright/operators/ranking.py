"""Choosing one of a file's candidates, and numbering its pages: windows and ordered aggregates by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import orientation_of_boxes

MOST_PIXELS = 100_000_000
LEAST_EDGE = 8
MOST_ICON_WIDTH = 4096
MOST_ATTEMPTS = 4


def size_fits(width: Column, height: Column, least: int = 1, widest: int | None = None) -> Column:
    """Whether an image's size may be decoded: edges of at least `least`, at most 100 megapixels, and a width limit if given
    (MOST_ICON_WIDTH for bitmaps inside icons)."""
    fits = (width >= least) & (height >= least) & (width.cast("long") * height <= MOST_PIXELS)
    return fits & (width <= widest) if widest else fits


def item_orientation(associations: DataFrame, properties: DataFrame, primary: DataFrame) -> DataFrame:
    """(file_id, orientation) by the rotation and mirror properties that a file's primary item is given.

    associations: file_id, item, place (order in the list), index (1-based, of a property); properties: file_id, index, type,
    value; primary: file_id, item. Of several properties of a type the last association counts; an index without a property
    and other types do nothing. All three are tables, so a file with many items is never one row."""
    own = associations.join(primary, ["file_id", "item"]).join(properties.where(F.col("type").isin("irot", "imir")), ["file_id", "index"])
    last = lambda kind, bits: F.max_by(F.when(F.col("type") == kind, F.col("value").bitwiseAND(bits)), F.when(F.col("type") == kind, F.col("place")))
    found = own.groupBy("file_id").agg(last("irot", 3).alias("angle"), last("imir", 1).alias("axis"))
    return primary.select("file_id").join(found, "file_id", "left").select("file_id", orientation_of_boxes(F.col("angle"), F.col("axis")).alias("orientation"))


def first_decoder(attempts: DataFrame) -> DataFrame:
    """file_id, decoder, attempt and message: the first attempt of a file that succeeds; if none does, the message of its
    first attempt explains it (of a file of unknown format none does).

    attempts: file_id, format, attempt_no (from 0), decoder, ok, message."""
    ok = F.col("ok")
    found = attempts.groupBy("file_id").agg(F.min_by(F.when(ok, F.struct("decoder", "attempt_no")), F.when(ok, F.col("attempt_no"))).alias("b"), F.min_by("message", "attempt_no").alias("m"), F.min("format").alias("format"))
    message = F.when(F.col("b").isNull(), F.when((F.col("format") != "unknown") & F.col("m").isNotNull(), F.col("m")).otherwise("not a readable image"))
    return found.select("file_id", "b.decoder", F.col("b.attempt_no").alias("attempt"), message.alias("message"))


def raw_preview(candidates: DataFrame) -> DataFrame:
    """The first candidate that decodes, of at most four, by area, then length, then discovery; one row per file.

    candidates: file_id, found_no, start, width, height, size, decodes. Of candidates at one start the first found counts;
    those over 100 megapixels aren't tried, and if nothing decodes they are the reason."""
    first = candidates.groupBy("file_id", "start").agg(F.min(F.struct("found_no", "width", "height", "size", "decodes")).alias("c")).select("file_id", "c.*")
    area = F.col("width").cast("long") * F.col("height")
    large = area > MOST_PIXELS
    usable = size_fits(F.col("width"), F.col("height"), LEAST_EDGE)
    order = Window.partitionBy("file_id", "usable").orderBy(F.desc("area"), F.desc("size"), "found_no")
    ranked = first.withColumns({"area": area, "usable": usable, "large": large}).withColumn("attempt", F.row_number().over(order))
    tried = F.col("usable") & F.col("decodes") & (F.col("attempt") <= MOST_ATTEMPTS)
    best = F.min_by(F.when(tried, F.struct("found_no", "width", "height", "attempt")), F.when(tried, F.col("attempt")))
    chosen = ranked.groupBy("file_id").agg(best.alias("b"), F.max("large").alias("any_large"))
    verdict = F.when(F.col("b").isNotNull(), "ok").when(F.col("any_large"), "too_large").otherwise("damaged_preview")
    return chosen.select("file_id", "b.found_no", "b.width", "b.height", "b.attempt", verdict.alias("verdict"))


def icon_best(entries: DataFrame, is_cursor: Column, file_size: Column) -> DataFrame:
    """The icon entry of greatest area, then depth (0 for cursors), then place; entries outside the file don't count."""
    side = lambda c: F.when(F.col(c) == 0, 256).otherwise(F.col(c))
    usable = entries.where((F.col("size") > 0) & (F.col("offset") >= 6) & (F.col("offset") + F.col("size") <= file_size))
    rows = usable.select("file_id", "entry_no", (side("width") * side("height")).alias("area"), F.when(is_cursor, 0).otherwise(F.col("bits")).alias("depth"))
    return rows.groupBy("file_id").agg(F.max_by(F.struct("entry_no", "area", "depth"), F.struct("area", "depth", -F.col("entry_no"))).alias("b")).select("file_id", "b.*")


def page_labels(pages: DataFrame, file_key: str, order: str, thumbnail: str) -> DataFrame:
    """Pages with a label "page i of n" if there are several; small previews are left out unless a file has nothing else."""
    by_file = Window.partitionBy(file_key)
    only = F.min(F.col(thumbnail).cast("int")).over(by_file) == 1
    kept = pages.withColumn("_only", only).where(~F.col(thumbnail) | F.col("_only")).drop("_only")
    i, n = F.row_number().over(by_file.orderBy(order)), F.count("*").over(by_file)
    return kept.withColumn("label", F.when(n > 1, F.concat(F.lit("page "), i.cast("string"), F.lit(" of "), n.cast("string"))))
