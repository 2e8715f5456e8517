"""Queries of the media-to-document dataflow over the given tables, each with equivalent SQL.

The tables hold no files, so inputs (paths, sizes, tags, bytes, pixels) are derived from their columns; every query
covers its whole table, and its SQL recomputes from the source columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .functions import geometry, scalars, sniff
from .operators import cache, containers, decode, manifest, ranking, verdicts
from .plans import build

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Endings of derived paths, by key modulo their number.
ENDINGS = (".jpg", ".JPG", ".png", ".pdf", ".PDF", ".txt", "", ".CR2", ".heic", ".tar.gz", ".Tiff", ".webp")


def _pick(values, by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _path(key: Column) -> Column:
    name = F.when(key % 97 == 0, F.lit(".jpg")).otherwise(F.concat(F.lit("IMG_"), key.cast("string"), _pick(ENDINGS, key)))
    return F.concat(F.lit("/photos/d"), F.pmod(key, F.lit(503)).cast("string"), F.lit("/"), name)


def _sql_path(key: str) -> str:
    return f"('/photos/d' || ({key} % 503) || '/' || CASE WHEN {key} % 97 = 0 THEN '.jpg' ELSE 'IMG_' || {key} || ({_sql_list(ENDINGS)})[({key} % {len(ENDINGS)} + 1)::INT] END)"


_SQL_EXT = "lower(regexp_extract(regexp_extract({p}, '[^/]*$'), '^.+\\.([^.]*)$', 1))"
_SQL_ACCEPTED = "(" + ", ".join(f"'{e}'" for e in scalars.ACCEPTED_EXTENSIONS) + ")"
_SQL_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower({n}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(ltrim(x, '0'))::VARCHAR, 4, '0') || ltrim(x, '0') ELSE x END), '')"


@query(f"""
WITH m AS (SELECT o_orderkey, {_sql_path('o_orderkey')} AS path FROM orders),
e AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, {_SQL_EXT.format(p='path')} AS ext FROM m),
k AS (SELECT *, {_SQL_NATURAL.format(n='name')} AS nat FROM e WHERE ext IN {_SQL_ACCEPTED})
SELECT o_orderkey, path, name, ext, ext = 'pdf' AS is_pdf, CASE WHEN ext = 'pdf' THEN 'pdf' ELSE 'image' END AS kind,
  row_number() OVER (PARTITION BY regexp_replace(path, '/[^/]*$', '') ORDER BY nat, name, o_orderkey) AS place FROM k
""")
def manifest_scan(spark, sf_dir):
    """Accepted files of each folder in natural order."""
    files = table(spark, sf_dir, "orders").select("o_orderkey", _path(F.col("o_orderkey")).alias("path"))
    return manifest.folder_scan(files, "o_orderkey").select("o_orderkey", "path", "name", "ext", "is_pdf", "kind", F.col("place").cast("long").alias("place"))


@query(f"""
WITH m AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, {_sql_path('(l_partkey % 40)')} AS path FROM lineitem),
d AS (SELECT l_suppkey, path, min(pos) AS pos FROM m WHERE regexp_matches(path, '/[^/]*\\.[^./]*$') AND lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN {_SQL_ACCEPTED} GROUP BY l_suppkey, path)
SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos, path) AS num FROM d
""")
def manifest_dedupe(spark, sf_dir):
    """Dropped files of each list: accepted ones, first of each path, numbered."""
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), _path(F.col("l_partkey") % 40).alias("path"))
    return manifest.intake(files, "l_suppkey").withColumn("num", F.col("num").cast("long"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
m AS (SELECT *, o_custkey % 4 AS f, o_custkey % 7 AS t FROM n)
SELECT o_custkey, o_orderkey, pos, CASE WHEN f = t OR t < 0 OR t >= n OR f >= n THEN pos WHEN pos = f THEN t WHEN f < t AND pos > f AND pos <= t THEN pos - 1 WHEN t < f AND pos >= t AND pos < f THEN pos + 1 ELSE pos END AS new_pos FROM m
""")
def reorder_move(spark, sf_dir):
    """One file of each list moved to another place."""
    lists = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    numbered = lists.withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1)
    return manifest.moved(numbered, "o_custkey", F.col("o_custkey") % 4, F.col("o_custkey") % 7)


@query("""
WITH r AS (SELECT p_partkey AS path, p_size * 37.5 - 900 AS deg FROM part WHERE p_partkey % 3 <> 0)
SELECT l_orderkey, l_linenumber, CAST(((floor(coalesce(deg, 0) / 90 + 0.5) * 90)::BIGINT % 360 + 360) % 360 AS INTEGER) AS turn,
  CAST((((floor(coalesce(deg, 0) / 90 + 0.5) * 90)::BIGINT + l_linenumber * 90) % 360 + 360) % 360 AS INTEGER) AS pdf_rotate,
  CASE WHEN ((floor(coalesce(deg, 0) / 90 + 0.5) * 90)::BIGINT % 180) = 0 THEN 300 ELSE 200 END AS width FROM lineitem LEFT JOIN r ON l_partkey = path
""")
def rotation_join(spark, sf_dir):
    """Each entry's turn by its path (0 if it has none), the PDF page's entry with it, and the width of a 300 x 200 image after it."""
    turns = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), (F.col("p_size") * 37.5 - 900).alias("deg"))
    entries = manifest.with_turns(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "path"), turns)
    rotate = scalars.norm_rotation(F.col("l_linenumber") * 90 + F.col("turn"))
    return entries.select("l_orderkey", "l_linenumber", "turn", rotate.alias("pdf_rotate"), F.when(F.col("turn") % 180 == 0, 300).otherwise(200).alias("width"))


_SQL_CLEAN = "trim(regexp_replace(regexp_replace({t}, '[^\\x20-\\x7E]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""
WITH c AS (SELECT doc_id, {_SQL_CLEAN.format(t="coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN ' - ' || lang ELSE '' END")} AS c, {_SQL_CLEAN.format(t="source || CASE WHEN doc_id % 3 = 0 THEN ' - ' || lang ELSE '' END")} AS s FROM documents)
SELECT doc_id, CASE WHEN length(c) > 110 THEN substr(c, 1, 107) || '...' ELSE c END AS caption, s AS short FROM c
""")
def caption(spark, sf_dir):
    """Captions of names (here whole texts, and sources) with their labels."""
    label = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", scalars.caption(F.coalesce("text", F.lit("")), label).alias("caption"), scalars.caption(F.col("source"), label).alias("short"))


@query("""
WITH d AS (SELECT p_partkey, p_size * 40 + p_partkey % 977 + 1 AS w, p_partkey % 1400 + p_size AS h, p_partkey % 2 = 0 AS cap, (['smaller','balanced','higher','none'])[(p_partkey % 4 + 1)::INT] AS q FROM part),
r AS (SELECT *, CASE WHEN w >= h THEN 792 ELSE 612 END AS page_w, CASE WHEN w >= h THEN 612 ELSE 792 END AS page_h, CASE WHEN cap THEN 22 ELSE 0 END AS band, CASE q WHEN 'smaller' THEN 1200 WHEN 'higher' THEN 2048 ELSE 1600 END AS edge, CASE q WHEN 'smaller' THEN 65 WHEN 'higher' THEN 82 ELSE 75 END AS quality FROM d),
s AS (SELECT *, least((page_w - 48)::DOUBLE / w, (page_h - 48 - band)::DOUBLE / h) AS k, least(1.0::DOUBLE, edge::DOUBLE / greatest(w, h)) AS f FROM r)
SELECT p_partkey, page_w, page_h, round(24 + (page_w - 48 - w * k) / 2, 4) AS draw_x, round(24 + band + (page_h - 48 - band - h * k) / 2, 4) AS draw_y, round(w * k, 4) AS draw_w, round(h * k, 4) AS draw_h,
  greatest(1, floor(w * f + 0.5))::INTEGER AS pixel_w, greatest(1, floor(h * f + 0.5))::INTEGER AS pixel_h, quality FROM s
""")
def page_layout(spark, sf_dir):
    """Page, place and pixel size of images of many shapes."""
    q = _pick(("smaller", "balanced", "higher", "none"), F.col("p_partkey"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 40 + F.col("p_partkey") % 977 + 1).alias("w"), (F.col("p_partkey") % 1400 + F.col("p_size")).alias("h"), q.alias("q"))
    laid = parts.withColumn("l", geometry.page_layout(F.col("w"), F.col("h"), F.col("p_partkey") % 2 == 0)).withColumn("px", geometry.bounded(F.col("w"), F.col("h"), scalars.max_edge(F.col("q"))))
    return laid.select("p_partkey", "l.page_w", "l.page_h", *[F.round(f"l.{c}", 4).alias(c) for c in ("draw_x", "draw_y", "draw_w", "draw_h")], F.col("px.width").alias("pixel_w"), F.col("px.height").alias("pixel_h"), scalars.jpeg_quality(F.col("q")).alias("quality"))


#: Heads of derived files (hexadecimal), by key modulo their number, and what each is with an extension that says nothing.
HEADS = (
    "FFD8FFE000104A46", "89504E470D0A1A0A00", "474946383961", "524946460000000057454250", "38425053000100", "716F696600000001", "464F56620000", "004D524D00",
    "46554A4946494C4D4343", "0000000C6A50202000", "FF4FFF5100", "FF0A0000", "424D3600", "00000018667479706372782000", "0000001866747970617669660000", "000000186674797068656963", "00000018667479706D69663100000000", "00000014667479706D703432",
    "49492A0010000000", "49492A00100000004352", "4D4D002A00000008", "49495500", "4949524F08", "50350A31", "503109", "503620", "50375A", "00000100", "00000200", "3C3F786D6C20", "20203C73766720", "414243", "41424344",
)
HEAD_ENDINGS = (".bin", ".nef", ".tga", ".ico", "", ".CUR")


@query(f"""
WITH h AS (SELECT p_partkey, ({_sql_list(HEADS)})[(p_partkey % {len(HEADS)} + 1)::INT] AS h, lower(ltrim(({_sql_list(HEAD_ENDINGS)})[(p_partkey // {len(HEADS)} % {len(HEAD_ENDINGS)} + 1)::INT], '.')) AS e FROM part),
k AS (SELECT *, h[9:16] = '66747970' AS iso, h[17:24] AS b FROM h)
SELECT p_partkey, CASE WHEN length(h) < 8 THEN 'unknown' WHEN h LIKE 'FFD8FF%' THEN 'jpeg' WHEN h LIKE '89504E47%' THEN 'png' WHEN h LIKE '474946%' THEN 'gif' WHEN h LIKE '52494646%57454250' THEN 'webp'
  WHEN h LIKE '38425053%' THEN 'psd' WHEN h LIKE '716F6966%' THEN 'qoi' WHEN h LIKE '464F5662%' OR h LIKE '004D524D%' OR h LIKE '46554A49%' THEN 'raw' WHEN h LIKE '0000000C6A502020%' OR h LIKE 'FF4FFF51%' THEN 'jp2'
  WHEN h LIKE 'FF0A%' THEN 'jxl' WHEN h LIKE '424D%' THEN 'bmp' WHEN iso AND b = '63727820' THEN 'cr3' WHEN iso AND b = '61766966' THEN 'avif' WHEN iso AND b IN ('68656963', '6D696631') THEN 'heic'
  WHEN (h LIKE '49492A00%' OR h LIKE '4D4D002A%') AND (h[17:20] = '4352' OR e = 'nef') THEN 'raw' WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'tiff' WHEN h LIKE '49495500%' OR h LIKE '4949524F%' THEN 'raw'
  WHEN h IN ('50350A31', '503109', '503620') AND length(h) >= 8 THEN 'pnm' WHEN e = 'tga' THEN 'tga' WHEN e IN ('ico', 'cur') THEN 'ico' WHEN h LIKE '3C3F786D6C%' OR h LIKE '20203C737667%' THEN 'svg' WHEN e = 'nef' THEN 'raw' ELSE 'unknown' END AS format FROM k
""")
def sniff_formats(spark, sf_dir):
    """Formats of derived file heads and names."""
    key = F.col("p_partkey")
    head, name = F.unhex(_pick(HEADS, key)), F.concat(F.lit("/a/file"), _pick(HEAD_ENDINGS, F.floor(key / len(HEADS))))
    return table(spark, sf_dir, "part").select("p_partkey", sniff.sniff(head, name).alias("format"))


_LEVELS = "list_transform(embedding, lambda e: least(255, greatest(0, floor((e::DOUBLE + 1) * 127.5)))::INTEGER)"
_PIXELS = f"(SELECT vec_id, i - 1 AS i, v[i] AS v FROM (SELECT vec_id, {_LEVELS} AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"


def _levels() -> Column:
    return F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1) * 127.5))).cast("int"))


def _images(spark, sf_dir) -> DataFrame:
    """vec_id and the 64 grey levels of an 8 x 8 image per vector."""
    return table(spark, sf_dir, "embeddings").select("vec_id", _levels().alias("v"))


def _hex_bytes(levels: Column) -> Column:
    return F.array_join(F.transform(levels, lambda v: F.lpad(F.hex(v), 2, "0")), "")


@query(f"SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(v * 255 // 255 AS INTEGER) AS grey FROM {_PIXELS}")
def decode_pgm(spark, sf_dir):
    """Pixels of ASCII grey maps made from the vectors, with a comment in the header."""
    text = F.concat(F.lit("P2\n# made\n8 8\n255\n"), F.array_join(F.col("v").cast("array<string>"), " "), F.lit("\n"))
    files = _images(spark, sf_dir).select("vec_id", text.cast("binary").alias("content"))
    return decode.pnm_pixels(files, "vec_id").select("vec_id", "x", "y", F.col("r").alias("grey"))


@query(f"SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v AS grey FROM {_PIXELS}")
def decode_pnm_binary(spark, sf_dir):
    """Pixels of binary grey maps made from the vectors."""
    content = F.unhex(F.concat(F.lit("50350A38203820323535" + "0A"), _hex_bytes(F.col("v"))))
    return decode.pnm_pixels(_images(spark, sf_dir).select("vec_id", content.alias("content")), "vec_id").select("vec_id", "x", "y", F.col("r").alias("grey"))


@query(f"SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(CASE WHEN vec_id % 2 = 0 THEN 7 - i // 8 ELSE i // 8 END AS INTEGER) AS y, v AS r, v AS g, v AS b FROM {_PIXELS}")
def decode_tga(spark, sf_dir):
    """Pixels of grey TGA images made from the vectors, bottom-up or top-down."""
    head = F.concat(F.lit("0000030000000000000000000800080008"), F.when(F.col("vec_id") % 2 == 0, "00").otherwise("20"))
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.concat(head, _hex_bytes(F.col("v")))).alias("content"))
    return decode.tga_pixels(files, "vec_id").select("vec_id", "x", "y", "r", "g", "b")


@query(f"SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v AS r, 255 - v AS g, v AS b, 255 AS a FROM {_PIXELS}")
def decode_qoi(spark, sf_dir):
    """Pixels of QOI images made from the vectors."""
    pixels = F.array_join(F.transform("v", lambda v: F.concat(F.lit("FE"), F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(255 - v), 2, "0"), F.lpad(F.hex(v), 2, "0"))), "")
    content = F.unhex(F.concat(F.lit("716F696600000008000000080300"), pixels, F.lit("0000000000000001")))
    return decode.qoi_pixels(_images(spark, sf_dir).select("vec_id", content.alias("content")), "vec_id").select("vec_id", "x", "y", "r", "g", "b", "a")


@query(f"""
WITH p AS (SELECT vec_id, CAST(vec_id % 8 + 1 AS INTEGER) AS code, (i % 16) AS sx, (i // 16) AS sy, v FROM {_PIXELS})
SELECT vec_id, code, CAST(CASE WHEN code IN (2, 3) THEN 15 - sx WHEN code IN (5, 8) THEN sy WHEN code IN (6, 7) THEN 3 - sy ELSE sx END AS INTEGER) AS x,
  CAST(CASE WHEN code IN (3, 4) THEN 3 - sy WHEN code IN (5, 6) THEN sx WHEN code IN (7, 8) THEN 15 - sx ELSE sy END AS INTEGER) AS y, v FROM p
""")
def orient_pixels(spark, sf_dir):
    """Pixels of 16 x 4 images after each orientation code."""
    px = _images(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "v")).withColumn("code", (F.col("vec_id") % 8 + 1).cast("int"))
    moved = geometry.oriented((F.col("i") % 16).cast("int"), F.floor(F.col("i") / 16).cast("int"), F.lit(16), F.lit(4), F.col("code"))
    return px.withColumn("o", moved).select("vec_id", "code", "o.x", "o.y", "v")


@query(f"""
SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(floor((v * a + 255 * (255 - a))::DOUBLE / 255 + 0.5) AS INTEGER) AS flat, CAST(CASE WHEN a IN (0, 255) THEN v ELSE least(255, floor((v * 255)::DOUBLE / a + 0.5)) END AS INTEGER) AS straight
FROM (SELECT vec_id, i, v, (v * 7 + i * 31) % 256 AS a FROM {_PIXELS})
""")
def flatten_white(spark, sf_dir):
    """Pixels over white, and un-premultiplied."""
    px = _images(spark, sf_dir).select("vec_id", F.posexplode("v").alias("i", "v")).withColumn("a", (F.col("v") * 7 + F.col("i") * 31) % 256)
    return px.select("vec_id", "i", geometry.flattened(F.col("v"), F.col("a")).alias("flat"), geometry.unpremultiplied(F.col("v"), F.col("a")).alias("straight"))


@query("""
WITH c AS (SELECT l_orderkey AS file_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS found_no, l_linenumber % 3 * 1000 + l_orderkey % 2 AS start, CAST(l_quantity * 300 AS INTEGER) AS width, CAST(l_partkey % 160 * 50 AS INTEGER) AS height, CAST(floor(l_extendedprice) AS BIGINT) AS size, l_suppkey % 3 <> 0 AS decodes FROM lineitem),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file_id, start ORDER BY found_no, width, height, size, decodes) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY width::BIGINT * height DESC, size DESC, found_no) AS attempt FROM d WHERE width >= 8 AND height >= 8 AND width::BIGINT * height <= 100000000),
b AS (SELECT file_id, min(attempt) AS attempt FROM r WHERE attempt <= 4 AND decodes GROUP BY file_id),
f AS (SELECT file_id, count(*) AS n, count_if(width::BIGINT * height > 100000000) AS n_large FROM d GROUP BY file_id)
SELECT f.file_id, coalesce(r.found_no, 0) AS found_no, coalesce(r.width, 0) AS width, coalesce(r.height, 0) AS height, coalesce(r.attempt, 0) AS attempt, CASE WHEN r.found_no IS NOT NULL THEN 'ok' WHEN n_large > 0 THEN 'too_large' ELSE 'damaged_preview' END AS verdict FROM f LEFT JOIN b USING (file_id) LEFT JOIN r ON r.file_id = b.file_id AND r.attempt = b.attempt
""")
def raw_candidate_rank(spark, sf_dir):
    """The preview chosen of each file's candidates."""
    c = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber").cast("long") * F.lit(1_000_000_000) + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("found_no"), (F.col("l_linenumber") % 3 * 1000 + F.col("l_orderkey") % 2).alias("start"), (F.col("l_quantity") * 300).cast("int").alias("width"),
        (F.col("l_partkey") % 160 * 50).cast("int").alias("height"), F.floor("l_extendedprice").alias("size"), (F.col("l_suppkey") % 3 != 0).alias("decodes"),
    )
    chosen = ranking.raw_preview(c).withColumn("attempt", F.col("attempt").cast("long"))
    return chosen.select("file_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("found_no", "width", "height", "attempt")], "verdict")


@query("""
WITH e AS (SELECT l_orderkey AS file_id, l_linenumber AS entry_no, CAST(l_quantity * 7 AS INTEGER) % 256 AS w, CAST(l_partkey % 256 AS INTEGER) AS h, ([1, 4, 8, 24, 32])[(l_suppkey % 5 + 1)::INT] AS bits, l_partkey % 5 * 400 AS size, l_linenumber * 16 + l_partkey % 9 AS off FROM lineitem),
u AS (SELECT *, (CASE w WHEN 0 THEN 256 ELSE w END) * (CASE h WHEN 0 THEN 256 ELSE h END) AS area, CASE WHEN file_id % 2 = 0 THEN bits ELSE 0 END AS depth FROM e WHERE size > 0 AND off >= 6 AND off + size <= 1700)
SELECT file_id, entry_no, CAST(area AS INTEGER) AS area, depth FROM u QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY area DESC, depth DESC, entry_no) = 1
""")
def ico_best_entry(spark, sf_dir):
    """The best usable entry of each icon directory."""
    e = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("entry_no"), ((F.col("l_quantity") * 7).cast("int") % 256).alias("width"), (F.col("l_partkey") % 256).cast("int").alias("height"),
        F.element_at(F.array(*[F.lit(b) for b in (1, 4, 8, 24, 32)]), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("bits"), (F.col("l_partkey") % 5 * 400).alias("size"), (F.col("l_linenumber") * 16 + F.col("l_partkey") % 9).alias("offset"),
    )
    return ranking.icon_best(e, F.col("file_id") % 2 == 1, F.lit(1700))


_TAGS = "l_orderkey, l_linenumber, l_partkey % 7 AS photometric, ([1, 2, 4, 8, 16])[(l_suppkey % 5 + 1)::INT] AS bps, (l_linenumber % 4 + 1) AS samples, ([1, 3, 5, 7])[(l_orderkey % 4 + 1)::INT] AS compression, (l_partkey % 11 = 0) AS truncated, CASE WHEN l_partkey % 13 = 0 THEN 2 ELSE 1 END AS planar, (l_partkey % 5 = 0) AS tiled, (l_partkey % 3 % 2 + 1) AS predictor, (l_suppkey % 17 = 0) AS uneven, (l_suppkey % 2 = 0) AS palette"


@query(f"""
SELECT l_orderkey, l_linenumber, CASE WHEN truncated THEN 'truncated' WHEN planar = 2 THEN 'separate_planes' WHEN compression = 3 THEN 'group3_fax' WHEN tiled AND predictor = 2 THEN 'tiled_predictor' WHEN compression = 7 AND samples = 3 THEN 'jpeg_rgb' WHEN uneven THEN 'inconsistent_channels'
 WHEN photometric = 0 THEN CASE WHEN samples = 1 AND bps IN (1, 4, 8) THEN 'ok' ELSE 'grey_depth' END WHEN photometric = 1 THEN CASE WHEN samples = 1 AND bps IN (1, 2, 8, 16) THEN 'ok' ELSE 'grey_depth' END
 WHEN photometric = 2 THEN CASE WHEN bps IN (8, 16) AND samples IN (3, 4) THEN 'ok' ELSE 'rgb_depth' END WHEN photometric = 3 THEN CASE WHEN bps = 8 AND palette THEN 'ok' ELSE 'palette_depth' END WHEN photometric = 5 THEN CASE WHEN bps = 8 AND samples >= 4 THEN 'ok' ELSE 'cmyk_depth' END ELSE 'unsupported_mode' END AS verdict
FROM (SELECT {_TAGS} FROM lineitem)
""")
def tiff_verdict(spark, sf_dir):
    """Whether pages with these tags can be read, and why not."""
    return _tiff_pages(spark, sf_dir).select("l_orderkey", "l_linenumber", verdicts.tiff_verdict().alias("verdict"))


def _tiff_pages(spark, sf_dir) -> DataFrame:
    key = F.col("l_partkey")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (key % 7).alias("photometric"), pick((1, 2, 4, 8, 16), F.col("l_suppkey")).alias("bps"), (F.col("l_linenumber") % 4 + 1).alias("samples"), pick((1, 3, 5, 7), F.col("l_orderkey")).alias("compression"),
        (key % 11 == 0).alias("truncated"), F.when(key % 13 == 0, 2).otherwise(1).alias("planar"), (key % 5 == 0).alias("tiled"), (key % 3 % 2 + 1).alias("predictor"), (F.col("l_suppkey") % 17 == 0).alias("uneven"), (F.col("l_suppkey") % 2 == 0).alias("palette"),
        (key % 4 == 0).alias("thumbnail"),
    )


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey % 4 = 0 AS thumb, bool_and(l_partkey % 4 = 0) OVER (PARTITION BY l_orderkey) AS only_thumbs FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM t WHERE NOT thumb OR only_thumbs)
SELECT l_orderkey, l_linenumber, CASE WHEN n > 1 THEN 'page ' || i || ' of ' || n END AS label FROM k
""")
def tiff_labels(spark, sf_dir):
    """Labels of each file's pages; small previews count only if there is nothing else."""
    return ranking.page_labels(_tiff_pages(spark, sf_dir), "l_orderkey", "l_linenumber", "thumbnail").select("l_orderkey", "l_linenumber", "label")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 'truncated' WHEN ([1, 8, 16, 32])[(p_size % 4 + 1)::INT] NOT IN (1, 8) THEN 'unsupported_depth' WHEN p_partkey % 6 NOT IN (0, 1, 2, 3) THEN 'unsupported_mode' WHEN p_size % 3 = 0 THEN 'no_composite' ELSE 'ok' END AS verdict FROM part
""")
def psd_gate(spark, sf_dir):
    """Verdicts on layered-image files made from parts: header, then three length-prefixed sections."""
    key, size = F.col("p_partkey"), F.col("p_size")
    hex4 = lambda v: F.lpad(F.hex(v), 4, "0")
    depth = F.element_at(F.array(*[F.lit(v) for v in (1, 8, 16, 32)]), (size % 4 + 1).cast("int"))
    wide = key % 2 == 0
    sections = F.concat(F.lit("00000002AABB00000000"), F.when(wide, "0000000000000001").otherwise("00000001"), F.lit("CC"), F.when(size % 3 == 0, "0000").otherwise("00000102"))
    head = F.concat(F.lit("38425053"), F.when(wide, "0002").otherwise("0001"), F.lit("0000000000000003" + "0000000800000008"), hex4(depth), hex4(key % 6))
    content = F.unhex(F.when(key % 10 == 9, F.substring(head, 1, 40)).otherwise(F.concat(head, sections)))
    return table(spark, sf_dir, "part").select("p_partkey", verdicts.psd_verdict(content).alias("verdict"))


@query("""
SELECT p_partkey, CAST(CASE WHEN axis IS NULL THEN ([1, 8, 3, 6])[a] WHEN axis = 0 THEN ([4, 5, 2, 7])[a] ELSE ([2, 7, 4, 5])[a] END AS INTEGER) AS orientation FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 1 ELSE p_size % 5 + 1 END AS a, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE p_partkey % 3 END AS axis FROM part)
""")
def isobmff_orientation(spark, sf_dir):
    """Orientation codes of rotation and mirror boxes."""
    angle = F.when(F.col("p_size") % 5 != 4, F.col("p_size") % 5).cast("int")
    axis = F.when(F.col("p_partkey") % 3 != 2, F.col("p_partkey") % 3)
    return table(spark, sf_dir, "part").select("p_partkey", geometry.orientation_of_boxes(angle, axis).alias("orientation"))


@query("""
WITH w AS (SELECT p_partkey, p_size % 4 AS extra, p_partkey % 5 = 4 AS cut FROM part)
SELECT p_partkey, CASE WHEN cut THEN 'truncated' WHEN extra = 3 THEN 'no_image_data' ELSE 'codec_missing' END AS verdict, CAST(CASE WHEN cut OR extra = 3 THEN 0 ELSE extra END AS INTEGER) AS n_animation FROM w
""")
def webp_walk(spark, sf_dir):
    """Verdicts on RIFF containers made from parts, from their chunk lists."""
    return containers.webp_verdicts(table(spark, sf_dir, "part").select("p_partkey", _riff(F.col("p_size") % 4, F.col("p_partkey") % 5 == 4).alias("content")), "p_partkey")


def _riff(extra: Column, cut: Column) -> Column:
    """A VP8X chunk, then 0..2 animation frames and a picture chunk, or an unknown chunk only (3)."""
    chunk = lambda name, body: name.encode().hex().upper() + len(body).to_bytes(4, "little").hex().upper() + body.hex().upper() + "00" * (len(body) % 2)
    bodies = [chunk("VP8X", b"\0" * 10) + chunk("ANMF", b"\1" * 17) * n + chunk("VP8 ", b"\2" * 5) for n in range(3)] + [chunk("VP8X", b"\0" * 10) + chunk("EXIF", b"\3")]
    whole = ["52494646" + (len(b) // 2 + 4).to_bytes(4, "little").hex().upper() + "57454250" + b for b in bodies]
    made = F.element_at(F.array(*[F.lit(w) for w in whole]), (extra + 1).cast("int"))
    return F.unhex(F.when(cut, F.substr(made, F.lit(1), F.length(made) - 6)).otherwise(made))


#: Error messages of derived files, by key modulo their number.
ERRORS = (None, None, None, "ENOENT: no such file or directory", "EPERM: operation not permitted", "truncated", "Input document is encrypted", "document has no pages", "boom")
_SQL_ERRORS = "[" + ", ".join("NULL" if e is None else f"'{e}'" for e in ERRORS) + "]"


@query(f"""
WITH m AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS pos, {_sql_path('l_partkey')} AS path, ({_SQL_ERRORS})[(l_partkey % 9 + 1)::INT] AS err, l_linenumber AS frames FROM lineitem),
k AS (SELECT *, {_SQL_EXT.format(p='path')} = 'pdf' AS pdf, regexp_extract(path, '[^/]*$') AS name FROM m),
r AS (SELECT *, CASE WHEN err IS NULL THEN NULL WHEN regexp_matches(err, 'ENOENT|no such file') THEN 'file_not_found' WHEN regexp_matches(err, 'EPERM') THEN 'no_permission' WHEN NOT pdf AND err = 'truncated' THEN 'decoder:truncated' WHEN NOT pdf THEN 'not_readable_image' WHEN regexp_matches(err, 'encrypt') THEN 'password_protected' WHEN regexp_matches(err, 'no pages') THEN 'no_pages' ELSE 'not_readable_pdf' END AS reason FROM k)
SELECT l_suppkey, count_if(reason IS NULL) AS used, count_if(reason IS NULL AND NOT pdf) AS images, count_if(reason IS NULL AND pdf) AS pdfs, CAST(coalesce(sum(frames) FILTER (WHERE reason IS NULL), 0) AS BIGINT) AS pages, count_if(reason IS NOT NULL) AS n_skipped,
  coalesce(string_agg(name || ' (' || reason || ')', ', ' ORDER BY pos, name, reason) FILTER (WHERE reason IS NOT NULL), '') AS skipped, first(reason ORDER BY pos, name, reason) FILTER (WHERE reason IS NOT NULL) AS first_reason FROM r GROUP BY l_suppkey
""")
def build_summary(spark, sf_dir):
    """Counters and skipped files of each list's build."""
    err = F.element_at(F.array(*[F.lit(e) for e in ERRORS]), (F.col("l_partkey") % len(ERRORS) + 1).cast("int"))
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), _path(F.col("l_partkey")).alias("path"), err.alias("error"), (err == "truncated").alias("user_facing"), F.col("l_linenumber").alias("frames"))
    return build.summary(files, "l_suppkey")


@query(f"""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS index, count(*) OVER (PARTITION BY o_custkey) AS total, CASE WHEN {_SQL_EXT.format(p=_sql_path('o_orderkey'))} = 'pdf' THEN 'pdf' ELSE 'image' END AS kind FROM orders
""")
def progress_events(spark, sf_dir):
    """Index, total and kind of every file of each list."""
    files = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("pos"), _path(F.col("o_orderkey")).alias("path"))
    return build.progress(files, "o_custkey").select("o_custkey", F.col("pos").alias("o_orderkey"), F.col("index").cast("long").alias("index"), "total", "kind")


@query("""
WITH r AS (SELECT event_id, ts, '/u' || user_id || '/' || event_type || '|' || (user_id % 1000 * 10) || '|' || date_trunc('day', ts)::DATE AS key FROM events)
SELECT key, max(ts) AS last_used, count(*) AS requests FROM r GROUP BY key ORDER BY last_used DESC, key LIMIT 400
""")
def thumb_cache(spark, sf_dir):
    """What the preview cache holds after all requests: the 400 keys used last."""
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    requests = table(spark, sf_dir, "events").select("ts", scalars.cache_key(path, F.col("user_id") % 1000 * 10, F.to_date("ts")).alias("key"))
    return build.cache_after(requests)


_SQL_STRIP = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({l}, '^#{{1,6}}\\s+', ''), '^>\\s?', '    '), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '\\*{{1,3}}([^*]+)\\*{{1,3}}', '\\1', 'g'), '`([^`]*)`', '\\1', 'g'), '^<(https?:[^>]+)>$', '\\1'), '\\s+$', '')"
_SQL_FOLD = "replace(translate({t}, '–—‘’“” ', '--''''\"\" '), '…', '...')"
_MARKED = "'# ' || source || chr(10) || '> **' || lang || '** `code` [link](http://x.y) — “' || doc_id || '”…' || chr(10) || coalesce(text, '')"


def _marked() -> Column:
    """A Markdown text around each document's whole text."""
    return F.concat(F.lit("# "), "source", F.lit("\n> **"), "lang", F.lit("** `code` [link](http://x.y) — “"), F.col("doc_id").cast("string"), F.lit("”…\n"), F.coalesce("text", F.lit("")))


@query(f"""
SELECT doc_id, array_to_string(list_transform(string_split({_SQL_FOLD.format(t=_MARKED)}, chr(10)), lambda l: {_SQL_STRIP.format(l='l')}), chr(10)) AS plain FROM documents
""")
def markdown_ascii(spark, sf_dir):
    """Texts with Markdown taken off and typographic signs folded."""
    lines = F.transform(F.split(scalars.ascii_folded(_marked()), "\n"), scalars.markdown_stripped)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("plain"))


@query(f"""
WITH l AS (SELECT doc_id, list_transform(string_split({_SQL_FOLD.format(t=_MARKED)}, chr(10)), lambda l: {_SQL_STRIP.format(l='l')}) AS ls FROM documents),
w AS (SELECT doc_id, list_transform(ls, lambda l: CASE WHEN length(l) <= 78 THEN l ELSE list_reduce(string_split(l, ' '), lambda a, x: CASE WHEN a = '' THEN x WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(x) > 78 AND regexp_extract(a, '[^\\n]*$') <> '' THEN a || chr(10) || x ELSE a || ' ' || x END) END) AS ws FROM l)
SELECT doc_id, regexp_replace(replace(array_to_string(ws, chr(10)), chr(10), chr(13) || chr(10)), '(\\r\\n){{3,}}', chr(13) || chr(10) || chr(13) || chr(10), 'g') || chr(13) || chr(10) AS wrapped FROM w
""")
def word_wrap(spark, sf_dir):
    """Texts as wrapped plain documents."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.plain_document(_marked()).alias("wrapped"))


@query("""
WITH s AS (SELECT doc_id, CAST(n_chars * 1000 AS BIGINT) AS b FROM documents)
SELECT doc_id, CASE WHEN floor(b / 1024.0 + 0.5) >= 1024 THEN printf('%d.%d MB', floor(floor(b / 1024.0 + 0.5) * 10 / 1024 + 0.5)::BIGINT // 10, floor(floor(b / 1024.0 + 0.5) * 10 / 1024 + 0.5)::BIGINT % 10) ELSE floor(b / 1024.0 + 0.5)::BIGINT || ' KB' END AS size_text FROM s
""")
def size_text(spark, sf_dir):
    """Sizes as text."""
    return table(spark, sf_dir, "documents").select("doc_id", scalars.size_text(F.col("n_chars") * 1000).alias("size_text"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM pages""")
def html_escape(spark, sf_dir):
    """Page sources with the five special characters escaped."""
    return table(spark, sf_dir, "pages").select("page_id", scalars.html_escaped(F.col("html")).alias("escaped"))


@query("""
WITH m AS (SELECT o_custkey, count_if(o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0) AS images, count_if(o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0) AS pdfs, count_if(o_orderkey % 7 = 0) AS skipped, CAST(sum(floor(o_totalprice)) AS BIGINT) AS b FROM orders GROUP BY o_custkey),
s AS (SELECT *, images + 3 * pdfs AS pages, floor(b / 1024.0 + 0.5) AS kb FROM m)
SELECT o_custkey, 'PDF saved — ' || concat_ws(' + ', CASE WHEN images > 0 THEN images || ' photo' || CASE images WHEN 1 THEN '' ELSE 's' END END, CASE WHEN pdfs > 0 THEN pdfs || ' PDF' || CASE pdfs WHEN 1 THEN '' ELSE 's' END END) || ', ' || pages || ' page' || CASE pages WHEN 1 THEN '' ELSE 's' END || ', ' ||
  CASE WHEN kb >= 1024 THEN printf('%d.%d MB', floor(kb * 10 / 1024 + 0.5)::BIGINT // 10, floor(kb * 10 / 1024 + 0.5)::BIGINT % 10) ELSE kb::BIGINT || ' KB' END || '.' || CASE WHEN skipped > 0 THEN ' ' || skipped || ' file' || CASE skipped WHEN 1 THEN '' ELSE 's' END || ' skipped.' ELSE '' END AS status,
  CASE WHEN images = 0 AND pdfs = 0 THEN 'Nothing added yet' WHEN pdfs = 0 THEN images || ' photo' || CASE images WHEN 1 THEN '' ELSE 's' END || ' ready' WHEN images = 0 THEN pdfs || ' PDF' || CASE pdfs WHEN 1 THEN '' ELSE 's' END || ' ready' ELSE images || ' photo' || CASE images WHEN 1 THEN '' ELSE 's' END || ' + ' || pdfs || ' PDF' || CASE pdfs WHEN 1 THEN '' ELSE 's' END || ' ready' END AS ready FROM s
""")
def status_message(spark, sf_dir):
    """What each list's build and the list itself say."""
    key = F.col("o_orderkey")
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if((key % 5 != 0) & (key % 7 != 0)).alias("images"), F.count_if((key % 5 == 0) & (key % 7 != 0)).alias("pdfs"), F.count_if(key % 7 == 0).alias("skipped"), F.sum(F.floor("o_totalprice")).alias("b"))
    return lists.select("o_custkey", scalars.status_text(F.col("images"), F.col("pdfs"), F.col("images") + 3 * F.col("pdfs"), F.col("b"), F.col("skipped")).alias("status"), scalars.ready_text(F.col("images"), F.col("pdfs")).alias("ready"))


@query(f"""
SELECT o_orderkey, regexp_replace({_sql_path('o_orderkey')}, '/[^/]*$', '') || '/Photos-' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' AS file FROM orders
""")
def default_file_name(spark, sf_dir):
    """Default names of results beside their first input."""
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.default_name(F.col("o_orderdate"), _path(F.col("o_orderkey"))).alias("file"))


@query("""
WITH p AS (SELECT vec_id, i, v FROM """ + _PIXELS + """)
SELECT vec_id, CAST(792 AS INTEGER) AS page_w, CAST(612 AS INTEGER) AS page_h, 114.0::DOUBLE AS draw_x, 24.0::DOUBLE AS draw_y, 564.0::DOUBLE AS draw_w, 564.0::DOUBLE AS draw_h, CAST(sum(v) AS BIGINT) AS pixel_sum FROM p GROUP BY vec_id
""")
def photo_pages(spark, sf_dir):
    """The whole way: grey-map files from the vectors, identified, routed, decoded and laid out, a page each."""
    text = F.concat(F.lit("P2\n# made\n8 8\n255\n"), F.array_join(F.col("v").cast("array<string>"), " "), F.lit("\n"))
    files = _images(spark, sf_dir).select("vec_id", text.cast("binary").alias("content"), F.concat(F.lit("/v/"), F.col("vec_id").cast("string"), F.lit(".pgm")).alias("path"))
    return build.grey_map_pages(files, "vec_id")


@query("SELECT page_id, 'data:image/jpeg;base64,' || to_base64(encode(html)) AS url, strlen(html) AS size FROM pages")
def data_urls(spark, sf_dir):
    """Sources of previews (here page sources) and the sizes of what is written."""
    raw = F.col("html").cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", scalars.data_url(raw).alias("url"), F.length(raw).cast("long").alias("size"))


@query(f"""
WITH m AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN substr({_sql_path('l_partkey')}, 2) ELSE {_sql_path('l_partkey')} END AS path FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(path LIKE '/%', false) AS asked FROM m
""")
def preview_requests(spark, sf_dir):
    """Which requests name a file by an absolute path."""
    path, key = _path(F.col("l_partkey")), F.col("l_partkey") % 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.absolute(F.when(key == 0, F.lit(None).cast("string")).when(key == 1, F.substring(path, 2, 1000)).otherwise(path)).alias("asked"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(((l_linenumber * 450 - l_partkey) % 360 + 360) % 360 AS BIGINT) AS degrees, CAST((l_suppkey % 32) * 8 + (l_suppkey % 32) // 4 AS INTEGER) AS level FROM lineitem
""")
def turn_degrees(spark, sf_dir):
    """Cumulative turns reduced to a full circle, and five-bit levels as eight bits."""
    turn = (F.col("l_linenumber") * 450).cast("long") - F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.norm_degrees(turn).alias("degrees"), geometry.five_to_eight((F.col("l_suppkey") % 32).cast("int")).alias("level"))


@query(f"""
WITH p AS (SELECT vec_id, CAST(floor((vec_id % 9 * 50 - 100) / 90.0 + 0.5) * 90 AS BIGINT) AS t, i % 16 AS sx, i // 16 AS sy, v FROM {_PIXELS}),
q AS (SELECT *, (t % 360 + 360) % 360 AS turn FROM p)
SELECT vec_id, CAST(turn AS INTEGER) AS turn, CAST(CASE turn WHEN 90 THEN 3 - sy WHEN 180 THEN 15 - sx WHEN 270 THEN sy ELSE sx END AS INTEGER) AS x, CAST(CASE turn WHEN 90 THEN sx WHEN 180 THEN 3 - sy WHEN 270 THEN 15 - sx ELSE sy END AS INTEGER) AS y, v FROM q
""")
def turn_pixels(spark, sf_dir):
    """Pixels of 16 x 4 images turned clockwise as the list says."""
    px = _images(spark, sf_dir).select("vec_id", scalars.norm_rotation(F.col("vec_id") % 9 * 50 - 100).alias("turn"), F.posexplode("v").alias("i", "v"))
    moved = geometry.oriented((F.col("i") % 16).cast("int"), F.floor(F.col("i") / 16).cast("int"), F.lit(16), F.lit(4), geometry.orientation_of_turn(F.col("turn")))
    return px.withColumn("o", moved).select("vec_id", "turn", "o.x", "o.y", "v")


@query(f"""
WITH p AS (SELECT vec_id, i, v, (v // 8)::INTEGER AS five, vec_id % 2 = 0 AS opaque FROM {_PIXELS})
SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(7 - i // 8 AS INTEGER) AS y, CAST(five * 8 + five // 4 AS INTEGER) AS r, CAST((31 - five) * 8 + (31 - five) // 4 AS INTEGER) AS g, CAST(five * 8 + five // 4 AS INTEGER) AS b,
  CAST(CASE WHEN NOT opaque AND v < 128 AND bool_or(v >= 128) OVER (PARTITION BY vec_id) THEN 0 ELSE 255 END AS INTEGER) AS a FROM p
""")
def decode_tga16(spark, sf_dir):
    """Pixels of 15- and 16-bit TGA images made from the vectors; of every other one the top bit is the alpha channel."""
    five = lambda v: F.floor(v / 8).cast("int")
    word = lambda v: F.when(v >= 128, 1 << 15).otherwise(0) + five(v) * 1024 + (31 - five(v)) * 32 + five(v)
    body = F.array_join(F.transform("v", lambda v: F.concat(F.lpad(F.hex(word(v) % 256), 2, "0"), F.lpad(F.hex(F.floor(word(v) / 256)), 2, "0"))), "")
    head = F.concat(F.lit("000002000000000000000000" + "08000800"), F.when(F.col("vec_id") % 2 == 0, "0F00").otherwise("1001"))
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.concat(head, body)).alias("content"))
    return decode.tga_pixels(files, "vec_id")


@query(f"""
WITH p AS (SELECT vec_id, i, v // 16 AS k FROM {_PIXELS})
SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, CAST(k * 3 AS INTEGER) AS r, CAST(255 - k * 16 AS INTEGER) AS g, CAST(k * 16 AS INTEGER) AS b FROM p
""")
def palette_pixels(spark, sf_dir):
    """Pixels of TGA images made from the vectors, with a colour map of 16 entries that starts at 5."""
    entries = "".join(f"{k * 16:02X}{255 - k * 16:02X}{k * 3:02X}" for k in range(16))
    body = F.array_join(F.transform("v", lambda v: F.lpad(F.hex(F.floor(v / 16) + 5), 2, "0")), "")
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.concat(F.lit("02010105001000180000000008000800" + "0820" + "AABB" + entries), body)).alias("content"))
    return decode.tga_pixels(files, "vec_id").select("vec_id", "x", "y", "r", "g", "b")


@query(f"""
WITH p AS (SELECT vec_id, i, v FROM {_PIXELS})
SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, v AS r, 255 - v AS g, v AS b, CASE vec_id % 3 WHEN 0 THEN 255 ELSE v END AS a FROM p WHERE vec_id % 3 <> 2
""")
def decode_tga32(spark, sf_dir):
    """Pixels of 32-bit TGA images made from the vectors; an alpha channel of zeros is opaque, a file cut short gives none."""
    body = F.array_join(F.transform("v", lambda v: F.concat(F.lpad(F.hex(v), 2, "0"), F.lpad(F.hex(255 - v), 2, "0"), F.lpad(F.hex(v), 2, "0"), F.when(F.col("vec_id") % 3 == 0, "00").otherwise(F.lpad(F.hex(v), 2, "0")))), "")
    whole = F.concat(F.lit("000002000000000000000000080008002028"), body)
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.when(F.col("vec_id") % 3 == 2, F.substring(whole, 1, 400)).otherwise(whole)).alias("content"))
    return decode.tga_pixels(files, "vec_id")


@query(f"""
SELECT vec_id, CAST(i % 4 AS INTEGER) AS x, CAST(i // 4 AS INTEGER) AS y, max(v) FILTER (WHERE k = 0) AS r, max(v) FILTER (WHERE k = 1) AS g, max(v) FILTER (WHERE k = 2) AS b, max(v) FILTER (WHERE k = 3) AS a
FROM (SELECT vec_id, i // 4 AS i, i % 4 AS k, v FROM {_PIXELS}) GROUP BY vec_id, i
""")
def decode_pam(spark, sf_dir):
    """Pixels of 4 x 4 arbitrary maps (P7) with colours and alpha, made from the vectors."""
    head = b"P7\nWIDTH 4\nHEIGHT 4\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n".hex().upper()
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.concat(F.lit(head), _hex_bytes(F.col("v")))).alias("content"))
    return decode.pnm_pixels(files, "vec_id")


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey END AS w, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_suppkey END AS h, CASE WHEN l_partkey % 3 <> 0 THEN [l_partkey, l_partkey * 2, l_suppkey] END AS strips,
  CASE WHEN l_partkey % 4 = 0 THEN [l_suppkey] END AS tiles, CASE WHEN l_suppkey % 3 <> 0 THEN [l_suppkey, 10, l_linenumber] END AS counts, CAST(l_quantity * 60 AS BIGINT) AS length FROM lineitem),
k AS (SELECT *, coalesce(strips, tiles) AS offs FROM t WHERE w IS NOT NULL AND h IS NOT NULL AND (strips IS NOT NULL OR tiles IS NOT NULL))
SELECT l_orderkey, l_linenumber, coalesce(len(list_filter(range(1, len(offs) + 1), lambda i: offs[i] + CASE WHEN counts IS NULL THEN 1 ELSE coalesce(counts[i], 1) END > length)) > 0, false) AS truncated FROM k
""")
def tiff_pages(spark, sf_dir):
    """Directories that are pages, and whether their strips or tiles end beyond the file."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    tags = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(part % 9 != 0, part).alias("w"), F.when(part % 10 != 0, supp).alias("h"), F.when(part % 3 != 0, F.array(part, part * 2, supp)).alias("strips"), F.when(part % 4 == 0, F.array(supp)).alias("tiles"),
        F.when(supp % 3 != 0, F.array(supp, F.lit(10).cast("long"), F.col("l_linenumber").cast("long"))).alias("counts"), (F.col("l_quantity") * 60).cast("long").alias("length"),
    )
    offsets = F.coalesce("strips", "tiles")
    counts = F.when(F.col("counts").isNotNull(), F.slice("counts", 1, F.size(offsets)))
    pages = tags.where(verdicts.tiff_page(F.col("w"), F.col("h"), F.col("strips"), F.col("tiles")))
    return pages.select("l_orderkey", "l_linenumber", verdicts.tiff_truncated(offsets, counts, F.col("length")).alias("truncated"))


def _numbered_lines() -> Column:
    return F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))


@query("""
WITH a AS (SELECT l_orderkey AS file_id, l_linenumber % 3 AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place, l_partkey % 6 AS index FROM lineitem),
p AS (SELECT o_orderkey AS file_id, i AS index, (['irot', 'imir', 'pixi', 'irot'])[(o_custkey + i) % 4 + 1] AS type, (o_custkey * 7 + i * 5) % 256 AS value FROM (SELECT *, unnest(range(1, 5)) AS i FROM orders)),
o AS (SELECT file_id, type, value, place FROM a JOIN (SELECT o_orderkey AS file_id, o_orderkey % 3 AS item FROM orders) USING (file_id, item) JOIN p USING (file_id, index)),
r AS (SELECT file_id, arg_max(value % 4, place) FILTER (WHERE type = 'irot') AS angle, arg_max(value % 2, place) FILTER (WHERE type = 'imir') AS axis FROM o GROUP BY file_id)
SELECT o_orderkey AS file_id, CAST(CASE WHEN axis IS NULL THEN ([1, 8, 3, 6])[coalesce(angle, 0) + 1] WHEN axis = 0 THEN ([4, 5, 2, 7])[coalesce(angle, 0) + 1] ELSE ([2, 7, 4, 5])[coalesce(angle, 0) + 1] END AS INTEGER) AS orientation FROM orders LEFT JOIN r ON file_id = o_orderkey
""")
def item_orientation(spark, sf_dir):
    """Orientation of each container's primary item by the properties that it is associated with."""
    of_items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_linenumber") % 3).cast("long").alias("item"), _numbered_lines().alias("place"), (F.col("l_partkey") % 6).cast("int").alias("index"))
    orders = table(spark, sf_dir, "orders")
    primary = orders.select(F.col("o_orderkey").alias("file_id"), (F.col("o_orderkey") % 3).alias("item"))
    made = orders.select(F.col("o_orderkey").alias("file_id"), "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("index"))
    properties = made.select("file_id", "index", _pick(("irot", "imir", "pixi", "irot"), F.col("o_custkey") + F.col("index")).alias("type"), ((F.col("o_custkey") * 7 + F.col("index") * 5) % 256).cast("int").alias("value"))
    return ranking.item_orientation(of_items, properties, primary)


@query("""
WITH a AS (SELECT l_orderkey AS file_id, (['unknown', 'jpeg', 'png'])[l_orderkey % 3 + 1] AS format, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS attempt_no, (['base', 'tiff', 'raw', 'heif'])[l_linenumber % 4 + 1] AS decoder, l_suppkey % 5 = 0 AS ok, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'fault ' || (l_partkey % 10) END AS message FROM lineitem),
g AS (SELECT file_id, min(format) AS format, arg_min(struct_pack(d := decoder, n := attempt_no), attempt_no) FILTER (WHERE ok) AS b, arg_min(struct_pack(m := message), attempt_no) AS m FROM a GROUP BY file_id)
SELECT file_id, b.d AS decoder, CAST(coalesce(b.n, -1) AS INTEGER) AS attempt, CASE WHEN b IS NULL THEN CASE WHEN format <> 'unknown' AND m.m IS NOT NULL THEN m.m ELSE 'not a readable image' END END AS message FROM g
""")
def decode_attempts(spark, sf_dir):
    """The decoder that reads each file, in the order of attempts, or what the first one says."""
    lines = table(spark, sf_dir, "lineitem")
    attempts = lines.select(
        F.col("l_orderkey").alias("file_id"), _pick(("unknown", "jpeg", "png"), F.col("l_orderkey")).alias("format"), (_numbered_lines() - 1).alias("attempt_no"), _pick(("base", "tiff", "raw", "heif"), F.col("l_linenumber")).alias("decoder"),
        (F.col("l_suppkey") % 5 == 0).alias("ok"), F.when(F.col("l_partkey") % 4 != 0, F.concat(F.lit("fault "), (F.col("l_partkey") % 10).cast("string"))).alias("message"),
    )
    return ranking.first_decoder(attempts).withColumn("attempt", F.coalesce("attempt", F.lit(-1)))


@query("SELECT l_orderkey, l_linenumber, w >= 8 AND h >= 8 AND w * h <= 100000000 AS preview, w >= 1 AND h >= 1 AND w * h <= 100000000 AND w <= 4096 AS icon FROM (SELECT l_orderkey, l_linenumber, l_partkey % 30000 AS w, l_suppkey * 7 % 9000 AS h FROM lineitem)")
def size_guards(spark, sf_dir):
    """Which sizes are decoded, as previews and as bitmaps inside icons."""
    w, h = F.col("l_partkey") % 30000, F.col("l_suppkey") * 7 % 9000
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ranking.size_fits(w, h, ranking.LEAST_EDGE).alias("preview"), ranking.size_fits(w, h, 1, ranking.MOST_ICON_WIDTH).alias("icon"))


@query("""
WITH t AS (SELECT p_partkey, p_size * 90 % 360 AS deg FROM part), f AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 25)
SELECT p_partkey, CAST(deg AS INTEGER) AS deg FROM t SEMI JOIN f ON p_partkey = l_partkey WHERE deg <> 0
""")
def turns_left(spark, sf_dir):
    """Turns of the files that are still in a list."""
    turns = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 90 % 360).alias("deg"))
    files = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_partkey").alias("p_partkey"))
    return manifest.without_left(turns, files, "p_partkey")


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
k AS (SELECT o_custkey, o_orderkey, pos FROM n WHERE o_orderkey % 6 <> 0)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS BIGINT) AS num FROM k
""")
def reorder_all(spark, sf_dir):
    """Lists in a whole new order that leaves some files out, numbered."""
    lists = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    order = table(spark, sf_dir, "orders").where("o_orderkey % 6 <> 0").select("o_custkey", "o_orderkey", (-F.col("o_orderkey")).alias("pos"))
    return manifest.numbered(manifest.reordered(lists, order, "o_custkey", "o_orderkey"), "o_custkey").select("o_custkey", "o_orderkey", F.col("num").cast("long").alias("num"))


@query("""
WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT o_custkey, o_orderkey, CASE WHEN pos > o_custkey % 5 THEN pos - 1 ELSE pos END AS pos FROM n WHERE pos <> o_custkey % 5
""")
def remove_one(spark, sf_dir):
    """Lists without the file at one place; the rest closes up."""
    lists = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").withColumn("pos", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1)
    return manifest.removed(lists, "o_custkey", F.col("o_custkey") % 5)


@query("""
WITH r AS (SELECT l_suppkey, l_linenumber AS frames, l_partkey % 3 = 0 AS bad FROM lineitem)
SELECT l_suppkey, CAST(count_if(NOT bad) AS BIGINT) AS used, CAST(coalesce(sum(frames) FILTER (WHERE NOT bad), 0) AS BIGINT) AS pages FROM r GROUP BY l_suppkey HAVING count_if(NOT bad) > 0
""")
def build_usable(spark, sf_dir):
    """Builds of the lists that have a usable file; without the filter the query would fail for the others."""
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("pos"), F.lit("/a/b.jpg").alias("path"), F.when(F.col("l_partkey") % 3 == 0, "boom").alias("error"), F.lit(False).alias("user_facing"), F.col("l_linenumber").alias("frames"))
    return build.usable(build.summary(files, "l_suppkey").where("used > 0")).select("l_suppkey", "used", "pages")


# ---- containers by their bytes


def _hex(value, size: int, little: Column | bool = False) -> Column:
    """Hex text of a number in so many bytes, big-endian or, where `little` is true, little-endian."""
    text = F.lpad(F.hex((value if isinstance(value, Column) else F.lit(value)).cast("long")), 2 * size, "0")
    turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    return turned if little is True else text if little is False else F.when(little, turned).otherwise(text)


def _joined(values: Column) -> Column:
    return F.array_join(values, "")


_CHUNK_IDS = ("EXIF", "ICCP", "XMP ", "ANMF", "VP8 ")


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
c AS (SELECT doc_id, i, ({_sql_list(_CHUNK_IDS)})[((doc_id + i) % {len(_CHUNK_IDS)} + 1)::INT] AS id, strlen(line) AS size, sum(8 + strlen(line) + strlen(line) % 2) OVER (PARTITION BY doc_id ORDER BY i) - strlen(line) - strlen(line) % 2 + 12 AS start FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_no, id, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size, '' AS fault FROM c WHERE doc_id % 7 <> 0
UNION ALL SELECT doc_id, -1, '', -1, -1, CASE WHEN doc_id % 7 = 0 THEN 'truncated' ELSE '' END FROM documents
""")
def riff_chunks(spark, sf_dir):
    """Chunks of RIFF files whose chunks are the lines of whole texts; every seventh file lost its last byte."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")

    def chunk(line: Column, i: Column) -> Column:
        size = F.octet_length(line)
        return F.concat(_pick([c.encode().hex().upper() for c in _CHUNK_IDS], F.col("doc_id") + i), _hex(size, 4, True), F.hex(F.encode(line, "UTF-8")), F.when(size % 2 == 1, "00").otherwise(""))

    made = table(spark, sf_dir, "documents").select("doc_id", _joined(F.transform(lines, chunk)).alias("body"))
    whole = F.concat(F.lit(b"RIFF".hex().upper()), _hex(F.length("body") / 2 + 4, 4, True), F.lit(b"WEBP".hex().upper()), "body")
    files = made.select("doc_id", F.unhex(F.when(F.col("doc_id") % 7 == 0, F.substr(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)).alias("content"))
    return containers.riff_chunks(files, "doc_id").drop("body").fillna(-1).fillna("")


@query("""
WITH v AS (SELECT vec_id AS file_id, vec_id % 5 AS fx, vec_id % 3 AS fy, 8 + 2 * (vec_id % 5) + vec_id % 4 - 1 AS cw, 8 + 2 * (vec_id % 3) + vec_id % 2 AS ch, vec_id % 6 AS o, label % 256 AS shade, list_transform(embedding, lambda e: CAST(floor((e + 1) * 100) AS INTEGER)) AS p FROM embeddings),
k AS (SELECT *, 2 * fx AS x0, 2 * fy AS y0 FROM v WHERE 2 * fx + 8 <= cw AND 2 * fy + 8 <= ch),
g AS (SELECT *, unnest(range(cw)) AS x FROM k), h AS (SELECT *, unnest(range(ch)) AS y FROM g),
i AS (SELECT *, x BETWEEN x0 AND x0 + 7 AND y BETWEEN y0 AND y0 + 7 AS inside FROM h)
SELECT file_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST(CASE WHEN inside THEN p[(y - y0) * 8 + x - x0 + 1] ELSE shade END AS INTEGER) AS r, CAST(CASE WHEN inside THEN 7 ELSE 20 END AS INTEGER) AS b, CAST(CASE WHEN inside THEN 255 ELSE 128 END AS INTEGER) AS a, CAST(o AS INTEGER) AS orientation FROM i
""")
def webp_first_frame(spark, sf_dir):
    """First frames of animated files, an 8 by 8 picture of each vector, on their canvases of the background's colour, with the
    metadata's orientation; frames that reach over their canvas have no pixels."""
    v, n = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    fx, fy = n % 5, n % 3
    head = lambda name, body: F.concat(F.lit(name.encode().hex().upper()), _hex(F.length(body) / 2, 4, True), body, F.when(F.length(body) % 4 == 2, "00").otherwise(""))
    canvas = F.concat(F.lit("12000000"), _hex(8 + 2 * fx + n % 4 - 2, 3, True), _hex(8 + 2 * fy + n % 2 - 1, 3, True))
    shown = F.concat(F.lit("141E"), _hex(F.col("label") % 256, 1), F.lit("80" + "0000"))  # b, g, r, a, loops
    frame = F.concat(_hex(fx, 3, True), _hex(fy, 3, True), F.lit("070000070000" + "640000" + "00"), head("VP8 ", F.lit("00" * 10)))
    little = n % 2 == 0
    turn = F.concat(F.when(n % 3 == 0, b"Exif\0\0".hex().upper()).otherwise(""), F.when(little, "49492A00").otherwise("4D4D002A"), _hex(8, 4, little), _hex(1, 2, little), _hex(274, 2, little), _hex(3, 2, little), _hex(1, 4, little), _hex(n % 6, 2, little), F.lit("0000" + "00000000"))
    body = F.concat(head("VP8X", canvas), head("ANIM", shown), head("ANMF", frame), head("ANMF", frame), head("EXIF", turn))
    files = v.select(n.alias("file_id"), F.unhex(F.concat(F.lit(b"RIFF".hex().upper()), _hex(F.length(body) / 2 + 4, 4, True), F.lit(b"WEBP".hex().upper()), body)).alias("content"))
    one, hundred = F.lit(1).cast("float"), F.lit(100).cast("float")  # with integers Spark would go on in double precision
    shade = v.select(n.alias("file_id"), F.posexplode(F.transform("embedding", lambda e: F.floor((e + one) * hundred).cast("int"))).alias("i", "r"))
    pixels = shade.select("file_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "r", F.lit(7).alias("g"), F.lit(7).alias("b"), F.lit(255).alias("a"))
    canvases = containers.webp_canvas(files, "file_id")
    return containers.on_canvas(canvases, pixels, "file_id").join(canvases.select("file_id", "orientation"), "file_id").select("file_id", "x", "y", "r", "b", "a", "orientation")


#: A made directory of 14 entries with four depths behind it, in a byte order, and its bytes.
_directory = lambda order: np.dtype([("n", f"{order}u2"), ("entries", [("tag", f"{order}u2"), ("kind", f"{order}u2"), ("count", f"{order}u4"), ("value", f"{order}u4")], 14), ("following", f"{order}u4"), ("depths", f"{order}u2", 4)])
_DIRECTORY = 2 + 14 * 12 + 4 + 8


def _entry(little, tag, kind: int, count, value) -> Column:
    """A directory entry: values of shorts stand at the left of its last four bytes."""
    last = F.concat(_hex(value, 2, little), F.lit("0000")) if kind == 3 else _hex(value, 4, little)
    return F.concat(_hex(tag, 2, little), _hex(kind, 2, little), _hex(count, 4, little), last)


def _tiff_directories(order: str, key, i, m, line, part, supp) -> np.ndarray:
    """A directory per line of orders (arrays by line: order, place in it, lines of it, number, part, supplier)."""
    made, base = np.zeros(len(key), _directory(order)), 8 + _DIRECTORY * i
    depth, n, high = np.array((1, 2, 4, 8, 16))[supp % 5], line % 4 + 1, 16 if order == ">" else 0
    depths = np.where(n == 1, depth << high, np.where(n == 2, depth << 16 | depth, base + _DIRECTORY - 8))
    or_other = lambda tag, has: np.where(has, tag, 65000)
    entries = (
        (254, 4, 1, np.where(part % 4 == 0, 1, 2)), (or_other(256, part % 10 != 0), 4, 1, part), (257, 4, 1, supp), (258, 3, n, depths), (259, 3, 1, np.array((1, 3, 5, 7))[key % 4]), (262, 3, 1, part % 7), (273, 4, 1, part % 5000),
        (274, 3, 1, line % 8 + 1), (277, 3, 1, n + (supp % 17 == 0)), (279, 4, 1, supp % 1000), (or_other(284, part % 13 == 0), 3, 1, 2), (or_other(320, supp % 2 == 0), 3, 1, 1), (or_other(322, part % 5 == 0), 3, 1, 64), (317, 3, 1, part % 3 % 2 + 1),
    )
    made["n"], made["depths"] = len(entries), depth[:, None]
    made["following"] = np.where(i + 1 < m, base + _DIRECTORY, np.where(key % 5 == 0, 8, 0))
    for e, (tag, kind, count, value) in enumerate(entries):
        entry = made["entries"][:, e]
        entry["tag"], entry["kind"], entry["count"] = tag, kind, count
        entry["value"] = value << high if kind == 3 and count is not n else value  # a short stands at the left of the four bytes
    return made


def _tiff_files(batches):
    """(file_id, content) of batches of orders (file_id, lines): even ones have the low byte first."""
    for batch in batches:
        keys, lines = batch.column(0).fill_null(0).to_numpy(), batch.column(1)
        m = lines.value_lengths().to_numpy()
        for of in containers.portions(8 + _DIRECTORY * m.astype(np.int64), containers.SIDE_BY_SIDE_BYTES):
            some, size = lines.slice(of.start, of.stop - of.start).flatten(), m[of].astype(np.int64)
            file, ends = np.repeat(np.arange(len(size)), size), np.cumsum(8 + _DIRECTORY * size)
            i, key = np.arange(len(file)) - np.repeat(np.cumsum(size) - size, size), keys[of][file]
            line, part, supp = (c.fill_null(0).to_numpy().astype(np.int64) for c in some.flatten())
            starts, content = ends - 8 - _DIRECTORY * size, np.empty(ends[-1], np.uint8)
            for order, head, rest in (("<", b"II\x2a\0\x08\0\0\0", 0), (">", b"MM\0\x2a\0\0\0\x08", 1)):
                containers.at_any_byte(content, "V8")[starts[keys[of] % 2 == rest]] = np.void(head)
                mine = key % 2 == rest
                made = _tiff_directories(order, *(a[mine] for a in (key, i, size[file], line, part, supp)))
                containers.at_any_byte(content, f"V{_DIRECTORY}")[starts[file[mine]] + 8 + _DIRECTORY * i[mine]] = made.view(f"V{_DIRECTORY}")
            edges = pa.py_buffer(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(of.start, len(size)), pa.Array.from_buffers(pa.binary(), len(size), [None, edges, pa.py_buffer(content)])], names=["file_id", "content"])


@query(f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
p AS (SELECT l_orderkey AS file_id, i AS directory_no, 8 + {_DIRECTORY} * i AS place, l_partkey AS width, l_suppkey AS height, l_linenumber % 8 + 1 AS orientation, l_partkey % 4 = 0 AS thumb, l_partkey % 7 AS ph, ([1, 2, 4, 8, 16])[(l_suppkey % 5 + 1)::INT] AS bps, l_linenumber % 4 + 1 AS n,
  ([1, 3, 5, 7])[(l_orderkey % 4 + 1)::INT] AS comp, l_partkey % 5000 + l_suppkey % 1000 > 8 + {_DIRECTORY} * m AS cut, l_partkey % 13 = 0 AS planes, l_partkey % 5 = 0 AND l_partkey % 3 % 2 + 1 = 2 AS smeared, l_suppkey % 17 = 0 AS uneven, l_suppkey % 2 = 0 AS palette FROM t WHERE l_partkey % 10 <> 0),
v AS (SELECT *, CASE WHEN cut THEN 'truncated' WHEN planes THEN 'separate_planes' WHEN comp = 3 THEN 'group3_fax' WHEN smeared THEN 'tiled_predictor' WHEN comp = 7 AND n = 3 THEN 'jpeg_rgb' WHEN uneven THEN 'inconsistent_channels'
  WHEN ph = 0 THEN CASE WHEN n = 1 AND bps IN (1, 4, 8) THEN 'ok' ELSE 'grey_depth' END WHEN ph = 1 THEN CASE WHEN n = 1 AND bps IN (1, 2, 8, 16) THEN 'ok' ELSE 'grey_depth' END WHEN ph = 2 THEN CASE WHEN bps IN (8, 16) AND n IN (3, 4) THEN 'ok' ELSE 'rgb_depth' END
  WHEN ph = 3 THEN CASE WHEN bps = 8 AND palette THEN 'ok' ELSE 'palette_depth' END WHEN ph = 5 THEN CASE WHEN bps = 8 AND n >= 4 THEN 'ok' ELSE 'cmyk_depth' END ELSE 'unsupported_mode' END AS verdict, bool_and(thumb) OVER (PARTITION BY file_id) AS all_small FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY directory_no) AS j, count(*) OVER (PARTITION BY file_id) AS pages FROM v WHERE NOT thumb OR all_small)
SELECT file_id, CAST(directory_no AS INTEGER) AS directory_no, CAST(place AS BIGINT) AS "at", width, height, CAST(orientation AS INTEGER) AS orientation, thumb AS thumbnail, verdict, verdict IN ('group3_fax', 'tiled_predictor', 'jpeg_rgb', 'palette_depth') AS second_opinion, CASE WHEN pages > 1 THEN 'page ' || j || ' of ' || pages END AS label FROM k
""")
def tiff_from_bytes(spark, sf_dir):
    """Pages of TIFF files, read from their bytes: a file per order in either byte order, a directory per line; every fifth
    file's chain runs in a circle."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("lines"))
    return containers.tiff_pages(lines.mapInArrow(_tiff_files, StructType([lines.schema["file_id"], StructField("content", BinaryType())])), "file_id")


#: Bytes of a made directory of five entries with two offsets and two strips behind it.
_NODE = 2 + 5 * 12 + 4 + 16


@query(f"""
WITH RECURSIVE w AS (SELECT p_partkey AS p, p_size % 6 + 2 AS k, [0] AS queue, CAST([] AS INTEGER[]) AS seen FROM part UNION ALL
  SELECT p, k, queue[2:] || CASE WHEN list_contains(seen, queue[1]) THEN [] ELSE CASE WHEN (p + queue[1]) % 4 <> 0 THEN [CAST((queue[1] + 1) % k AS INTEGER)] ELSE [] END || [CAST((p + 3 * queue[1]) % k AS INTEGER), CAST((2 * queue[1] + 1) % k AS INTEGER)] || CASE WHEN (p + queue[1]) % 3 = 0 THEN [CAST(p * queue[1] % k AS INTEGER)] ELSE [] END END,
    CASE WHEN list_contains(seen, queue[1]) THEN seen ELSE list_append(seen, queue[1]) END FROM w WHERE len(queue) > 0),
d AS (SELECT p, unnest(seen) AS j, generate_subscripts(seen, 1) AS n FROM w WHERE len(queue) = 0),
c AS (SELECT p, n, 0 AS part, 5000 + j // 3 * 100 AS start, 'preview' AS source FROM d WHERE j % 2 = 0 UNION ALL SELECT p, n, 1, 5000 + j % 3 * 100, 'strip' FROM d WHERE (p + j) % 3 <> 0 AND j % 4 <> 3),
f AS (SELECT p, start, min(n * 2 + part) AS place, arg_min(source, n * 2 + part) AS source FROM c GROUP BY p, start)
SELECT p AS file_id, CAST(row_number() OVER (PARTITION BY p ORDER BY place) - 1 AS INTEGER) AS found_no, CAST(start AS BIGINT) AS start, source FROM f
""")
def raw_candidates(spark, sf_dir):
    """Where previews begin in RAW files made from parts, whose 2 to 7 directories form a graph with circles: the chain, two
    previews' directories and the camera's."""
    p, k, j, little = F.col("p_partkey"), F.col("p_size") % 6 + 2, F.col("j"), F.col("p_partkey") % 2 == 1
    place = lambda node: 8 + _NODE * node
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), k - 1)).alias("j"))
    stored = place(j) + _NODE - 16
    strips = F.when(j % 4 == 3, F.concat(_hex(273, 2, little), _hex(4, 2, little), _hex(2, 4, little), _hex(stored + 8, 4, little))).otherwise(_entry(little, 273, 4, 1, 5000 + j % 3 * 100))
    entries = [
        _entry(little, 259, 3, 1, F.element_at(F.array(F.lit(1), F.lit(6), F.lit(7)), (F.pmod(p + j, F.lit(3)) + 1).cast("int"))), strips, F.concat(_hex(330, 2, little), _hex(4, 2, little), _hex(2, 4, little), _hex(stored, 4, little)),
        _entry(little, F.when(j % 2 == 0, 513).otherwise(65000), 4, 1, 5000 + F.floor(j / 3) * 100), _entry(little, 34665, 4, 1, F.when((p + j) % 3 == 0, place(p * j % k)).otherwise(0)),
    ]
    following = F.when((p + j) % 4 != 0, place((j + 1) % k)).otherwise(0)
    one = F.concat(_hex(5, 2, little), *entries, _hex(following, 4, little), _hex(place((p + 3 * j) % k), 4, little), _hex(place((2 * j + 1) % k), 4, little), _hex(5000, 4, little), _hex(5100, 4, little))
    files = rows.select("p_partkey", "j", one.alias("one")).groupBy(p.alias("file_id")).agg(F.array_sort(F.collect_list(F.struct("j", "one"))).alias("all"))
    little = F.col("file_id") % 2 == 1
    content = F.unhex(F.concat(F.when(little, "49492A00").otherwise("4D4D002A"), _hex(8, 4, little), _joined(F.transform("all", lambda s: s["one"]))))
    return containers.raw_candidates(files.select("file_id", content.alias("content")), "file_id")


@query(SQL["item_orientation"])
def heif_orientation(spark, sf_dir):
    """The same as item_orientation from the bytes of nested boxes: a file per order, with sizes of 32 bits, of 64 bits or up to
    the end, and both widths of item ids and property numbers."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), _numbered_lines().alias("place"), (F.col("l_linenumber") % 3).alias("item"), (F.col("l_partkey") % 6).alias("index"))
    held = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("place", "item", "index"))).alias("all"))
    orders = table(spark, sf_dir, "orders").join(held, "o_orderkey", "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<place:int,item:int,index:bigint>>")))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda text: F.lit(text.encode().hex().upper())
    box = lambda kind, body: F.concat(_hex(F.length(body) / 2 + 8, 4), kind if isinstance(kind, Column) else name(kind), body)
    kinds = [_pick([t.encode().hex().upper() for t in ("irot", "imir", "pixi", "irot")], cust + i) for i in range(1, 5)]
    properties = F.concat(*[box(kind, _hex((cust * 7 + i * 5) % 256, 1)) for i, kind in enumerate(kinds, 1)])
    wide, large = key % 2 == 0, cust % 3 == 0
    number = lambda v, which, sizes: F.when(which, _hex(v, sizes[1])).otherwise(_hex(v, sizes[0]))
    entry = lambda e: F.concat(number(e["item"], wide, (2, 4)), F.lit("01"), number(e["index"], large, (1, 2)))
    given = F.concat(F.when(wide, "01").otherwise("00"), F.lit("0000"), F.when(large, "01").otherwise("00"), _hex(F.size("all"), 4), _joined(F.transform("all", entry)))
    primary = F.concat(F.when(wide, "01").otherwise("00"), F.lit("000000"), number(key % 3, wide, (2, 4)))
    meta = F.concat(F.lit("00000000"), box("hdlr", F.lit("00" * 4)), box("pitm", primary), box("iprp", F.concat(box("ipco", properties), box("ipma", given))), box("idat", F.lit("0000000969726F7403")))
    sized = F.when(key % 3 == 0, box("meta", meta)).when(key % 3 == 1, F.concat(F.lit("00000001"), name("meta"), _hex(F.length(meta) / 2 + 16, 8), meta)).otherwise(F.concat(F.lit("00000000"), name("meta"), meta))
    content = F.unhex(F.concat(box("ftyp", name("heic")), box("mdat", F.lit("0000000969726F7401")), sized))
    return containers.heif_orientation(orders.select(key.alias("file_id"), content.alias("content")), "file_id")


@query(f"""
WITH r AS (SELECT event_id, CASE WHEN user_id % 11 <> 0 THEN '/u' || user_id || '/' || event_type || '|' || (user_id % 1000 * 10) END AS key, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events),
p AS (SELECT *, lag(pos) OVER (PARTITION BY key ORDER BY pos) AS before FROM r)
SELECT event_id, coalesce(key IS NOT NULL AND before IS NOT NULL AND (SELECT count(DISTINCT q.key) FROM r q WHERE q.pos > p.before AND q.pos < p.pos) < {build.CACHE_ENTRIES}, false) AS hit FROM p
""")
def cache_hits(spark, sf_dir):
    """Which requests a preview cache of 400 entries answers, in order of time; missing files are asked for each time."""
    path = F.concat(F.lit("/u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit("|"), (F.col("user_id") % 1000 * 10).cast("string"))
    requests = table(spark, sf_dir, "events").select("event_id", "ts", F.when(F.col("user_id") % 11 != 0, path).alias("key"))
    return cache.hits(requests, "event_id").select("event_id", "hit")


def _run_of(i: int, odd: int) -> int:
    """Pixels that the packet of a vector's i-th value makes: repeats, or two pixels of its own."""
    return i % 5 * 2 + 1 if (i + odd) % 2 == 0 else 2


_RUNS = [sum(_run_of(i, odd) for i in range(64)) for odd in (0, 1)]


@query(f"""
WITH p AS (SELECT vec_id, i, v, CASE WHEN (i + vec_id) % 2 = 0 THEN i % 5 * 2 + 1 ELSE 2 END AS run FROM {_PIXELS}),
s AS (SELECT *, sum(run) OVER (PARTITION BY vec_id ORDER BY i) - run AS first FROM p), e AS (SELECT *, unnest(range(run)) AS k FROM s),
q AS (SELECT vec_id, first + k AS place, CASE WHEN (i + vec_id) % 2 = 1 AND k = 1 THEN 255 - v ELSE v END AS v, CASE WHEN vec_id % 2 = 0 THEN {_RUNS[0]} ELSE {_RUNS[1]} END AS n FROM e WHERE vec_id % 9 <> 0)
SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN n - 1 - place ELSE place END AS INTEGER) AS x, v AS r, 255 - v AS g, v AS b FROM q
""")
def decode_tga_runs(spark, sf_dir):
    """Pixels of run-length TGA images made from the vectors, a line of packets of both kinds; every ninth file lost its end."""
    odd = F.col("vec_id") % 2
    colour = lambda v: F.concat(*[F.lpad(F.hex(c), 2, "0") for c in (v, 255 - v, v)])

    def packet(v: Column, i: Column) -> Column:
        return F.when((i + odd) % 2 == 0, F.concat(F.lpad(F.hex(128 + i % 5 * 2), 2, "0"), colour(v))).otherwise(F.concat(F.lit("01"), colour(v), colour(255 - v)))

    n = F.when(odd == 0, _RUNS[0]).otherwise(_RUNS[1])
    whole = F.concat(F.lit("00000A000000000000000000"), _hex(n, 2, True), F.lit("0100" + "18"), F.when(F.col("vec_id") % 3 == 0, "30").otherwise("20"), _joined(F.transform("v", packet)))
    files = _images(spark, sf_dir).select("vec_id", F.unhex(F.when(F.col("vec_id") % 9 == 0, F.substr(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)).alias("content"))
    return decode.tga_pixels(decode.without_runs(files, "vec_id"), "vec_id").select("vec_id", "x", "r", "g", "b")


#: Bytes of made pieces of a file by kind: a broken chain, a stream, a stream with a thumbnail inside its metadata, one that is
#: too small, and text.
_PIECES = (9, 25, 25 + 4 + 6 + 26 + 25, 25, 7)


@query(f"""
WITH t AS (SELECT *, l_partkey % 5 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem),
s AS (SELECT *, sum(([{', '.join(map(str, _PIECES))}])[(kind + 1)::INT]) OVER (PARTITION BY l_orderkey ORDER BY place) AS until FROM t)
SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY place) - 1 AS INTEGER) AS found_no, CAST(until - ([{', '.join(map(str, _PIECES))}])[(kind + 1)::INT] AS BIGINT) AS start, CAST(until AS BIGINT) AS "end", CAST(l_suppkey % 60000 + 8 AS INTEGER) AS width, CAST(l_linenumber + 8 AS INTEGER) AS height, CAST(CASE WHEN kind = 2 THEN l_linenumber % 8 + 1 ELSE 0 END AS INTEGER) AS orientation FROM s WHERE kind IN (1, 2)
""")
def jpeg_scan(spark, sf_dir):
    """JPEG streams in files of unknown kind: a file per order, a piece per line, some of them no streams or streams in streams."""
    line, supp = F.col("l_linenumber"), F.col("l_suppkey")
    frame = lambda w, h: F.concat(F.lit("FFC0000A08"), _hex(h, 2), _hex(w, 2), F.lit("010101"))
    scan = "FFDA000301" + "AAFF00" + "FFD9"
    whole = lambda w, h, inside="": F.concat(F.lit("FFD8"), inside if isinstance(inside, Column) else F.lit(inside), F.lit("FF"), frame(w, h), F.lit(scan))
    w, h = supp % 60000 + 8, line + 8
    turn = F.concat(F.lit(b"Exif\0\0".hex().upper() + "4D4D002A00000008" + "0001" + "0112000300000001"), _hex(line % 8 + 1, 2), F.lit("0000" + "00000000"))
    inside = F.concat(F.lit("FFE1"), _hex(2 + 6 + 26 + 25, 2), turn, whole(F.lit(16), F.lit(16)))
    pieces = [F.lit("FFD8FFE00004000012"), whole(w, h), whole(w, h, inside), whole(F.lit(7), h), F.lit("74657874FFD900")]
    kind = F.col("l_partkey") % 5
    piece = F.element_at(F.array(*pieces), (kind + 1).cast("int"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), _numbered_lines().alias("place"), piece.alias("piece")).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("all"))
    return containers.jpeg_streams(files.select("file_id", F.unhex(_joined(F.transform("all", lambda s: s["piece"]))).alias("content")), "file_id")


@query(f"""
WITH p AS (SELECT vec_id, i, v, ([1, 4, 8, 24, 32])[(vec_id % 5 + 1)::INT] AS bits, 256 // ([2, 16, 256, 256, 256])[(vec_id % 5 + 1)::INT] AS step FROM {_PIXELS}),
k AS (SELECT *, v // step * step AS c, bits = 32 AND bool_or(v > 0) OVER (PARTITION BY vec_id) AND bool_or(v < 255) OVER (PARTITION BY vec_id) AS own FROM p)
SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, CAST(CASE WHEN vec_id % 2 = 0 THEN 7 - i // 8 ELSE i // 8 END AS INTEGER) AS y, CAST(c AS INTEGER) AS r, CAST(255 - c AS INTEGER) AS g, CAST(c AS INTEGER) AS b, CAST(CASE WHEN own THEN v WHEN vec_id % 2 = 0 AND i % 8 IN (0, 3) THEN 0 ELSE 255 END AS INTEGER) AS a FROM k
""")
def decode_icon(spark, sf_dir):
    """Pixels of icon bitmaps of all depths made from the vectors: with a mask from the bottom up, or without one from the top
    down; a lesser picture and one outside the file stand before."""
    n, v = F.col("vec_id"), F.col("v")
    bits, masked = _pick((1, 4, 8, 24, 32), n), n % 2 == 0
    rgb = lambda c: F.concat(*[_hex(x, 1) for x in (c, 255 - c, c)])
    palette = lambda size: "".join(f"{c:02X}{255 - c:02X}{c:02X}00" for c in range(0, 256, 256 // size))
    rows = [F.slice(v, 8 * y + 1, 8) for y in range(8)]
    row_of = {
        1: lambda r: F.concat(F.lpad(F.conv(_joined(F.transform(r, lambda e: F.floor(e / 128).cast("string"))), 2, 16), 2, "0"), F.lit("000000")), 4: lambda r: _joined(F.transform(r, lambda e: F.hex(F.floor(e / 16).cast("long")))),
        8: lambda r: _joined(F.transform(r, lambda e: _hex(e, 1))), 24: lambda r: _joined(F.transform(r, rgb)), 32: lambda r: _joined(F.transform(r, lambda e: F.concat(rgb(e), _hex(e, 1)))),
    }
    made = lambda b: F.concat(F.lit(palette(1 << b) if b <= 8 else ""), *[row_of[b](r) for r in rows])
    body = F.when(bits == 1, made(1)).when(bits == 4, made(4)).when(bits == 8, made(8)).when(bits == 24, made(24)).otherwise(made(32))
    height = F.when(masked, F.lit("10000000")).otherwise("F8FFFFFF")
    image = F.concat(F.lit("28000000" + "08000000"), height, F.lit("0100"), _hex(bits, 2, True), F.lit("00" * 24), body, F.when(masked, "90000000" * 8).otherwise(""))
    entry = lambda w, size, offset: F.concat(F.lit(f"{w:02X}{w:02X}0000" + "0100"), _hex(bits, 2, True), _hex(size, 4, True), _hex(offset, 4, True))
    size = F.length(image) / 2
    whole = F.concat(F.lit("000001000300"), entry(4, F.lit(10), F.lit(6)), entry(200, F.lit(90), F.lit(999_999)), entry(8, size, F.lit(6 + 48)), image)
    return decode.icon_pixels(_images(spark, sf_dir).select("vec_id", F.unhex(whole).alias("content")), "vec_id")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey % 500 + 8 AS w, o_orderkey % 90 + 8 AS h FROM orders),
f AS (SELECT k, w, h, n, CASE k % 3 WHEN 0 THEN (['header', 'scan'])[n + 1] WHEN 1 THEN (['PRVW', 'mdat'])[n + 1] ELSE (['preview', 'scan'])[n + 1] END AS source, CASE k % 3 WHEN 0 THEN (['92', '116'])[n + 1] WHEN 1 THEN (['56', '88'])[n + 1] ELSE (['26', '50'])[n + 1] END::BIGINT AS start FROM o, (SELECT unnest([0, 1]) AS n)),
s AS (SELECT k, n, start, source, CASE n WHEN 0 THEN w ELSE 400 - w // 2 END AS width, CASE n WHEN 0 THEN h ELSE 100 END AS height FROM f)
SELECT k AS file_id, CAST(arg_max(n, [width * height, -n]) AS INTEGER) AS found_no, CAST(arg_max(width, [width * height, -n]) AS INTEGER) AS width, CAST(arg_max(height, [width * height, -n]) AS INTEGER) AS height, arg_max(source, [width * height, -n]) AS source, CAST(arg_max(start, [width * height, -n]) AS BIGINT) AS start FROM s GROUP BY k
""")
def raw_files(spark, sf_dir):
    """The largest preview of RAW files of three kinds, from their bytes: one that a header's place, a box or a directory names,
    and one that a box of data or the search finds."""
    key, w, h = F.col("o_orderkey"), F.col("o_custkey") % 500 + 8, F.col("o_orderkey") % 90 + 8
    text = lambda t: F.lit(t.hex().upper())
    stream = lambda w, h: F.concat(F.lit("FFD8FFC0000A08"), _hex(h, 2), _hex(w, 2), F.lit("010101" + "FFDA000301" + "AAFF00" + "FFD9"))
    box = lambda kind, body: F.concat(_hex(F.length(body) / 2 + 8, 4), text(kind), body)
    one, two = stream(w, h), stream(400 - F.floor(w / 2), F.lit(100))
    header = F.concat(text(b"FUJIFILM" + bytes(76)), _hex(92, 4), _hex(24, 4), one, two)
    boxes = F.concat(box(b"ftyp", text(b"crx ")), box(b"moov", box(b"uuid", F.concat(F.lit("00" * 16), box(b"PRVW", F.concat(F.lit("0000"), F.lit("0000"), one))))), box(b"mdat", two))
    tags = F.concat(F.lit("4D4D002A00000008" + "0001" + "0201000400000001" + "0000001A" + "00000000"), one, two)
    content = F.unhex(F.when(key % 3 == 0, header).when(key % 3 == 1, boxes).otherwise(tags))
    files = table(spark, sf_dir, "orders").select(key.alias("file_id"), content.alias("content"))
    streams = containers.raw_streams(files, "file_id")
    chosen = ranking.raw_preview(streams.select("file_id", "found_no", "start", "width", "height", (F.col("end") - F.col("start")).alias("size"), F.lit(True).alias("decodes")))
    return chosen.join(streams.select("file_id", "found_no", "source", "start"), ["file_id", "found_no"]).select("file_id", "found_no", "width", "height", "source", "start")
