"""Files in, PDF out, and the streaming intake."""

import json
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pagewright.plans import build
from pagewright.sources import files, pdf_book, pdf_sink, text_sink
from pagewright.streaming import intake


def test_listed_files_keep_missing_and_empty(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P2 1 1 1 1")
    (tmp_path / "b.jpg").write_bytes(b"")
    listed = spark.createDataFrame([(0, f"{tmp_path}/a.pgm"), (1, f"{tmp_path}/b.jpg"), (2, f"{tmp_path}/c.jpg")], "pos int, path string")
    got = {r.pos: (r.length, r.error is None) for r in files.read_listed(listed, str(tmp_path)).collect()}
    assert got[0] == (10, True) and not got[1][1] and not got[2][1]
    assert files.stat_scan(spark, str(tmp_path)).where("path like '%a.pgm'").count() == 1


def test_pdf_sink(spark, tmp_path):
    spark.dataSource.register(pdf_sink.PagePdf)
    rows = spark.range(3).select(F.col("id").alias("pos"), F.lit(792).alias("page_w"), F.lit(612).alias("page_h"), *[F.lit(float(v)).alias(c) for c, v in (("draw_x", 24), ("draw_y", 24), ("draw_w", 100), ("draw_h", 50))], F.concat(F.lit("page (1) "), F.col("id").cast("string")).alias("caption"), F.lit(90).alias("rotate"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.unhex(F.lit("010203040506")).alias("rgb"))
    rows.coalesce(1).sortWithinPartitions("pos").write.format("page-pdf").mode("append").save(str(tmp_path / "out"))
    ((name, pages),) = json.loads((tmp_path / "out/_parts.json").read_text())
    raw = (tmp_path / "out" / name).read_bytes()
    assert pages == 3 and raw.startswith(b"%PDF-1.4") and raw.count(b"/Type /Page ") == 3 and b"(page \\(1\\) 2)" in raw
    start = int(raw.split(b"startxref\n")[1].split()[0])
    assert raw[start : start + 4] == b"xref"
    first = int(raw[start:].split(b"\n")[3].split()[0])
    assert raw[first:].startswith(b"1 0 obj")
    assert zlib.decompress(raw.split(b"/FlateDecode")[1].split(b"stream\n")[1].split(b"\nendstream")[0]) == bytes([1, 2, 3, 4, 5, 6])


def test_stream_intake(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pgm").write_bytes(b"P2 1 1 1 1")
    (source / "b.txt").write_bytes(b"text")
    (source / "c.webp").write_bytes(b"RIFF\0\0\0\0WEBP")
    q = intake.incoming(spark, str(source)).select("format", "decoder").writeStream.format("memory").queryName("incoming").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.format, r.decoder) for r in spark.table("incoming").collect()) == [("pnm", "simple"), ("webp", "webp")]
    assert intake.counts(intake.incoming(spark, str(source))).isStreaming


def test_cache(spark):
    requests = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "key string, ts int")
    assert [r.key for r in build.cache_after(requests, 1).collect()] == ["a"]
    assert [r.key for r in build.to_fetch(requests, spark.createDataFrame([("a",)], "key string")).collect()] == ["b"]


def test_requests_that_share_a_decode(spark, tmp_path):
    source = tmp_path / "requests"
    source.mkdir()
    (source / "a.json").write_text("".join(json.dumps({"key": k, "ts": f"2024-01-01T00:{m:02}:00Z"}) + "\n" for k, m in (("a", 0), ("a", 5), ("b", 6), ("a", 7))))
    q = intake.new_only(spark.readStream.schema("key string, ts timestamp").json(str(source))).select("key").writeStream.format("memory").queryName("asked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.key for r in spark.table("asked").collect()) == ["a", "b"]


def test_text_sink_and_explicit_lists(spark, tmp_path):
    docs = spark.createDataFrame([("# Title\n\n\n\n*one* two\n",)], "t string").coalesce(1)
    text_sink.write_plain(docs, F.col("t"), str(tmp_path / "text"))
    (part,) = (tmp_path / "text").glob("part-*")
    assert part.read_bytes() == b"Title\r\n\r\none two\r\n\r\n" or part.read_bytes() == b"Title\r\n\r\none two\r\n"
    assert [tuple(r) for r in files.listed(spark, ["/b", "/a", "/b"]).orderBy("pos").collect()] == [(0, "/b"), (1, "/a"), (2, "/b")]


def book_pages(spark, n):
    return spark.range(n).select(
        (-F.col("id")).alias("pos"), (F.lit(600) + F.col("id") % 7).cast("int").alias("page_w"), F.lit(612).alias("page_h"), *[F.lit(float(v)).alias(c) for c, v in (("draw_x", 24), ("draw_y", 24), ("draw_w", 100), ("draw_h", 50))],
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("page (a) "), F.col("id").cast("string"))).alias("caption"), F.when(F.col("id") % 2 == 0, 90).alias("rotate"), F.lit(2).alias("width"), F.lit(1).alias("height"), F.unhex(F.lpad(F.hex(F.col("id")), 12, "0")).alias("rgb"),
    )


@pytest.mark.parametrize("n, range_pages", [(1, 10), (250, 30), (120, 1000)])
def test_one_ordered_book(spark, tmp_path, n, range_pages):
    """Every entry of the cross-reference table is where its object begins; the page tree gives the pages in order."""
    path = tmp_path / "book.pdf"
    assert pdf_book.write_book(book_pages(spark, n).repartition(4), ["pos"], f"file://{path}", range_pages) == n
    raw = path.read_bytes()
    table = int(raw.rsplit(b"startxref\n", 1)[1].split()[0])
    head, rest = raw[table:].split(b"\n", 2)[:2], raw[table:].split(b"\n", 2)[2]
    size = int(head[1].split()[1])
    places = [int(rest[20 * i : 20 * i + 10]) for i in range(size)]
    body = {}
    for i in range(1, size):
        assert raw[places[i] :].startswith(b"%d 0 obj\n" % i)
        body[i] = raw[places[i] :].split(b"\n", 1)[1].split(b"\nendobj", 1)[0]
    assert raw[table:].split(b"\n", 1)[0] == b"xref" and b"/Size %d /Root 1 0 R" % size in rest[20 * size :]
    refs = lambda text: [int(x) for x in re.findall(rb"(\d+) 0 R", text)]
    nodes = refs(body[2].split(b"/Kids")[1])
    pages = [p for node in nodes for p in refs(body[node].split(b"/Kids")[1])]
    assert len(nodes) == len(set(nodes)) and (len(nodes) > 3 or n < 200) and len(pages) == n
    for place, number in enumerate(pages):
        i = n - 1 - place  # pages stand in order of pos
        parent, content, image = refs(body[number])[:3]
        assert b"/MediaBox [0 0 %d 612] /Rotate %d" % (600 + i % 7, 90 * (i % 2 == 0)) in body[number] and number in refs(body[parent])
        pixels = zlib.decompress(body[image].split(b"stream\n", 1)[1].rsplit(b"\nendstream", 1)[0])
        assert int.from_bytes(pixels, "big") == i and (b"(page \\(a\\) %d)" % i in body[content]) == (i % 3 > 0)


def test_a_book_without_pages(spark, tmp_path):
    with pytest.raises(ValueError, match="no pages"):
        pdf_book.write_book(book_pages(spark, 0), ["pos"], str(tmp_path / "none.pdf"))
    assert not (tmp_path / "none.pdf").exists()
