"""One PDF of all pages in order, written by many tasks: each writes its own bytes of the file, at a place it is told.

Rows: the order's columns and page_w, page_h, draw_x, draw_y, draw_w, draw_h, caption, rotate, width, height, rgb. Pages
are cut into ranges of the order. Two prefix sums over one row a range give first every page its number, and so the
numbers of its objects, then every range its place in the file, as the objects' lengths are known once they are made.
Tasks then write their ranges, and the entries of the cross-reference table, which have a fixed length, straight into the
file. The driver writes the first bytes and, behind the last range, the catalog and a page tree with a node per range.

The path is a folder's file that the driver and all executors share and can write at any place (a network or cluster file
system that is mounted). A task that runs again writes the same bytes at the same place."""

from __future__ import annotations

import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pdf_sink import escaped
from .shared import settled

HEAD = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"
#: Objects of a page: image, content, page. The first objects are catalog, page tree and font.
OF_PAGE, FIRST = 3, 4
#: Bytes of an entry of the cross-reference table.
ENTRY = 20
#: Pages of a range, about, and ranges at most.
RANGE_PAGES, MOST_RANGES = 2_000, 20_000
COLUMNS = ["page_w", "page_h", "draw_x", "draw_y", "draw_w", "draw_h", "caption", "rotate", "width", "height", "rgb"]


def _object(number: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (number, body)


def _stream(number: int, head: bytes, raw: bytes) -> bytes:
    return _object(number, b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(raw), raw))


def page_objects(row: dict, page: int, parent: int) -> list[bytes]:
    """The three objects of a page of that number (from 0), whose node in the page tree is `parent`."""
    first = FIRST + OF_PAGE * page
    image = _stream(first, b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode" % (row["width"], row["height"]), zlib.compress(bytes(row["rgb"])))
    draw = "q %.4f 0 0 %.4f %.4f %.4f cm /I Do Q\n" % (row["draw_w"], row["draw_h"], row["draw_x"], row["draw_y"])
    text = b"BT 0.3 g /F 10 Tf 24 33 Td (%s) Tj ET\n" % escaped(row["caption"]) if row["caption"] else b""
    body = b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %d %d] /Rotate %d /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> /Font << /F 3 0 R >> >> >>" % (parent, row["page_w"], row["page_h"], row["rotate"] or 0, first + 1, first)
    return [image, _stream(first + 1, b"", draw.encode() + text), _object(first + 2, body)]


def _node(number: int, kids: range) -> bytes:
    """A range's node in the page tree: a page's object is the last of its three."""
    return _object(number, b"<< /Type /Pages /Parent 2 0 R /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % (FIRST + OF_PAGE * p + 2) for p in kids)))


def write_book(pages: DataFrame, order: list[str], path: str, range_pages: int = RANGE_PAGES) -> int:
    """Writes all pages (rows with COLUMNS and those of order, which says their order) as one PDF; how many they are. Pages that
    are equal in order stand in any order. Without pages nothing is written and the error names it, as a build without a
    usable file."""
    total = pages.count()
    if not total:
        raise ValueError("no pages")
    n = max(1, min(MOST_RANGES, -(-total // range_pages)))
    placed = pages.select(*order, *[c for c in COLUMNS if c not in order]).repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = settled(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33).cast("int")), "pages")

    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    numbers = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    numbers = numbers.select("_range", "_least", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), (F.row_number().over(Window.orderBy("_range")) - 1).alias("_index"))
    nodes = FIRST + OF_PAGE * total  # the number of the first range's node

    def made(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                objects = page_objects(row, row["_page"], nodes + row["_index"])
                yield pa.RecordBatch.from_arrays([pa.array([row["_index"]], pa.int32()), pa.array([row["_page"]]), pa.array([b"".join(objects)], pa.binary()), pa.array([[len(o) for o in objects]], pa.list_(pa.int64()))], ["index", "page", "body", "sizes"])

    numbered = ranged.join(numbers, "_range").withColumn("_page", F.col("_first") + F.col("_at") - F.col("_least"))
    bodies = settled(numbered.select("_index", "_page", *COLUMNS).mapInArrow(made, "index int, page long, body binary, sizes array<long>"), "bodies")

    # a range's bytes are its pages and its node; the node's length follows from its pages' numbers
    spans = bodies.groupBy("index").agg(F.sum(F.length("body")).alias("bytes"), F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    node_size = F.udf(lambda index, first, count: len(_node(nodes + index, range(first, first + count))), "long")("index", "first", "n")
    spans = spans.select("index", "first", "n", (F.col("bytes") + node_size).alias("bytes"))
    told = settled(spans.withColumn("start", F.lit(len(HEAD)) + F.coalesce(F.sum("bytes").over(Window.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))), "spans")
    ends = told.agg(F.max(F.col("start") + F.col("bytes")).alias("end"), F.count(F.lit(1)).alias("n")).first()
    end, ranges = ends.end, ends.n

    kids = b" ".join(b"%d 0 R" % (nodes + i) for i in range(ranges))
    last = [_object(1, b"<< /Type /Catalog /Pages 2 0 R >>"), _object(2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (total, kids)), _object(3, b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")]
    size = nodes + ranges  # objects, with that of number 0
    table = end + sum(map(len, last))
    entries = table + len(b"xref\n0 %d\n" % size)

    local = path.removeprefix("file://")

    def put(out, at, raw):
        view = memoryview(raw)
        while view:
            done = os.pwrite(out, view, at)
            view, at = view[done:], at + done

    def write(batches):
        out, here, at = None, None, 0
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                out = os.open(local, os.O_WRONLY | os.O_CREAT, 0o644) if out is None else out
                if row["index"] != here:
                    here, at = row["index"], row["start"]
                    node = _node(nodes + here, range(row["first"], row["first"] + row["n"]))
                    put(out, row["start"] + row["bytes"] - len(node), node)
                    put(out, entries + ENTRY * (nodes + here), b"%010d 00000 n \n" % (row["start"] + row["bytes"] - len(node)))
                put(out, at, row["body"])
                places = [at, at + row["sizes"][0], at + row["sizes"][0] + row["sizes"][1]]
                put(out, entries + ENTRY * (FIRST + OF_PAGE * row["page"]), b"".join(b"%010d 00000 n \n" % p for p in places))
                at += len(row["body"])
                yield pa.RecordBatch.from_arrays([pa.array([row["page"]])], ["page"])
        if out is not None:
            os.fsync(out)
            os.close(out)

    with open(local, "wb") as f:
        f.write(HEAD)
    done = bodies.join(told, "index").repartition("index").sortWithinPartitions("index", "page").select("index", "page", "body", "sizes", "start", "bytes", "first", "n").mapInArrow(write, "page long").count()
    if done != total:
        raise RuntimeError(f"{done} of {total} pages were written")
    out = os.open(local, os.O_WRONLY)
    places = [end, end + len(last[0]), end + len(last[0]) + len(last[1])]
    put(out, end, b"".join(last) + b"xref\n0 %d\n" % size + b"0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places))
    put(out, entries + ENTRY * size, b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (size, table))
    os.fsync(out)
    os.close(out)
    return total
