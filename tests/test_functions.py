"""Column functions on hand-made values; goldens follow from the layout rule and the formats' definitions."""

import pytest
from pyspark.sql import functions as F

from pagewright.functions import geometry, scalars, sniff
from pagewright.operators import decode, manifest, ranking, verdicts
from pagewright.plans import build


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_norm_rotation(spark):
    got = values(spark, "v double", [(x,) for x in (100.0, 45.0, -45.0, -90.0, 450.0, 0.0, float("nan"), float("inf"), None)], scalars.norm_rotation(F.col("v")))
    assert [g[0] for g in got] == [90, 90, 0, 270, 90, 0, 0, 0, 0]


def test_extensions(spark):
    paths = ["/a/b.JPG", "/a/.jpg", "c:\\x\\y.Pdf", "/a/none", "/a/x.tar.gz"]
    got = values(spark, "p string", [(p,) for p in paths], scalars.extension(F.col("p")), scalars.accepted(F.col("p")), scalars.accepted_when_dropped(F.col("p")), scalars.kind(F.col("p")))
    assert got == [("jpg", True, True, "image"), ("", False, True, "image"), ("pdf", True, True, "pdf"), ("", False, False, "image"), ("gz", False, False, "image")]


def test_natural_order(spark):
    names = ["IMG_10.jpg", "IMG_2.jpg", "a1", "IMG_002b.jpg", "x" + "9" * 30, "x1" + "0" * 30]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(scalars.natural_key(F.col("n"))).collect()] == ["a1", "IMG_2.jpg", "IMG_002b.jpg", "IMG_10.jpg", "x" + "9" * 30, "x1" + "0" * 30]


def test_caption(spark):
    got = values(spark, "t string, l string", [("Été\n  x", None), ("a" * 120, None), ("name", "page 1 of 2"), (None, None)], scalars.caption(F.col("t"), F.col("l")))
    assert [g[0] for g in got] == ["t x", "a" * 107 + "...", "name - page 1 of 2", ""]


@pytest.mark.parametrize(
    ("w", "h", "cap", "want"),
    [(1400, 900, True, (792, 612, 24.0, 77.8571, 744.0, 478.2857)), (900, 1400, True, (612, 792, 73.9286, 46.0, 464.1429, 722.0)), (8, 8, True, (792, 612, 125.0, 46.0, 542.0, 542.0)), (8, 8, False, (792, 612, 114.0, 24.0, 564.0, 564.0)), (300, 200, False, (792, 612, 24.0, 58.0, 744.0, 496.0)), (200, 300, False, (612, 792, 58.0, 24.0, 496.0, 744.0))],
)
def test_layout(spark, w, h, cap, want):
    (got,) = values(spark, "w int, h int, c boolean", [(w, h, cap)], geometry.page_layout(F.col("w"), F.col("h"), F.col("c")))
    assert tuple(round(x, 4) for x in got[0]) == want


def test_bounded(spark):
    got = values(spark, "w int, h int", [(3000, 2000), (100, 50), (5000, 1)], geometry.bounded(F.col("w"), F.col("h"), F.lit(360)))
    assert [tuple(g[0]) for g in got] == [(360, 240), (100, 50), (360, 1)]


def test_orientation_composes(spark):
    """Four quarter turns are none; a mirror twice is none."""
    px = [(x, y) for x in range(3) for y in range(2)]
    df = spark.createDataFrame(px, "x int, y int").withColumns({"ox": F.col("x"), "oy": F.col("y"), "w": F.lit(3), "h": F.lit(2)})
    for code, times in ((6, 4), (8, 4), (2, 2), (4, 2), (5, 2), (7, 2), (3, 2)):
        now = df
        for _ in range(times):
            o = geometry.oriented(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(code))
            now = now.withColumn("o", o).withColumns({"x": F.col("o.x"), "y": F.col("o.y"), "w": F.col("o.width"), "h": F.col("o.height")})
        assert now.where("x <> ox OR y <> oy OR w <> 3 OR h <> 2").count() == 0


def test_word_wrap(spark):
    got = values(spark, "t string", [("aa bb cc",), ("aaaaaaaaaa b",), ("",)], scalars.wrapped(F.col("t"), 5))
    assert [g[0] for g in got] == [["aa bb", "cc"], ["aaaaaaaaaa", "b"], [""]]


def test_messages(spark):
    got = values(spark, "i long, p long", [(0, 0), (1, 0), (0, 2), (3, 1)], scalars.ready_text(F.col("i"), F.col("p")))
    assert [g[0] for g in got] == ["Nothing added yet", "1 photo ready", "2 PDFs ready", "3 photos + 1 PDF ready"]
    got = values(spark, "b long", [(0,), (1536,), (1048576,), (1310720,)], scalars.size_text(F.col("b")))
    assert [g[0] for g in got] == ["0 KB", "2 KB", "1.0 MB", "1.3 MB"]


def test_reasons(spark):
    rows = [("a.jpg", "ENOENT x", False), ("a.pdf", "Permission denied", False), ("a.jpg", "too odd", True), ("a.jpg", None, None), ("a.pdf", "is encrypted", None), ("a.pdf", "x", None)]
    got = [r.reason for r in build.reasons(spark.createDataFrame(rows, "path string, error string, user_facing boolean").coalesce(1)).collect()]
    assert got == ["file_not_found", "no_permission", "decoder:too odd", None, "password_protected", "not_readable_pdf"]


@pytest.mark.parametrize(("head", "path", "want"), [(b"\xff\xd8\xff\xe0", "x.png", "jpeg"), (b"P5\xa0x", "x", "pnm"), (b"P8 x", "x", "unknown"), (b"II*\0\x10\0\0\0CR", "x.tif", "raw"), (b"II*\0\x10\0\0\0\0\0", "x.tif", "tiff"), (b"abc", "x.nef", "unknown"), (b"abcd", "x.nef", "raw"), (b"  <SVG x", "x", "svg"), (b"\0\0\1\0", "x.cur", "ico"), (b"\0\0\0\x18ftypmif1", "x", "heic"), (b"\0\0\0\x18ftypmp42\0\0\0\0avif", "x", "avif"), (None, "x", "unknown")])
def test_sniff(spark, head, path, want):
    (got,) = values(spark, "c binary, p string", [(head, path)], sniff.sniff(F.col("c"), F.col("p")))
    assert got[0] == want


def pixels(df):
    return {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.collect()}


def test_netpbm(spark):
    def of(content):
        return pixels(decode.pnm_pixels(spark.createDataFrame([(1, content)], "k long, content binary"), "k"))

    black, white = (0, 0, 0, 255), (255, 255, 255, 255)
    assert of(b"P1\n# c\n3 1\n1 0 1\n") == {(0, 0): black, (1, 0): white, (2, 0): black}
    assert of(b"P4 3 1\n\xa0") == {(0, 0): black, (1, 0): white, (2, 0): black}
    assert of(b"P3 1 1 15 15 0 7") == {(0, 0): (255, 0, 119, 255)}
    assert of(b"P6 1 1 255\n\1\2\3") == {(0, 0): (1, 2, 3, 255)}
    assert of(b"P5 1 1 65535\n\xff\xff") == {(0, 0): white}
    for bad in (b"P2 1 1 5 6", b"P5 2 1 255\n\1", b"P5 0 1 255\n\1", b"P9 1 1 1 1", b""):
        assert of(bad) == {}


def test_tga(spark):
    def of(content):
        return pixels(decode.tga_pixels(spark.createDataFrame([(1, content)], "k long, content binary"), "k"))

    head = bytes([0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 2, 0])
    assert of(head + bytes([24, 0]) + b"\1\2\3\4\5\6") == {(0, 1): (3, 2, 1, 255), (0, 0): (6, 5, 4, 255)}
    assert of(head + bytes([32, 0x28]) + b"\1\2\3\0\4\5\6\0") == {(0, 0): (3, 2, 1, 255), (0, 1): (6, 5, 4, 255)}
    assert of(head + bytes([32, 0x28]) + b"\1\2\3\0\4\5\6\7")[(0, 1)] == (6, 5, 4, 7)
    assert of(head + bytes([24, 0]) + b"\1\2\3") == {}


def test_qoi(spark):
    def of(content):
        return pixels(decode.qoi_pixels(spark.createDataFrame([(1, content)], "k long, content binary"), "k"))

    head, end = b"qoif" + (5).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\4\0", b"\0" * 7 + b"\1"
    body = b"\xfe\x0a\x14\x1e" + bytes([0x40 | 3 << 4 | 2 << 2 | 1]) + bytes([0x80 | 33, 0x88]) + b"\xc1"
    got = of(head + body + end)
    assert got == {(0, 0): (10, 20, 30, 255), (1, 0): (11, 20, 29, 255), (2, 0): (12, 21, 30, 255), (3, 0): (12, 21, 30, 255), (4, 0): (12, 21, 30, 255)}
    for bad in (head + body, head + body + b"\0" * 8, b"qoif", head + b"\xfd" + end):
        assert of(bad) == {}


def test_lists(spark):
    df = spark.createDataFrame([("l", i, f"/{i}.jpg") for i in range(4)], "k string, pos long, path string")
    order = lambda s, t: [r.pos for r in manifest.moved(df, "k", F.lit(s), F.lit(t)).orderBy("new_pos").collect()]
    assert order(0, 2) == [1, 2, 0, 3] and order(3, 0) == [3, 0, 1, 2] and order(1, 9) == [0, 1, 2, 3]
    assert [r.pos for r in manifest.removed(df, "k", F.lit(1)).orderBy("pos").collect()] == [0, 1, 2]
    turns = spark.createDataFrame([("/0.jpg", 90), ("/9.jpg", 90), ("/1.jpg", 0)], "path string, deg int")
    assert [r.path for r in manifest.without_left(turns, df).collect()] == ["/0.jpg"]


def test_raw_choice_falls_through(spark):
    rows = [(1, 1, 0, 20000, 6000, 9, True), (1, 2, 5, 100, 100, 5, False), (1, 3, 6, 90, 90, 5, True), (1, 4, 6, 900, 900, 5, True), (2, 1, 0, 20000, 6000, 9, True), (3, 1, 0, 50, 50, 9, False)]
    df = spark.createDataFrame(rows, "file_id long, found_no int, start int, width int, height int, size int, decodes boolean")
    got = {r.file_id: (r.found_no, r.attempt, r.verdict) for r in ranking.raw_preview(df).collect()}
    assert got == {1: (3, 2, "ok"), 2: (None, None, "too_large"), 3: (None, None, "damaged_preview")}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k string, pos long, path string, error string, user_facing boolean, frames int")
    assert build.summary(empty, "k").count() == 0 and manifest.intake(empty, "k").count() == 0 and build.progress(empty, "k").count() == 0


def _rgb_image(w, h):
    return bytes((x * 7 + y * 3 + k * 50) % 256 for y in range(h) for x in range(w) for k in range(3))


def test_decoders_take_time_by_the_size(spark):
    """Images of a million samples, binary and text; the time may not follow the square of the file's length."""
    import time

    w, h = 640, 520
    body = _rgb_image(w, h)
    bgr = bytes(body[i + 2 - k] for i in range(0, len(body), 3) for k in range(3))
    tga = bytes([0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0]) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([24, 0x20]) + bgr
    qoi = b"qoif" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\3\0" + b"".join(b"\xfe" + body[i : i + 3] for i in range(0, len(body), 3)) + b"\0" * 7 + b"\1"
    text = f"P3\n{w} {h} 255\n".encode() + b" ".join(b"%d" % v for v in body) + b"\n"
    for made, raw in ((decode.pnm_pixels, f"P6\n{w} {h}\n255\n".encode() + body), (decode.pnm_pixels, text), (decode.tga_pixels, tga), (decode.qoi_pixels, qoi)):
        began = time.time()
        got = made(spark.createDataFrame([(1, raw)], "k long, content binary"), "k").agg(F.count("*"), F.sum(F.col("r").cast("long") * (F.col("x") + 1)), F.sum("g"), F.sum(F.col("b") * F.col("y")), F.max("x"), F.max("y")).first()
        px = [body[i : i + 3] for i in range(0, len(body), 3)]
        want = (w * h, sum(p[0] * (i % w + 1) for i, p in enumerate(px)), sum(p[1] for p in px), sum(p[2] * (i // w) for i, p in enumerate(px)), w - 1, h - 1)
        assert tuple(got) == want and time.time() - began < 60


def test_tga_maps_and_words(spark):
    """Colour maps with an offset and 32-bit entries, 15 and 16 bits, and pixels outside the map."""
    head = lambda *v: bytes(v)
    of_map = head(0, 1, 1, 2, 0, 2, 0, 32, 0, 0, 0, 0, 2, 0, 1, 0, 8, 0x20) + bytes([3, 2, 1, 9, 6, 5, 4, 0])
    files = [(1, of_map + bytes([2, 3])), (2, of_map + bytes([2, 4])), (3, of_map + bytes([3, 3])), (4, head(0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 2, 0, 1, 0, 16, 0x21) + bytes([0x1F, 0x80, 0xE0, 3])), (5, head(0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 15, 0x20) + bytes([0, 0x7C])), (6, head(0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 1, 0, 16, 0x20) + bytes([7, 8])), (7, None), (8, b"")]
    got = {}
    for r in decode.tga_pixels(spark.createDataFrame(files, "k long, content binary"), "k").orderBy("k", "x").collect():
        got.setdefault(r.k, []).append((r.r, r.g, r.b, r.a))
    assert got == {1: [(1, 2, 3, 9), (4, 5, 6, 0)], 3: [(4, 5, 6, 255)] * 2, 4: [(0, 0, 255, 255), (0, 255, 0, 0)], 5: [(255, 0, 0, 255)], 6: [(7, 7, 7, 8)]}


def test_arbitrary_maps(spark):
    made = lambda depth, most, body, w=1: f"P7\n# made\nWIDTH {w}\nHEIGHT 1\nDEPTH {depth}\nMAXVAL {most}\nTUPLTYPE X\nENDHDR\n".encode() + body
    files = [(1, made(4, 255, bytes([1, 2, 3, 4]))), (2, made(2, 15, bytes([15, 0]))), (3, made(1, 1, bytes([1, 0]), 2)), (4, made(3, 65535, bytes([255, 255, 0, 0, 128, 0]))), (5, made(3, 15, bytes([16, 0, 0]))), (6, made(3, 255, b"ab")), (7, made(5, 255, b"abcde"))]
    got = {}
    for r in decode.pnm_pixels(spark.createDataFrame(files, "k long, content binary"), "k").orderBy("k", "x").collect():
        got.setdefault(r.k, []).append((r.r, r.g, r.b, r.a))
    assert got == {1: [(1, 2, 3, 4)], 2: [(255, 255, 255, 0)], 3: [(255, 255, 255, 255), (0, 0, 0, 255)], 4: [(255, 0, 128, 255)]}


def test_word_wrap_by_pattern_equals_the_fold(spark):
    import random

    def fold(line, width):
        if len(line) <= width:
            return [line]
        done, now = [], ""
        for word in line.split(" "):
            if now and len(now) + 1 + len(word) > width:
                done.append(now)
                now = word
            else:
                now = f"{now} {word}" if now else word
        return done + [now] * bool(now)

    rng = random.Random(2)
    lines = [rng.choice(["", "", " ", "  "]) + rng.choice([" ", " ", " ", "  "]).join("".join(rng.choice("aé漢\t.😀") for _ in range(rng.choice([1, 3, 9, 10, 11, 25]))) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "", " "]) for _ in range(600)]
    got = values(spark, "l string", [(x,) for x in lines], F.col("l"), scalars.wrapped(F.col("l"), 10))
    assert {line: out for line, out in got} == {line: fold(line, 10) for line in lines}


def test_last_property_counts_and_first_decoder_speaks(spark):
    of_items = spark.createDataFrame([(1, 5, 0, 1), (1, 5, 1, 2), (1, 6, 2, 3), (1, 5, 3, 9), (2, 1, 0, 1)], "file_id long, item int, place int, index int")
    properties = spark.createDataFrame([(1, 1, "irot", 1), (1, 2, "irot", 7), (1, 3, "imir", 1), (2, 1, "imir", 0)], "file_id long, index int, type string, value int")
    primary = spark.createDataFrame([(1, 5), (2, 1), (3, 4)], "file_id long, item int")
    assert {r.file_id: r.orientation for r in ranking.item_orientation(of_items, properties, primary).collect()} == {1: 6, 2: 4, 3: 1}
    attempts = spark.createDataFrame([(1, "jpeg", 0, "base", False, "torn"), (1, "jpeg", 1, "raw", True, None), (2, "jpeg", 0, "base", False, "torn"), (2, "jpeg", 1, "raw", False, "no"), (3, "unknown", 0, "base", False, "torn")], "file_id long, format string, attempt_no int, decoder string, ok boolean, message string")
    assert sorted(tuple(r) for r in ranking.first_decoder(attempts).collect()) == [(1, "raw", 1, None), (2, None, None, "torn"), (3, None, None, "not a readable image")]


def test_no_usable_file_fails_the_build(spark):
    with pytest.raises(Exception, match="no usable file"):
        build.usable(spark.createDataFrame([(1, 0)], "list int, used int")).collect()
