"""Pixel decoders. Where a format's pixels stand at computed places they are Column expressions over BINARY, whose slices
take the same time at any place: a file is cut into lines, a line into pixels, so no pixel carries the file. QOI, whose
pixels depend on all before, is a small loop on Arrow batches. Output: a row per pixel (x, y, r, g, b, a)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import five_to_eight, rescaled
from .verdicts import u_le

MOST_PIXELS = 100_000_000
#: First bytes of a PNG image.
PNG_MARK = b"\x89PNG\r\n\x1a\n"
MOST_ICON_EDGE = 4096
#: Bytes of run-length packets whose starts are found at once.
PACKET_WINDOW = 1 << 16
#: Rows of a batch that leaves a Python decoder.
BATCH_PIXELS = 1 << 18


def byte_at(content: Column, at: Column) -> Column:
    """The byte at a 0-based place of BINARY; 0 beyond the end."""
    return F.ascii(F.decode(F.substring(content, at.cast("int") + 1, F.lit(1)), "ISO-8859-1"))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with made columns that are computed once a row, however often they are read: a generator stands between."""
    kept = [c for c in rows.columns if c not in made]
    return rows.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))


def _places(n: Column) -> Column:
    return F.sequence(F.lit(0), n.cast("int") - 1)


def _pixels(lines: DataFrame, key: str, width: str, made) -> DataFrame:
    """A row per pixel of lines (columns x and p) with made(x) as p."""
    return lines.withColumn("p", F.transform(_places(F.col(width)), made)).select("*", F.posexplode("p").alias("x", "px")).drop("p")


def pnm_pixels(files: DataFrame, key: str) -> DataFrame:
    """Pixels of Netpbm files P1..P7 (files: key, content). Damaged files (short data, a sample over the maximum) give none.

    In bitmaps 1 is black. Comments may stand between header tokens; one white-space byte ends the header. Of P7 the depth
    1 to 4 says whether there are colours and an alpha channel."""
    files = _once(files.select(key, "content"), content=F.col("content"))
    text = F.decode(F.col("content"), "ISO-8859-1")
    gap = r"(?:[\s\x0B]|#[^\n\r]*[\n\r])+"
    plain = rf"^P([1-6]){gap}(\d+){gap}(\d+)"
    deep = rf"^P[2356]{gap}\d+{gap}\d+{gap}(\d+)"
    told = r"^(P7\n(?:[^\n]*\n)*?ENDHDR\n)"
    number = lambda pattern, of="t": F.regexp_extract(of, pattern, 1).try_cast("int")
    named = lambda word: number(rf"\n{word} +(\d+) *\n", "told")
    head = _once(files.withColumn("t", text), told=F.regexp_extract("t", told, 1))
    of_kind = lambda other, pam: F.when(F.col("told") != "", pam).otherwise(other)
    head = head.select(
        key, "content", "t", of_kind(number(plain), F.lit(7)).alias("kind"), of_kind(F.regexp_extract("t", plain, 2).try_cast("int"), named("WIDTH")).alias("w"), of_kind(F.regexp_extract("t", plain, 3).try_cast("int"), named("HEIGHT")).alias("h"),
        of_kind(F.coalesce(number(deep), F.lit(1)), named("MAXVAL")).alias("most"), of_kind(F.when(number(plain).isin(3, 6), 3).otherwise(1), named("DEPTH")).alias("c"),
        of_kind(F.length(F.regexp_extract("t", rf"^P(?:[14]{gap}\d+{gap}\d+|[2356]{gap}\d+{gap}\d+{gap}\d+)[\s\x0B]", 0)), F.length("told")).alias("at"),
    )
    head = head.where((F.col("w") > 0) & (F.col("h") > 0) & (F.col("w").cast("long") * F.col("h") <= MOST_PIXELS) & F.col("most").between(1, 65535) & F.col("c").between(1, 4) & (F.col("at") > 0))
    body = F.regexp_replace(F.substr("t", F.col("at") + 1), r"#[^\n\r]*", " ")
    numbers = F.transform(F.regexp_extract_all(body, F.lit(r"\d+"), F.lit(0)), lambda v: v.try_cast("int"))
    digits = F.transform(F.regexp_extract_all(body, F.lit("[01]"), F.lit(0)), lambda v: 1 - v.cast("int"))
    n, wide = F.col("w") * F.col("h") * F.col("c"), F.when(F.col("most") > 255, 2).otherwise(1)
    stride = F.when(F.col("kind") == 4, F.ceil(F.col("w") / 8)).otherwise(F.col("w") * F.col("c") * F.col("wide")).cast("int")
    rows = _once(head, n=n, wide=wide, s=F.when(F.col("kind") == 1, digits).when(F.col("kind").isin(2, 3), numbers)).drop("t")
    rows = _once(rows, stride=stride, all=F.when(F.col("s").isNull(), F.substring("content", F.col("at") + 1, F.col("h") * stride)))

    def stored(line: Column, i: Column) -> Column:
        """Sample i of a line of bytes."""
        bit = 1 - F.pmod(F.floor(byte_at(line, F.floor(i / 8)) / F.pow(F.lit(2.0), 7 - i % 8)).cast("int"), F.lit(2))
        double = byte_at(line, i * 2) * 256 + byte_at(line, i * 2 + 1)
        return F.when(F.col("kind") == 4, bit).when(F.col("wide") == 2, double).otherwise(byte_at(line, i))

    written = F.col("s").isNotNull()
    over = F.when(written, F.exists(F.slice("s", 1, F.col("n")), lambda v: v.isNull() | (v > F.col("most")))).when((F.col("kind") == 4) | F.col("most").isin(255, 65535), False).otherwise(F.exists(_places(F.col("n")), lambda i: stored(F.col("all"), i) > F.col("most")))
    enough = F.when(written, F.size("s") >= F.col("n")).otherwise(F.length("content") >= F.col("at") + F.col("h").cast("long") * F.col("stride"))
    cut = lambda y: F.struct(y.alias("y"), F.substring("all", y * F.col("stride") + 1, F.col("stride")).alias("line"), F.slice("s", y * F.col("w") * F.col("c") + 1, F.col("w") * F.col("c")).alias("told"))
    lines = rows.where(enough & ~over).select(key, "kind", "w", "most", "c", "wide", F.explode(F.transform(_places(F.col("h")), cut)).alias("l")).select(key, "kind", "w", "most", "c", "wide", "l.*")

    def pixel(x: Column) -> Column:
        sample = lambda k: rescaled(F.coalesce(F.element_at("told", x * F.col("c") + k + 1), stored(F.col("line"), x * F.col("c") + k)), F.col("most"))
        grey, clear = F.col("c") < 3, F.when(F.col("c") == 2, sample(F.lit(1))).when(F.col("c") == 4, sample(F.lit(3))).otherwise(255)
        return F.struct(sample(F.lit(0)).alias("r"), sample(F.when(grey, 0).otherwise(1)).alias("g"), sample(F.when(grey, 0).otherwise(2)).alias("b"), clear.alias("a"))

    return _pixels(lines, key, "w", pixel).select(key, "x", "y", "px.*")


def tga_pixels(files: DataFrame, key: str) -> DataFrame:
    """Pixels of uncompressed TGA files: colour map (type 1), true colour of 15 to 32 bits (type 2) and grey with or without
    alpha (type 3), rows from either side.

    An alpha channel that is 0 everywhere counts as opaque. Files cut short, of another kind or with a pixel outside the
    colour map give no pixels."""
    files, c = _once(files.select(key, "content"), content=F.col("content")), F.col("content")
    bit = lambda at, n: F.shiftright(u_le(c, at, 1).cast("int"), n).bitwiseAND(1)
    entry = lambda v: F.when(v == 15, 2).otherwise((v / 8).cast("int"))
    whole = lambda at, n: u_le(c, at, n).cast("int")
    head = files.select(
        key, "content", whole(0, 1).alias("skip"), whole(1, 1).alias("mapped"), whole(2, 1).alias("kind"), whole(3, 2).alias("first"), whole(5, 2).alias("n_map"), entry(whole(7, 1)).alias("e"),
        whole(12, 2).alias("w"), whole(14, 2).alias("h"), whole(16, 1).alias("bits"), entry(whole(16, 1)).alias("d"), bit(17, 5).alias("top"), bit(17, 4).alias("right"), whole(17, 1).bitwiseAND(15).alias("clear"),
    )
    mapped = F.col("mapped") == 1
    head = head.withColumn("at", F.lit(18) + F.col("skip") + F.when(mapped, F.col("n_map") * F.col("e")).otherwise(0)).withColumn("n", F.col("w").cast("long") * F.col("h"))
    kinds = ((F.col("kind") == 1) & mapped & F.col("d").isin(1, 2) & F.col("e").isin(2, 3, 4)) | ((F.col("kind") == 2) & F.col("d").isin(2, 3, 4)) | ((F.col("kind") == 3) & F.col("d").isin(1, 2))
    fine = head.where(kinds & F.col("mapped").isin(0, 1) & (F.col("n") > 0) & (F.col("n") <= MOST_PIXELS) & (F.length("content") >= F.col("at") + F.col("n") * F.col("d")))
    fine = _once(fine, map=F.when(F.col("kind") == 1, F.substring("content", F.lit(19) + F.col("skip"), F.col("n_map") * F.col("e"))), all=F.substring("content", F.col("at") + 1, (F.col("n") * F.col("d")).cast("int"))).drop("content")

    with_bit = (F.col("bits") == 16) & (F.col("clear") == 1)  # the top bit of a 16-bit pixel is its alpha

    def index(line: Column, x: Column) -> Column:
        return F.when(F.col("d") == 1, byte_at(line, x)).otherwise(byte_at(line, x * 2) + byte_at(line, x * 2 + 1) * 256) - F.col("first")

    def colour(source: Column, at: Column, size: Column, attribute: Column) -> Column:
        """r, g, b and a of size bytes at a place: blue first, or five bits each."""
        word = byte_at(source, at) + byte_at(source, at + 1) * 256
        five = lambda n: five_to_eight(F.shiftright(word, n).bitwiseAND(31))
        of = lambda n, k: F.when(size == 2, five(n)).otherwise(byte_at(source, at + k))
        alpha = F.when(size == 4, byte_at(source, at + 3)).when((size == 2) & attribute, F.shiftright(word, 15) * 255).otherwise(255)
        return F.struct(of(10, 2).alias("r"), of(5, 1).alias("g"), of(0, 0).alias("b"), alpha.alias("a"))

    def pixel(line: Column, x: Column) -> Column:
        grey = byte_at(line, x * F.col("d"))
        of_grey = F.struct(grey.alias("r"), grey.alias("g"), grey.alias("b"), F.when(F.col("d") == 2, byte_at(line, x * 2 + 1)).otherwise(255).alias("a"))
        of_map = colour(F.col("map"), index(line, x) * F.col("e"), F.col("e"), F.lit(False))
        of_true = colour(line, x * F.col("d"), F.col("d"), with_bit)
        return F.when(F.col("kind") == 1, of_map).when(F.col("kind") == 3, of_grey).otherwise(of_true)

    outside = (F.col("kind") == 1) & F.exists(_places(F.col("n")), lambda i: ~index(F.col("all"), i).between(0, F.col("n_map") - 1))
    mapped_alpha = F.exists(_places(F.col("n")), lambda i: byte_at(F.col("map"), index(F.col("all"), i) * 4 + 3) > 0)
    own_alpha = F.exists(_places(F.col("n")), lambda i: byte_at(F.col("all"), i * F.col("d") + F.col("d") - 1) >= F.when((F.col("kind") == 2) & (F.col("d") == 2), 128).otherwise(1))
    some = F.when((F.col("kind") == 1) & (F.col("e") == 4), mapped_alpha).when((F.col("kind") == 2) & ((F.col("d") == 4) | with_bit) | ((F.col("kind") == 3) & (F.col("d") == 2)), own_alpha).otherwise(True)
    names = ["kind", "first", "map", "e", "w", "h", "bits", "d", "top", "right", "clear"]
    stride = F.col("w") * F.col("d")
    cut = lambda y: F.struct(y.alias("row"), F.substring("all", y * stride + 1, stride).alias("line"))
    lines = _once(fine.where(~outside), some=some).select(key, "some", *names, F.explode(F.transform(_places(F.col("h")), cut)).alias("l")).select(key, "some", *names, "l.*")
    x, y = F.col("x"), F.col("row")
    return _pixels(lines, key, "w", lambda i: pixel(F.col("line"), i)).select(key, F.when(F.col("right") == 1, F.col("w") - 1 - x).otherwise(x).alias("x"), F.when(F.col("top") == 1, y).otherwise(F.col("h") - 1 - y).alias("y"), "px.r", "px.g", "px.b", F.when(F.col("some"), F.col("px.a")).otherwise(255).alias("a"))


def _packets(data, at: int, record: int, count: int):
    """Starts and pixels of the run-length packets that make `count` pixels from byte `at`, or None if they don't.

    Where the next packet begins is known for each byte on its own, so within a window the starts are found by doubling:
    who is reached in up to 2^k steps, and the jumps of 2^k steps. Windows bound what is held."""
    import numpy as np

    starts, runs, left = [], [], count
    while left > 0:
        if at >= len(data):
            return None
        head = data[at : at + PACKET_WINDOW].astype(np.int64)
        run = (head & 127) + 1
        places = np.arange(len(head))
        jump = np.append(np.minimum(places + 1 + np.where(head & 128, record, run * record), len(head)), len(head))  # the last: beyond
        reached = np.zeros(1, np.int64)
        while jump[reached[0]] < len(head):
            reached = np.unique(np.concatenate([reached, jump[reached]]))
            jump = jump[jump]
        reached = reached[reached < len(head)]
        last = int(reached[-1])
        ends = np.cumsum(run[reached])
        if ends[-1] >= left:
            n = int(np.searchsorted(ends, left)) + 1
            if ends[n - 1] != left:
                return None  # a packet runs past the image
            reached, left = reached[:n], 0
        else:
            left -= int(ends[-1])
        starts.append(reached + at)
        runs.append(run[reached])
        at += last + 1 + (record if head[last] & 128 else int(run[last]) * record)
    return np.concatenate(starts), np.concatenate(runs)


def _unpacked(data):
    """A TGA file without run lengths in place of one with them; None if its packets end early or run past the image."""
    import numpy as np

    kind, entry = int(data[2]), {15: 2}.get(int(data[7]), int(data[7]) // 8)
    record = {15: 2}.get(int(data[16]), int(data[16]) // 8)
    count = int.from_bytes(data[12:14].tobytes(), "little") * int.from_bytes(data[14:16].tobytes(), "little")
    body = 18 + int(data[0]) + (int.from_bytes(data[5:7].tobytes(), "little") * entry if data[1] == 1 else 0)
    if not 1 <= record <= 4 or not 0 < count <= MOST_PIXELS:
        return None
    found = _packets(data, body, record, count)
    if found is None:
        return None
    starts, runs = found
    repeated = (data[starts] & 128) > 0
    if int((starts + 1 + np.where(repeated, record, runs * record)).max()) > len(data):
        return None
    out, at = [data[:2], np.array([kind - 8], np.uint8), data[3:body]], 0
    while at < len(starts):  # so many packets at once that their pixels are some MB
        some = slice(at, at + (PACKET_WINDOW >> 2))
        run = runs[some]
        within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
        source = np.repeat(starts[some] + 1, run) + np.where(np.repeat(repeated[some], run), 0, within * record)
        out.append(data[source[:, None] + np.arange(record)].ravel())
        at = some.stop
    return np.concatenate(out).tobytes()


def without_runs(files: DataFrame, key: str) -> DataFrame:
    """files (key, content) with TGA types 9 to 11 in their plain form, for `tga_pixels`; packets may cross rows. Files whose
    packets end early or run past the image are left out, others pass as they are."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                content = one.column(1)[0]
                data = np.frombuffer(content.as_buffer(), np.uint8) if content.is_valid else np.zeros(0, np.uint8)
                if len(data) >= 18 and data[2] in (9, 10, 11):
                    made = _unpacked(data)
                    if made is None:
                        continue
                    one = pa.RecordBatch.from_arrays([one.column(0), pa.array([made], pa.binary())], one.schema.names)
                yield one

    rows = files.select(key, "content")
    return rows.mapInArrow(run, rows.schema)


def _qoi(data: bytes):
    """(width, height, RGBA bytes) of a QOI file, or None if it is damaged."""
    if data is None or len(data) < 22 or data[:4] != b"qoif" or data[12] not in (3, 4) or data[13] > 1:
        return None
    w, h = int.from_bytes(data[4:8], "big"), int.from_bytes(data[8:12], "big")
    if not w or not h or w * h > MOST_PIXELS:
        return None
    seen, px, out, i, need, done = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), bytearray(4 * w * h), 14, w * h, 0
    while done < need:
        if i >= len(data) - 8:
            return None
        tag, n, (r, g, b, a) = data[i], 1, px
        i += 1
        if tag == 0xFE:
            px, i = (*data[i : i + 3], a), i + 3
        elif tag == 0xFF:
            px, i = tuple(data[i : i + 4]), i + 4
        elif tag < 0x40:
            px = seen[tag]
        elif tag < 0x80:
            px = ((r + (tag >> 4 & 3) - 2) & 255, (g + (tag >> 2 & 3) - 2) & 255, (b + (tag & 3) - 2) & 255, a)
        elif tag < 0xC0:
            up = (tag & 63) - 32
            px, i = ((r + up + (data[i] >> 4) - 8) & 255, (g + up) & 255, (b + up + (data[i] & 15) - 8) & 255, a), i + 1
        else:
            n = (tag & 63) + 1
        if len(px) < 4 or done + n > need:
            return None
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out[4 * done : 4 * (done + n)] = bytes(px) * n
        done += n
    return (w, h, out) if data[i : i + 8] == b"\0\0\0\0\0\0\0\1" else None


def qoi_pixels(files: DataFrame, key: str) -> DataFrame:
    """Pixels of QOI files (files: key of type long, content). Damaged files give none. Of a file its bytes and four bytes a
    pixel are held; rows leave in batches."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _qoi(data)
                if found:
                    w, h, px = found
                    rgba = np.frombuffer(px, np.uint8).reshape(-1, 4)
                    for at in range(0, w * h, BATCH_PIXELS):
                        some = rgba[at : at + BATCH_PIXELS].astype(np.int32)
                        i = np.arange(at, at + len(some))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int64)), pa.array((i % w).astype(np.int32)), pa.array((i // w).astype(np.int32)), *[pa.array(np.ascontiguousarray(some[:, c])) for c in range(4)]], [key, "x", "y", "r", "g", "b", "a"])

    return files.select(F.col(key).cast("long").alias(key), "content").mapInArrow(run, f"{key} long, x int, y int, r int, g int, b int, a int")


def icon_images(files: DataFrame, key: str) -> DataFrame:
    """key, image, png: the bytes of the best picture of each icon or cursor file (greatest area, then depth but of cursors,
    then place) and whether it is a PNG. Files that aren't icons, or whose pictures all lie outside, are left out."""
    c = F.col("content")
    place = lambda i: i * 16 + 6
    side = lambda at: F.when(u_le(c, at, 1) == 0, 256).otherwise(u_le(c, at, 1))

    def entry(i: Column) -> Column:
        at = place(i)
        depth = F.when(u_le(c, 2, 2) == 1, u_le(c, at + 6, 2)).otherwise(0)
        return F.struct((side(at) * side(at + 1)).alias("area"), depth.alias("depth"), (-i).alias("order"), u_le(c, at + 8, 4).alias("size"), u_le(c, at + 12, 4).alias("offset"))

    files = _once(files.select(key, "content"), content=F.col("content"))
    icons = files.where((F.length(c) >= 22) & (u_le(c, 0, 2) == 0) & u_le(c, 2, 2).isin(1, 2) & (u_le(c, 4, 2) > 0) & (place(u_le(c, 4, 2)) <= F.length(c)))
    inside = lambda e: (e["size"] > 0) & (e["offset"] >= 6) & (e["offset"] + e["size"] <= F.length(c))
    best = F.array_max(F.filter(F.transform(_places(u_le(c, 4, 2)), entry), inside))
    chosen = _once(icons, best=best, content=c).where("best IS NOT NULL")
    image = F.substring("content", F.col("best.offset").cast("int") + 1, F.col("best.size").cast("int"))
    return _once(chosen, image=image).select(key, "image", (F.substring("image", 1, 8) == F.lit(PNG_MARK)).alias("png"))


def icon_pixels(files: DataFrame, key: str) -> DataFrame:
    """Pixels of the best picture of icon and cursor files, where it is a bitmap: 1, 4, 8 (with a palette), 24 or 32 bits.

    An even height above 0 counts the lines of a mask too, which hides pixels of all forms without an alpha channel of their
    own (32 bits with a channel that is 0, or 255, everywhere have none); a mask that isn't there hides nothing. Rows stand
    from the bottom up, or, of a height below 0, from the top. Damaged bitmaps give no pixels."""
    i = F.col("image")
    signed = lambda v: F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)
    read = icon_images(files, key).where(~F.col("png") & (F.length(i) >= 40)).select(key, "image", u_le(i, 0, 4).alias("head"), signed(u_le(i, 4, 4)).alias("w"), signed(u_le(i, 8, 4)).alias("stored"), u_le(i, 14, 2).alias("bits"), u_le(i, 16, 4).alias("packed"), u_le(i, 32, 4).alias("told"))
    c = F.col
    masked = (c("stored") > 0) & (c("stored") % 2 == 0)
    sized = read.where((c("head") >= 40) & (c("head") <= F.length(i)) & (c("packed") == 0) & c("w").between(1, MOST_ICON_EDGE) & (c("stored") != 0) & c("bits").isin(1, 4, 8, 24, 32)).withColumns(
        {"h": F.when(masked, c("stored") / 2).otherwise(F.abs("stored")).cast("int"), "masked": masked, "w": c("w").cast("int"), "bits": c("bits").cast("int"), "colours": F.when(c("bits") <= 8, F.when(c("told") == 0, F.pow(F.lit(2), c("bits"))).otherwise(c("told")).cast("long")).otherwise(0)}
    )
    words = lambda bits: F.floor((bits + 31) / 32) * 4
    placed = sized.withColumns({"start": c("head") + c("colours") * 4, "stride": words(c("w") * c("bits")), "mask_stride": words(c("w"))}).withColumn("mask_start", c("start") + c("stride") * c("h"))
    fine = placed.where((c("colours") <= 256) & (c("w").cast("long") * c("h") <= MOST_PIXELS) & (c("mask_start") <= F.length(i)))
    cut = lambda at, n: F.substring(i, at.cast("int") + 1, n.cast("int"))
    hides = c("masked") & (c("mask_start") + c("mask_stride") * c("h") <= F.length(i))
    parts = _once(fine, palette=cut(c("head"), c("colours") * 4), all=cut(c("start"), c("stride") * c("h")), mask=F.when(hides, cut(c("mask_start"), c("mask_stride") * c("h"))))

    def index(line: Column, x: Column) -> Column:
        per = (F.lit(8) / F.col("bits")).cast("int")
        shift = (per - 1 - x % per) * c("bits")
        return F.floor(byte_at(line, F.floor(x / per)) / F.pow(F.lit(2), shift)).cast("int") % F.pow(F.lit(2), F.col("bits")).cast("int")

    line_of = lambda y, rows, stride: F.substring(rows, (y * c(stride)).cast("int") + 1, c(stride).cast("int"))
    some_index = F.exists(_places(c("h")), lambda y: F.exists(_places(c("w")), lambda x: index(line_of(y, c("all"), "stride"), x) >= c("colours")))
    outside = (c("bits") <= 8) & (c("colours") < F.pow(F.lit(2), c("bits"))) & some_index
    alpha = lambda test: F.exists(_places(c("h")), lambda y: F.exists(_places(c("w")), lambda x: test(byte_at(line_of(y, c("all"), "stride"), x * 4 + 3))))
    own = (c("bits") == 32) & alpha(lambda a: a > 0) & alpha(lambda a: a < 255)
    stored_line = lambda y: F.when(c("stored") > 0, c("h") - 1 - y).otherwise(y)
    names = ["w", "bits", "palette", "own"]
    line = lambda y: F.struct(y.alias("row"), line_of(stored_line(y), c("all"), "stride").alias("line"), F.when(c("mask").isNotNull(), line_of(stored_line(y), c("mask"), "mask_stride")).alias("hidden"))
    lines = _once(parts.where(~outside), own=own).select(key, *names, F.explode(F.transform(_places(c("h")), line)).alias("l")).select(key, *names, "l.*")

    def pixel(x: Column) -> Column:
        wide, at = (F.col("bits") / 8).cast("int"), index(F.col("line"), x) * 4
        of = lambda k: F.when(F.col("bits") >= 24, byte_at(F.col("line"), x * wide + k)).otherwise(byte_at(F.col("palette"), at + k))
        hidden = F.col("hidden").isNotNull() & (F.floor(byte_at(F.col("hidden"), F.floor(x / 8)) / F.pow(F.lit(2), 7 - x % 8)).cast("int") % 2 == 1)
        return F.struct(of(2).alias("r"), of(1).alias("g"), of(0).alias("b"), F.when(F.col("own"), byte_at(F.col("line"), x * 4 + 3)).when(hidden, 0).otherwise(255).alias("a"))

    return _pixels(lines, key, "w", pixel).select(key, "x", F.col("row").alias("y"), "px.*")
