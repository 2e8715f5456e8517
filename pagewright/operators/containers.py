"""Containers by their bytes: RIFF chunks, TIFF directories and ISO boxes as rows.

Offsets stand in the bytes themselves, so what can be read next is known only when the last was read: a file is walked
where it lies, on the Arrow buffer without a copy, by a step for each chunk, directory or box. What comes out are rows of
places and values; choosing, joining, numbering and judging them are DataFrame operators over these rows. A file is one
row of the input, and no file is shuffled."""

from __future__ import annotations

import re
import struct
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import ranking, verdicts
from .verdicts import u_be, u_le

#: Directories of a file that are looked at, counted as they leave the queue (also those that can't be read or were seen).
MOST_DIRECTORIES = 64
#: Entries of a directory, and values of an entry, that are read; a directory or an entry beyond has none.
MOST_ENTRIES, MOST_VALUES = 512, 1024
#: Bytes of a value by the type of its entry.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
#: Tags whose values are offsets of further directories, and how many of them are followed.
SUB_DIRECTORIES = {330: 8, 34665: 1}
#: Compressions of a directory whose one strip is a JPEG stream.
STREAM_COMPRESSIONS = (6, 7, 34892)
#: Boxes that hold boxes, with the bytes before the first of these.
HOLDERS = {"meta": 4, "iprp": 0, "ipco": 0, "moov": 0, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "udta": 0, "uuid": 16}
#: Boxes whose bytes are kept: the primary item, its turn and mirror, and which items have which properties.
KEPT_BODIES = ("pitm", "irot", "imir", "ipma")
MOST_DEPTH = 8
#: Streams of a file that are looked for.
MOST_STREAMS = 64
#: Marks without a length, and marks of frame heads.
STANDING_ALONE = {0x01, *range(0xD0, 0xD8)}
FRAME_HEADS = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_START_MARK, _END_MARK = re.compile(rb"\xff\xd8\xff"), re.compile(rb"\xff\xd9")
#: First bytes of a chunk that are kept.
HEAD_BYTES = 32
#: Rows of a batch that leaves a walk.
BATCH_ROWS = 1 << 14


def walked(files: DataFrame, key: str, walk, schema: str) -> DataFrame:
    """The rows (tuples) that walk(bytes) yields for each file (key, content), behind its key; a null content has none."""
    out = StructType([files.schema[key], *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(out)

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in walk(memoryview(content.as_buffer()).cast("B")) if content.is_valid else ():
                    held.append((k, *row))
                    if len(held) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held.clear()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return files.select(key, "content").mapInArrow(run, out)


# ---- RIFF


def riff_chunks(files: DataFrame, key: str, whole: tuple[str, ...] = ("EXIF",)) -> DataFrame:
    """key, chunk_no, id, start, size, body, fault. A row per chunk, with its first bytes (those in `whole` with all), then one
    for the file (chunk_no null) with what is wrong: not_webp, truncated (a size runs beyond the file or its declared end;
    the chunks before are rows still) or no_chunks."""

    def walk(data):
        if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            yield None, None, None, None, None, "not_webp"
            return
        end, at, n = int.from_bytes(data[4:8], "little") + 8, 12, 0
        fault = "truncated" if end > len(data) else None
        while fault is None and at + 8 <= end:
            size, start = int.from_bytes(data[at + 4 : at + 8], "little"), at + 8
            if start + size > end:
                fault = "truncated"
                break
            name = str(data[at : at + 4], "latin1")
            yield n, name, start, size, bytes(data[start : start + (size if name in whole else min(size, HEAD_BYTES))]), None
            at, n = start + size + (size & 1), n + 1
        yield None, None, None, None, None, fault or (None if n else "no_chunks")

    return walked(files, key, walk, "chunk_no int, id string, start long, size long, body binary, fault string")


def webp_verdicts(files: DataFrame, key: str) -> DataFrame:
    """verdict and number of animation frames by chunk list; pixels need a codec that isn't there. A null content is empty."""
    found = riff_chunks(files.select(key, F.coalesce("content", F.lit(b"")).alias("content")), key).groupBy(key).agg(F.max("fault").alias("fault"), F.count_if(F.col("id") == "ANMF").alias("n"), F.count_if(F.col("id").isin("VP8 ", "VP8L", "ANMF")).alias("pictures"))
    verdict = F.when(F.col("fault").isin("truncated", "not_webp"), F.col("fault")).when(F.col("pictures") == 0, "no_image_data").otherwise("codec_missing")
    return found.select(key, verdict.alias("verdict"), F.when(F.col("fault") == "truncated", 0).otherwise(F.col("n")).cast("int").alias("n_animation"))


def webp_canvas(files: DataFrame, key: str) -> DataFrame:
    """Of each animated file: canvas size, background (r, g, b, a; clear if there is none), the first frame's place and size,
    and the orientation of its metadata (0: none or not 1 to 8). Damaged files and those without frame or canvas are left out."""
    chunks = riff_chunks(files, key)
    first = lambda name: F.min_by(F.when(F.col("id") == name, F.struct("body", "size")), F.when(F.col("id") == name, F.col("chunk_no")))
    found = chunks.groupBy(key).agg(F.max("fault").alias("fault"), first("VP8X").alias("x"), first("ANIM").alias("b"), first("ANMF").alias("f"))
    found = found.where(F.col("fault").isNull() & (F.col("x.size") >= 10) & (F.col("f.size") >= 24))
    shade = lambda at: F.when(F.col("b.size") >= 4, u_be(F.col("b.body"), at, 1)).otherwise(0).cast("int")
    three = lambda body, at: u_le(F.col(body), at, 3).cast("int")
    sized = found.select(
        key, (three("x.body", 4) + 1).alias("canvas_w"), (three("x.body", 7) + 1).alias("canvas_h"), F.struct(shade(2).alias("r"), shade(1).alias("g"), shade(0).alias("b"), shade(3).alias("a")).alias("background"),
        (three("f.body", 0) * 2).alias("frame_x"), (three("f.body", 3) * 2).alias("frame_y"), (three("f.body", 6) + 1).alias("frame_w"), (three("f.body", 9) + 1).alias("frame_h"),
    )
    body = F.when(F.substring("body", 1, 4) == F.lit(b"Exif"), F.expr("substring(body, 7)")).otherwise(F.col("body"))
    metadata = chunks.where((F.col("id") == "EXIF") & F.col("chunk_no").isNotNull()).groupBy(key).agg(F.min_by(body, "chunk_no").alias("content"))
    value = F.element_at("values", 1)
    turned = directories(metadata, key, follow={}).where((F.col("directory_no") == 0) & (F.col("tag") == 274)).groupBy(key).agg(F.min_by(value, "entry_no").alias("o"))
    return sized.join(turned, key, "left").select(sized.columns + [F.when(F.col("o").between(1, 8), F.col("o")).otherwise(0).cast("int").alias("orientation")])


def on_canvas(canvases: DataFrame, pixels: DataFrame, key: str) -> DataFrame:
    """Pixels (key, x, y, r, g, b, a) of each canvas: the frame's own, moved to its place, and the background elsewhere.

    canvases: what webp_canvas gives; pixels: key, x, y, r, g, b, a of the frames. Frames that reach over the canvas have no
    pixels (the file is damaged), nor have canvases above the limit. Only frames' pixels are joined; the background comes
    from the canvas's own lines, as rows of rows."""
    c = F.col
    inside = (c("frame_x") + c("frame_w") <= c("canvas_w")) & (c("frame_y") + c("frame_h") <= c("canvas_h")) & ranking.size_fits(c("canvas_w"), c("canvas_h"))
    fine = canvases.where(inside)
    moved = pixels.join(fine.select(key, "frame_x", "frame_y", "frame_w", "frame_h"), key).where((c("x") < c("frame_w")) & (c("y") < c("frame_h")))
    moved = moved.select(key, (c("x") + c("frame_x")).alias("x"), (c("y") + c("frame_y")).alias("y"), "r", "g", "b", "a")
    outside = lambda v, start, size: ~v.between(c(start), c(start) + c(size) - 1)
    lines = fine.select("*", F.explode(F.sequence(F.lit(0), c("canvas_h") - 1)).alias("y"))
    rest = lines.select("*", F.explode(F.sequence(F.lit(0), c("canvas_w") - 1)).alias("x")).where(outside(c("x"), "frame_x", "frame_w") | outside(c("y"), "frame_y", "frame_h"))
    return moved.unionByName(rest.select(key, "x", "y", "background.r", "background.g", "background.b", "background.a"))


# ---- TIFF


def _directory_entries(data, follow: dict[int, int], most_values: int | None):
    """(directory_no, at, entry_no, tag, values, length) of the entries of all directories of a TIFF file's bytes."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None:
        return
    end = len(data)
    short, long = struct.Struct(order + "H"), struct.Struct(order + "I")
    u16 = lambda o: short.unpack_from(data, o)[0] if o + 2 <= end else 0
    u32 = lambda o: long.unpack_from(data, o)[0] if o + 4 <= end else 0
    u8 = lambda o: data[o] if o < end else 0
    queue, seen, n = deque([u32(4)]), set(), 0
    for _ in range(MOST_DIRECTORIES):
        if not queue:
            return
        at = queue.popleft()
        if not at or at in seen:
            continue
        seen.add(at)
        entries = u16(at)
        tail = at + 2 + 12 * entries
        if not 0 < entries <= MOST_ENTRIES or tail > end:
            continue
        if u32(tail):
            queue.append(u32(tail))
        subs: dict[int, list[int]] = {}
        for i in range(entries):
            p = at + 2 + 12 * i
            tag, size, count = u16(p), TYPE_BYTES.get(u16(p + 2), 0), u32(p + 4)
            values: list[int] = []
            if size and 0 < count <= (end // size if most_values is None else most_values):
                start = p + 8 if size * count <= 4 else u32(p + 8)
                read = {1: u8, 2: u16}.get(size, u32)
                values = [read(start + size * j) for j in range(count)]
            subs.setdefault(tag, values)
            yield n, at, i, tag, values, end
        for tag, most in follow.items():
            found = subs.get(tag, [])[:most]
            queue.extend(found if most > 1 else [v for v in found if v])
        n += 1


def directories(files: DataFrame, key: str, follow: dict[int, int] | None = None, most_values: int | None = MOST_VALUES) -> DataFrame:
    """key, directory_no, at, entry_no, tag, values, length. A row per entry of each directory that can be reached, breadth
    first: from a directory to the next of its chain, then to those that the tags of `follow` (tag: how many) name. A
    directory is read once, so cycles end; MOST_DIRECTORIES bounds how many leave the queue. Values beyond the file are 0;
    without most_values an entry may have as many as the file has room for."""
    follow = SUB_DIRECTORIES if follow is None else follow

    return walked(files, key, lambda data: _directory_entries(data, follow, most_values), "directory_no int, at long, entry_no int, tag int, values array<bigint>, length long")


def tags(entries: DataFrame, key: str, named: dict[str, int]) -> DataFrame:
    """A row per directory with the values of its tags by name, null where it has none; the first entry of a tag counts."""
    first = lambda tag: F.min_by(F.when(F.col("tag") == tag, F.col("values")), F.when(F.col("tag") == tag, F.col("entry_no")))
    kept = entries.where(F.col("tag").isin(*named.values()) | (F.col("entry_no") == 0))
    return kept.groupBy(key, "directory_no", "at", "length").agg(*(first(t).alias(name) for name, t in named.items()))


#: Tags of a page, by what they are called here; of those in WHOLE_TAGS all values are read, of the others the first.
PAGE_TAGS = {"subfile": 254, "width": 256, "height": 257, "depths": 258, "compression": 259, "photometric": 262, "strips": 273, "orientation": 274, "samples": 277, "strip_bytes": 279, "planar": 284, "predictor": 317, "palette": 320, "tile_width": 322, "tiles": 324, "tile_bytes": 325}
WHOLE_TAGS = ("depths", "strips", "strip_bytes", "tiles", "tile_bytes")
#: Fixed value: more than any entry's number of values.
MOST_COUNT = 1 << 32
#: Bytes of files that are walked side by side (a file at least), and for how many steps; entries that are read side by side.
SIDE_BY_SIDE_BYTES, SIDE_BY_SIDE_STEPS, SIDE_BY_SIDE_ENTRIES = 4 << 20, 64, 1 << 18


def portions(sizes: np.ndarray, most: int):
    """Slices of neighbours whose sizes add up to `most` at most, or of one that is larger."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def at_any_byte(data: np.ndarray, kind) -> np.ndarray:
    """The same bytes as numbers or records of a kind, one from each byte on."""
    kind = np.dtype(kind)
    return np.ndarray(max(len(data) - kind.itemsize + 1, 0), kind, data, 0, (1,))


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _read(data: np.ndarray, kind: str, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers at these places, 0 where one ends behind its file."""
    held = at_any_byte(data, kind)
    inside = at + held.itemsize <= end
    if inside.all():
        return held[at].astype(np.int64)
    return np.where(inside, held[np.where(inside, at, 0)], 0).astype(np.int64)


def _chains(data: np.ndarray, order: str, start: np.ndarray, end: np.ndarray):
    """(file, number, place in the file, entries) of the directories of files of a byte order, by file and number. All
    files go a step together, from a directory to the next; what is left of long chains is walked file by file. A directory
    is read once, and those of a file have no more bytes than the file, as only damaged ones overlap."""
    file, room, found = np.arange(len(start)), end - start, []
    at, seen = _read(data, order + "u4", start + 4, end), np.zeros((len(start), 0), np.int64)
    for n in range(SIDE_BY_SIDE_STEPS):
        entries = _read(data, order + "u2", start + at, end)
        tail = start + at + 2 + 12 * entries
        room = room - 2 - 12 * entries
        there = (at != 0) & ~(seen == at[:, None]).any(axis=1) & (entries > 0) & (entries <= MOST_ENTRIES) & (tail <= end) & (room >= 0)
        file, start, end, at, tail, seen, room = file[there], start[there], end[there], at[there], tail[there], np.column_stack([seen[there], at[there]]), room[there]
        found.append((file, np.full(len(file), n), at, entries[there]))
        if not len(file):
            break
        at = _read(data, order + "u4", tail, end)
    for i in np.flatnonzero(at) if len(file) else ():
        rest = _rest_of_chain(data, order, int(start[i]), int(end[i]), int(at[i]), set(seen[i].tolist()), int(room[i]))
        if rest:
            found.append((np.full(len(rest), file[i]), SIDE_BY_SIDE_STEPS + np.arange(len(rest)), *np.array(rest).T))
    parts = [np.concatenate(p) for p in zip(*found, strict=True)]
    sort = np.argsort(parts[0], kind="stable")
    return [p[sort] for p in parts]


def _rest_of_chain(data: np.ndarray, order: str, start: int, end: int, at: int, seen: set[int], room: int) -> list[tuple[int, int]]:
    """(place in the file, entries) of a file's directories from a place on, apart from those that were seen."""
    short, long, found = struct.Struct(order + "H"), struct.Struct(order + "I"), []
    while at and at not in seen and start + at + 2 <= end:
        (entries,) = short.unpack_from(data, start + at)
        tail = start + at + 2 + 12 * entries
        room -= 2 + 12 * entries
        if not 0 < entries <= MOST_ENTRIES or tail > end or room < 0:
            break
        seen.add(at)
        found.append((at, entries))
        at = long.unpack_from(data, tail)[0] if tail + 4 <= end else 0
    return found


def _tag_values(data: np.ndarray, order: str, start: np.ndarray, end: np.ndarray, at: np.ndarray, entries: np.ndarray, named: dict[str, int], whole: tuple[str, ...]):
    """An Arrow array per tag of what it has in each of these directories (file's start and end, place, entries)."""
    column = np.full(1 << 16, len(named))
    column[list(named.values())] = np.arange(len(named))
    directory = np.repeat(np.arange(len(at)), entries)
    place = np.repeat(start + at + 2, entries) + 12 * _counted(entries)
    record = np.dtype([("tag", order + "u2"), ("kind", order + "u2"), ("count", order + "u4"), ("value", order + "u4")])
    held = at_any_byte(data, f"V{record.itemsize}")[place].view(record)
    slot = column[held["tag"]] * len(at) + directory
    first = np.full((len(named) + 1) * len(at), -1)
    first[slot[::-1]] = np.arange(len(slot))[::-1]  # backwards, so that the first entry of a tag stays
    first = first[: len(named) * len(at)]
    present = first >= 0
    used = first[present]
    held, place, directory = held.view(f"V{record.itemsize}")[used].view(record), place[used], directory[used]
    size, count = np.array([TYPE_BYTES.get(k, 0) for k in range(max(TYPE_BYTES) + 2)])[np.minimum(held["kind"], max(TYPE_BYTES) + 1)], held["count"].astype(np.int64)
    most = np.repeat(np.where(np.isin(list(named), whole), MOST_COUNT, 1), present.reshape(len(named), len(at)).sum(axis=1))
    n = np.where((size > 0) & (size * count <= (end - start)[directory]), np.minimum(count, most), 0)
    origin, end = np.where(size * count <= 4, place + 8, start[directory] + held["value"]), end[directory]
    if (n != 1).any():
        size, origin, end = np.repeat(size, n), np.repeat(origin, n), np.repeat(end, n)
        origin = origin + size * _counted(n)
    values = np.zeros(len(size), np.int64)
    for some, kind in ((size == 1, "u1"), (size == 2, order + "u2"), (size >= 4, order + "u4")):
        values[some] = _read(data, kind, origin[some], end[some])
    sizes = np.zeros(len(first), np.int64)
    sizes[present] = n
    ends, found = np.concatenate([[0], np.cumsum(sizes)]), []
    for i, name in enumerate(named):
        of = slice(i * len(at), (i + 1) * len(at))
        edges, none = ends[of.start : of.stop + 1], ~present[of]
        if name in whole:
            found.append(pa.ListArray.from_arrays(pa.array((edges - edges[0]).astype(np.int32), mask=np.append(none, False)), pa.array(values[edges[0] : edges[-1]])))
        else:
            one = np.full(len(at), -1)
            one[sizes[of] == 1] = values[edges[0] : edges[-1]]
            found.append(pa.array(one, mask=none))
    return found


def directory_chains(files: DataFrame, key: str, named: dict[str, int], whole: tuple[str, ...] = ()) -> DataFrame:
    """key, length, directories: a row per TIFF file with all directories of its chain: number, place, and what the named tags
    have, null where there is none. Of those in `whole` these are all values, as `tags` of `directories` gives them, of the
    others the first (-1 if an entry has none that can be read). Files of a batch are walked side by side, so a step is a
    few array operations for all of them."""
    element = "struct<directory_no: int, at: bigint, " + ", ".join(f"{name}: {'array<bigint>' if name in whole else 'bigint'}" for name in named) + ">"
    out = StructType([files.schema[key], *StructType.fromDDL(f"length bigint, directories array<{element}>")])
    arrow = to_arrow_schema(out)
    listed = arrow.field("directories").type

    def walked_together(keys, data, order, start, end):
        file, n, at, entries = _chains(data, order, start, end)
        found = [_tag_values(data, order, start[file[of]], end[file[of]], at[of], entries[of], named, whole) for of in portions(entries, SIDE_BY_SIDE_ENTRIES)]
        columns = [pa.array(n.astype(np.int32)), pa.array(at), *[pa.concat_arrays(c) for c in zip(*found, strict=True)]]
        if found:
            inside = pa.StructArray.from_arrays([c.cast(t.type) for c, t in zip(columns, listed.value_type, strict=True)], fields=list(listed.value_type))
            edges = np.searchsorted(file, np.arange(len(start) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([keys, pa.array(end - start), pa.ListArray.from_arrays(pa.array(edges), inside, type=listed)], schema=arrow)

    def run(batches):
        for batch in batches:
            content = batch.column(1).cast(pa.large_binary())
            edges = np.frombuffer(content.buffers()[1], np.int64)[content.offset : content.offset + len(content) + 1]
            data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
            rows = np.flatnonzero(content.is_valid().to_numpy(zero_copy_only=False) & (np.diff(edges) >= 8))
            mark = at_any_byte(data, "S2")[edges[rows]]
            for sign, order in ((b"II", "<"), (b"MM", ">")):
                some = rows[mark == sign]
                for of in portions(edges[some + 1] - edges[some], SIDE_BY_SIDE_BYTES):
                    yield from walked_together(batch.column(0).take(pa.array(some[of])), data, order, edges[some[of]], edges[some[of] + 1])

    return files.select(key, "content").mapInArrow(run, out)


def tiff_pages(files: DataFrame, key: str) -> DataFrame:
    """key, directory_no, at, width, height, orientation, thumbnail, verdict, label: the pages of TIFF files, of each whether
    it can be read, and "page i of n". Directories without size or data are no pages; small previews are left out unless a
    file has nothing else. A file's pages are chosen and numbered in its row, so nothing is shuffled."""
    c, first = F.col, lambda name: F.when(F.col(name) >= 0, F.col(name))
    some = lambda name, other: F.coalesce(first(name), F.lit(other))
    small = lambda subfile: F.coalesce((subfile >= 0) & (subfile.bitwiseAND(1) == 1), F.lit(False))
    pages = directory_chains(files, key, PAGE_TAGS, WHOLE_TAGS).select(key, "length", F.filter("directories", lambda d: verdicts.tiff_page(d["width"], d["height"], d["strips"], d["tiles"])).alias("pages"))
    large = pages.select(key, "length", "pages", F.filter("pages", lambda d: ~small(d["subfile"])).alias("large"))
    shown = large.select(key, "length", F.when(F.size("large") > 0, c("large")).otherwise(c("pages")).alias("pages")).withColumn("_n", F.size("pages"))
    # the outer form, as Spark puts a filter before the other one that chooses the pages once more
    each = shown.select(key, "length", "_n", F.posexplode_outer("pages").alias("_i", "_d")).where("_i IS NOT NULL").select(key, "length", "_n", "_i", "_d.*")
    offsets, counts = F.coalesce("strips", "tiles"), F.coalesce("strip_bytes", "tile_bytes")
    tagged = each.select(
        key, "directory_no", "at", first("width").alias("width"), first("height").alias("height"), F.coalesce(first("orientation").try_cast("int"), F.lit(1)).alias("orientation"), small(c("subfile")).alias("thumbnail"),
        some("photometric", 2).alias("photometric"), F.coalesce(F.get("depths", 0), F.lit(1)).alias("bps"), F.when(c("depths").isNotNull(), F.size("depths")).otherwise(some("samples", 1)).alias("samples"), some("compression", 1).alias("compression"),
        verdicts.tiff_truncated(offsets, F.when(counts.isNotNull(), F.slice(counts, 1, F.size(offsets))), c("length")).alias("truncated"), some("planar", 1).alias("planar"), c("tile_width").isNotNull().alias("tiled"), some("predictor", 1).alias("predictor"),
        F.coalesce(c("samples").isNotNull() & c("depths").isNotNull() & (F.size("depths") != some("samples", 1)), F.lit(False)).alias("uneven"), c("palette").isNotNull().alias("palette"),
        F.when(c("_n") > 1, F.concat(F.lit("page "), (c("_i") + 1).cast("string"), F.lit(" of "), c("_n").cast("string"))).alias("label"),
    )
    judged = tagged.withColumn("verdict", verdicts.tiff_verdict())
    return judged.select(key, "directory_no", "at", "width", "height", "orientation", "thumbnail", "verdict", verdicts.second_opinion(c("verdict")).alias("second_opinion"), "label")


def raw_candidates(files: DataFrame, key: str) -> DataFrame:
    """key, found_no, start, source: where the directories of a RAW file say that previews begin (the tag of a preview, or the
    one strip of a directory that is a stream), in the order found; of equal places the first counts."""
    held = tags(directories(files, key), key, {"preview": 513, "compression": 259, "strips": 273})
    value = lambda name: F.coalesce(F.element_at(name, 1), F.lit(0))
    strip = F.when(value("compression").isin(*STREAM_COMPRESSIONS) & (F.size("strips") == 1), value("strips"))
    both = F.array(F.struct(F.when(value("preview") != 0, value("preview")).alias("start"), F.lit("preview").alias("source")), F.struct(strip.alias("start"), F.lit("strip").alias("source")))
    rows = held.select(key, "directory_no", F.posexplode(both).alias("part", "c")).select(key, "directory_no", "part", "c.*").where(F.col("start").isNotNull())
    first = rows.groupBy(key, "start").agg(F.min(F.struct("directory_no", "part", "source")).alias("f"))
    order = Window.partitionBy(key).orderBy("f.directory_no", "f.part")
    return first.select(key, (F.row_number().over(order) - 1).alias("found_no"), "start", "f.source")


# ---- JPEG streams


def _orientation(data) -> int:
    """What the first directory of an Exif block says, 1 to 8, or 0."""
    if bytes(data[:6]) != b"Exif\0\0":
        return 0
    values = next((v for n, _, _, tag, v, _ in _directory_entries(data[6:], {}, MOST_VALUES) if n == 0 and tag == 274), [])
    return values[0] if values and 1 <= values[0] <= 8 else 0


def jpeg_stream(data, start: int):
    """(end, width, height, orientation) of the stream that begins at a place, or None if its chain of segments breaks, its size
    is none or too small, or it has no end. What follows the first scan's head is not read but for the end mark."""
    at, width, height, turned, limit = start + 2, 0, 0, 0, len(data)
    if start < 0 or start + 4 > limit or data[start] != 0xFF or data[start + 1] != 0xD8:
        return None
    while at + 3 < limit:
        if data[at] != 0xFF:
            return None
        while data[at + 1] == 0xFF and at + 3 < limit:  # fill bytes
            at += 1
        mark, at = data[at + 1], at + 2
        if mark in (0xD8, 0xD9):
            return None
        if mark in STANDING_ALONE:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > limit or (mark in FRAME_HEADS and size < 8):
            return None
        if mark in FRAME_HEADS:
            height, width = int.from_bytes(data[at + 3 : at + 5], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        elif mark == 0xE1 and not turned:
            turned = _orientation(data[at + 2 : at + size])
        at += size
        if mark == 0xDA:
            end = _END_MARK.search(data, at) if min(width, height) >= ranking.LEAST_EDGE else None
            return (end.end(), width, height, turned) if end else None
    return None


def jpeg_streams(files: DataFrame, key: str) -> DataFrame:
    """key, found_no, start, end, width, height, orientation: the JPEG streams in files of any kind, from the first on, none of
    which overlaps the one before (so the thumbnail inside a stream isn't one); MOST_STREAMS of a file at most."""

    def walk(data):
        n, found = 0, _START_MARK.search(data)
        while found and n < MOST_STREAMS:
            stream = jpeg_stream(data, found.start())
            if stream:
                yield n, found.start(), *stream
                n += 1
            found = _START_MARK.search(data, stream[0] if stream else found.end())

    return walked(files, key, walk, "found_no int, start long, end long, width int, height int, orientation int")


#: Boxes of a RAW file that are gone into, and those whose bytes are searched for streams.
RAW_HOLDERS = {"moov": 0, "uuid": 16, "trak": 0, "mdia": 0, "minf": 0, "stbl": 0, "udta": 0, "CMT1": 0}
RAW_STREAMS = ("PRVW", "THMB", "mdat")
RAW_DEPTH = 6


def _boxes(data, at: int, end: int):
    """(type, first byte, end) of the boxes of one level; it ends at a size that can't be."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield str(data[at + 4 : at + 8], "latin1"), at + head, at + size
        at += size


def _places(data):
    """(source, start, end) where a RAW file says that previews are: a start alone is a stream's, both are searched. Last the
    whole file."""
    if bytes(data[:8]) == b"FUJIFILM":
        if len(data) >= 92:
            yield "header", int.from_bytes(data[84:88], "big"), None
    elif bytes(data[4:8]) == b"ftyp":
        levels = [(0, _boxes(data, 0, len(data)))]
        while levels:
            depth, level = levels[-1]
            kind, start, end = next(level, (None, 0, 0))
            if kind is None:
                levels.pop()
            elif kind in RAW_STREAMS:
                yield kind, start, end
            elif kind in RAW_HOLDERS and depth < RAW_DEPTH:
                levels.append((depth + 1, _boxes(data, start + RAW_HOLDERS[kind], end)))
    else:
        held: dict[int, dict[int, list[int]]] = {}
        for n, _, _, tag, values, _ in _directory_entries(data, SUB_DIRECTORIES, MOST_VALUES):
            held.setdefault(n, {}).setdefault(tag, values)
        for tagged in held.values():
            if any(preview := tagged.get(513, [])[:1]):
                yield "preview", preview[0], None
            if tagged.get(259, [0])[:1] and tagged.get(259, [0])[0] in STREAM_COMPRESSIONS and len(tagged.get(273, [])) == 1:
                yield "strip", tagged[273][0], None
    yield "scan", 0, len(data)


def raw_streams(files: DataFrame, key: str) -> DataFrame:
    """key, found_no, start, end, width, height, orientation, source: the whole JPEG streams of RAW files, first where a
    container says they are (a header's place, boxes, directories), then by a search of the file; a stream that is found
    again counts once, and MOST_STREAMS of a file at most. `ranking.raw_preview` picks one of them."""

    def walk(data):
        found: dict[int, tuple] = {}

        def offered(start: int, source: str):
            if start not in found and len(found) < MOST_STREAMS and (stream := jpeg_stream(data, start)):
                found[start] = (len(found), start, *stream, source)
            return found.get(start)

        for source, start, end in _places(data):
            if end is None:
                offered(start, source)
                continue
            mark = _START_MARK.search(data, start)
            while mark and mark.start() < end and len(found) < MOST_STREAMS:
                stream = offered(mark.start(), source)
                mark = _START_MARK.search(data, stream[2] if stream else mark.end())
        yield from found.values()

    return walked(files, key, walk, "found_no int, start long, end long, width int, height int, orientation int, source string")


# ---- ISO boxes


def iso_boxes(files: DataFrame, key: str) -> DataFrame:
    """key, box_no, depth, path, first, type, start, end, body. A row per box, those inside behind the one that holds them;
    sizes of 32 and 64 bits and up to the end of what holds the box. first: whether all boxes around are the first of their
    type there. A level ends at a size that can't be."""

    def walk(data):
        number = 0

        def level(at, end, depth, path, first):
            nonlocal number
            seen = set()
            for kind, start, stop in _boxes(data, at, end):
                yield number, depth, f"{path}{kind}", first, kind, start, stop, bytes(data[start:stop]) if kind in KEPT_BODIES else None
                number += 1
                if kind in HOLDERS and depth < MOST_DEPTH:
                    yield from level(start + HOLDERS[kind], stop, depth + 1, f"{path}{kind}/", first and kind not in seen)
                seen.add(kind)

        yield from level(0, len(data), 0, "", True)

    return walked(files, key, walk, "box_no int, depth int, path string, first boolean, type string, start long, end long, body binary")


def _associations(boxes: DataFrame) -> DataFrame:
    """file_id, item, place, index of the entries of bodies of `ipma` boxes (file_id, content)."""

    def walk(data):
        if len(data) < 8:
            return
        wide, large = (4 if data[0] else 2), (2 if data[3] & 1 else 1)
        at, place = 8, 0
        for _ in range(int.from_bytes(data[4:8], "big")):
            if at + wide >= len(data):
                return
            item, count = int.from_bytes(data[at : at + wide], "big"), data[at + wide]
            at += wide + 1
            for _ in range(count):
                if at + large > len(data):
                    return
                place += 1
                yield item, place, int.from_bytes(data[at : at + large], "big") & (0x7FFF if large == 2 else 0x7F)
                at += large

    return walked(boxes, "file_id", walk, "item long, place int, index int")


def heif_orientation(files: DataFrame, key: str) -> DataFrame:
    """key, orientation: how each file's primary item is turned, by the properties that it is given; 1 where the boxes don't
    say or can't be read."""
    boxes = iso_boxes(files, key).withColumnRenamed(key, "file_id").where("first")
    first = lambda path: boxes.where(F.col("path") == path).groupBy("file_id").agg(F.min_by("body", "box_no").alias("content"))
    body = F.col("content")
    item: Column = F.when(u_be(body, 0, 1) < 1, u_be(body, 4, 2)).otherwise(u_be(body, 4, 4))
    primary = first("meta/pitm").select("file_id", item.alias("item")).where("item IS NOT NULL")
    properties = boxes.where((F.col("depth") == 3) & F.col("path").startswith("meta/iprp/ipco/")).select("file_id", F.row_number().over(Window.partitionBy("file_id").orderBy("box_no")).alias("index"), "type", u_be(F.col("body"), 0, 1).cast("int").alias("value"))
    turned = ranking.item_orientation(_associations(first("meta/iprp/ipma")), properties, primary)
    return files.select(F.col(key).alias("file_id")).join(turned, "file_id", "left").select(F.col("file_id").alias(key), F.coalesce("orientation", F.lit(1)).alias("orientation"))
