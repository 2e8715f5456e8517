"""Containers walked by their bytes, made with faults, circles and large sizes; the cache against a plain one."""

import random
import struct
import time
from collections import OrderedDict, deque

import pytest

from pagewright.operators import cache, containers


def chunk(name, body):
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def riff(body, size=None):
    return b"RIFF" + (len(body) + 4 if size is None else size).to_bytes(4, "little") + b"WEBP" + body


def files(spark, contents):
    return spark.createDataFrame([*enumerate(contents)], "k int, content binary")


def test_riff_chunks(spark):
    body = chunk(b"VP8X", b"0" * 10) + chunk(b"ANMF", b"1") + chunk(b"EXIF", b"e" * 50) + chunk(b"VP8 ", b"22")
    got = containers.riff_chunks(files(spark, [riff(body) + b"tail", riff(body)[:-1], riff(body[:-8] + b"VP8 " + (99).to_bytes(4, "little")), riff(b""), b"RIFF", None]), "k").collect()
    whole = [(r.id, r.start, r.size, len(r.body)) for r in got if r.k == 0 and r.id]
    assert whole == [("VP8X", 20, 10, 10), ("ANMF", 38, 1, 1), ("EXIF", 48, 50, 50), ("VP8 ", 106, 2, 2)]
    assert {r.k: r.fault for r in got if r.chunk_no is None} == {0: None, 1: "truncated", 2: "truncated", 3: "no_chunks", 4: "not_webp"}
    assert [r.id for r in got if r.k == 2 and r.id] == ["VP8X", "ANMF", "EXIF"]


def test_riff_steps_are_chunks(spark):
    """A file of 20 MB with three chunks and one of 100,000 chunks take seconds."""
    large = riff(chunk(b"VP8X", b"0" * 10) + chunk(b"VP8 ", bytes(20 << 20)) + chunk(b"EXIF", b"e"))
    many = riff(chunk(b"VP8X", b"0" * 10) + chunk(b"ANMF", b"12345") * 100_000)
    began = time.time()
    got = {r.k: r["count"] for r in containers.riff_chunks(files(spark, [large, many]), "k").groupBy("k").count().collect()}
    assert got == {0: 4, 1: 100_002} and time.time() - began < 30
    assert [(r.verdict, r.n_animation) for r in containers.webp_verdicts(files(spark, [large, many, many[:-3], b"", None]), "k").orderBy("k").collect()] == [("codec_missing", 0), ("codec_missing", 100_000), ("truncated", 0), ("not_webp", 0), ("not_webp", 0)]


def animated(w, h, x, y, fw, fh, extra=b""):
    three = lambda v: v.to_bytes(3, "little")
    return riff(chunk(b"VP8X", b"\x12\0\0\0" + three(w - 1) + three(h - 1)) + chunk(b"ANIM", bytes([1, 2, 3, 4, 0, 0])) + chunk(b"ANMF", three(x // 2) + three(y // 2) + three(fw - 1) + three(fh - 1) + b"\0" * 4 + chunk(b"VP8 ", b"1234")) + extra)


def test_first_frame_on_its_canvas(spark):
    odd = chunk(b"EXIF", b"Exif\0\0MM\0\x2a\0\0\0\x08\0\x02\x01\0\0\3\0\0\0\1\0\7\0\0\x01\x12\0\3\0\0\0\1\0\6\0\0\0\0\0\0")
    made = files(spark, [animated(4, 3, 2, 0, 2, 2, odd), animated(4, 3, 2, 0, 3, 2), animated(2, 2, 0, 0, 2, 2)[:-2], riff(chunk(b"VP8 ", b"1"))])
    canvases = containers.webp_canvas(made, "k")
    assert [(r.k, r.canvas_w, r.canvas_h, tuple(r.background), r.frame_x, r.frame_w, r.orientation) for r in canvases.orderBy("k").collect()] == [(0, 4, 3, (3, 2, 1, 4), 2, 2, 6), (1, 4, 3, (3, 2, 1, 4), 2, 3, 0)]
    pixels = spark.createDataFrame([(k, x, y, 10 * y + x, 0, 0, 255) for k in (0, 1) for y in range(2) for x in range(2)], "k int, x int, y int, r int, g int, b int, a int")
    got = containers.on_canvas(canvases, pixels, "k").collect()
    assert {(r.k, r.x, r.y): r.r for r in got} == {(0, x, y): 10 * y + x - 2 if x >= 2 and y < 2 else 3 for x in range(4) for y in range(3)} and len(got) == 12


def tiff(order, dirs):
    """dirs: {offset: (entries (tag, kind, values), next)}; long values stand behind their directory."""
    out = bytearray(4000)
    out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, min(dirs))
    for at, (entries, following) in dirs.items():
        spare = at + 2 + 12 * len(entries) + 4
        struct.pack_into(order + "H", out, at, len(entries))
        for i, (tag, kind, values) in enumerate(entries):
            code = {1: "B", 3: "H", 4: "I"}[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                out[spare : spare + len(raw)] = raw
                raw, spare = struct.pack(order + "I", spare), spare + len(raw)
            struct.pack_into(order + "HHI4s", out, at + 2 + 12 * i, tag, kind, len(values), raw)
        struct.pack_into(order + "I", out, at + 2 + 12 * len(entries), following)
    return bytes(out)


@pytest.mark.parametrize("order", "<>")
def test_directories(spark, order):
    """Breadth first, each directory once, circles end; damaged directories have no rows."""
    made = {8: ([(256, 3, [7]), (330, 4, [500, 900, 8]), (330, 4, [700])], 300), 300: ([(34665, 4, [700])], 8), 500: ([(258, 3, [8, 8, 8]), (1, 1, [1, 2, 3])], 300), 700: ([(513, 4, [77])], 0), 900: ([(259, 3, [6])], 3990)}
    got = containers.directories(files(spark, [tiff(order, made), tiff(order, made)[:890], b"nothing", b"", b"II"]), "k").collect()
    rows = lambda k: [(r.directory_no, r.at, r.tag, r["values"]) for r in got if r.k == k]
    first = [(0, 8, 256, [7]), (0, 8, 330, [500, 900, 8]), (0, 8, 330, [700]), (1, 300, 34665, [700]), (2, 500, 258, [8, 8, 8]), (2, 500, 1, [1, 2, 3])]
    assert rows(0) == [*first, (3, 900, 259, [6]), (4, 700, 513, [77])]
    assert rows(1) == [*first, (3, 700, 513, [77])] and not rows(2) + rows(3) + rows(4)


def plain_visits(dirs, start):
    queue, seen, out = deque([start]), set(), []
    for _ in range(containers.MOST_DIRECTORIES):
        if not queue:
            break
        at = queue.popleft()
        if not at or at in seen or at not in dirs:
            seen.add(at)
            continue
        seen.add(at)
        out.append(at)
        entries, following = dirs[at]
        queue.extend([following] if following else [])
        queue.extend(entries[0][2])
    return out


def test_directories_are_bounded(spark):
    """What leaves the queue counts, also when it was seen before."""
    dirs = {8 + 40 * i: ([(330, 4, [8 + 40 * ((i * 3 + d) % 90) for d in (1, 2, 5)])], 8 + 40 * ((i + 1) % 90)) for i in range(90)}
    got = containers.directories(files(spark, [tiff("<", dirs)]), "k").collect()
    assert [r.at for r in got] == plain_visits(dirs, 8) and len(got) < 64


def test_raw_candidates(spark):
    made = {8: ([(259, 3, [6]), (273, 4, [1000]), (513, 4, [2000])], 300), 300: ([(259, 3, [7]), (273, 4, [1, 2])], 500), 500: ([(259, 3, [7]), (273, 4, [2000])], 700), 700: ([(513, 4, [1000]), (513, 4, [5])], 0)}
    assert [(r.found_no, r.start, r.source) for r in containers.raw_candidates(files(spark, [tiff(">", made)]), "k").orderBy("found_no").collect()] == [(0, 2000, "preview"), (1, 1000, "strip")]


def test_tiff_pages(spark):
    grey = lambda subfile, at, n=1: [(254, 4, [subfile]), (256, 4, [4]), (257, 4, [2]), (258, 3, [8] * n), (262, 3, [1]), (273, 4, [at]), (277, 3, [1]), (279, 4, [8])]
    made = tiff("<", {8: (grey(0, 3000), 300), 300: (grey(1, 3000), 600), 600: ([(256, 4, [4])], 900), 900: (grey(0, 3995), 1200), 1200: (grey(0, 3000, 2), 8)})
    got = containers.tiff_pages(files(spark, [made, tiff(">", {8: (grey(1, 0), 0)}), b"MM"]), "k").orderBy("k", "directory_no").collect()
    assert [(r.k, r.at, r.verdict, r.label) for r in got] == [(0, 8, "ok", "page 1 of 3"), (0, 900, "truncated", "page 2 of 3"), (0, 1200, "inconsistent_channels", "page 3 of 3"), (1, 8, "ok", None)]


def damaged_tiff(rng):
    """Chains with gaps, circles, cut ends, unknown kinds, counts and places that can't be."""
    order, size = rng.choice("<>"), rng.choice([0, 5, 8, 9, 300, 3000, 3000, 3000])
    out, at, places = bytearray(size), 8, []
    while at + 30 < size and len(places) < 80:
        n = rng.choice([1, 1, 2, 5, 9, 14, 20] * 4 + [0])
        entries = [(rng.choice([*containers.PAGE_TAGS.values(), 330, 1]), rng.choice([1, 2, 3, 3, 4, 4, 5, 6, 8, 12, 0, 13, 65535]), rng.choice([0, 1, 1, 1, 2, 4, 5, 30, size, 1 << 31, (1 << 32) - 1]), rng.choice([0, 1, 8, size - 3, size, rng.randrange(1 << 32), rng.randrange(size)])) for _ in range(n)]
        places.append(at)
        following = at + 6 + 12 * n + rng.choice([0, 0, 3])
        raw = struct.pack(order + "H", rng.choice([n] * 20 + [600])) + b"".join(struct.pack(order + "HHII", *e) for e in entries) + struct.pack(order + "I", rng.choice([following] * 30 + [0, at, 1 << 31, rng.choice(places)]))
        out[at : at + len(raw)] = raw[: size - at]
        at = following
    if size >= 8:
        out[:8] = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, rng.choice([8] * 15 + [0, 20, size - 2, size, 5000]))
    return bytes(out)


def test_directory_chains(spark, monkeypatch):
    """What a walk of files side by side finds equals a walk of each, also in portions of few bytes, steps and entries."""
    rng = random.Random(5)
    made = files(spark, [None, b"", b"IIII", *[damaged_tiff(rng) for _ in range(600)]]).repartition(3)
    of = containers.tags(containers.directories(made, "k", follow={}, most_values=None), "k", containers.PAGE_TAGS).collect()
    one = lambda name, v: v if name in containers.WHOLE_TAGS or v is None else v[0] if v else -1
    want = {(r.k, r.directory_no, r.at, r.length): [one(name, r[name]) for name in containers.PAGE_TAGS] for r in of}
    assert len(want) > 800
    for sizes in ((4 << 20, 64, 1 << 18), (3000, 2, 40)):
        for name, size in zip(("SIDE_BY_SIDE_BYTES", "SIDE_BY_SIDE_STEPS", "SIDE_BY_SIDE_ENTRIES"), sizes, strict=True):
            monkeypatch.setattr(containers, name, size)
        found = containers.directory_chains(made, "k", containers.PAGE_TAGS, containers.WHOLE_TAGS).collect()
        assert {(r.k, d.directory_no, d.at, r.length): [d[name] for name in containers.PAGE_TAGS] for r in found for d in r.directories} == want


def test_long_chains_are_whole(spark):
    """All pages of a file count, also beyond what is walked side by side; circles and overlapping directories end."""
    page = [(256, 4, [4]), (257, 4, [2]), (273, 4, [8])]
    size = 2 + 12 * len(page) + 4
    straight = {8 + size * i: (page, 8 + size * (i + 1) if i < 89 else 0) for i in range(90)}
    circle = straight | {8 + size * 89: (page, 8 + size * 70)}
    lap = bytearray(tiff("<", {8: ([], 0)}))
    for at in range(8, 1400, 18):  # directories of 200 entries, each a few bytes behind the one before
        struct.pack_into("<H", lap, at, 200)
        struct.pack_into("<I", lap, at + 2 + 12 * 200, at + 18)
    got = containers.tiff_pages(files(spark, [tiff("<", straight), tiff(">", circle)]), "k").collect()
    for k in (0, 1):
        assert sorted((r.directory_no, r.at, r.label) for r in got if r.k == k) == [(i, 8 + size * i, f"page {i + 1} of 90") for i in range(90)]
    assert [len(r.directories) for r in containers.directory_chains(files(spark, [bytes(lap)]), "k", {"width": 256}).collect()] == [1]


def test_tiff_pages_are_not_shuffled(spark):
    """A file's pages are numbered where it was walked; before, entries and pages of all files were shuffled by file."""
    page = [(256, 4, [4]), (257, 4, [2]), (262, 3, [1]), (273, 4, [8])]
    got = containers.tiff_pages(files(spark, [tiff("<", {8: (page, 300), 300: (page, 0)})] * 3), "k")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.directory_no, r.label) for r in got.collect()) == [(k, i, f"page {i + 1} of 2") for k in range(3) for i in range(2)]


def test_tiff_pages_with_damaged_tags(spark):
    """Entries of an unknown kind or without room have no values; before, such a file ended the whole query."""
    raw = bytearray(tiff("<", {8: ([(256, 4, [4]), (257, 4, [2]), (262, 3, [1]), (273, 4, [8]), (274, 4, [1 << 31])], 0)}))
    struct.pack_into("<H", raw, 8 + 2 + 2, 99)
    struct.pack_into("<I", raw, 8 + 2 + 2 * 12 + 4, 1 << 30)
    assert [(r.width, r.height, r.orientation, r.verdict) for r in containers.tiff_pages(files(spark, [bytes(raw)]), "k").collect()] == [(None, 2, 1, "rgb_depth")]


def box(kind, body, form=0):
    if form == 1:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", 0 if form == 2 else len(body) + 8, kind) + body


def heif(items, form=0, wide=False, inside=b"", primary=2):
    props = box(b"irot", b"\1") + box(b"pixi", b"\0") + box(b"imir", b"\0") + box(b"irot", b"\3")
    given = b"".join(struct.pack(">I" if wide else ">H", i) + bytes([len(p)]) + b"".join(bytes([0x80 | x]) for x in p) for i, p in items)
    pitm = box(b"pitm", bytes([wide, 0, 0, 0]) + struct.pack(">I" if wide else ">H", primary))
    meta = b"\0" * 4 + inside + pitm + box(b"pitm", b"\0" * 6) + box(b"iprp", box(b"ipco", props) + box(b"ipma", bytes([wide, 0, 0, 0]) + struct.pack(">I", len(items)) + given))
    return box(b"ftyp", b"heic") + box(b"mdat", box(b"irot", b"\3")) + box(b"meta", meta, form)


def test_heif_orientation(spark):
    """A quarter turn of the primary item alone; the last property counts; damaged files are the right way up."""
    first = heif([(1, [4]), (2, [1])])
    contents = [first, heif([(2, [1, 4])], 1), heif([(2, [1, 3, 2, 9])], 2, True), heif([(1, [1])]), first[: len(first) - 4], b"", None, heif([(2, [1])], inside=struct.pack(">I4s", 7, b"free")), first + box(b"meta", b"\0" * 4), box(b"meta", b"\0" * 4) + first]
    got = {r.k: r.orientation for r in containers.heif_orientation(files(spark, contents), "k").collect()}
    assert got == {0: 8, 1: 6, 2: 5, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 1}
    tree = [(r.path, r.depth) for r in containers.iso_boxes(files(spark, [first]), "k").orderBy("box_no").collect()]
    assert tree[:4] == [("ftyp", 0), ("mdat", 0), ("meta", 0), ("meta/pitm", 1)] and ("meta/iprp/ipco/imir", 3) in tree


def plain_hits(requests, entries):
    held, out = OrderedDict(), {}
    for number, key, _ in sorted(requests, key=lambda r: (r[2], r[0])):
        out[number] = key is not None and key in held
        if key is not None:
            held[key] = 1
            held.move_to_end(key)
            if len(held) > entries:
                held.popitem(last=False)
    return out


@pytest.mark.parametrize("entries, range_rows", [(3, 7), (20, 40), (20, 1000), (1, 5), (200, 30)])
def test_cache_hits(spark, entries, range_rows):
    """Ranges far smaller than the cache and far larger; a hot key, missing files, equal times."""
    rng = random.Random(entries)
    requests = [(i, rng.choice([None, "hot", "hot", f"k{rng.randrange(40)}"]), rng.randrange(100)) for i in range(400)]
    got = cache.hits(spark.createDataFrame(requests, "n long, key string, ts int").repartition(3), "n", entries, range_rows).collect()
    assert {r.n: r.hit for r in got} == plain_hits(requests, entries) and len(got) == 400


def test_cache_hits_of_none(spark):
    assert cache.hits(spark.createDataFrame([], "n long, key string, ts int"), "n").collect() == []


def jpeg(w=16, h=16, before=b"", scan=b"\xff\xda\0\3\1", data=b"\xaa\xff\0\xbb", end=b"\xff\xd9"):
    return b"\xff\xd8" + before + b"\xff\xc0\0\x0a\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\1\1\1" + scan + data + end


def test_jpeg_streams(spark):
    """From the first whole stream on, none inside another; broken, small, endless and restarted ones are passed over."""
    segment = lambda mark, body: b"\xff" + mark + (len(body) + 2).to_bytes(2, "big") + body
    exif = b"Exif\0\0" + tiff("<", {8: ([(274, 3, [6])], 0)})[:40]
    whole = [jpeg(), jpeg(20, 30, segment(b"\xe1", exif + jpeg())), jpeg(9, 8, b"\xff\xff\xff\x01" + segment(b"\xe1", b"none"))]
    broken = [jpeg(7), b"\xff\xd8\xff\xe0\0\4\0\0\x12", b"\xff\xd8\xff\xd9", b"\xff\xd8\xff\xc0\0\4\0\0", b"\xff\xd8\xff\xe1\0\1", b"text\xff\xd8\xff"]
    content = b"x".join([broken[0], whole[0], *broken[1:4], whole[1], broken[4], whole[2], broken[5]])
    got = [(r.found_no, content[r.start : r.end], r.width, r.height, r.orientation) for r in containers.jpeg_streams(files(spark, [content]), "k").orderBy("found_no").collect()]
    assert got == [(0, whole[0], 16, 16, 0), (1, whole[1], 20, 30, 6), (2, whole[2], 9, 8, 0)]
    odd = [None, b"", b"\xff\xd8\xff", jpeg(end=b""), jpeg() * 70, jpeg(end=b"") + jpeg()]
    got = containers.jpeg_streams(files(spark, odd), "k").collect()
    assert {k: sum(r.k == k for r in got) for k in range(6)} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 64, 5: 1}
    assert next((r.start, r.end) for r in got if r.k == 5) == (0, len(odd[5]))  # its end is the next one there is


def test_bytes_above_127(spark):
    made = tiff("<", {8: ([(1, 1, [200, 255, 128, 7]), (254, 1, [250] * 6)], 0)})
    got = containers.directories(files(spark, [made]), "k").orderBy("entry_no").collect()
    assert [r["values"] for r in got] == [[200, 255, 128, 7], [250] * 6]


def test_raw_streams(spark):
    """What a container says comes first, in its order; the search adds what it can't reach; damaged places are passed over."""
    a, b, c = jpeg(20, 20), jpeg(30, 30), jpeg(40, 40)
    raf = b"FUJIFILM" + bytes(76) + (92 + len(a)).to_bytes(4, "big") + bytes(4) + a + b
    deep = box(b"PRVW", b"head" + b)
    for _ in range(3):
        deep = box(b"udta", deep)
    cr3 = box(b"ftyp", b"crx ") + box(b"moov", box(b"uuid", bytes(16) + deep + box(b"THMB", b"none")) + box(b"free", a)) + box(b"mdat", b"xx" + c, 2)
    directory = {8: ([(513, 4, [2000]), (259, 3, [6]), (273, 4, [1500])], 100), 100: ([(513, 4, [3])], 0)}
    raw = bytearray(tiff("<", directory))
    raw[2000 : 2000 + len(a)], raw[1500 : 1500 + len(b)], raw[3000 : 3000 + len(c)] = a, b, c
    torn = box(b"ftyp", b"crx ") + struct.pack(">I4s", 9999, b"moov") + a
    got = containers.raw_streams(files(spark, [raf, cr3, bytes(raw), torn, b"text" + a + b, b"FUJIFILM", b"", None]), "k").orderBy("k", "found_no").collect()
    assert [(r.k, r.found_no, r.width, r.source) for r in got] == [(0, 0, 30, "header"), (0, 1, 20, "scan"), (1, 0, 30, "PRVW"), (1, 1, 40, "mdat"), (1, 2, 20, "scan"), (2, 0, 20, "preview"), (2, 1, 30, "strip"), (2, 2, 40, "scan"), (3, 0, 20, "scan"), (4, 0, 20, "scan"), (4, 1, 30, "scan")]
