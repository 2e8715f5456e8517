"""Icon bitmaps against a plain reader, with faults."""

import random
import struct

from pagewright.operators import decode


def picture(rng, bits, w, h, masked, colours=None, alpha=None, top_down=False):
    """(bytes, pixels by x and y) of a bitmap inside an icon."""
    n = colours or (1 << bits if bits <= 8 else 0)
    palette = [tuple(rng.randrange(256) for _ in range(3)) for _ in range(n)] if bits <= 8 else []
    px = [[(rng.randrange(n) if n else tuple(rng.randrange(256) for _ in range(3))) for _ in range(w)] for _ in range(h)]
    alphas = [[alpha if alpha is not None else rng.randrange(256) for _ in range(w)] for _ in range(h)]
    hidden = [[rng.random() < 0.4 for _ in range(w)] for _ in range(h)]

    def line(y):
        if bits >= 24:
            raw = b"".join(bytes(px[y][x][::-1]) + (bytes([alphas[y][x]]) if bits == 32 else b"") for x in range(w))
        else:
            text = "".join(f"{px[y][x]:0{bits}b}" for x in range(w))
            raw = int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")
        return raw.ljust((w * bits + 31) // 32 * 4, b"\0")

    mask_line = lambda y: int("".join(str(int(v)) for v in hidden[y]).ljust((w + 31) // 32 * 32, "0"), 2).to_bytes((w + 31) // 32 * 4, "big")
    order = range(h) if top_down else range(h - 1, -1, -1)
    stored = -h if top_down else h * 2 if masked is not None else h
    head = struct.pack("<IiiHHII8xII", 40, w, stored, 1, bits, 0, 0, colours or 0, 0)
    raw = head + b"".join(bytes(c[::-1]) + b"\0" for c in palette) + b"".join(map(line, order)) + (b"".join(map(mask_line, order)) if masked else b"")
    own = bits == 32 and any(a for r in alphas for a in r) and any(a < 255 for r in alphas for a in r)
    colour = lambda x, y: palette[px[y][x]] if n else px[y][x]
    return raw, {(x, y): (*colour(x, y), alphas[y][x] if own else 0 if masked and hidden[y][x] else 255) for x in range(w) for y in range(h)}


def icon(pictures, kind=1):
    """pictures: (w, h, bits, bytes, offset or None)."""
    at, head, body = 6 + 16 * len(pictures), struct.pack("<HHH", 0, kind, len(pictures)), b""
    for w, h, bits, raw, offset in pictures:
        head += struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, 1, bits, len(raw), at + len(body) if offset is None else offset)
        body += raw
    return head + body


def test_icon_pixels(spark):
    rng = random.Random(3)
    files, want = [], {}
    for bits in (1, 4, 8, 24, 32):
        for masked, top in ((True, False), (False, False), (None, True)):
            w, h = rng.randrange(2, 40), rng.randrange(2, 12)
            raw, px = picture(rng, bits, w, h, masked, top_down=top)
            want[len(files)] = px
            files.append(icon([(1, 1, 8, b"x" * 50, None), (w, h, bits, raw, None), (200, 200, 32, b"y", 1 << 20)]))
    for alpha in (0, 255, 7):  # a channel that says nothing, and one that does
        raw, px = picture(rng, 32, 9, 3, True, alpha=alpha)
        want[len(files)] = px
        files.append(icon([(9, 3, 32, raw, None)], 2))
    raw, px = picture(rng, 8, 5, 4, True, colours=7)
    want[len(files)] = px
    files.append(icon([(5, 4, 8, raw, None)]))
    ok = len(files)
    bad = picture(rng, 8, 5, 4, True, colours=7)[0]
    at = 40 + 28 + 2
    files += [icon([(5, 4, 8, bad[:at] + b"\x07" + bad[at + 1 :], None)]), icon([(5, 4, 8, bad[:60], None)]), icon([(5, 4, 8, bad[:16] + b"\1" + bad[17:], None)]), icon([(5, 4, 24, decode.PNG_MARK + b"z" * 60, None)]), b"\0\0\1\0", b"\0\0\1\0\0\0" + b"\0" * 40, None, icon([(9, 9, 8, bad, 5)])]
    frame = spark.createDataFrame([*enumerate(files)], "k int, content binary")
    got = {}
    for r in decode.icon_pixels(frame, "k").collect():
        got.setdefault(r.k, {})[r.x, r.y] = (r.r, r.g, r.b, r.a)
    assert {k for k in range(len(files)) if got.get(k) != want.get(k)} == set() and len(want) == ok
    assert [r.k for r in decode.icon_images(frame, "k").where("png").collect()] == [ok + 3]


def test_the_best_picture(spark):
    """Area, then depth (not of cursors), then place."""
    rng = random.Random(4)
    a, b = picture(rng, 24, 4, 4, True), picture(rng, 32, 4, 4, True)
    pictures = [(4, 4, 8, a[0], None), (4, 4, 32, b[0], None), (2, 2, 32, b"z" * 99, None)]
    frame = spark.createDataFrame([(0, icon(pictures)), (1, icon(pictures, 2)), (2, icon(pictures[:1] * 2))], "k int, content binary")
    assert {r.k: bytes(r.image) for r in decode.icon_images(frame, "k").collect()} == {0: b[0], 1: a[0], 2: a[0]}
