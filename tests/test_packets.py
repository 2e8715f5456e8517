"""Run-length TGA images against a plain reader."""

import random

import numpy as np
import pytest

from pagewright.operators import decode


def packed(rng, pixels, record):
    """Packets of both kinds, cut at random."""
    out, i = b"", 0
    while i < len(pixels):
        n = min(rng.randrange(1, 129), len(pixels) - i)
        same = 1
        while same < n and pixels[i + same] == pixels[i]:
            same += 1
        if same > 1 or rng.random() < 0.3:
            out, i = out + bytes([127 + same]) + pixels[i], i + same
        else:
            out, i = out + bytes([n - 1]) + b"".join(pixels[i : i + n]), i + n
    return out


def tga(kind, w, h, bits, body, flags=0x20):
    return bytes([0, 0, kind]) + bytes(9) + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([bits, flags]) + body


@pytest.mark.parametrize("window", [7, 1 << 16])
def test_unpacked(monkeypatch, window):
    """Every window size finds the same packets; damaged ones give nothing."""
    monkeypatch.setattr(decode, "PACKET_WINDOW", window)
    rng = random.Random(window)
    for record in (1, 2, 3, 4):
        for _ in range(20):
            w, h = rng.randrange(1, 40), rng.randrange(1, 20)
            colours = [rng.randbytes(record) for _ in range(3)]
            pixels = [rng.choice(colours) if rng.random() < 0.7 else rng.randbytes(record) for _ in range(w * h)]
            body = packed(rng, pixels, record)
            read = lambda b: decode._unpacked(np.frombuffer(b, np.uint8))
            assert read(tga(10, w, h, 8 * record, body + b"tail")) == tga(2, w, h, 8 * record, b"".join(pixels))
            assert read(tga(10, w, h, 8 * record, body[:-1])) is None
            assert read(tga(10, w, h + 1, 8 * record, body)) is None
            assert read(tga(10, w, h, 8 * record, body[: -record - 1] + b"")) is None
    assert decode._unpacked(np.frombuffer(tga(10, 1, 1, 24, b"\x81abc"), np.uint8)) is None  # past the image


def test_runs_to_pixels(spark):
    files = [(1, tga(11, 2, 2, 8, b"\x82\x07\x00\x09")), (2, tga(3, 1, 1, 8, b"\x05")), (3, tga(10, 2, 2, 24, b"\x81")), (4, None), (5, tga(10, 300, 200, 24, b"\xffabc" * 468 + b"\xdfabc"))]
    frame = spark.createDataFrame(files, "k long, content binary")
    got = decode.tga_pixels(decode.without_runs(frame, "k"), "k").collect()
    assert sorted((r.k, r.x, r.y, r.r) for r in got if r.k < 5) == [(1, 0, 0, 7), (1, 0, 1, 7), (1, 1, 0, 7), (1, 1, 1, 9), (2, 0, 0, 5)]
    assert sum(r.k == 5 for r in got) == 60_000 and {(r.r, r.g, r.b) for r in got if r.k == 5} == {(99, 98, 97)}
