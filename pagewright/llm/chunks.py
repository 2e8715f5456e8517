"""Texts cut into chunks that a byte-level tokenizer's pattern never matches across, each distinct chunk encoded once.

A match of the pattern that both byte-level tokenizers use holds letters, digits or signs with one space before them
at most, or white space alone, or an apostrophe and letters. So it never goes on from another character into white
space, nor between letters, digits and signs but behind an apostrophe. A text is cut at such places among its ASCII
characters; chunks are encoded by themselves and joined again. Cutting, finding the
distinct chunks and joining their results run on whole blocks in numpy and Arrow, not by row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textnum import _SPACE

#: Chunks above this many bytes are encoded where they occur, but not kept.
LONGEST_KEPT = 64
#: Bytes that a worker keeps of chunks and their results, with what Python needs to hold them.
KEPT_BYTES = 160 << 20
_ENTRY_BYTES = 200
#: The last two or three UTF-8 bytes of white space beyond ASCII.
_WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", *[bytes([0xE2, 0x80, b]) for b in (*range(0x80, 0x8C), 0xA8, 0xA9, 0xAF)], b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_WIDE_CODES = np.array(sorted(int.from_bytes(b, "big") for b in _WIDE_SPACES), np.int64)
_ODD, _SPACES, _LETTER, _DIGIT, _SIGN, _WIDE = range(6)  # odd: control characters, never next to a cut
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[:33] = _ODD
_KIND[127] = _ODD
_KIND[_SPACE] = _SPACES
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _WIDE
#: By 6 * kind before + kind here: white space behind anything else, or a change between letters, digits and signs.
_CUT = np.array([a not in (_ODD, _SPACES) if b == _SPACES else a != b and {a, b} <= {_LETTER, _DIGIT, _SIGN} for a in range(6) for b in range(6)])


def cuts(data: np.ndarray, offs: np.ndarray, whole: np.ndarray | None = None) -> np.ndarray:
    """Ascending places where chunks begin and the end; rows begin chunks. whole: rows that stay one chunk."""
    kind = _KIND[data]
    begin = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        before, here = kind[:-1], kind[1:]
        begin[1:-1] = _CUT[before * np.uint8(6) + here]
        begin[1:-1] &= ~((data[:-1] == 39) & (here == _LETTER))  # an apostrophe and letters may be one match
        at = np.flatnonzero(begin[1:-1] & (before == _WIDE)) + 1  # a space behind a character beyond ASCII
        if len(at):
            last = [np.where(at >= k, data[np.maximum(at - k, 0)], 0).astype(np.int64) for k in (1, 2, 3)]
            two = last[1] << 8 | last[0]
            begin[at[np.isin(two, _WIDE_CODES) | np.isin(last[2] << 16 | two, _WIDE_CODES)]] = False
    if whole is not None and whole.any():
        for i in np.flatnonzero(whole):
            begin[offs[i] : offs[i + 1]] = False
    begin[offs] = True
    return np.flatnonzero(begin)


class Results:
    """Results (bytes) of chunks, kept from block to block up to KEPT_BYTES; then all are forgotten and found anew."""

    def __init__(self, encode, kept_bytes: int = KEPT_BYTES):
        self.encode, self.most = encode, kept_bytes
        self.held: dict[bytes, bytes] = {}
        self.size = 0

    def of(self, chunks: list[bytes]) -> list[bytes]:
        if self.size > self.most:
            self.held, self.size = {}, 0
        held = self.held
        new = [c for c in chunks if c not in held]
        made = dict(zip(new, self.encode(new), strict=True)) if new else {}
        short = {c: r for c, r in made.items() if len(c) <= LONGEST_KEPT}
        held.update(short)
        self.size += sum(len(c) + len(r) + _ENTRY_BYTES for c, r in short.items())
        return [held[c] if c in held else made[c] for c in chunks]


def joined(results: Results, data: np.ndarray, offs: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The results of all chunks, joined in order (bytes), and where each row's begin in them (one more entry than rows)."""
    bounds = cuts(data, offs, whole)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    got = pa.array(results.of(chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)
    _, ends, raw = got.buffers()
    ends = np.frombuffer(ends, np.int64, len(got) + 1) if len(got) else np.zeros(1, np.int64)
    raw = np.frombuffer(raw, np.uint8, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint8)
    return raw, ends[np.searchsorted(bounds, offs)]
