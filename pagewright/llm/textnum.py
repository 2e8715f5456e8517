"""Words, lines and their 64-bit hashes over the UTF-8 buffers of Arrow columns, in numpy.

A word is a maximal run of bytes other than space and \\t\\n\\v\\f\\r. Hashes are polynomials modulo 2**64 over random
byte codes, finished by a bijective mixer; equal words have equal hashes in every task, as the codes are fixed."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240601))
_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_P, _PINV)]
    return _POWERS[0][:n], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each codes[start:end]; the length is part of it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; no word crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    word = ~space
    return np.flatnonzero(word & (before | edge[:-1])), np.flatnonzero(word & (after | edge[1:])) + 1


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start of each word, and for each row the index of its first word (one more entry than rows)."""
    starts, ends = word_spans(data, offs)
    hashes = runs((_CODE_LOWER if lower else _CODE)[data], starts, ends)
    return hashes, starts, np.searchsorted(starts, offs)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, rows ignored: entry i covers words i..i+n-1."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total = total * np.uint64(_P) + hashes[i : i + m]
    return mix(total)


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int, lower: bool = True) -> list[np.ndarray]:
    """For each row its sorted distinct n-word shingle hashes; a row of 1 to n-1 words has one: the whole sequence."""
    hashes, _, first = words(data, offs, lower)
    all_grams = grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(all_grams[a : b - n + 1]))
        elif b > a:
            out.append(grams(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
