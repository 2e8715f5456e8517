"""Byte-level BPE encoding and decoding by ranks.

A text is cut into chunks that no match of the pattern crosses (chunks.py); the distinct chunks of a block are matched
once, and the distinct matches are encoded together: rows are bucketed by length into padded numpy matrices of token
ids; in each round every row merges its leftmost minimum-rank pair, found through a hash table of pairs, and rows are
compacted; rows without a pair leave. Matches above LONG bytes are first cut between bytes that stand side by side in no
token, as nothing merges there; a piece still above it is a row by itself whose pairs wait in a heap in the same order,
so work grows with the length, not its square. Decoding joins the tokens' bytes. Results of short chunks are kept from
block to block up to a number of bytes, so memory is bounded by that, the block and its longest text.

The pattern must be like the one of chunks.py: no match goes on from another character into white space, nor between
letters, digits and signs but behind an apostrophe.

Defined results: a null text is empty (no ids, sha256 of nothing); texts of any length are whole; repeated rows give
repeated results; an empty table gives an empty result; other columns are ignored."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import KEPT_BYTES, Results, joined
from .common import pieces, table, texts

ROWS = 8192
#: Matches above this many bytes are cut or get a row of their own.
LONG = 256
BLOCK = 4 << 20
_NONE = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Pairs:
    """Open-addressing hash table from a pair of ids to the id (= rank) that it merges to."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    found[(a << 32) | b] = rank
        raw = np.frombuffer(b"".join(self.tokens), np.uint8)
        same = np.ones(len(raw), bool)
        same[np.cumsum([len(t) for t in self.tokens if t])[:-1]] = False
        self.meet = np.zeros((256, 256), bool)  # bytes that stand side by side in a token
        self.meet[raw[:-1][same[1:]], raw[1:][same[1:]]] = True
        self.ranks_of: dict[int, int] | None = None
        keys = np.array(list(found), np.int64)
        values = np.array(list(found.values()), np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):  # place what finds its slot free, move the rest on by one
            _, first = np.unique(slot, return_index=True)
            free = first[self.keys[slot[first]] == -1]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            rest = np.ones(len(keys), bool)
            rest[free] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        import numpy as np

        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left, right):
        """Rank of each pair, _NONE for pairs that don't merge."""
        import numpy as np

        keys = (left << 32) | right
        slot = self._slot(keys.ravel()).reshape(keys.shape)
        at = self.keys[slot]
        out = np.where(at == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero(((at != keys) & (at != -1)).ravel())
        flat, key, s = out.reshape(-1), keys.ravel()[open_], slot.ravel()[open_]
        while len(open_):
            s = (s + 1) & ((1 << self.bits) - 1)
            at = self.keys[s]
            hit = at == key
            flat[open_[hit]] = self.values[s[hit]]
            on = ~hit & (at != -1)
            open_, key, s = open_[on], key[on], s[on]
        return out

    def encode(self, words: list[bytes]) -> tuple:
        """(ids of all words in one array, how many each word has). Words above LONG bytes are first cut between bytes that
        no token holds side by side; what is still above it is merged in one row with a heap of its pairs."""
        import numpy as np

        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, n_parts = words, None
        if max(map(len, words)) > LONG:
            cut = [self._cut(w) if len(w) > LONG else [w] for w in words]
            parts, n_parts = [p for ps in cut for p in ps], np.array([len(ps) for ps in cut])
        lengths = np.array([len(w) for w in parts], np.int64)
        order = np.argsort(lengths, kind="stable")
        ranked = lengths[order]
        counts, made, at = np.zeros(len(parts), np.int64), [], int(np.searchsorted(ranked, 0, "right"))
        while at < len(order):
            n = int(ranked[at])
            if n > LONG:
                out = self._by_heap(parts[order[at]])[None]
                made.append((order[at : at + 1], out))
                counts[order[at]] = out.shape[1]
                at += 1
                continue
            top = min(LONG, max(n + 1, n * 9 // 8))
            end = min(int(np.searchsorted(ranked, top, "right")), at + max(1, (ROWS * 16) // max(16, top)))
            rows = order[at:end]
            out, counts[rows] = self._matrix([parts[i] for i in rows], lengths[rows])
            made.append((rows, out))
            at = end
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int64)
        for rows, out in made:
            inside = np.arange(out.shape[1]) < counts[rows][:, None]
            flat[(starts[rows][:, None] + np.arange(out.shape[1]))[inside]] = out[inside]
        if n_parts is not None:
            counts = np.add.reduceat(counts, np.cumsum(n_parts) - n_parts)
        return flat, counts

    def _cut(self, word: bytes) -> list[bytes]:
        import numpy as np

        raw = np.frombuffer(word, np.uint8)
        at = [0, *(np.flatnonzero(~self.meet[raw[:-1], raw[1:]]) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _by_heap(self, word: bytes):
        """Ids of one long row: its pairs in a heap by rank and place, its tokens linked."""
        from heapq import heapify, heappop, heappush

        import numpy as np

        if self.ranks_of is None:
            used = self.keys >= 0
            self.ranks_of = dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))
        ranks_of, n = self.ranks_of, len(word)
        first = self.byte[np.frombuffer(word, np.uint8)]
        rank = [*self.merged(first[:-1], first[1:]).tolist(), _NONE]
        ids, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i, r in enumerate(rank) if r != _NONE]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), 1 << 32)
            if rank[i] != r:
                continue
            gone = after[i]
            ids[i], ids[gone], rank[gone] = r, -1, _NONE
            after[i] = nxt = after[gone]
            if nxt < n:
                before[nxt] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    rank[left] = new = ranks_of.get(ids[left] << 32 | ids[right], _NONE) if right < n else _NONE
                    if new != _NONE:
                        heappush(heap, new << 32 | left)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def _matrix(self, words: list[bytes], length):
        """(ids of each word, padded, and how many they are)."""
        import numpy as np

        n, width, length = len(words), int(length.max()), length.copy()
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        ids = self.byte[raw]
        ids[np.arange(width) >= length[:, None]] = -1
        out = ids.copy()
        if width == 1:
            return out, length
        live, rank = np.arange(n), self._ranks(ids)
        while True:
            here = np.arange(len(live))
            best = rank.argmin(1)
            least = rank[here, best]
            over = least == _NONE
            if over.any():
                out[live[over], : ids.shape[1]] = ids[over]
                on = ~over
                ids, rank, best, least, live = ids[on], rank[on], best[on], least[on], live[on]
                if not len(live):
                    return out, length
                here = np.arange(len(live))
            cols = np.arange(ids.shape[1] - 1)
            shift = cols > best[:, None]  # close the gap behind the merged pair
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[here, best] = least
            rank[:, :-1] = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = _NONE
            length[live] -= 1
            for side in (best - 1, best):
                r = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                c = side[r]
                a, b = ids[r, c], ids[r, c + 1]
                new = np.full(len(r), _NONE, np.int64)
                both = b >= 0
                new[both] = self.merged(a[both], b[both])
                rank[r, c] = new
            widest = int(length[live].max())
            if widest == 1:
                out[live, :1] = ids[:, :1]
                return out, length
            if widest < ids.shape[1]:  # compaction
                ids, rank = np.ascontiguousarray(ids[:, :widest]), np.ascontiguousarray(rank[:, : widest - 1])

    def _ranks(self, ids):
        import numpy as np

        left, right = ids[:, :-1], ids[:, 1:]
        out = np.full(left.shape, _NONE, np.int64)
        fine = right >= 0
        out[fine] = self.merged(left[fine], right[fine])
        return out


class Encoder:
    """Encodes blocks of texts; what it keeps between blocks is bounded in bytes."""

    def __init__(self, ranks_path: str, pattern: str):
        import numpy as np
        import regex

        self.pairs = Pairs(read_ranks(ranks_path))
        n = len(self.pairs.tokens)
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.tokens = pa.array(self.pairs.tokens, pa.large_binary())
        self.digits = pa.array([b",%d" % i for i in range(n)], pa.large_binary())
        self.pattern = regex.compile(pattern)
        self.results = Results(self._encoded)

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk: its matches are found, and the distinct matches encoded together."""
        import numpy as np

        words = [c.decode("utf-8", "replace") for c in chunks]
        # a space and letters are one match of the pattern; the rest is matched
        matches = [(w,) if w.isalpha() or w[0] == " " and w[1:].isalpha() else self.pattern.findall(w) for w in words]
        place: dict[str, int] = {}
        at = [[place.setdefault(m, len(place)) for m in ms] for ms in matches]
        flat, counts = self.pairs.encode([m.encode() for m in place])
        packed, size = flat.astype(self.dtype).tobytes(), self.dtype.itemsize
        ends = (np.cumsum(counts) * size).tolist()
        made = [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return [made[ms[0]] if len(ms) == 1 else b"".join([made[i] for i in ms]) for ms in at]

    def block(self, column: pa.Array):
        """(number of ids, ids joined by commas, decoded bytes) of each text."""
        import numpy as np

        raw, at = joined(self.results, *texts(column))
        ids, at = np.frombuffer(raw, self.dtype), at // self.dtype.itemsize
        (said, a), (decoded, b) = _spelled(self.digits, ids, at), _spelled(self.tokens, ids, at)
        for i, n in enumerate(np.diff(at).tolist()):
            yield n, said[a[i] + 1 : a[i + 1]], decoded[b[i] : b[i + 1]]


def _spelled(spellings: pa.Array, ids, at) -> tuple[bytes, list[int]]:
    """The ids' spellings, joined, and where each row's begin."""
    import numpy as np

    got = spellings.take(pa.array(ids))
    _, ends, raw = got.buffers()
    ends = np.frombuffer(ends, np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
    return (raw.to_pybytes()[: int(ends[-1])] if ends[-1] else b""), ends[at].tolist()


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids as text "1,2,...", decoded bytes) of every document; no shuffle, each block on its own."""
    return _run(docs, ranks_path, pattern, id_col, text_col, f"{id_col} long, n_tokens long, ids string, decoded binary", lambda n, ids, raw: (n, ids.decode(), raw), [pa.int64(), pa.string(), pa.binary()])


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", kept_bytes: int = KEPT_BYTES) -> DataFrame:
    """As encoded(), with the SHA-256 of the ids and of the decoded bytes in place of both. kept_bytes: what a worker may keep
    of chunks and their results."""
    import hashlib

    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _run(docs, ranks_path, pattern, id_col, text_col, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, raw: (n, sha(ids), sha(raw)), [pa.int64(), pa.string(), pa.string()], kept_bytes)


_ENCODERS: dict = {}  # of this worker process, by its files


def _run(docs, ranks_path, pattern, id_col, text_col, schema, made, types, kept_bytes=KEPT_BYTES):
    def run(batches):
        if (ranks_path, pattern) not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[ranks_path, pattern] = Encoder(ranks_path, pattern)
        encoder = _ENCODERS[ranks_path, pattern]
        encoder.results.most = kept_bytes
        for batch in batches:
            for piece in pieces(batch, text_col, BLOCK):
                rows = [made(*x) for x in encoder.block(piece.column(1))]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def op10_byte_bpe(spark, sf_dir):
    """Token counts and digests of the ids and the decoded bytes of every document."""
    import public_tokenizers as P

    return digests(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
