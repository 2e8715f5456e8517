"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least hash of its inner s-mers stands at its first or last place:
that depends on the k-mer alone, so an edit elsewhere never moves an anchor. A fingerprint holds every anchor's hash with
its first position, so it grows with the text (about two anchors in nine code points). Two fingerprints are likened by
all their anchors: the share of their union that both hold at a common shift, the shift being the one that most shared
anchors agree on, within a tolerance. Written out it is about 1.8 times the text: HASH_BYTES of each hash and, in a byte
mostly, the step from the anchor before, in base 64, without loss. Texts without a closed syncmer (short ones) have one anchor: a hash of the whole text; an
empty text has none. Equal texts have equal fingerprints.

The edited text of a document takes its last floor(n/4) code points from the next one's start. Its anchors are those of
the document that end before the cut, those of the next that end within the part taken, and those of the k-1 windows
across the cut, so each text is hashed once. Documents are dealt into ranges of id and text hash by one shuffle of whole
texts, so texts that share an id, or have none, may fill many; each range also gets the first document of the next range (the last range that of the first), then is streamed in
order: a task holds one document and its neighbour.

Defined results: a null text is empty; two empty texts have likeness 1, an empty and another 0; repeated ids are ordered
by text hash; null ids come first; a single document is its own next; an empty table gives an empty result."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, bytes_of, pieces, table

K = 16
S = 8
SHIFT_TOLERANCE = 8
#: Bytes of an anchor's hash that a fingerprint keeps.
HASH_BYTES = 5
#: Texts of about so many bytes make a range, until there are MOST_RANGES; then ranges grow, as a range is streamed.
RANGE_BYTES = 24 << 20
MOST_RANGES = 50_000


def syncmers_of(codes):
    """(hashes, positions) of the closed syncmers of an array of code points."""
    import numpy as np

    from .textnum import _P, mix

    n = len(codes)
    if n < K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = codes.astype(np.uint64) + np.uint64(1)
    p, p2, p4, p8 = (np.uint64(pow(_P, e, 1 << 64)) for e in (1, 2, 4, 8))
    h2 = x[:-1] * p + x[1:]
    h4 = h2[:-2] * p2 + h2[2:]
    h8 = h4[:-4] * p4 + h4[4:]
    s = mix(h8)  # S = 8
    w = K - S + 1  # 9 inner s-mers
    least = s
    for step in (1, 2, 4, 1):
        least = np.minimum(least[:-step], least[step:])
    m = n - K + 1
    picked = np.flatnonzero((s[:m] == least) | (s[w - 1 : w - 1 + m] == least))
    whole = h8[picked] * p8 + h8[picked + 8]
    return mix(whole + np.uint64(K)), picked


def anchors(codes, found=None):
    """(hashes, positions) of the closed syncmers (found, if they are known), or of the whole text if it has none."""
    import numpy as np

    from .textnum import _P, mix

    h, p = syncmers_of(codes) if found is None else found
    if len(h) or not len(codes):
        return h, p
    total = len(codes)
    for c in codes.tolist():
        total = (total * _P + c + 1) & (1 << 64) - 1
    return mix(np.array([total], np.uint64)), np.zeros(1, np.int64)


def sketch(hashes, positions):
    """All distinct hashes in order, each at its first position; positions come ascending."""
    import numpy as np

    h, first = np.unique(hashes >> np.uint64(64 - 8 * HASH_BYTES), return_index=True)
    return h, positions[first]


def as_text(sk) -> str:
    """The steps between the anchors' positions, seven bits a byte, and their hashes in that order, each in base 64."""
    import numpy as np

    h, p = sk
    order = np.argsort(p)
    steps = np.diff(p[order], prepend=0)
    width = 1 + sum((steps >> 7 * k > 0).astype(np.int64) for k in range(1, 9))
    at, out = np.cumsum(width) - width, np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        more = width > k
        out[at[more] + k] = (steps[more] >> 7 * k & 127) | np.where(width[more] > k + 1, 128, 0)
    raw = h[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
    return f"cs{K}.{S}={base64.b64encode(out.tobytes()).decode()}.{base64.b64encode(raw.tobytes()).decode()}"


def read_text(text: str):
    """The sketch that as_text wrote."""
    import numpy as np

    steps, raw = (np.frombuffer(base64.b64decode(part), np.uint8) for part in text.removeprefix(f"cs{K}.{S}=").split("."))
    ends = np.flatnonzero(steps < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    values = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        more = starts + k <= ends
        values[more] |= (steps[starts[more] + k].astype(np.int64) & 127) << 7 * k
    wide = np.zeros((len(ends), 8), np.uint8)
    wide[:, :HASH_BYTES] = raw.reshape(-1, HASH_BYTES)
    h, p = wide.view("<u8").ravel().astype(np.uint64), np.cumsum(values)
    order = np.argsort(h)
    return h[order], p[order]


def likeness(a, b) -> float:
    """Share of both texts' anchors that both hold at one shift."""
    import numpy as np

    (ha, pa_), (hb, pb) = a, b
    if not len(ha) or not len(hb):
        return float(len(ha) == len(hb))
    shared, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    shift = np.sort(pa_[i] - pb[j])
    agree = int((np.searchsorted(shift, shift + SHIFT_TOLERANCE, "right") - np.arange(len(shift))).max())
    return agree / (len(ha) + len(hb) - len(shared))


def _codes(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Doc:
    __slots__ = ("codes", "doc_id", "hashes", "positions", "sketch", "text")

    def __init__(self, doc_id, text):
        self.doc_id, self.text, self.codes = doc_id, text, _codes(text)
        self.hashes, self.positions = found = syncmers_of(self.codes)
        self.sketch = sketch(*anchors(self.codes, found))


def _edited(doc: _Doc, nxt: _Doc):
    """The edited text and its sketch, from both documents' anchors and the windows across the cut."""
    import numpy as np

    n = len(doc.codes)
    take = min(n // 4, len(nxt.codes))
    cut = n - n // 4
    text = doc.text[:cut] + nxt.text[:take]
    mine = doc.positions + K <= cut
    theirs = nxt.positions + K <= take
    across = np.concatenate([doc.codes[max(0, cut - K + 1) : cut], nxt.codes[: min(take, K - 1)]])
    hx, px = syncmers_of(across)
    found = np.concatenate([doc.hashes[mine], hx, nxt.hashes[theirs]]), np.concatenate([doc.positions[mine], px + max(0, cut - K + 1), nxt.positions[theirs] + cut])
    return text, sketch(*anchors(np.concatenate([doc.codes[:cut], nxt.codes[:take]]) if not len(found[0]) else doc.codes[:1], found))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _row(doc: _Doc, nxt: _Doc) -> dict:
    text, sk = _edited(doc, nxt)
    return {
        "doc_id": doc.doc_id, "n_chars": len(doc.codes), "edited_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": as_text(doc.sketch), "edited_fingerprint": as_text(sk), "near_edited": likeness(doc.sketch, sk), "near_next": likeness(doc.sketch, nxt.sketch),
    }


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every document; no shuffle."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([as_text(sketch(*anchors(_codes(t or "")))) for t in piece.column(1).to_pylist()])], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def place_buckets(places: DataFrame, n: int) -> list:
    """Ascending lower bounds (without the first range's) that cut the places (known, id, h) into about n even ranges, by
    Spark's own range partitioning."""
    if n < 2:
        return []
    keys = places.select("place.*").repartitionByRange(n, "known", "id", "h")
    least = keys.groupBy(F.spark_partition_id().alias("b")).agg(F.min(F.struct("known", "id", "h")).alias("k")).collect()
    return [F.struct(F.lit(k.known).alias("known"), F.lit(k.id).cast("long").alias("id"), F.lit(k.h).cast("long").alias("h")) for k in sorted((r.k for r in least))[1:]]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every document and of its edited text, and its likeness to that and to the next document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = min(MOST_RANGES, max(1, -(-bytes_of(source) // range_bytes), source.sparkSession.sparkContext.defaultParallelism))
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    bounds = place_buckets(source.select(place.alias("place")), n)
    ranged = source.withColumn("place", place).withColumn("b", bucket_of("place", bounds).cast("int")).drop("place")
    # a row per range (MOST_RANGES at most): the place of its first document
    first = {r.b: (r.p.known, r.p.id if r.p.known else None, r.p.h) for r in ranged.groupBy("b").agg(F.min(place).alias("p")).collect()}
    used = sorted(first)
    ahead = [(first[b][1], first[b][2], used[i - 1]) for i, b in enumerate(used)]  # the range before; the last for the first
    schema = "first_id long, first_h long, to int"
    heads = ranged.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(source.sparkSession.createDataFrame(ahead, schema)), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")))
    heads = heads.dropDuplicates(["to"]).select("doc_id", "text", F.col("to").alias("b"), F.lit(True).alias("guest"))
    dealt = ranged.select("doc_id", "text", "b", F.lit(False).alias("guest")).unionByName(heads).repartitionById(len(bounds) + 1, F.col("b")).sortWithinPartitions("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        held, rows = None, []
        for batch in batches:
            for piece in pieces(batch):
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    doc = _Doc(doc_id, text)
                    if held is not None:
                        rows.append(_row(held, doc))
                    held = doc
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []

    return dealt.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op4_syncmers(spark, sf_dir):
    """Fingerprints of every document and its edited text, with their likenesses."""
    return with_next(table(spark, sf_dir, "documents"))
