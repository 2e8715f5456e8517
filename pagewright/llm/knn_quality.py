"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are of four kinds, each hashed to a quarter of DIMS places: words, pairs of neighbouring words, runs of three bytes,
and how far back each word last occurred (as a power of two of words, or never). Weights are TF-IDF with the logarithm of
counts; each kind has the same length in a text's vector, however many terms it has. Fit: of the labelled rows outside the held-out fold, a sample of at most MAX_LABELLED distinct texts (by hash of
the text, so the same in each run) gives rows whose truncated SVD (randomised, with a fixed seed) gives the projection
and the labelled vectors; the bound keeps both under a few MB whatever the input size. Scoring: every document is
projected, its cosine to all labelled vectors is computed exactly in blocks, and the K nearest vote with their similarity
as weight.

Defined results: a null text is empty; a text without known terms gets the labelled rows' mean label; without labelled
rows of a class every score is 1.0 (nothing is rejected unseen) or that of the only class; labelled copies are one row
with their mean label; of equal similarities the labelled row of lesser text hash comes first; repeated rows score alike;
a column named like the score is replaced; other columns are kept and ignored. The score reads the text alone."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import labelled_sample, pieces, table, texts, written

MAX_LABELLED = 6000
RANK = 32
NEIGHBOURS = 9
THRESHOLD = 0.3

DIMS = 1 << 14
KINDS = 4
#: Tasks of a sum over the labelled sample, whose partial sums of some MB are shuffled in so many slices.
SUM_TASKS, SLICES = 12, 64
#: Rows and text bytes of a block, so that its dense counts stay under 17 MB.
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 19
_BACK = 0x5851F42D4C957F2D


def recurrences(row, words):
    """For each word the number of bits of how many words ago its row last had it; 0 if it hadn't."""
    import numpy as np

    keys = textnum.mix(words) ^ textnum.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    back = np.zeros(len(words), np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    return np.where(back > 0, np.floor(np.log2(np.maximum(back, 1))) + 1, 0).astype(np.uint64)


def term_counts(data, offs):
    """(row, term, count) of each term of each row, in order of row and term."""
    import numpy as np

    n = len(offs) - 1
    starts, ends = textnum.word_spans(data, offs)
    row = np.searchsorted(offs, starts, "right") - 1
    words = textnum.runs(textnum._CODE_LOWER[data], starts, ends)
    inside = row[1:] == row[:-1]
    rows = [row, row[1:][inside], row]
    terms = [textnum.mix(words + np.uint64(1)), textnum.mix(words[:-1] * np.uint64(textnum._P) + words[1:])[inside], textnum.mix(recurrences(row, words) + np.uint64(_BACK))]
    if len(data) > 2:
        at = np.repeat(np.arange(n), np.diff(offs))
        wide = data.astype(np.uint64)
        threes = textnum.mix(((wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]) + np.uint64(1 << 40))
        whole = at[2:] == at[:-2]
        rows.append(at[2:][whole])
        terms.append(threes[whole])
    part = DIMS // KINDS
    shift = np.uint64(64 - part.bit_length() + 1)
    counts = np.bincount(np.concatenate([r * DIMS + kind * part + (t >> shift).astype(np.int64) for kind, (r, t) in enumerate(zip(rows, terms, strict=True))]), minlength=n * DIMS)
    held = np.flatnonzero(counts)
    return held // DIMS, held % DIMS, counts[held]


def _weighted(row, term, count, n: int, idf):
    """Rows x DIMS unit vectors of TF-IDF weights, and their norms before."""
    import numpy as np

    out = np.zeros((n, DIMS), np.float32)
    out[row, term] = np.log1p(count).astype(np.float32) * idf[term]
    kinds = out.reshape(n, KINDS, DIMS // KINDS)
    kinds /= np.maximum(np.linalg.norm(kinds, axis=2, keepdims=True), 1e-9)
    norm = np.linalg.norm(out, axis=1)
    out /= np.maximum(norm, 1e-9)[:, None]
    return out, norm


def _unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _blocks(batches, idf):
    """Dense unit vectors of the rows (h, label, terms, counts), in blocks, with their batches."""
    import numpy as np

    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            some = batch.slice(i, BLOCK_ROWS)
            term, count = ([np.frombuffer(v, kind) for v in some.column(c).to_pylist()] for c, kind in ((2, np.uint16), (3, np.uint32)))
            row = np.repeat(np.arange(some.num_rows), [len(t) for t in term])
            yield some, _weighted(row, np.concatenate(term).astype(np.int64), np.concatenate(count), some.num_rows, idf)[0]


def _summed(rows: DataFrame, part, dtype):
    """Sum of the arrays of DIMS rows that part(batches) yields in each task, in an order of its own. Tasks cut theirs into
    slices that executors add up, so one array comes to the driver, however many tasks there are."""
    import numpy as np

    def run(batches):
        total, least = None, None
        for h, some in part(batches):
            total, least = (some, h) if total is None else (total + some, min(h, least))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([least] * SLICES, pa.int64()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], ["slice", "h", "part"])

    def added(batches):
        now, total = None, None
        for batch in batches:
            for slice_no, some in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if slice_no != now and now is not None:
                    yield _slice(now, total)
                some = np.frombuffer(some, dtype)
                now, total = slice_no, some if slice_no != now else total + some
        if now is not None:
            yield _slice(now, total)

    parts = rows.coalesce(SUM_TASKS).mapInArrow(run, "slice int, h long, part binary")
    held = parts.repartition("slice").sortWithinPartitions("slice", "h").mapInArrow(added, "slice int, part binary").collect()
    return np.concatenate([np.frombuffer(r.part, dtype) for r in sorted(held, key=lambda r: r.slice)])


def _slice(slice_no: int, total):
    return pa.RecordBatch.from_arrays([pa.array([slice_no], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slice", "part"])


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, rank: int = RANK) -> dict:
    """labelled: text, label (0 or 1). The sample's terms stay in a written table; each round of the SVD is a sum over it on
    executors. What comes to the driver is DIMS x (rank + 16) numbers a round and max_labelled vectors of the rank."""
    import numpy as np

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=BLOCK_BYTES, rows=BLOCK_ROWS):
                row, term, count = term_counts(*texts(piece.column(2)))
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                packed = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (term.astype(np.uint16), np.minimum(count, (1 << 32) - 1).astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, pa.binary()) for x in packed)], ["h", "label", "terms", "counts"])

    rows = written(labelled_sample(labelled, max_labelled).mapInArrow(run, "h long, label double, terms binary, counts binary"), "labelled")
    found = rows.agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).first()
    if not found.n or found.least == found.most:
        return {"label": found.least if found.n else 1.0}

    def held_terms(batches):
        for batch in batches:
            for h, terms in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield h, np.bincount(np.frombuffer(terms, np.uint16), minlength=DIMS)

    df = _summed(rows, held_terms, np.int64)
    idf = np.where(df >= 2, np.log((1 + found.n) / (1 + df)) + 1, 0).astype(np.float32)
    wide = min(rank + 16, found.n, DIMS)
    q = np.random.Generator(np.random.PCG64(7)).standard_normal((DIMS, wide)).astype(np.float32)
    for _ in range(3):
        total = _summed(rows, lambda batches, q=q: ((some.column(0)[0].as_py(), x.T @ (x @ q)) for some, x in _blocks(batches, idf)), np.float32)
        q = np.linalg.qr(total.reshape(DIMS, wide))[0]

    def placed(batches):
        for some, x in _blocks(batches, idf):
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([p.tobytes() for p in x @ q], pa.binary())], ["h", "label", "point"])

    held = sorted(rows.mapInArrow(placed, "h long, label double, point binary").collect(), key=lambda r: r.h)
    points, y = np.stack([np.frombuffer(r.point, np.float32) for r in held]), np.array([r.label for r in held])
    _, _, turn = np.linalg.svd(points, full_matrices=False)
    turn = turn[:rank].T.astype(np.float32)
    return {"idf": idf, "projection": np.ascontiguousarray(q @ turn), "points": _unit(points @ turn).astype(np.float32), "y": y, "label": float(y.mean())}


def _score(model: dict, data, offs, neighbours: int):
    import numpy as np

    n = len(offs) - 1
    if "points" not in model:
        return np.full(n, model["label"])
    x, norm = _weighted(*term_counts(data, offs), n, model["idf"])
    sims = _unit(x @ model["projection"]) @ model["points"].T
    k = min(neighbours, sims.shape[1])
    least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]  # the k-th similarity; rows equal to it enter by their order
    score = np.empty(n)
    for i in range(n):
        sure, equal = np.flatnonzero(sims[i] > least[i]), np.flatnonzero(sims[i] == least[i])
        near = np.concatenate([sure, equal[: k - len(sure)]])
        weight = np.maximum(sims[i, near], 0).astype(np.float64) + 1e-12
        score[i] = (weight * model["y"][near]).sum() / weight.sum()
    return np.where(norm > 0, np.clip(score, 0, 1), model["label"])


def scored(docs: DataFrame, model: dict, text_col: str = "text", neighbours: int = NEIGHBOURS, name: str = "score") -> DataFrame:
    """docs with a column of that name. The model (bounded by MAX_LABELLED, DIMS and RANK) is broadcast; each block is one
    matrix product."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != name]
    schema = docs.select(*names).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, text_col, BLOCK_BYTES, BLOCK_ROWS):
                score = _score(held.value, *texts(piece.column(names.index(text_col))), neighbours)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score, pa.float64())], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)


def train_fold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the labelled rows outside the held-out fold (crc32 of the id, modulo 5, is 0)."""
    outside = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0
    picked = labels.where(outside & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    return docs.select("doc_id", "text").where(outside).join(picked, "doc_id").select("text", "label")


def op9_knn_quality(spark, sf_dir):
    """Score of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = scored(docs, fit(train_fold(docs, labels)))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))
