"""Toxicity: embeddings of subwords, averaged into a linear softmax, all trained together in numpy.

A text's words (letters and digits, lower-cased, with a space on either side) give their runs of SHORTEST to LONGEST
characters, hashed to BUCKETS places. So a misspelling that was never seen still has most of its word's subwords. A text
is the mean of its known subwords' vectors and of PAD zero vectors, which hold short texts back; the softmax of a linear
map of that mean is the score.

Fit: of the labelled rows a sample of at most MAX_LABELLED distinct texts (by hash of the text, so the same in each run).
Subwords in LEAST_TEXTS of these or more, whose chi-square with the label is LEAST_CHI or more, are known: Spark counts
them, and at most MAX_FEATURES of highest chi-square come to the driver, with their counts in the sample. There vectors
and linear map are trained together by Adagrad on the cross entropy. Scoring is map only, over whole texts in slices.

Defined results: a null text is empty; a text without known subwords has the score of the bias; without labelled rows of
both classes every score is that of the only class, or 0.0; labelled copies are one row with their mean label; repeated
rows score alike; a column named like the score is replaced; other columns are kept and ignored."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, pieces, table, written

MAX_LABELLED = 12000
MAX_FEATURES = 1 << 16
THRESHOLD = 0.3
SHORTEST, LONGEST = 3, 6
BUCKETS = 1 << 20
LEAST_TEXTS, LEAST_CHI = 4, 15.0
WIDTH, PAD = 10, 10.0
EPOCHS, BATCH, RATE = 6, 64, 0.3
#: Characters of which a task hashes the subwords at once, and entries of the distinct ones that it holds before it merges them.
SLICE, MERGE = 1 << 18, 1 << 22
_SPACE = 32
_NO_WORD = re.compile(r"[\W_]+")


def subwords(values: list[str]):
    """(rows, buckets) of all subwords of some texts, in slices of SLICE characters."""
    import numpy as np

    clean = [_NO_WORD.sub(" ", v.lower()).strip() for v in values]
    ends = np.cumsum([len(c) + 1 for c in clean])  # of each text with the space behind it; a space stands before all
    codes = np.frombuffer((" " + "".join(c + " " for c in clean)).encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), SLICE):
        some = codes[start : start + SLICE + LONGEST - 1].astype(np.uint64)
        spaces = np.concatenate([[0], np.cumsum(some == _SPACE)])
        mixed = (some + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(29)
        most = min(SLICE, len(codes) - start)
        h = np.zeros(len(some), np.uint64)
        at, found = [], []
        for n in range(1, LONGEST + 1):
            count = len(some) - n + 1
            if count <= 0:
                break
            h = h[:count] * np.uint64(0x9E3779B97F4A7C15) + mixed[n - 1 :]
            if n >= SHORTEST:
                here = np.flatnonzero(spaces[n - 1 : n - 1 + count] == spaces[1 : 1 + count])  # no space but at the edges
                here = here[here < most]
                g = h[here] ^ (h[here] >> np.uint64(31))
                found.append(((g * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
                at.append(here)
        if found:
            # a subword's second character stands in its text, whatever the edges are
            yield np.searchsorted(ends, np.concatenate(at) + start, "right"), np.concatenate(found)


def distinct_subwords(values: list[str]):
    """Sorted distinct row * BUCKETS + bucket, and how often each occurs."""
    import numpy as np

    keys, counts, held = [], [], 0
    for rows, buckets in [*subwords(values), (np.zeros(0, np.int64), np.zeros(0, np.int64))]:
        k, c = np.unique(rows * BUCKETS + buckets, return_counts=True)
        keys.append(k)
        counts.append(c)
        held += len(k)
        if held > MERGE or not len(rows):
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            keys, counts = [k], [np.bincount(inverse, np.concatenate(counts), len(k)).astype(np.int64)]
            held = len(k)
    return keys[0], counts[0]


def _known(sample: DataFrame, max_features: int) -> dict[int, float]:
    """Buckets of the subwords that tell the classes apart, with their chi-square."""

    def run(batches):
        import numpy as np

        texts_with, labels_with = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
        for batch in batches:
            for piece in pieces(batch):
                label = piece.column(1).to_numpy(zero_copy_only=False)
                keys, _ = distinct_subwords(piece.column(2).to_pylist())
                np.add.at(texts_with, keys % BUCKETS, 1)
                np.add.at(labels_with, keys % BUCKETS, label[keys // BUCKETS])
        held = np.flatnonzero(texts_with)
        for i in range(0, len(held), 1 << 16):
            some = held[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(texts_with[some]), pa.array(labels_with[some])], ["bucket", "texts", "labels"])

    total = sample.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    a, b = F.col("labels"), F.col("texts") - F.col("labels")
    c, d = F.lit(float(total.p)) - a, F.lit(float(total.n - total.p)) - b
    chi = F.lit(float(total.n)) * (a * d - b * c) ** 2 / F.greatest((a + b) * (c + d) * (a + c) * (b + d), F.lit(1e-9))
    counted = sample.mapInArrow(run, "bucket long, texts long, labels double").groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("labels").alias("labels"))
    best = counted.where(F.col("texts") >= LEAST_TEXTS).select("bucket", F.round(chi, 6).alias("chi")).where(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "bucket").limit(max_features)
    return {r.bucket: r.chi for r in best.collect()}


def _slots(buckets):
    """For each bucket its place among the known ones, else -1."""
    import numpy as np

    out = np.full(BUCKETS, -1, np.int32)
    out[buckets] = np.arange(len(buckets))
    return out


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> dict:
    """labelled: text, label (0 or 1). The driver gets at most max_labelled rows of at most max_features counts."""
    import numpy as np

    sample = written(labelled_sample(labelled, max_labelled), "labelled")
    ends = sample.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if ends[0] is None or ends[0] == ends[1]:
        return {"label": float(ends[2] or 0.0)}
    buckets = np.array(sorted(_known(sample, max_features)), np.int64)
    slots = sample.sparkSession.sparkContext.broadcast(_slots(buckets))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                keys, counts = distinct_subwords(piece.column(2).to_pylist())
                slot = slots.value[keys % BUCKETS]
                keys, counts, slot = keys[slot >= 0], counts[slot >= 0], slot[slot >= 0]
                cut = np.searchsorted(keys, np.arange(piece.num_rows + 1) * BUCKETS)
                packed = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (slot, np.minimum(counts, 2**31 - 1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(x, pa.binary()) for x in packed)], ["h", "label", "slots", "counts"])

    held = sorted(sample.mapInArrow(run, "h long, label double, slots binary, counts binary").collect(), key=lambda r: r.h)
    return {"buckets": buckets, **train([(np.frombuffer(r.slots, np.int32), np.frombuffer(r.counts, np.int32)) for r in held], np.array([r.label for r in held]), len(buckets))}


def train(rows: list, label, size: int) -> dict:
    """Vectors of `size` subwords, linear map and bias. rows: (slots, counts) of each text."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(11))
    vectors, turn, bias = (rng.standard_normal((size, WIDTH)) * 0.1).astype(np.float32), (rng.standard_normal((WIDTH, 2)) * 0.3).astype(np.float32), np.zeros(2, np.float32)
    seen = [np.zeros((size, 1), np.float32), np.zeros_like(turn), np.zeros_like(bias)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            active, place = np.unique(np.concatenate([rows[r][0] for r in some]), return_inverse=True)
            x = np.zeros((len(some), len(active)), np.float32)
            x[np.repeat(np.arange(len(some)), [len(rows[r][0]) for r in some]), place] = np.concatenate([rows[r][1] for r in some])
            x /= (x.sum(axis=1) + PAD)[:, None]
            mean = x @ vectors[active]
            off = _softmax(mean @ turn + bias) - np.stack([1 - label[some], label[some]], axis=1).astype(np.float32)
            down = x.T @ (off @ turn.T)
            seen[0][active] += (down * down).mean(axis=1, keepdims=True)
            vectors[active] -= RATE * down / (np.sqrt(seen[0][active]) + 1e-6)
            for held, total, slope in ((turn, seen[1], mean.T @ off / len(some)), (bias, seen[2], off.mean(axis=0))):
                total += slope * slope
                held -= RATE * slope / (np.sqrt(total) + 1e-6)
    return {"vectors": vectors, "turn": turn, "bias": bias}


def _softmax(z):
    import numpy as np

    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _score(model: dict, slots, values: list[str]):
    import numpy as np

    if "vectors" not in model:
        return np.full(len(values), model["label"])
    sums, count = np.zeros((len(values), WIDTH)), np.zeros(len(values))
    for rows, buckets in subwords(values):
        slot = slots[buckets]
        known = slot >= 0
        rows, vectors = rows[known], model["vectors"][slot[known]]
        count += np.bincount(rows, minlength=len(values))
        for i in range(WIDTH):
            sums[:, i] += np.bincount(rows, vectors[:, i], len(values))
    return _softmax(sums / (count + PAD)[:, None] @ model["turn"].astype(np.float64) + model["bias"])[:, 1]


def scored(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of that name. The model, of MAX_FEATURES vectors at most, is broadcast."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != name]
    schema = docs.select(*names).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        slots = _slots(held.value["buckets"]) if "buckets" in held.value else None
        for batch in batches:
            for piece in pieces(batch, text_col, SLICE):
                values = [v or "" for v in piece.column(names.index(text_col)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_score(held.value, slots, values), pa.float64())], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)


def held_out(doc_id):
    """Whether an id (none: no) is in the fold that no label is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train_fold(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and label of the labelled rows outside the held-out fold."""
    outside = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    picked = labels.where(outside & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))
    return docs.select("doc_id", "text").where(outside).join(picked, "doc_id").select("text", "label")


def op13_toxicity(spark, sf_dir):
    """Toxicity of every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    out = scored(docs, fit(train_fold(docs, labels)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= F.lit(THRESHOLD)).cast("int").alias("predicted"))
