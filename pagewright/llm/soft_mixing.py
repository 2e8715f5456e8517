"""Soft-membership mixing: domain posteriors from a labelled table, then document rates by projected gradient.

A document belongs to domains by posterior, not by a label. Presence of hashed words and of shape signs (shares of
repeated, capital, sign-ending and separator words) is counted by class over all labelled rows; all features that speak
for a class (in LEAST_SHARE of its documents, LEAST_LIFT times as common there as elsewhere, chi-square above LEAST_CHI)
make a naive Bayes of their presence and absence. Its posteriors p and the words n of every document are written once.

Rates w >= 0 minimise the sum over domains of (T_j - t_j)^2 / m_j, where T_j = sum of w n p_j, t_j is the target and
m_j the domain's expected share at rate 1. The gradient, scaled per document by 1/n, is p . (r / m), so a step is
w <- max(0, w - p . (r / m)); as posteriors sum to 1, a step of 1 never overshoots. Steps start from a point ahead
(accelerated projected gradient, restarted when the loss rises). A round is one pass over the
written table, without a shuffle: a row of sums a task; a document's rate follows from its p, the rate last written and the few residuals since. Nothing of a
document is kept on the driver, only a task's sums for the round and one residual per domain and round. With a largest rate, steps are cut there too.

Defined results: null texts have no words, prior posteriors and no part in totals; an unlabelled or unknown class gets
no posterior; without labels posteriors are even; a domain without expected tokens is left out of the fit; unreachable
targets end at the least squares of the rounds allowed; repeated rows count each; an empty table gives an empty result."""

from __future__ import annotations

from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import pieces, table, texts, written

DOMAINS = ("clean", "low", "toxic")
TARGETS = {"clean": 0.9, "low": 0.07, "toxic": 0.03}
HASHED = 1 << 16
SHARES = (0.05, 0.15, 0.3, 0.6)
SHAPES = 4
DIMS = HASHED + SHAPES * len(SHARES)
LEAST_SHARE = 0.05
LEAST_LIFT = 3.0
LEAST_CHI = 20.0
ROUNDS = 200
WRITTEN_ROUNDS = 8
TOLERANCE = 1e-6
BROADCAST_LABELS = 1_000_000


def features_of(data, offs):
    """(row, feature) of each feature present, distinct, and the number of words of each row."""
    import numpy as np

    n = len(offs) - 1
    starts, ends = textnum.word_spans(data, offs)
    row = np.searchsorted(offs, starts, "right") - 1
    n_words = np.bincount(row, minlength=n)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    signs = np.ones(256, bool)
    signs[48:58] = signs[65:91] = signs[97:123] = signs[128:] = False
    last = ends.copy()
    for _ in range(3):  # signs at the end, three at most, don't make another word
        more = (last - 1 > starts) & signs[data[last - 1]]
        last[more] -= 1
    hashes = textnum.runs(textnum._CODE_LOWER[data], starts, last)
    words = (hashes & np.uint64(HASHED - 1)).astype(np.int64)
    upper = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=upper[1:])
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    capital = upper[last] - upper[starts] >= np.maximum(2, (last - starts + 1) // 2)
    plain = np.zeros(256, bool)
    plain[list(b".,;:?'\")")] = True
    odd = (ends - last >= 1) & ~plain[data[ends - 1]]
    alone = (ends - starts == 1) & signs[data[starts]]
    rows, feats = [row], [words]
    for k, flag in enumerate((again, capital, odd, alone)):
        share = np.bincount(row[flag], minlength=n) / np.maximum(n_words, 1)
        for j, least in enumerate(SHARES):
            at = np.flatnonzero(share >= least)
            rows.append(at)
            feats.append(np.full(len(at), HASHED + k * len(SHARES) + j))
    pairs = np.unique(np.concatenate(rows) * DIMS + np.concatenate(feats))
    return pairs // DIMS, pairs % DIMS, n_words


def domain_of():
    """The labelled table's classes: toxic, low (quality 0) or clean."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def fit(labelled: DataFrame, domains=DOMAINS) -> dict:
    """Naive Bayes from text and domain of all labelled rows; counts are summed on executors, at most DIMS a class come back."""
    import numpy as np

    def run(batches):
        counts = np.zeros((len(domains), DIMS + 1), np.int64)
        place = {d: i for i, d in enumerate(domains)}
        for batch in batches:
            for piece in pieces(batch):
                row, feat, _ = features_of(*texts(piece.column(0)))
                kind = np.array([place.get(d, -1) for d in piece.column(1).to_pylist()])
                for i in range(len(domains)):
                    counts[i, :DIMS] += np.bincount(feat[kind[row] == i], minlength=DIMS)
                    counts[i, DIMS] += int((kind == i).sum())
        k, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(counts[k, f])], ["k", "f", "c"])

    summed = labelled.select("text", "domain").mapInArrow(run, "k int, f int, c long").groupBy("k", "f").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros((len(domains), DIMS + 1))
    for r in summed:
        counts[r.k, r.f] = r.c
    docs, counts = counts[:, DIMS], counts[:, :DIMS]
    total = docs.sum()
    if not total:
        return {"prior": np.zeros(len(domains)), "used": np.zeros(0, np.int64)}
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = np.where(docs > 0, np.log(docs / total), -np.inf)
        present = counts.sum(0)
        chosen = set()
        for i in range(len(domains)):
            a, b = counts[i], present - counts[i]
            c, d = docs[i] - a, total - docs[i] - b
            chi = np.nan_to_num(total * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)))
            lift = np.nan_to_num((a / docs[i]) / ((b + 0.5) / (total - docs[i] + 1)))
            chi[(a < max(2, LEAST_SHARE * docs[i])) | (lift < LEAST_LIFT)] = 0
            chosen.update(np.flatnonzero(chi > LEAST_CHI).tolist())
    used = np.array(sorted(chosen), np.int64)
    p = (counts[:, used] + 0.5) / (docs[:, None] + 1)
    on, off = np.log(p), np.log1p(-p)
    return {"prior": prior, "used": used, "weights": on - off, "base": off.sum(1)}


def _posteriors(model: dict, data, offs, k: int):
    """Words of each row and its posteriors (rows x k)."""
    import numpy as np

    place = np.full(DIMS, -1)
    place[model["used"]] = np.arange(len(model["used"]))
    row, feat, n_words = features_of(data, offs)
    z = np.tile(model["prior"] + model.get("base", 0.0), (len(offs) - 1, 1))
    at = place[feat] >= 0
    for i in range(k if len(model["used"]) else 0):
        z[:, i] += np.bincount(row[at], model["weights"][i, place[feat[at]]], minlength=len(z))
    z[n_words == 0] = model["prior"]
    z = np.exp(z - z.max(1, keepdims=True))
    return n_words, z / z.sum(1, keepdims=True)


def posteriors(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", domains=DOMAINS) -> DataFrame:
    """doc_id, n_tokens (words) and p (a posterior per domain) of every document."""
    held, k = docs.sparkSession.sparkContext.broadcast(model), len(domains)

    def run(batches):
        import numpy as np

        for batch in batches:
            for piece in pieces(batch):
                n_words, p = _posteriors(held.value, *texts(piece.column(1)), k)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n_words.astype(np.int64)), lists], ["doc_id", "n_tokens", "p"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, p array<double>")


def _moved(w, y, p, steps, most):
    """Rates w and look-ahead points y after the steps (a gradient and a momentum each), rates kept within 0 and most."""
    import numpy as np

    for gradient, momentum in steps:
        new = np.clip(y - p @ gradient, 0.0, most)
        w, y = new, new + momentum * (new - w)
    return w, y


def _matrix(column, k):
    import numpy as np

    return np.asarray(column.flatten()).reshape(-1, k)


def solve(soft: DataFrame, targets: dict[str, float], budget: float | None = None, anchor: str | None = None, most: float = float("inf"), domains=DOMAINS, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[DataFrame, list, list[float]]:
    """(soft with each document's rate, all steps, the residual shares they leave). soft: a written table of n_tokens and p.

    budget: tokens of the mix (as many as there are, if None); with an anchor domain it is set so that the anchor's
    expected tokens already meet its target. most: the largest rate. Rounds end when a step moves a token's rate by
    tolerance at most on average (the projected gradient is as good as 0). Rates are written every WRITTEN_ROUNDS rounds,
    so a round replays a few steps whatever came before."""
    import numpy as np

    k = len(domains)

    def totals(state, steps):
        """Expected tokens of each domain at the rates and at the look-ahead points, and how far the last step moved all
        tokens' rates from the point it started at."""

        def run(batches):
            t = np.zeros(2 * k + 1)
            for batch in batches:
                n, p, w, y = np.asarray(batch.column(0), dtype=np.float64), _matrix(batch.column(1), k), batch.column(2).to_numpy(), batch.column(3).to_numpy()
                w, y = _moved(w, y, p, steps[:-1], most)
                before = y
                w, y = _moved(w, y, p, steps[-1:], most)
                t += np.concatenate([(w * n) @ p, (y * n) @ p, [(np.abs(w - before) * n).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([t.tolist()], pa.list_(pa.float64()))], ["t"])

        out = np.zeros(2 * k + 1)
        for r in state.select("n_tokens", "p", "rate", "ahead").mapInArrow(run, "t array<double>").collect():  # a row a task
            out += r.t
        return out[:k], out[k:-1], out[-1]

    state, steps, done = soft.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)}), [], []
    start, ahead, _ = totals(state, [])
    total = start.sum()
    if not total:
        return state.drop("ahead"), [], [0.0] * k
    share = np.array([targets.get(d, 0.0) for d in domains])
    share = share / share.sum()
    anchored = list(domains).index(anchor) if anchor else -1
    mass = budget or (start[anchored] / share[anchored] if anchor and start[anchored] and share[anchored] else total)
    m, now, loss, turn = start / total, start, float("inf"), 1.0
    scale = np.where(m > 1e-12, 1.0 / np.maximum(m, 1e-12), 0.0)
    for _ in range(rounds):
        following = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        steps.append(((ahead / total - share * mass / total) * scale, (turn - 1) / following))
        now, ahead, moved = totals(state, steps)
        turn, was = following, loss
        loss = float(((now / total - share * mass / total) ** 2 * scale).sum())
        if moved <= tolerance * total:
            break
        if loss > was:  # momentum has gone too far
            turn = 1.0
        if len(steps) == WRITTEN_ROUNDS:
            state, done, steps = written(_stepped(state, steps, most, k), "rates"), done + steps, []
    return _stepped(state, steps, most, k).drop("ahead"), done + steps, (now / total - share * mass / total).tolist()


def _stepped(state: DataFrame, steps: list, most: float, k: int) -> DataFrame:
    names = state.columns
    at, rate, ahead = (names.index(c) for c in ("p", "rate", "ahead"))

    def run(batches):
        for batch in batches:
            w, y = _moved(batch.column(rate).to_numpy(), batch.column(ahead).to_numpy(), _matrix(batch.column(at), k), steps, most)
            yield batch.set_column(rate, "rate", pa.array(w)).set_column(ahead, "ahead", pa.array(y))

    return state.mapInArrow(run, state.schema)


def with_rates(soft: DataFrame, steps: list, most: float = float("inf"), domains=DOMAINS) -> DataFrame:
    """soft with the rates that all steps of solve() lead to."""
    return _stepped(soft.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)}), steps, most, len(domains)).drop("ahead")


def rated(docs: DataFrame, model: dict, steps: list, most: float = float("inf"), name: str = "rate", text_col: str = "text", domains=DOMAINS) -> DataFrame:
    """docs with a column of that name: the rate of each, found again from its text and all steps, so that texts stay where
    they are. A column of that name in docs is replaced."""
    held, names = docs.sparkSession.sparkContext.broadcast(model), [c for c in docs.columns if c != name]
    schema = docs.select(*names).withColumn(name, F.lit(0.0)).schema

    def run(batches):
        import numpy as np

        for batch in batches:
            for piece in pieces(batch, text_col):
                _, p = _posteriors(held.value, *texts(piece.column(names.index(text_col))), len(domains))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(_moved(np.ones(len(p)), np.ones(len(p)), p, steps, most)[0])], [*names, name])

    return docs.select(*names).mapInArrow(run, schema)


def uniform(*keys):
    """A number in [0, 1) that depends on the keys (the id) alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text and domain of the labelled documents; of several labels of an id toxic counts before low, and low before clean.
    Up to BROADCAST_LABELS labels are broadcast, so texts stay where they are; beyond that both sides are shuffled by id."""
    worst = F.when(F.col("domain") == "toxic", 0).when(F.col("domain") == "low", 1).otherwise(2)
    of_id = labels.select("doc_id", domain_of().alias("domain")).where(F.col("domain").isNotNull()).groupBy("doc_id").agg(F.min_by("domain", worst).alias("domain"))
    small = labels.count() <= BROADCAST_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(of_id) if small else of_id, "doc_id").select("text", "domain")


def op7_soft_mixing(spark, sf_dir):
    """Posteriors, rate and copies of every document in a mix of as many tokens at the target weights."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    soft = written(posteriors(docs, fit(labelled_docs(docs, labels))), "posteriors")
    out = solve(soft, TARGETS)[0]
    return out.select("doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)], "rate", F.floor(F.col("rate") + uniform("doc_id")).cast("int").alias("copies"))
