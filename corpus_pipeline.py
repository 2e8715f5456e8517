"""The corpus pipeline: quality, line rules, near duplicates, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next; all but
the last return the columns of documents. Stages bound the session's Arrow batches (common.small_batches), as executors
live on between them. Empty tables, nulls and repeated rows are as in the operators' docstrings."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import bpe, jaccard_join, knn_quality, line_frequency, soft_mixing
from pagewright.llm.common import small_batches, table, written

#: Target weights of the mix: what the classifier takes for low quality or toxic is nearly left out.
MIX_TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def in_small_batches(stage):
    @wraps(stage)
    def run(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what nearest-neighbour voting doesn't take for low quality."""
    model = knn_quality.fit(knn_quality.train_fold(docs, table(spark, sf_dir, "labels")))
    return knn_quality.scored(docs, model, name="_quality").where(F.col("_quality") >= knn_quality.THRESHOLD).select(docs.columns)


@in_small_batches
def rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the base rules and isn't depleted; takes lines above their host's limit out of the texts."""
    verdicts = line_frequency.judged(written(line_frequency.line_stats(docs), "line-stats"))
    kept = line_frequency.without_lines(docs, verdicts)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@in_small_batches
def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (5-word shingles, similarity 0.8 or more): that of least id, or, if
    none has an id, of least text hash. Texts without words are no group and stay. Rows are told apart by id and text, so
    a row without an id stays in its place; of rows repeated in both, one stays."""
    own, text_hash = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.xxhash64("text")
    groups = written(jaccard_join.near_components(docs, keys=True), "groups")
    least = groups.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "at", "text_hash")).alias("least")).select("least.at", "least.text_hash")
    kept = written(least.unionByName(groups.where("n_shingles = 0").select("at", "text_hash").distinct()), "kept", groups.count())
    # texts are shuffled whatever the size, as both sides grow alike
    out = docs.withColumns({"_at": own, "_text": text_hash}).join(kept.hint("merge"), (F.col("_at") == F.col("at")) & (F.col("_text") == F.col("text_hash")), "left_semi")
    repeated = groups.groupBy("at", "text_hash").count().where("count > 1").join(kept, ["at", "text_hash"], "left_semi")
    return (out if repeated.isEmpty() else out.dropDuplicates(["_at", "_text"])).select(docs.columns)


@in_small_batches
def mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins documents by their rates in a mix at MIX_TARGETS that leaves the clean tokens as many as they are.

    Rates are those of the least squares within 0 and 1; a document stays if a number in [0, 1) that its id (or else its
    text) decides is below its rate, so repeated rows stay or go together."""
    model = soft_mixing.fit(soft_mixing.labelled_docs(docs, table(spark, sf_dir, "labels")))
    soft = written(soft_mixing.posteriors(docs, model), "posteriors")
    _, steps, _ = soft_mixing.solve(soft, MIX_TARGETS, anchor="clean", most=1.0)
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return soft_mixing.rated(docs, model, steps, 1.0, "_rate").where(soft_mixing.uniform(key) < F.col("_rate")).select(docs.columns)


#: Bytes of encoded chunks that a worker keeps: less than in a job of its own, as workers live on between the stages.
KEPT_BYTES = 32 << 20


@in_small_batches
def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids of what is left, and of the bytes they decode to."""
    import public_tokenizers as P

    return bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, kept_bytes=KEPT_BYTES)


STAGES = [("quality", quality), ("rules", rules), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
