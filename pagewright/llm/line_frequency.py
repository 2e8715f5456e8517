"""Quality rules: counts within each document, then cross-document line frequency per host.

Normalised lines (A-Z lower-cased, words joined by one space) are hashed; for each host the distinct documents that
hold a line are counted; lines in more than max(min_docs, share * the host's distinct documents) of them are removed,
and a document that keeps less than min_left of its words is depleted and rejected.

Documents are distinct by id: copies of one text under several ids count each, so a text that fills a host is removed
from it. The text is read once; what follows works on hashes (a few per document). Counting dedupes (host, id, line)
before it counts, both steps with map-side partial aggregates, so one hot host or line never meets in one task as raw
rows. What a host's frequent lines take from a text is found once per host and text, as it is alike for all copies.

Defined results: a null or blank text has no words and fails the base rules; a null host is the host ''; repeated
rows are one document; rows without an id are documents by their text; an empty table gives an empty result; other
columns of the input are ignored."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import pieces, texts, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 10
HOST_SHARE = 0.02
MIN_LEFT = 0.5

_STATS = "doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:long>>"
_LINES = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))


def _line_spans(data, offs):
    """Start and end of each \\n-split line of each row, and the row of each line."""
    import numpy as np

    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offs[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], breaks]), kind="stable")
    n_lines = textnum.per_row(data == 10, offs) + 1
    return starts, ends, np.repeat(np.arange(len(n_lines)), n_lines)


def _stats_of(piece: pa.RecordBatch) -> pa.RecordBatch:
    import numpy as np

    data, offs = texts(piece.column(2))
    n_rows = piece.num_rows
    low, starts, first = textnum.words(data, offs, lower=True)
    exact = textnum.words(data, offs)[0]
    row_of_word = np.repeat(np.arange(n_rows), np.diff(first))
    space = textnum._SPACE[data]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True

    # words covered by 3-word windows that occur twice in their row
    covered = np.zeros(len(exact), bool)
    if len(exact) >= 3:
        window = textnum.mix(textnum.grams(exact, 3) ^ textnum.mix(row_of_word[:-2].astype(np.uint64)))
        inside = np.flatnonzero(row_of_word[:-2] == row_of_word[2:])
        order = inside[np.argsort(window[inside], kind="stable")]
        same = window[order][1:] == window[order][:-1]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        for k in range(3):
            covered[twice + k] = True

    begin, end, row = _line_spans(data, offs)
    word_a, word_b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = word_b > word_a
    raw = textnum.runs(textnum._CODE[data], begin[full], end[full])
    norm = textnum.runs(low, word_a[full], word_b[full])
    row, n_in = row[full], (word_b - word_a)[full]

    def distinct(key):
        order = np.lexsort((key, row))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
        return order, new

    _, new = distinct(raw)
    n_full = np.bincount(row, minlength=n_rows)
    n_dup = n_full - np.bincount(row[distinct(raw)[0]][new], minlength=n_rows) if len(row) else np.zeros(n_rows, np.int64)
    order, new = distinct(norm)
    at = np.flatnonzero(new)
    words_in = np.add.reduceat(n_in[order], at) if len(at) else np.zeros(0, np.int64)
    per = np.bincount(row[order][at], minlength=n_rows) if len(at) else np.zeros(n_rows, np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(norm[order][at].view(np.int64)), pa.array(words_in.astype(np.int64))], ["line", "words"]),
    )
    host = piece.column(1).fill_null("")
    columns = [
        piece.column(0), host, pa.array(textnum.runs(textnum._CODE[data], offs[:-1], offs[1:]).view(np.int64)),
        pa.array(np.diff(first).astype(np.int64)),
        pa.array(textnum.per_row(~space & ((data & 0xC0) != 0x80), offs)),
        pa.array(textnum.per_row(symbol[data], offs)),
        pa.array(n_dup.astype(np.int64)),
        pa.array(textnum.per_row(covered, first)),
        lists,
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])


def line_stats(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: counts of its words, symbols, repeated lines and windows, and its distinct line hashes."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                yield _stats_of(piece)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _STATS)


def frequent_lines(stats: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line) of the lines above their host's limit."""
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash")))
    held = stats.select("host", document.alias("d"), F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.countDistinct("d").alias("n_docs"))
    hosts = stats.groupBy("host").agg(F.countDistinct(document).alias("host_docs"))
    return held.where(F.col("n_docs") > min_docs).join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * F.lit(host_share)).select("host", "line", "n_docs")


def judged(stats: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """stats with removed_words, removed_lines (their hashes), base_failed and kept. stats should be a written table."""
    # joined tables stand by themselves, so that Spark splits a line, or a copied text, that a third of the rows have
    frequent = written(frequent_lines(stats, min_docs, host_share), "frequent")
    lines = stats.select("host", "text_hash", F.explode("lines").alias("l")).select("host", "text_hash", F.col("l.line").alias("line"), F.col("l.words").alias("words")).distinct()
    removed = lines.join(frequent, ["host", "line"]).groupBy("host", "text_hash").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    removed = written(removed, "removed")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        stats.drop("lines").join(removed, ["host", "text_hash"], "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", base)
        .withColumn("kept", ~base & (F.col("n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("n_words")))
    )


def without_lines(docs: DataFrame, verdicts: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents kept, with their frequent lines taken out of the text; columns as in docs.

    verdicts has a row per document; it is reduced to one per (host, text) before the join."""
    names = docs.columns
    plain = written(verdicts.where("kept").select("host", "text_hash", "removed_lines").dropDuplicates(["host", "text_hash"]), "kept")
    schema = docs.withColumn("_text_hash", F.lit(0).cast("long")).schema

    def hashed(batches):
        import numpy as np

        for batch in batches:
            for piece in pieces(batch, text_col):
                data, offs = texts(piece.column(piece.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(textnum.runs(textnum._CODE[data], offs[:-1], offs[1:]).view(np.int64))], [*names, "_text_hash"])

    keyed = docs.mapInArrow(hashed, schema).withColumn("_host", F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    joined = keyed.join(plain.withColumnsRenamed({"host": "_host", "text_hash": "_text_hash", "removed_lines": "_removed"}), ["_host", "_text_hash"]).select(*names, "_removed")

    def cut(batches):
        import numpy as np

        for batch in batches:
            for piece in pieces(batch, text_col):
                at, gone = piece.schema.get_field_index(text_col), piece.column(len(names))
                if gone.null_count < len(gone):
                    data, offs = texts(piece.column(at))
                    low, starts, _ = textnum.words(data, offs, lower=True)
                    begin, end, row = _line_spans(data, offs)
                    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
                    norm = np.zeros(len(a), np.uint64)
                    norm[b > a] = textnum.runs(low, a[b > a], b[b > a])
                    gone = [set(x) if x else () for x in gone.to_pylist()]
                    values = piece.column(at).to_pylist()
                    norm, raw = norm.view(np.int64), data.tobytes()
                    for i in {int(r) for r in row if gone[r]}:
                        mine = np.flatnonzero(row == i) if len(gone) < 2 else np.arange(*np.searchsorted(row, [i, i + 1]))
                        values[i] = b"\n".join(raw[begin[j] : end[j]] for j in mine if not (b[j] > a[j] and int(norm[j]) in gone[i])).decode()
                    piece = piece.set_column(at, piece.schema.field(at), pa.array(values, piece.schema.field(at).type))
                yield piece.select(names)

    return joined.mapInArrow(cut, docs.schema)


def op1_line_frequency(spark, sf_dir):
    """Base counts and the line-frequency verdict of every document."""
    from .common import table

    stats = written(line_stats(table(spark, sf_dir, "documents")), "line-stats")
    return judged(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'text ' || coalesce(text, '')) AS document, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, text FROM d),
tri AS (SELECT doc_id, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, document, host, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT doc_id, document, host, line, array_to_string(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS norm,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT document) AS docs FROM d GROUP BY host),
freq AS (SELECT host, norm FROM full_lines JOIN hosts USING (host) GROUP BY host, norm, docs HAVING count(DISTINCT document) > 10 AND count(DISTINCT document) > docs * CAST(0.02 AS DOUBLE)),
gone AS (SELECT doc_id, sum(n) AS n FROM full_lines JOIN freq USING (host, norm) GROUP BY doc_id),
s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= CAST(0.5 AS DOUBLE) * n_words AS kept, removed_words FROM b
"""
