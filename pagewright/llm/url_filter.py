"""URL filters: host and path rules, then naive Bayes over segmented words.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's; the longest rule wins.
The rest is judged by multinomial naive Bayes, learned from the URLs that rules decide. Tokens are the words of host
labels and path parts; names without separators are split by unigram Viterbi: over all ways to cut a run of letters,
the one of most probable words, by the counts of words in all page texts (unknown pieces cost more the longer they
are). Words that rules name (and their hosts' labels) are no evidence, as rules already spoke; digits count as one token.

Counts cover all words and tokens of all pages, are summed by grouped aggregates with map-side partials and stay in
written tables. Each distinct run of letters is cut once: its substrings are joined with the words. Each distinct run's
weights are joined to the pages that hold it; Spark picks the join by the tables' sizes and splits frequent runs.

Defined results: a null URL or one without :// has empty host and path, and no rule; a URL without a known token is
allowed; a tie is allowed; if rules decide no URL of one verdict, the rest is allowed; repeated rows are judged alike;
an empty table gives an empty result; null texts add no words; other columns are ignored."""

from __future__ import annotations

import re
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, table, texts, written

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: What a letter of an unknown piece costs: a tenth of the probability.
UNKNOWN_LETTER = log(10.0)
#: Words of up to so many letters are found in a run by all its substrings of their lengths; longer ones by their start.
SHORT_WORD, START = 24, 16
#: Places of a run whose substrings leave a task at once.
SLICE = 4096


def host_of(url):
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES):
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(slash + p))
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("rule_verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) of the a-z words of all page texts, markup left out."""
    markup, word = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>"), re.compile(rb"[a-z]+")

    def run(batches):
        from collections import Counter

        counts: Counter = Counter()

        def out():
            got = list(counts.items())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["word", "n"])

        for batch in batches:
            for piece in pieces(batch, "html"):
                data, offs = texts(piece.column(0))
                raw = data.tobytes()
                for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    counts.update(word.findall(markup.sub(b" ", raw[a:b]).lower()))
                if len(counts) > 200_000:
                    yield out()
        yield out()

    return pages.select(F.col(html_col).cast("string").alias("html")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Segmenter:
    """Unigram Viterbi over runs of a-z."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cost = {w: log(self.total / n) for w, n in counts.items()}
        self.lengths = sorted({len(w) for w in counts})

    def _cost(self, piece: str) -> float:
        known = self.cost.get(piece)
        return known if known is not None else log(self.total) + len(piece) * UNKNOWN_LETTER

    def split(self, run: str) -> list[str]:
        """The words of the cheapest cut; among equal ones that whose last word is longest, from the end.

        Known words end in a place by their lengths alone. Of unknown pieces, whose cost is linear in their length, the
        best start so far serves every later end, so the work is the run's length times the number of word lengths."""
        fresh, cost = log(self.total), self.cost
        best, back = [0.0], [0]
        origin, least = 0, 0.0  # of an unknown piece: its start, and what is cheapest there without the letters up to it
        for end in range(1, len(run) + 1):
            c, start = least + fresh + end * UNKNOWN_LETTER, origin
            for length in self.lengths:
                if length > end:
                    break
                known = cost.get(run[end - length : end])
                if known is not None:
                    other = best[end - length] + known
                    if other < c or (other == c and end - length < start):
                        c, start = other, end - length
            best.append(c)
            back.append(start)
            if c - end * UNKNOWN_LETTER < least:
                origin, least = end, c - end * UNKNOWN_LETTER
        out, end = [], len(run)
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


_RUN = re.compile(r"[a-z]+|[0-9]+")
DIGITS = "<digits>"


def keys_of(host: str, path: str, silent: frozenset[str]) -> list[str]:
    """The runs of host and path with their mark; all digits are one run, silent runs are left out."""
    runs = ((mark, run) for mark, text in (("h:", host), ("p:", path.lower())) for run in _RUN.findall(text))
    return [mark + (DIGITS if run.isdigit() else run) for mark, run in runs if run.isdigit() or run not in silent]


def silent_words(rules=RULES) -> frozenset[str]:
    """Words that rules name."""
    return frozenset(w for _, rule in rules for w in _RUN.findall(rule))


def parsed(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A number of its own, page_id, host, path, rule, rule_verdict and marked runs of every page."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    silent = silent_words(rules)

    def run(batches):
        for batch in batches:
            keys = [keys_of(h, p, silent) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.string()))], [*batch.schema.names, "keys"])

    return rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", "r.*").mapInArrow(run, "row long, page_id long, host string, path string, rule string, rule_verdict string, keys array<string>")


def segments(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, words) of distinct runs of letters, by the counts of all words.

    Of a run, only its substrings among the words matter. Those of the lengths of short words are joined with the words,
    under the run's hash, so that a run isn't carried with each of its pieces. A long word is looked for only in runs that
    hold its first START letters somewhere: these starts are joined, then the word is searched in the run. So what a task
    makes grows with the run's length alone, whatever lengths words have."""
    sizes = counts.groupBy(F.least(F.length("word"), F.lit(SHORT_WORD + 1)).alias("size")).agg(F.sum("n").alias("n")).collect()
    lengths, total = sorted(r["size"] for r in sizes), sum(r.n for r in sizes)
    short = [n for n in lengths if n <= SHORT_WORD]

    def substrings(of_lengths, least):
        def cut(batches):
            for batch in batches:
                for rid, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for at in range(0, len(run) - least + 1, SLICE):
                        found = list({run[a : a + n] for a in range(at, min(at + SLICE, len(run) - least + 1)) for n in of_lengths if a + n <= len(run)})
                        yield pa.RecordBatch.from_arrays([pa.array([rid] * len(found), pa.int64()), pa.array(found, pa.string())], ["rid", "word"])

        return cut

    def split(batches):
        for batch in batches:
            held = batch.column(1).to_pylist()
            words = [Segmenter({w["word"]: w["n"] for w in known or []}, total or 1).split(run) for run, known in zip(batch.column(0).to_pylist(), held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    keyed = runs.select(F.xxhash64("run").alias("rid"), "run")
    found = keyed.mapInArrow(substrings(short, 1), "rid long, word string").join(counts, "word").select("rid", "word", "n")
    if len(short) < len(lengths):
        starts = keyed.mapInArrow(substrings([START], SHORT_WORD + 1), "rid long, word string").withColumnRenamed("word", "start").distinct()
        long = counts.where(F.length("word") > SHORT_WORD).withColumn("start", F.substring("word", 1, START))
        found = found.unionByName(starts.join(long, "start").join(keyed, "rid").where(F.contains("run", "word")).select("rid", "word", "n"))
    known = found.groupBy("rid").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    return keyed.join(known, "rid", "left").select("run", "known").mapInArrow(split, "run string, words array<string>")


def prior_of(decided: DataFrame) -> float | None:
    """Log odds of block among decided rows; None if one verdict is missing."""
    n = {r.rule_verdict: r.n for r in decided.groupBy("rule_verdict").agg(F.count("*").alias("n")).collect()}
    return log(n["block"] / n["allow"]) if n.get("block") and n.get("allow") else None


def weights_of(held: DataFrame) -> DataFrame:
    """(token, weight) of all tokens that decided rows hold, from their counts (token, block, allow)."""
    held = held.where(F.col("block") + F.col("allow") > 0)
    block, allow, n = (float(x or 0) for x in held.agg(F.sum("block"), F.sum("allow"), F.count("*")).first())
    return held.select("token", (F.log((F.col("block") + 1) / F.lit(block + n)) - F.log((F.col("allow") + 1) / F.lit(allow + n))).alias("weight"))


def learn(rows: DataFrame) -> dict:
    """Naive Bayes from the rows (rule_verdict, tokens) that rules decide, as a dictionary: for small tables."""
    decided = rows.where(F.col("rule_verdict").isNotNull())
    prior = prior_of(decided)
    if prior is None:
        return {"prior": 0.0, "weights": {}}
    held = decided.select("rule_verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if(F.col("rule_verdict") == "block").alias("block"), F.count_if(F.col("rule_verdict") == "allow").alias("allow"))
    return {"prior": prior, "weights": {r.token: r.weight for r in weights_of(held).collect()}}


def score(tokens: list[str], model: dict) -> float:
    """Log odds of block; 0 without a known token."""
    known = [model["weights"][t] for t in tokens if t in model["weights"]]
    return model["prior"] + sum(known) if known else 0.0


def run_tokens(rows: DataFrame, counts: DataFrame, rules=RULES) -> DataFrame:
    """key, how often rows of each verdict hold it, and tokens of every distinct marked run."""
    verdict, silent = F.col("rule_verdict"), list(silent_words(rules))
    held = rows.select("rule_verdict", F.explode("keys").alias("key")).groupBy("key").agg(F.count_if(verdict == "block").alias("block"), F.count_if(verdict == "allow").alias("allow"))
    held = written(held.withColumn("run", F.substring("key", 3, 1 << 30)), "runs")
    cut = segments(held.where(F.col("run") != DIGITS).select("run").distinct(), counts)
    said = F.filter(F.coalesce("words", F.array(F.lit(DIGITS))), lambda w: ~w.isin(silent)) if silent else F.coalesce("words", F.array(F.lit(DIGITS)))
    return held.join(cut, "run", "left").select("key", "block", "allow", F.transform(said, lambda w: F.concat(F.substring("key", 1, 2), w)).alias("tokens"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page."""
    rows = written(parsed(pages, rules), "urls")
    runs = written(run_tokens(rows, written(word_counts(pages), "words"), rules), "tokens")
    prior = prior_of(rows.where(F.col("rule_verdict").isNotNull()))
    at_token = runs.select("key", "block", "allow", F.posexplode("tokens").alias("at", "token"))
    weights = weights_of(at_token.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")))
    in_order = lambda: F.transform(F.sort_array(F.collect_list(F.struct("at", "weight"))), lambda x: x["weight"])
    known = at_token.join(weights, "token").groupBy("key").agg(in_order().alias("weight"))
    if prior is None:
        known = known.where(F.lit(False))
    scored = rows.select("row", F.posexplode("keys").alias("at", "key")).join(known, "key").groupBy("row").agg(F.flatten(in_order()).alias("weights"))

    def run(batches):
        for batch in batches:
            scores = [prior + sum(w) if w else 0.0 for w in batch.column(5).to_pylist()]
            verdicts = [r or ("block" if s > 0 else "allow") for r, s in zip(batch.column(4).to_pylist(), scores, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "score"])

    out = rows.join(scored, "row", "left").select("page_id", "host", "path", "rule", "rule_verdict", "weights")
    return out.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def op2_url_filter(spark, sf_dir):
    """The verdict on every page's URL."""
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
