"""The corpus operators against brute force on small tables: nulls, empty and long texts, ties, repeats, odd columns."""

import base64
import gzip
import hashlib
import random
import re
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.llm import bpe, common, components, jaccard_join, knn_quality, license_scan, line_frequency, queries, soft_mixing, syncmers, textnum, token_frames, url_filter, warc_zip
from pagewright.llm.common import new_path

from ..oracle import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, h long, n long"


def made_docs(seed=1, n=120):
    """Small texts with copies, near copies, nulls, blanks, one long text, Unicode spaces and clashing column names."""
    rng = random.Random(seed)
    words = ["the", "of", "Été", "naïve", "x1", "don't", "漢字", "a b", "end.", "!!", "one", "two"] + [f"w{i}" for i in range(400)]
    texts = [None, "", " ", "\n\n", "one two", "A b c", "a  b   c", "tail ", " head", "x　y 　 z", "\n a \n b"]
    while len(texts) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(("\n" if rng.random() < 0.3 else " ").join(near).upper() if rng.random() < 0.2 else " ".join(near))
    texts.append(" ".join(rng.choice(words) for _ in range(20000)))
    return [(i * 3, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "k", i, -i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made_docs(), DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def split(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_word_hashes():
    from pagewright.llm.common import texts

    data, offs = texts(pa.array(["a b", None, "b  a\x0bé", ""]))
    h, starts, first = textnum.words(data, offs)
    assert first.tolist() == [0, 2, 2, 5, 5] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def brute_lines(rows):
    norm = lambda line: b" ".join(split(line.lower() if line.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    held, hosts, out = defaultdict(set), defaultdict(set), {}
    for doc_id, text, _, source, *_ in rows:
        hosts[source or ""].add(text or "" if doc_id is None else doc_id)
        for line in (text or "").split("\n"):
            if split(line):
                held[source or "", norm(line)].add(text or "" if doc_id is None else doc_id)
    frequent = {k for k, v in held.items() if len(v) > 3 and len(v) > 0.02 * len(hosts[k[0]])}
    for doc_id, text, _, source, *_ in rows:
        w = split(text)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)} if len(w) < 5000 else set()
        lines = [x for x in (text or "").split("\n") if split(x)]
        gone = sum(len(split(x)) for x in lines if (source or "", norm(x)) in frequent)
        bad = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        out[doc_id] = (len(w), len(lines) - len(set(lines)), len(twice), bad, not bad and len(w) - gone >= 0.5 * len(w), gone)
    return out


def test_lines(spark, empty):
    rows = made_docs(2, 60)
    shared = "This Line is on many pages\tof the site and it is long enough to matter"
    rows += [(10_000 + i, f"{shared}\n" + " ".join(f"q{i}x{j}" for j in range(60 if i % 2 else 20)) + f"\n{shared}\n{shared.upper()}" + "\nz z z z z" * (i % 3), None, "s1", 1, "k", 0, 0) for i in range(12)]
    copied = " ".join(f"c{j}" for j in range(55)) + "\n" + " ".join(f"d{j}" for j in range(20))
    rows += [(11_000 + i, copied, None, "s2", 1, "k", 0, 0) for i in range(6)]  # copies are documents: depleted
    rows += [(12_000, copied, None, "s9", 1, "k", 0, 0)] * 6  # repeated rows are one document
    df = spark.createDataFrame(rows, DOCS)
    stats = line_frequency.line_stats(df)
    got = line_frequency.judged(stats, min_docs=3)
    want = brute_lines(rows)
    for r in got.collect():
        if r.n_words < 5000:
            assert (r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words) == want[r.doc_id], r
    left = {r.doc_id: r.text for r in line_frequency.without_lines(df, got).collect()}
    assert not want[11_000][4] and want[12_000][4] and len([1 for r in got.collect() if r.doc_id == 12_000]) == 6
    assert set(left) == {k for k, v in want.items() if v[4]} and left[10_001] and shared not in left[10_001]
    assert line_frequency.judged(line_frequency.line_stats(empty)).count() == 0


def test_url_rules_and_segments(spark):
    rows = [(1, "http://a.net/x", None), (2, "http://A.Example.NET/en/q?x#y", ""), (3, None, None), (4, "nothing", "<p>x"), (5, "https://x.example.com/de/1#/", None), (6, "http://b.org/fr", None), (7, "http://b.org/free", None), (10, "http://b.org/fr/x", None), (11, "http://org/fr/", None), (8, "http://net", None), (9, "http://notnet/", None), (2, "http://A.Example.NET/en/q?x#y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("a.example.net", "/en/q", "example.net/en/", "allow") and got[3] == ("", "", None, "allow") == got[4]
    assert got[5][2:] == ("example.com/de/", "block") and got[6][2] is None and got[7][2] is None and got[10][2:] == ("org/fr/", "allow") == got[11][2:] and got[8][2] is None and got[9][2] is None
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_viterbi_is_the_best_cut():
    seg = url_filter.Segmenter({"spam": 50, "farm": 40, "far": 30, "ms": 5, "pam": 3, "s": 2})
    assert seg.split("spamfarm") == ["spam", "farm"]

    def best(run):
        cuts = [[run]] if run else [[]]
        for i in range(1, len(run)):
            cuts += [[run[:i], *rest] for rest in [best(run[i:])]]
        return min(cuts, key=lambda c: sum(map(seg._cost, c)))

    rng = random.Random(9)
    for run in ("farmspam", "pamsfar", "zzspam", "sfarms", *("".join(rng.choice("spamfr") for _ in range(rng.randrange(1, 13))) for _ in range(60))):
        assert "".join(seg.split(run)) == run and abs(sum(map(seg._cost, seg.split(run))) - sum(map(seg._cost, best(run)))) < 1e-9


def test_bayes_by_hand(spark):
    rows = [("block", ["h:spam", "p:win"]), ("block", ["h:spam"]), ("allow", ["h:news"]), (None, ["h:spam"])]
    model = url_filter.learn(spark.createDataFrame(rows, "rule_verdict string, tokens array<string>"))
    weight = np.log(3 / 6) - np.log(1 / 4)  # spam: (2 + 1) / (3 + 3) against (0 + 1) / (1 + 3)
    assert abs(model["weights"]["h:spam"] - weight) < 1e-12 and url_filter.score(["h:none"], model) == 0
    assert abs(url_filter.score(["h:spam"], model) - weight - np.log(2)) < 1e-12


def test_url_filter_uses_all_words_and_tokens(spark):
    """A run is cut at, and judged by, the rarest words of a table of more than 50,000 words and tokens, and by words of over 24 letters."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    long_word = "zyxwvutsrqponmlkjihgfedcba"
    common = " ".join(name(i) for i in range(60_000) for _ in range(2))
    rows = [(0, "http://q.org/fr/about", common + " zzzzq zzzzr " + long_word)]
    rows += [(1 + i, f"http://s.net/{'/'.join(name(j) for j in range(i * 600, i * 600 + 600))}", "") for i in range(100)] * 2
    rows += [(500, "http://t.net/zzzzq", ""), (501, "http://u.com/zzzzqzzzzr", ""), (502, "http://t.net/" + long_word, ""), (503, "http://u.com/" + long_word + "zzzzr", ""), (504, "http://u.com/qqqq", "")]
    got = {r.page_id: r for r in url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    n = 60_000 + 3 + 3  # names, zzzzq, long_word and about; hosts q, s and t; words that rules name are left out
    block, allow = 200 * 601 + 4, 2
    want = np.log(202) + np.log(2 / (block + n)) - np.log(1 / (allow + n))
    for page in (501, 503):
        assert got[page].rule is None and got[page].verdict == "block" and abs(got[page].score - want) < 1e-9
    assert len(got) == 106 and got[504].score == 0 and got[504].verdict == "allow"


def brute_verdicts(rows):
    """host, path, rule and verdict of each page, written from the contract and the method with plain dictionaries."""
    from collections import Counter
    from math import log

    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    words = Counter(w for _, _, html in rows for w in re.findall("[a-z]+", re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", html or "").encode().lower().decode("ascii", "replace")))
    total = max(1, sum(words.values()))
    cost = lambda w: log(total / words[w]) if w in words else log(total) + len(w) * log(10)

    def cut(run):
        best = [(0.0, [])]
        for e in range(1, len(run) + 1):
            best.append(min((best[s][0] + cost(run[s:e]), [*best[s][1], run[s:e]]) for s in range(e)))
        return best[-1][1]

    silent, pages = {"net", "example", "en", "com", "de", "org", "fr"}, []
    for page_id, url, _ in rows:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fits, key=len, default=None)
        tokens = []
        for mark, text in (("h:", host), ("p:", path.lower())):
            for run in re.findall("[a-z]+|[0-9]+", text):
                tokens += [mark + "<digits>"] if run.isdigit() else [mark + w for w in ([] if run in silent else cut(run)) if w not in silent]
        pages.append((page_id, host, path, rule, tokens))
    held = {v: Counter(t for _, _, _, r, ts in pages if r and rules[r] == v for t in ts) for v in ("block", "allow")}
    n = Counter(rules[r] for _, _, _, r, _ in pages if r)
    known = set(held["block"]) | set(held["allow"])
    size = {v: sum(held[v].values()) + len(known) for v in held}
    for page_id, host, path, rule, tokens in pages:
        seen = [log((held["block"][t] + 1) / size["block"]) - log((held["allow"][t] + 1) / size["allow"]) for t in tokens if t in known]
        s = log(n["block"] / n["allow"]) + sum(seen) if seen and len(n) == 2 else 0.0
        yield page_id, host, path, rule, rules[rule] if rule else "block" if s > 1e-9 else "allow", round(s, 6)


def test_url_verdicts_against_brute_force(spark):
    """All columns, over given pages and odd ones: nulls, ties, repeats, upper case, ports, long names, other columns."""
    given = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = [(r.page_id, r.url, r.html) for r in given]
    rows += [(None, "http://A.B.ORG/FR/x1", "<b>cheap pills</b> shop"), (900, "ftp://cheappills.net:80/winmoney99/", None), (901, "http://shopcheap.info/pillsshop", ""), (901, "http://shopcheap.info/pillsshop", ""), (902, None, "x"), (903, "://", None), (904, "http://" + "cheap" * 900 + ".info/" + "z" * 3000, None), (905, "http://net/?q", None), (906, "http://x.example.com/de/cheappills", None)]
    pages = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "page_id long, url string, html string, host string, score double")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6)) for r in url_filter.judged(pages).collect()]
    order = lambda r: tuple(map(str, r))
    assert sorted(got, key=order) == sorted(brute_verdicts(rows), key=order)


def brute_components(rows, n, percent):
    sets, parent = {}, {}
    for doc_id, text, *_ in rows:
        w = [x.lower() for x in split(text)]
        sets[doc_id] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset()
        parent[doc_id] = doc_id

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, docs, empty, n, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "PART", 3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(docs, n, percent).collect()}
    assert got == brute_components(made_docs(), n, percent)
    assert jaccard_join.near_components(empty, n, percent).count() == 0


def test_jaccard_near_copy_group(spark):
    """A large group whose members are near its base but mostly not near each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_components(df, 4, 85).collect()} == brute_components(rows, 4, 85)


def test_boundary_follows_the_cost():
    assert jaccard_join.choose_boundary({}, 85) == 0
    few, many = jaccard_join.choose_boundary({30: 1000}, 85), jaccard_join.choose_boundary({5: 1000, 30: 10}, 85)
    assert many >= 5 and few < 30
    for a in range(1, 60):
        for b in range(a, 80):
            o = jaccard_join.least_overlap(a, b, 85)
            assert 100 * o >= 85 * (a + b - o) and (o == 0 or 100 * (o - 1) < 85 * (a + b - o + 1))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {a: find(a) for a in parent}


def test_syncmers_are_context_free():
    rng = random.Random(4)
    text = "".join(rng.choice("abcde é漢") for _ in range(400))
    h, p = syncmers.syncmers_of(syncmers._codes(text))
    for a, b in zip(h.tolist(), p.tolist(), strict=True):
        k, at = syncmers.syncmers_of(syncmers._codes(text[b : b + syncmers.K]))
        assert k.tolist() == [a] and at.tolist() == [0]
    single = [i for i in range(400 - syncmers.K + 1) if len(syncmers.syncmers_of(syncmers._codes(text[i : i + syncmers.K]))[0])]
    assert single == p.tolist()


def test_fingerprints(spark, docs, empty):
    rows = sorted((r[0], r[1] or "") for r in made_docs())
    got = {r.doc_id: r for r in syncmers.with_next(docs).collect()}
    assert len(got) == len(rows)
    sk = lambda t: syncmers.sketch(*syncmers.anchors(syncmers._codes(t)))
    for i, (doc_id, text) in enumerate(rows):
        nxt, r = rows[(i + 1) % len(rows)][1], got[doc_id]
        edited = text[: len(text) - len(text) // 4] + nxt[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == syncmers.as_text(sk(text)) and r.edited_fingerprint == syncmers.as_text(sk(edited))
        assert abs(r.near_edited - syncmers.likeness(sk(text), sk(edited))) < 1e-12 and 0 <= r.near_next <= 1
    assert syncmers.with_next(empty).count() == 0
    one = syncmers.with_next(docs.where("doc_id = 60")).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert syncmers.fingerprints(docs).where("doc_id = 60").first().fingerprint == got[60].fingerprint


def test_anchors_and_likeness_by_their_definition():
    """Closed syncmers and likeness again with loops over k-mers and s-mers; only the hash of a run of characters is shared."""
    rng = random.Random(12)
    K, S, mask = syncmers.K, syncmers.S, 2**64 - 1

    def poly(codes):
        total = 0
        for c in codes:
            total = (total * textnum._P + c + 1) & mask
        return total

    mixed = lambda v: int(textnum.mix(np.array([v & mask], np.uint64))[0])

    def plain(text):
        codes, found = [ord(c) for c in text], {}
        for at in range(len(codes) - K + 1):
            inner = [mixed(poly(codes[at + i : at + i + S])) for i in range(K - S + 1)]
            if min(inner) in (inner[0], inner[-1]):
                found.setdefault(mixed(poly(codes[at : at + K]) + K) >> 24, at)
        whole = len(codes)
        for c in codes:
            whole = (whole * textnum._P + c + 1) & mask
        return found or ({mixed(whole) >> 24: 0} if codes else {})

    def alike(a, b):
        if not a or not b:
            return float(len(a) == len(b))
        shared = sorted(a[h] - b[h] for h in a.keys() & b.keys())
        agree = max((sum(s <= t <= s + syncmers.SHIFT_TOLERANCE for t in shared) for s in shared), default=0)
        return agree / len(a.keys() | b.keys())

    texts = ["".join(rng.choice("ab é漢😀") for _ in range(n)) for n in (3, 15, 16, 17, 18, 19, 20, 40, 150)] + ["", "a" * 60, "ab" * 40]
    texts.append(texts[8][:70] + "zz" + texts[8][70:])
    for text in texts:
        h, p = syncmers.sketch(*syncmers.anchors(syncmers._codes(text)))
        assert dict(zip(h.tolist(), p.tolist(), strict=True)) == plain(text), text
    for a in texts:
        for b in texts:
            got = syncmers.likeness(*(syncmers.sketch(*syncmers.anchors(syncmers._codes(t))) for t in (a, b)))
            assert abs(got - alike(plain(a), plain(b))) < 1e-12


def test_buckets_are_even_and_ordered(spark):
    rng = random.Random(5)
    ids = sorted({rng.randrange(10**12) for _ in range(3000)} | set(range(500)))
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "k long")
    bounds = common.id_buckets(df, "k", 37)
    got = {r.k: r.b for r in df.select("k", common.bucket_of("k", bounds).alias("b")).collect()}
    assert got[None] == 0 and all(got[i] == sum(b <= i for b in bounds) for i in ids) and 30 <= len(bounds) <= 36
    assert common.id_buckets(df.limit(0), "k", 5) == [] == common.id_buckets(df, "k", 1)


def test_long_texts_keep_every_anchor():
    rng = random.Random(8)
    passage, a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (900, 30_000, 40_000))
    sk = lambda t: syncmers.sketch(*syncmers.anchors(syncmers._codes(t)))
    one, two = sk(a + passage), sk(passage + b)
    assert len(one[0]) == len(set(syncmers.anchors(syncmers._codes(a + passage))[0].tolist())) > 5_000
    for held in (one, two, sk(""), sk("a"), sk(passage[:20])):
        again = syncmers.read_text(syncmers.as_text(held))
        assert all((x == y).all() for x, y in zip(again, held, strict=True))
    assert len(syncmers.as_text(one)) < 2 * len(a + passage)
    held = len(np.intersect1d(sk(passage)[0], one[0]))
    assert held > 150 and abs(syncmers.likeness(one, two) - held / len(set(one[0].tolist()) | set(two[0].tolist()))) < 1e-3


def test_licences(spark):
    full = license_scan.TEMPLATES["BSD-3-Clause"][2]
    wrapped_mit = "Copyright (c) 2020 Some One\n\n" + "\n".join(re.findall(r"(?s).{1,70}(?:\s|$)", license_scan.TEMPLATES["MIT"][2]))
    rows = [
        (1, "p/LICENSE", "MIT License\nReleased under the MIT License."), (2, "p/a/x.py", "code code code code code code"), (3, "p/a/b/y.py", "Licensed under the Apache License, Version 2.0. " + "More words here and so on. " * 9), (4, "q/z.py", None),
        (5, "p/a/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "p/a/b/c/w.py", ""), (7, None, "some text"), (2, "p/a/x.py", "code code code code code code"), (8, "p/v.py", "A licensee wrote about a licence to drive on roads of the north."),
        (9, "r/LICENSE.md", full), (10, "r/s/t/u.c", "int x;"), (11, "r/s/LICENCE", wrapped_mit), (12, "r/s/a.c", "nothing"), (13, "v/long.txt", "prose words of any kind. " * 20_000 + "Licensed under CC BY 4.0.\n" + "other words. " * 9000 + "\nRights reserved by nobody with any licence of note or permission. "),
        (14, "r/two.c", "Released under the MIT License. And so on. Licensed under CC BY 4.0. " + "and much else. " * 9),
    ]
    files = spark.createDataFrame([(*r, "k", 2.0, "d", True, 3) for r in rows], "file_id long, path string, text string, license string, cosine double, directory string, says boolean, row int")
    got = {r.file_id: (r.license, r.found, r.from_directory) for r in license_scan.scanned(files, "file_id", "path", "text").collect()}
    assert got[1] == ("MIT", "own", None) and got[2] == ("GPL-3.0", "inherited", "p/a") and got[3] == ("Apache-2.0", "own", None) and got[4] == (None, "none", None)
    assert got[5] == ("GPL-3.0", "own", None) and got[6] == ("GPL-3.0", "inherited", "p/a") and got[7] == (None, "none", None) and got[8] == ("MIT", "inherited", "p")
    assert got[9] == ("BSD-3-Clause", "own", None) and got[10] == ("MIT", "inherited", "r/s") == got[12] and got[11] == ("MIT", "own", None)
    assert got[13] == ("CC-BY-4.0", "own", None) and got[14][1] == "own"
    assert license_scan.scanned(files.limit(0), "file_id", "path", "text").count() == 0


def test_warc_round_trip(spark):
    rows = [(3, "u", "aa"), (1, "v\r\n", "aa"), (2, None, None), (9, "q", ""), (None, "z", "aa"), (4, "é", "x" * 200_000), (5, "w", "日本"), (5, "w", "日本")]
    pages = spark.createDataFrame([(*r, "d", "f", 5, None) for r in rows], "page_id long, url string, html string, digest string, first string, size int, refers_to long")
    manifest = warc_zip.write_packages(pages, new_path(spark, "warc"))
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_zip.read_records(warc_zip.record_index(manifest)).collect())
    digest = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    want = [(-1, "aa", "revisit", 1), (1, "aa", "response", None), (2, "", "response", None), (3, "aa", "revisit", 1), (4, "x" * 200_000, "response", None), (5, "日本", "response", None), (5, "日本", "response", None), (9, "", "revisit", 2)]
    assert got == sorted((i, len(s.encode()), digest(s), k, r) for i, s, k, r in want)
    payloads = {r.page_id: bytes(r.payload) for r in warc_zip.read_records(warc_zip.record_index(manifest), True).collect()}
    assert payloads[4] == b"x" * 200_000 and payloads[3] == b""
    for r in manifest.collect():  # another reader agrees, and each record stands alone in the stored member
        z = zipfile.ZipFile(r.path.removeprefix("file://"))
        assert z.testzip() is None and z.namelist() == [warc_zip.ARCHIVE, warc_zip.INDEX] and b"WARC/1.1" in gzip.decompress(z.read(warc_zip.ARCHIVE))
    none = warc_zip.write_packages(pages.limit(0), new_path(spark, "warc"))
    assert none.count() == 0 and warc_zip.read_records(warc_zip.record_index(none)).count() == 0
    limited = warc_zip.write_packages(pages, new_path(spark, "warc"), min_bytes=3)
    assert warc_zip.read_records(warc_zip.record_index(limited)).where("record_type = 'revisit'").count() == 0


def test_zip_reader_takes_plain_zips_and_refuses_packed_members(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("stored.txt", b"abc", zipfile.ZIP_STORED)
        z.writestr("packed.txt", b"abc" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 not the end"[4:]
    with open(path, "rb") as f:
        reader = warc_zip.PackageReader(f, path.stat().st_size)
        assert reader.read("stored.txt") == b"abc"
        with pytest.raises(ValueError):
            reader.read("packed.txt")


def test_mixing_reaches_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.2, 0.2, 0.2], 500)
    soft = spark.createDataFrame([(i, int(rng.integers(0, 300)), [float(v) for v in row]) for i, row in enumerate(p)], "doc_id long, n_tokens long, p array<double>")
    targets = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    out, steps, left = soft_mixing.solve(soft, targets)
    rows = out.collect()
    again = {r.doc_id: r.rate for r in soft_mixing.with_rates(soft, steps).collect()}
    assert all(abs(again[r.doc_id] - r.rate) < 1e-9 for r in rows)
    t = np.zeros(3)
    for r in rows:
        assert r.rate >= 0
        t += r.rate * r.n_tokens * np.array(r.p)
    assert np.abs(t / sum(r.n_tokens for r in rows) - np.array([0.5, 0.3, 0.2])).max() < 1e-5 and max(map(abs, left)) < 1e-5
    none, steps, left = soft_mixing.solve(soft.limit(0), targets)
    assert (none.count(), steps, left) == (0, [], [0.0] * 3)


@pytest.mark.parametrize(("most", "shares"), [(float("inf"), [0.5, 0.3, 0.2]), (1.0, [0.98, 0.01, 0.01])])
def test_mixing_is_the_least_squares(spark, most, shares):
    """Against a plain projected gradient with small steps run to its end, with targets in and out of reach."""
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 60), rng.integers(0, 200, 60)
    p[:5], n[5:8] = p[0], 10**4  # ties and long texts
    soft = spark.createDataFrame([(None if i == 9 else i, int(n[i]), [float(v) for v in p[i]]) for i in range(60)] * 2, "doc_id long, n_tokens long, p array<double>")
    out, _, left = soft_mixing.solve(soft, dict(zip(soft_mixing.DOMAINS, shares, strict=True)), most=most, rounds=60)
    t0 = 2 * n @ p
    want, w = np.array(shares) * t0.sum(), np.ones(60)
    loss = lambda t: (((t - want) ** 2) / t0).sum() / t0.sum()
    for _ in range(20_000):
        w = np.clip(w - 0.3 * p @ ((2 * (w * n) @ p - want) / t0), 0, most)
    got = np.zeros(3)
    for r in out.collect():
        assert 0 <= r.rate <= most
        got += r.rate * r.n_tokens * np.array(r.p)
    assert loss(got) <= loss(2 * (w * n) @ p) + 1e-4 and np.abs((got - want) / t0.sum() - left).max() < 1e-9


def test_mixing_posteriors(spark, docs, empty):
    rows = [(f"good words here number {i}", "clean") for i in range(40)] + [(f"moron idiot {i} words", "toxic") for i in range(40)] + [("X!! " * 5 + f"Y{i}!!", "low") for i in range(40)] + [(None, "clean"), ("odd", None)]
    model = soft_mixing.fit(spark.createDataFrame(rows, "text string, domain string"))
    test = spark.createDataFrame([(1, "an idiot and a moron"), (2, "words that are good"), (3, "Z!! Z!! Z!! Z!!"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, int(np.argmax(r.p))) for r in soft_mixing.posteriors(test, model).collect()}
    assert got[1] == (5, 2) and got[2] == (4, 0) and got[3] == (4, 1) and got[4][0] == 0
    assert soft_mixing.posteriors(empty, model).count() == 0
    bare = soft_mixing.fit(spark.createDataFrame([], "text string, domain string"))
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in soft_mixing.posteriors(docs, bare).collect())


def test_token_frames(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    manifest = token_frames.write_frames(docs, P.path("byte_bpe_50k.json"), new_path(spark, "frames"), file_text_bytes=20_000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_frames.read_frames(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", token_frames._crc).collect()}
    start, want = 0, {}
    for doc_id, text, *_ in sorted(made_docs()):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, token_frames.END_ID], "<u4")
        want[doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert got == want and manifest.count() > 1
    some = token_frames.read_frames(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", token_frames._crc, wanted={0, 33}).collect()
    assert {r.doc_id for r in some} == {0, 33}
    none = token_frames.write_frames(empty, P.path("byte_bpe_50k.json"), new_path(spark, "frames"))
    assert token_frames.read_frames(none, "doc_id long, start long, n_tokens long, ids_crc32 long", token_frames._crc).count() == 0


def test_literals_of_special_tokens_are_their_ids():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), token_frames.ChunkEncoder(P.path("byte_bpe_50k.json"))
    rows = ["a <|endoftext|> b", "<|endoftext|>", "a\n <|endoftext|> \n b", " x<|endoftext|>y z.", "one two <|endoftext |> <|endoftext|>", "one two <|endoftext|>|>", "plain words end.", "  a<|endoftext|><|endoftext|>  ", ""]
    got = [np.frombuffer(ids, f"<u{encoder.width}").tolist() for ids in encoder.block(pa.array(rows))]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, token_frames.END_ID] for t in rows]
    assert got[0][:-1] == [64, 220, 50256, 275]


def test_frames_are_independent_and_checked():
    import io

    sink = io.BytesIO()
    writer = token_frames.FrameWriter(sink, 2, frame_bytes=8)
    for i in range(7):
        writer.add(i, bytes([i, 0]) * (i + 1))
    writer.close()
    raw = sink.getvalue()
    reader = token_frames.FrameReader(io.BytesIO(raw), len(raw))
    assert [(i, d, x.tolist()) for i, d, x in reader.documents({4})] == [(4, 4, [4] * 5)]
    assert [d for _, d, _ in reader.documents()] == list(range(7)) and len(reader.entries) > 3
    damaged = bytearray(raw)
    damaged[len(raw) - 9 - 12 * len(reader.entries) + 8] ^= 1  # a frame's checksum in the seek table
    with pytest.raises(ValueError):
        list(token_frames.FrameReader(io.BytesIO(bytes(damaged)), len(raw)).documents())


def test_knn_held_out(spark, empty):
    from pagewright.llm.common import table

    labels = table(spark, "/root/testdata/sf0.01", "labels")
    got = knn_quality.op9_knn_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.93 and (held[held.quality == 1].predicted == 1).mean() > 0.98 and got.score.between(0, 1).all()
    model = knn_quality.fit(spark.createDataFrame([("a b c", 1), (None, 1)], "text string, label int"))
    assert model == {"label": 1.0} and knn_quality.scored(empty, model).count() == 0
    assert knn_quality.fit(spark.createDataFrame([], "text string, label int")) == {"label": 1.0}


def test_knn_against_a_plain_reading(spark):
    """Terms, weights, cosines, ties and votes again with dictionaries and a loop; the projection alone is the model's."""
    from math import log, log1p

    rng = np.random.default_rng(2)
    made = [" ".join("".join(rng.choice(list("abcé!"), 3)) for _ in range(rng.integers(1, 30))) for _ in range(70)]
    made[5] = made[6] = "tie tie tie"
    labelled = [(t, i % 2) for i, t in enumerate(made[:50])] + [(made[0], 1), (None, 0), ("odd", None), ("odd", 7)]
    model = knn_quality.fit(spark.createDataFrame(labelled, "text string, label int"))
    hash_of = {r.text: r.h for r in spark.createDataFrame([(t or "",) for t, _ in labelled], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    votes = defaultdict(list)
    for t, label in labelled:
        if label in (0, 1):
            votes[t or ""].append(label)
    order = sorted(votes, key=hash_of.get)
    assert np.allclose(model["y"], [np.mean(votes[t]) for t in order]) and 0.5 in model["y"]
    assert abs(np.linalg.norm(model["points"][order.index(made[0])]) - 1) < 1e-4

    few = knn_quality.fit(spark.createDataFrame(labelled, "text string, label int"), max_labelled=12)
    kept = [t for t in order if hash_of[t] % 2**20 < int(2**20 * 1.2 * 12 / 52)][:12]
    assert len(kept) >= 8 and np.allclose(few["y"], [np.mean(votes[t]) for t in kept])

    def place(x):
        data, offs = common.texts(pa.array([x]))
        return knn_quality.term_counts(data, offs)

    def weights(text):
        mix, part = textnum.mix, knn_quality.DIMS // 4
        one = lambda kind, v: kind * part + int(mix(np.array([v], np.uint64))[0] >> np.uint64(52))
        counts, seen, raw, marks = defaultdict(int), {}, text.encode(), []
        for i, w in enumerate(split(text)):
            data, offs = common.texts(pa.array([w.decode()]))
            marks.append(int(textnum.words(data, offs, lower=True)[0][0]))
            back = i - seen[marks[i]] if marks[i] in seen else 0
            seen[marks[i]] = i
            counts[one(2, knn_quality._BACK + back.bit_length())] += 1
        for m in marks:
            counts[one(0, (m + 1) % 2**64)] += 1
        for m, k in zip(marks[:-1], marks[1:], strict=True):
            counts[one(1, (m * textnum._P + k) % 2**64)] += 1
        for i in range(len(raw) - 2):
            counts[one(3, int.from_bytes(raw[i : i + 3], "big") + (1 << 40))] += 1
        assert {int(t): int(c) for t, c in zip(*place(text)[1:], strict=True)} == dict(counts)
        return counts

    docs_with = defaultdict(int)
    for t in order:
        for k in weights(t):
            docs_with[k] += 1

    def vector(text):
        x = np.zeros(knn_quality.DIMS)
        for k, c in weights(text).items():
            x[k] = log1p(c) * (log((1 + len(order)) / (1 + docs_with[k])) + 1 if docs_with[k] >= 2 else 0)
        kinds = x.reshape(4, -1)
        x = (kinds / np.maximum(np.linalg.norm(kinds, axis=1, keepdims=True), 1e-9)).reshape(-1)
        x = x @ model["projection"] if x.any() else None
        return None if x is None else x / max(np.linalg.norm(x), 1e-9)

    rows = [(i, t, 9.0) for i, t in enumerate([*made[50:], "", None, made[0], made[5], "tie tie tie", "q" * 50_000])]
    got = {r.doc_id: r.score for r in knn_quality.scored(spark.createDataFrame(rows, "doc_id long, text string, score double"), model).collect()}
    for doc_id, text, _ in rows:
        x = vector(text or "")
        if x is None:
            assert got[doc_id] == model["label"]
            continue
        sims = model["points"] @ x
        near = sorted(range(len(order)), key=lambda j: (-round(float(sims[j]), 5), j))[: knn_quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0) + 1e-12
        edge = np.sort(sims)[::-1][knn_quality.NEIGHBOURS - 1 : knn_quality.NEIGHBOURS + 1]
        if edge[0] - edge[1] > 1e-4:
            assert abs(got[doc_id] - (w * model["y"][near]).sum() / w.sum()) < 1e-3


def test_bpe_equals_the_library(spark, docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path, P.PATTERN).collect()}
    for doc_id, text, *_ in made_docs():
        ids = library.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()), text
    assert bpe.digests(empty, path, P.PATTERN).count() == 0
    row = bpe.encoded(docs.where("doc_id = 12"), path, P.PATTERN).first()
    assert bytes(row.decoded).decode() == made_docs()[4][1] and row.ids == ",".join(map(str, library.encode_ordinary(made_docs()[4][1])))


#: Pieces of odd texts: kinds of white space, contractions, signs, digits, marks and characters of several bytes.
ODD = ["a", "b", "é", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "'", "'s", "'ll", "1", "22", "!", "?!", "漢", "\x1c", "\x00", "\x7f", "\u200b", "the", "don't", "😀", "\u0301", "²", "Ⅷ", "_", "`", "\u0085", "\u2028"]


def test_chunks_are_cut_where_no_match_goes_on():
    """Encoding by chunks equals both libraries on odd texts, alone and as rows of one block."""
    import tiktoken
    from tokenizers import Tokenizer

    rng, path = random.Random(6), P.path("byte_bpe_multi_50k.tiktoken")
    rows = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(4000)]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = list(bpe.Encoder(path, P.PATTERN).block(pa.array(rows)))
    for text, (n, ids, raw) in zip(rows, got, strict=True):
        want = library.encode_ordinary(text)
        assert (n, ids.decode(), raw.decode()) == (len(want), ",".join(map(str, want)), text), repr(text)
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoder = token_frames.ChunkEncoder(P.path("byte_bpe_50k.json"))
    for text, ids, want in zip(rows, encoder.block(pa.array(rows)), other.encode_batch_fast(rows, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, f"<u{encoder.width}").tolist() == [*want.ids, token_frames.END_ID], repr(text)


def test_long_matches_take_time_by_their_length():
    import time

    import tiktoken

    rng, path = random.Random(7), P.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(path, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = ["".join(rng.choice(letters + letters.upper() + "0123456789+/") for _ in range(1_000_000)), "".join(rng.choice(letters) for _ in range(1_000_000)), "a" * 200_001, "thequickbrownfox" * 20_000, "漢字" * 50_000, "éa" * 3000]
    began = time.process_time()
    got = list(encoder.block(pa.array(rows)))
    assert time.process_time() - began < 60
    for text, (n, ids, raw) in zip(rows, got, strict=True):
        want = library.encode_ordinary(text)
        assert n == len(want) and ids.decode() == ",".join(map(str, want)) and raw.decode() == text
    assert max(map(len, encoder.results.held)) <= 64 and encoder.results.size < 1 << 26  # long chunks aren't kept


def test_results_are_kept_in_a_bounded_table(monkeypatch):
    from pagewright.llm import chunks

    results = chunks.Results(lambda new: [c.upper() for c in new], kept_bytes=50_000)
    for k in range(40):
        column = pa.array([f"if  x{i}k{k}:\n        return  y" for i in range(100)])
        raw, at = chunks.joined(results, *common.texts(column))
        assert [bytes(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)] == [v.upper().encode() for v in column.to_pylist()]
        assert results.size < 110_000
    data, offs = common.texts(pa.array(["  a b", "", "c\u3000 d e", None, "x"]))
    bounds = chunks.cuts(data, offs).tolist()
    assert [bytes(data[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == ["  a", " b", "c\u3000 d", " e", "x"]
