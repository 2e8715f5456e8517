"""Manifest, filter audit and toxicity against plain readings of what they compute."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import filter_audit, merkle_manifest, toxicity

from .test_operators import DOCS, made_docs

LABELS = "doc_id long, quality int, toxic int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def odd_docs():
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    found = made_docs(7, 80)
    extra = [(None, "No Id", "en", "s1", 3, "k", 1, 1), (None, "No Id", "en", "s1", 3, "k", 1, 1), (None, None, None, None, None, None, None, None), (5, "SAME text", "en", "s1", 9, "k", 1, 1), (5, "SAME text", "en", "s1", 9, "k", 1, 1), (5, "other", "de", "", 9, "k", 1, 1), (10, "Ünï CODE", "", "é", 8, "k", 1, 1)]
    return found + extra


# ---- manifest


def plain_tree(level):
    """Root, and for each leaf its siblings by level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            first = p // 16 * 16
            paths[i].append((level[first:p], level[p + 1 : first + 16]))
            at[i] = p // 16
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0] if level else "", paths


def plain_manifest(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for doc_id, text, lang, source, n_chars, *_ in docs:
        own = [doc_id, source, lang, n_chars]
        leaf = H(*map(field, [*own, text]))
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        lower = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        sources.setdefault(source, []).append((doc_id, leaf, H(*map(field, [*own, lower])) if tampered else leaf))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = plain_tree([leaf for _, leaf, _ in sources[s]])
    root, tops = plain_tree([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for (doc_id, leaf, changed), path in zip(sources[s], trees[s][1], strict=True):
            end = changed
            for before, after in path + top:
                end = H(*before, end, *after)
            yield doc_id, leaf, trees[s][0], root, H(*(d for b, a in path + top for d in b + a)), end, end == root


def checked_manifest(spark, docs):
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    got = merkle_manifest.proofs(*merkle_manifest.manifest(merkle_manifest.documents_leaves(frame))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(plain_manifest(docs), key=key)
    return got


def test_manifest_of_odd_rows(spark):
    got = checked_manifest(spark, odd_docs())
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_several_rounds(spark):
    """A source above one block, whose last run at each level is short; as many sources as give their tree two levels."""
    docs = [(i, f"T{i}", "en", "big", i, None, None, None) for i in range(merkle_manifest.BLOCK * 2 + 17)]
    docs += [(10**6 + i, "A", "en", f"s{i % 40}", 1, None, None, None) for i in range(300)] + [(10**7, "lone", None, None, None, None, None, None)]
    checked_manifest(spark, docs)


def test_manifest_of_one_and_of_none(spark):
    checked_manifest(spark, [(1, "A", "en", "s", 1, None, None, None)])
    checked_manifest(spark, [])


def test_addresses_are_a_layout():
    """Each node has a place of its own, subtrees of half height are contiguous, and the root is first."""
    for n in (1, 2, 16, 17, 255, 256, 257, 4095, 4096):
        h = merkle_manifest.height(n)
        places = merkle_manifest.addresses(n, h)
        assert sorted(np.concatenate(places)) == list(range(merkle_manifest.nodes_in(n, h)))
        assert places[h][0] == 0
    places = merkle_manifest.addresses(4096, 3)
    upper = np.concatenate([places[3], places[2]])
    assert sorted(upper) == list(range(17))
    for i in range(256):
        lower = np.concatenate([places[1][i : i + 1], places[0][i * 16 : i * 16 + 16]])
        assert sorted(lower) == list(range(lower.min(), lower.min() + 17)) and lower[0] == lower.min()
    deep = [merkle_manifest.address(level, np.arange(-(-70000 // 16**level)), 70000, 5) for level in range(6)]
    assert sorted(np.concatenate(deep)) == list(range(merkle_manifest.nodes_in(70000, 5)))


# ---- filter audit


def plain_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    fails = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        fails.append((lang or "", {k for k, v in f.items() if v}, doc_id in good, doc_id in toxic))
    for part in {f[0] for f in fails}:
        mine, out, shapley = [f for f in fails if f[0] == part], [], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                shapley[letter] += len(gone)
                out.append((letter, part, "".join(order), step, len(left), len(gone), sum(letter in f[1] for f in mine) - len(gone), sum(f[1] == {letter} for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)))
        yield from ((*r[1:], shapley[r[0]]) for r in out)


def test_audit_of_odd_rows(spark):
    rng = random.Random(3)
    docs = odd_docs() + [(1000 + i, rng.choice(["A B # c", "word " * 250, "a b c", "x * y", " ".join(f"w{j}" for j in range(220))]), rng.choice(["en", "de", None, ""]), "s", 1, None, None, None) for i in range(200)]
    labels = [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs] + [(1003, 0, 0), (1003, 1, 1), (None, 1, 1), (99999, 1, 1)]
    got = filter_audit.audit(filter_audit.cells(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)), "ABCDE").collect()
    assert sorted(map(tuple, got)) == sorted(plain_audit(docs, labels))


def test_audit_of_none(spark):
    assert filter_audit.audit(filter_audit.cells(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)), "ABCDE").collect() == []


def test_survivors_are_those_of_each_set():
    counts = np.random.default_rng(1).integers(0, 9, (3, 32, 3))
    got = filter_audit.survivors(counts)
    for active in range(32):
        assert (got[:, active] == counts[:, [m for m in range(32) if not m & active]].sum(axis=1)).all()


# ---- toxicity


def plain_subwords(text):
    clean = re.sub(r"[\W_]+", " ", text.lower()).strip()
    spaced = f" {clean} "
    return [spaced[i : i + n] for n in range(3, 7) for i in range(len(spaced) - n + 1) if " " not in spaced[i + 1 : i + n - 1]]


def test_subwords(monkeypatch):
    """As many as a plain reading finds, the same bucket for the same subword in every text, slice and place."""
    texts = ["idiot", "An IDIOT, says  who?", "", "  ", "a", "é漢字 ü_x", "x" * 50, "one two " * 40]
    whole = [np.concatenate([np.zeros(0, np.int64), *(b[r == i] for r, b in toxicity.subwords(texts))]) for i in range(len(texts))]
    for text, buckets in zip(texts, whole, strict=True):
        assert len(buckets) == len(plain_subwords(text)) and len(set(buckets)) == len(set(plain_subwords(text)))
        alone = np.concatenate([np.zeros(0, np.int64), *(b for _, b in toxicity.subwords([text]))])
        assert sorted(alone) == sorted(buckets)
    assert set(whole[0]) <= set(whole[1])
    keys, counts = toxicity.distinct_subwords(texts)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    monkeypatch.setattr(toxicity, "MERGE", 5)
    again, recounts = toxicity.distinct_subwords(texts)
    assert (keys == again).all() and (counts == recounts).all()


def toxic_rows(rng, n):
    insults, plain = ["scoundrel", "blockhead", "nitwit"], [f"{a}{b}" for a in ("tel", "mar", "con", "vis") for b in ("en", "or", "al", "ta")]
    out = []
    for i in range(n):
        words, bad = [rng.choice(plain) for _ in range(rng.choice([5, 30, 200]))], i % 4 == 0
        for _ in range(3 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_learns_subwords(spark):
    """Misspellings that no label has seen score above clean texts; empty tables and single classes have their scores."""
    model = toxicity.fit(spark.createDataFrame(toxic_rows(random.Random(1), 400), "doc_id long, text string, label int"))
    tests = [(0, "you scoundrell marta telen conor", "k"), (1, "what a blockheadz visal maren", "k"), (2, "telen maral conta visor", "k"), (3, None, "k"), (4, "", "k"), (5, "!!! ???", "k"), (0, "you scoundrell marta telen conor", "k")]
    got = toxicity.scored(spark.createDataFrame(tests, "doc_id long, text string, score string"), model).collect()
    scores = [r.score for r in sorted(got, key=lambda r: r.doc_id)]
    assert scores[0] == scores[1] and min(scores[:3]) > 0.3 > max(scores[3:]) and scores[4] == scores[5] == scores[6]
    one = spark.createDataFrame([("a b c", 1)], "text string, label int")
    assert [r.score for r in toxicity.scored(spark.createDataFrame(tests, "doc_id long, text string, x string"), toxicity.fit(one)).collect()] == [1.0] * 7
    assert toxicity.fit(one.limit(0)) == {"label": 0.0}
    assert toxicity.scored(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_toxicity_scores_are_the_mean_of_vectors(spark):
    model = toxicity.fit(spark.createDataFrame(toxic_rows(random.Random(2), 200), "doc_id long, text string, label int"))
    slots = toxicity._slots(model["buckets"])
    for text in ("a nitwit, telen", "marta", "blockhead " * 30):
        vectors = [model["vectors"][slots[b]].astype(float) for _, bs in toxicity.subwords([text]) for b in bs if slots[b] >= 0]
        z = sum(vectors, np.zeros(toxicity.WIDTH)) / (len(vectors) + toxicity.PAD) @ model["turn"] + model["bias"]
        assert toxicity._score(model, slots, ["x", text])[1] == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), abs=1e-6)


def test_toxicity_held_out(spark):
    """Labels outside the fold alone are learned; those inside are told apart."""
    from pagewright.llm.common import table

    got = toxicity.op13_toxicity(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where(F.col("held_out")).select("score", "predicted", "toxic").toPandas()
    rank = got.score.rank()
    bad = got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    missed, false = int((bad & (got.predicted == 0)).sum()), int((~bad & (got.predicted == 1)).sum())
    print(f"held-out AUC {auc:.4f}, {missed} of {bad.sum()} toxic missed, {false} of {(~bad).sum()} others flagged")
    assert auc > 0.97 and missed <= 12 and false <= 20


# ---- earlier operators


def test_segments_of_long_words(spark):
    """Words of 1 to 2,000 letters: runs hold short and long ones, overlapping and unknown; equal to cutting with all words.
    A run of 100,000 letters makes pieces that grow with its length alone."""
    from pagewright.llm import url_filter

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    words = {word(n): rng.randrange(1, 50) for n in range(1, 2001)}
    longest = sorted(words, key=len)
    runs = ["".join(rng.choice(longest[:60]) for _ in range(30)), longest[900] + longest[40] + longest[1999], longest[24] + longest[23] + longest[25][:20], "a" * 300, "z", longest[24][1:] + longest[30]]
    counts = spark.createDataFrame([*words.items()], "word string, n long")
    got = {r.run: r.words for r in url_filter.segments(spark.createDataFrame([(r,) for r in runs], "run string"), counts).collect()}
    whole = url_filter.Segmenter(words)
    assert got == {r: whole.split(r) for r in runs} and longest[1999] in got[runs[1]]
    far = word(50_000) + longest[1500] + word(50_000)
    held = url_filter.segments(spark.createDataFrame([(far,)], "run string"), counts).first().words
    assert "".join(held) == far and longest[1500] in held


def test_packages_roll_over(spark):
    """A small bound makes a package of every piece; all records come back."""
    from pagewright.llm import warc_zip
    from pagewright.llm.common import new_path

    rng = random.Random(5)
    pages = spark.createDataFrame([(i, f"http://x/{i}", rng.randbytes(4000).hex() if i % 3 else "same") for i in range(3000)], "page_id long, url string, html string").coalesce(1)
    manifest = warc_zip.write_packages(pages, new_path(spark, "warc"), package_bytes=1 << 20)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_records")).first()[0] == 3000
    got = {r.page_id: (r.record_type, r.payload_bytes) for r in warc_zip.read_records(warc_zip.record_index(manifest)).collect()}
    assert got == {i: ("revisit" if i % 3 == 0 and i else "response", 8000 if i % 3 else 4) for i in range(3000)}


def plain_features(text):
    """Hashed words without up to three signs at their end, and shapes whose share of the words reaches a level."""
    import pyarrow as pa

    from pagewright.llm import soft_mixing, textnum
    from pagewright.llm.common import texts as buffers

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    letter = lambda b: chr(b).isalnum() or b >= 128
    bare, found, shapes = [], set(), [0] * soft_mixing.SHAPES
    for w in words:
        end = len(w)
        for _ in range(3):
            if end > 1 and not letter(w[end - 1]):
                end -= 1
        bare.append(w[:end].lower() if w[:end].isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in w[:end]))
        found.add(int(textnum.words(*buffers(pa.array([bare[-1].decode()])))[0][0]) % soft_mixing.HASHED)
        shapes[0] += len(bare) > 1 and bare[-1] == bare[-2]
        shapes[1] += sum(65 <= b <= 90 for b in w[:end]) >= max(2, (end + 1) // 2)
        shapes[2] += end < len(w) and w[-1] not in b".,;:?'\")"
        shapes[3] += len(w) == 1 and not letter(w[0])
    for k, n in enumerate(shapes):
        found |= {soft_mixing.HASHED + k * len(soft_mixing.SHARES) + j for j, least in enumerate(soft_mixing.SHARES) if words and n / len(words) >= least}
    return found, len(words)


def test_mixing_posteriors_against_a_plain_reading(spark):
    """Features, their choice by share, lift and chi-square, and the posteriors of all documents, with dictionaries."""
    from math import exp, log

    from pagewright.llm import soft_mixing

    rng = random.Random(8)
    common, own = [f"word{i}" for i in range(30)], {"clean": ["fine.", "good,"], "low": ["BUY", "BUY", "NOW!!!", "***"], "toxic": ["nitwit", "blockhead!"]}
    rows = []
    for i in range(300):
        domain = rng.choice(["clean", "clean", "low", "toxic"])
        rows.append((" ".join(rng.choice(common + own[domain] * 4) for _ in range(rng.choice([3, 12, 40]))), domain))
    rows += [(None, "clean"), ("", "low"), ("Ünï ünï", "clean"), ("a b", None), ("a b", "other")]
    model = soft_mixing.fit(spark.createDataFrame(rows, "text string, domain string"))
    docs = {d: sum(x == d for _, x in rows) for d in soft_mixing.DOMAINS}
    total, held = sum(docs.values()), {d: Counter() for d in soft_mixing.DOMAINS}
    for text, domain in rows:
        if domain in docs:
            held[domain].update(plain_features(text)[0])
    used = set()
    for f in set().union(*held.values()):
        for d, n in docs.items():
            a, b = held[d][f], sum(held[o][f] for o in docs if o != d)
            c, e = n - a, total - n - b
            if a >= max(2, soft_mixing.LEAST_SHARE * n) and (a / n) / ((b + 0.5) / (total - n + 1)) >= soft_mixing.LEAST_LIFT and total * (a * e - b * c) ** 2 > soft_mixing.LEAST_CHI * ((a + b) * (c + e) * (a + c) * (b + e)):
                used.add(f)
    assert used and used == set(model["used"].tolist())
    tests = [(i, t) for i, (t, _) in enumerate(rows)]
    for r in soft_mixing.posteriors(spark.createDataFrame(tests, "doc_id long, text string"), model).collect():
        mine, n_words = plain_features(tests[r.doc_id][1])
        odds = [log(n / total) + (sum(log((held[d][f] + 0.5) / (n + 1)) if f in mine else log(1 - (held[d][f] + 0.5) / (n + 1)) for f in used) if n_words else 0) for d, n in docs.items()]
        want = [exp(z - max(odds)) for z in odds]
        assert r.n_tokens == n_words and all(abs(p - w / sum(want)) < 1e-9 for p, w in zip(r.p, want, strict=True))


def test_worst_of_several_labels_counts(spark):
    from pagewright.llm import soft_mixing

    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (2, 1, 1), (3, 1, 0), (3, None, None), (4, None, 0), (None, 1, 1)], LABELS)
    assert sorted(map(tuple, soft_mixing.labelled_docs(docs, labels).collect())) == [("a", "low"), ("b", "toxic"), ("c", "clean")]


def test_ids_that_are_null_or_repeated(spark):
    """Fingerprints and token files of rows without an id, of an id with several texts and of repeated rows, against loops."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from pagewright.llm import syncmers, token_frames
    from pagewright.llm.common import new_path

    texts = [(None, "b" * 40), (None, "abc " * 30), (None, None), (7, "xyz " * 25), (7, "one two " * 20), (7, "xyz " * 25), (3, "q"), (3, "q"), (9, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    hashed = {r.text: r.h for r in spark.createDataFrame([(t or "",) for _, t in texts], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    order = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in syncmers.with_next(frame, range_bytes=64).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    path = P.path("byte_bpe_50k.json")
    library, at, rows = Tokenizer.from_file(path), 0, []
    for i, t in order:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        rows.append((i, at, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        at += len(ids)
    held = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_frames.read_frames(token_frames.write_frames(frame, path, new_path(spark, "frames")), "doc_id long, start long, n_tokens long, ids_crc32 long", token_frames._crc).collect()]
    assert sorted(held, key=str) == sorted(rows, key=str)


def test_licences_by_tag_and_by_text(spark):
    """Tags with short names and suffixes, notices of the GNU family, short texts; equal cosines go to the first name."""
    from pagewright.llm import license_scan

    texts = {
        "a/1.py": ("# SPDX-License-Identifier: MIT\nimport x", "MIT"), "a/2.py": ("// spdx-license-identifier: Apache-2.0\n", "Apache-2.0"), "a/3.py": ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"), "a/4.py": ("SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0"),
        "a/5.py": ("SPDX-License-Identifier: AGPL-3.0+", "AGPL-3.0"), "z/6.py": ("SPDX-License-Identifier: Nobody-1.0 words of another kind that fill this sentence up", None), "b/LICENSE": (license_scan.TEMPLATES["LGPL-3.0"][-1], "LGPL-3.0"), "b/x.c": ("int main;", "LGPL-3.0"),
        "c/LICENSE": (license_scan.TEMPLATES["Unlicense"][-1], "Unlicense"), "d/COPYING": (license_scan.TEMPLATES["AGPL-3.0"][-1], "AGPL-3.0"), "e/LICENSE.txt": (license_scan.TEMPLATES["0BSD"][-1], "0BSD"), "f/x.py": ("/* " + license_scan.TEMPLATES["GPL-3.0"][-1] + " */", "GPL-3.0"),
        "g/none.py": ("no word of that kind", None), "h/null.py": (None, None),
    }
    frame = spark.createDataFrame([(i, path, text) for i, (path, (text, _)) in enumerate(texts.items())], "n int, path string, text string")
    got = {r.path: r.license for r in license_scan.scanned(frame, "n", "path", "text").collect()}
    assert got == {path: want for path, (_, want) in texts.items()}
    twice = {name: (license_scan.TEMPLATES["MIT"][0],) for name in ("Zed", "Abe")}
    held, license_scan.TEMPLATES = license_scan.TEMPLATES, twice
    try:
        assert [r.license for r in license_scan.scanned(frame.limit(0).unionByName(spark.createDataFrame([(1, "x/y", twice["Zed"][0])], "n int, path string, text string")), "n", "path", "text").collect()] == ["Abe"]
    finally:
        license_scan.TEMPLATES = held
