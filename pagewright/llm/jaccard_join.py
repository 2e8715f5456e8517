"""N-gram Jaccard join: size-aware, with light and heavy sets.

Sets of distinct n-word shingles link when 100 * intersection >= percent * union. Equal sets are one class from the
start, so copies are never paired. Light sets (size up to a boundary) enumerate their subsets of each overlap size that
a link with a light set needs; sets that link share one such subset. Heavy sets, and light ones in reach of a heavy one,
enter the inverted lists of a prefix of their elements (in one global order, frequent elements last) long enough that
sets that link share an element of it. The boundary is the size at which the measured sizes cost least: a subset is one
entry, a list entry also costs a scan of its list, whose length is measured over a share of the shingles.

Lists are scanned in three passes, so a large group of near copies doesn't make all its pairs. First each list's members
are paired with one pivot (its smallest); links give components. Lists whose members are all in one component are done.
In the long ones of the rest, a member outside the list's largest component is then paired with its nearest one of
another component, by outlines; links join components. Last, members of one list that are still in different components
are paired. Long lists are dealt into blocks of members to compare, so no task holds a whole one; that a list's entries have
neighbours of their size is found before by streaming it, two rows at a time.

Pairs are ruled out by the bound of positions and shared elements, and by outlines: counts of a set's elements in equal
ranges of the hashes, whose differences add up to no more than the sets' symmetric difference has elements. What is left
is checked exactly on the full sets. No cap is set on lists, partners or candidates.

Defined results: null and blank texts have no shingles and are alone; a text of fewer than n words has one shingle, its
whole sequence; repeated rows are copies of each other; a null id is in its class's component, which is null if all its
ids are; an empty table gives an empty result; other columns are ignored. Shingles are compared by 64-bit hashes."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import in_tasks, pieces, table, texts, written
from .components import connected_components

#: Largest size that may be light: beyond it a set of 85 % or less would have more subsets than any list is long.
MOST_LIGHT = 40
#: Shingles of the highest counts, which come last in the global order; they decide nothing else.
MOST_FREQUENT = 1 << 17
LEAST_FREQUENT = 8
#: One shingle in so many is counted in full to measure the lists.
MEASURED = 64
PIVOT_SHARE = 256
#: Rows that a pair counts for, as it carries outlines or whole sets (in_tasks).
OUTLINE_ROWS, SET_ROWS = 4, 32
#: Lists of more members are dealt into blocks: minor members (outside the largest component) and parts of all members.
LONG_LIST = 32
BLOCK = 2048
PART = 2048
#: Bytes of the outlines that long lists carry.
SHORT_OUTLINE = 128
#: Of its long lists, so many (the least keys) are named with each member, so that a pair that shares several leaves once.
NAMED_LISTS = 16
#: Rows of ids that are broadcast; beyond that texts are shuffled by id.
BROADCAST_IDS = 2_000_000


def least_overlap(a: int, b: int, percent: int) -> int:
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(s: int, percent: int) -> int:
    return s - (percent * s + 99) // 100 + 1


def subset_sizes(s: int, boundary: int, percent: int) -> list[int]:
    """Overlaps that a light set of size s may need with a light set."""
    partners = range((percent * s + 99) // 100, min(boundary, 100 * s // percent) + 1)
    return sorted({least_overlap(s, b, percent) for b in partners})


def choose_boundary(sizes: dict[int, int], percent: int, list_length: float = 1.0) -> int:
    """The light sets' largest size: least entries to make and scan, over the counts of the sizes up to 2 * MOST_LIGHT.

    list_length: entries that a heavy set's entry meets in its list, itself included."""

    def cost(x: int) -> float:
        light = sum(n * sum(comb(s, o) for o in subset_sizes(s, x, percent)) for s, n in sizes.items() if s <= x)
        heavy = sum(n * (1.0 + list_length) * prefix_length(s, percent) for s, n in sizes.items() if s >= (percent * (x + 1) + 99) // 100)
        return light + heavy

    return min(range(MOST_LIGHT + 1), key=lambda x: (cost(x), x))


def _set_hash(s) -> int:
    import numpy as np

    total = np.add.reduce(textnum.mix(s + np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64) + np.uint64(len(s))
    return int(textnum.mix(np.array([total], np.uint64)).view(np.int64)[0])


def outline_of(tokens) -> bytes:
    """Counts of a set's elements in 2**k equal ranges of the hashes, two to four elements in each on average; nothing if a
    count doesn't fit into a byte."""
    import numpy as np

    k = max(5, (max(1, len(tokens) // 4) - 1).bit_length())
    counts = np.bincount((tokens >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
    return counts.astype(np.uint8).tobytes() if not len(tokens) or counts.max() < 256 else b""


def folded(counts, size: int):
    """An outline's counts over fewer, larger ranges."""
    import numpy as np

    return counts if len(counts) <= size else np.add.reduceat(counts, np.arange(0, len(counts), len(counts) // size))


def may_differ(na, nb, percent: int):
    """Elements that the symmetric difference of linked sets may have at most; numbers or arrays."""
    return na + nb - 2 * (-(-percent * (na + nb) // (100 + percent)))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, its hash, and a key to find a set's text again: the id, or else that hash."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64(text)).alias("at"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def set_stats(source: DataFrame, n: int) -> DataFrame:
    """(doc_id, at, text_hash, n, h, outline) of each document: its set's size, hash and outline. Rows with block hold shingles (h) and
    how often (n) a block's distinct sets hold them: those in the least quarter of the hashes, as prefixes seldom reach
    beyond, that occur twice or more; and in the least share MEASURED of the hashes all."""
    names = ["doc_id", "at", "text_hash", "n", "h", "outline", "block"]

    def run(batches):
        import numpy as np

        held, size, seen = [], 0, set()

        def repeats():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, int))
            often = (counts >= 2) | (tokens < np.uint64((1 << 64) // MEASURED))
            tokens, counts = tokens[often].view(np.int64), counts[often]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(counts.astype(np.int64)), pa.array(tokens), pa.nulls(len(tokens), pa.binary()), pa.array(np.ones(len(tokens), bool))], names)

        for batch in batches:
            for piece in pieces(batch):
                sets = textnum.shingle_sets(*texts(piece.column(3)), n)
                hashes = [_set_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.int64()), pa.array([outline_of(s) for s in sets], pa.binary()), pa.array(np.zeros(len(sets), bool))], names)
                for s, h in zip(sets, hashes, strict=True):
                    if len(s) and h not in seen:
                        seen.add(h)
                        held.append(s[: np.searchsorted(s, np.uint64(1 << 62))])
                        size += len(held[-1])
                if size > 1 << 20:
                    yield repeats()
                    held, size, seen = [], 0, set()
        yield repeats()

    return source.mapInArrow(run, "doc_id long, at long, text_hash long, n long, h long, outline binary, block boolean")


@lru_cache(256)
def _left_out(s: int, r: int):
    """Places of r of s elements, in all ways."""
    import numpy as np

    return np.array(list(combinations(range(s), r)), np.int64).reshape(-1, r)


def postings(source: DataFrame, n: int, percent: int, boundary: int, frequent) -> DataFrame:
    """(key, h, n, pos) of every set: its prefix's elements with their places, and a light set's subsets. Copies that one
    task meets enter once."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)
    reach = (percent * (boundary + 1) + 99) // 100
    sizes = {s: subset_sizes(s, boundary, percent) for s in range(1, boundary + 1)}

    def run(batches):
        import numpy as np

        hot, done = shared.value, set()
        for batch in batches:
            for piece in pieces(batch):
                keys, sets_h, sets_n, pos = [], [], [], []
                if len(done) > 1 << 18:
                    done.clear()

                def put(k, h, s, p):
                    keys.append(k)
                    sets_h.append(np.full(len(k), h, np.int64))
                    sets_n.append(np.full(len(k), s, np.int32))
                    pos.append(p)

                for tokens in textnum.shingle_sets(*texts(piece.column(0)), n):
                    s = len(tokens)
                    if not s or (h := _set_hash(tokens)) in done:
                        continue
                    done.add(h)
                    if s <= boundary:
                        coded = textnum.mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                        total = np.add.reduce(coded)
                        for o in sizes[s]:
                            k = total - coded[_left_out(s, s - o)].sum(1, dtype=np.uint64) if o < s else np.array([total])
                            put(textnum.mix(k + np.uint64(o)), h, s, np.full(len(k), -1, np.int32))
                    if s >= reach:
                        p = prefix_length(s, percent)
                        if len(hot):
                            is_hot = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                            tokens = np.concatenate([tokens[~is_hot][:p], tokens[is_hot][:p]])
                        put(tokens[:p], h, s, np.arange(p, dtype=np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sets_h)), pa.array(np.concatenate(sets_n)), pa.array(np.concatenate(pos))], ["key", "h", "n", "pos"])

    return source.select("text").mapInArrow(run, "key long, h long, n int, pos int")


def shared_lists(entries: DataFrame, percent: int) -> DataFrame:
    """The entries of lists whose neighbours by size are near enough to link; one of each (key, h), with the list's first
    entry (p, pn) as its pivot. Streams sorted lists; what is held is two rows and one pivot."""

    def run(batches):
        import numpy as np

        held, pivot = None, (None, 0, 0)  # the last two rows so far, the first of them decided; key, h and n of the last pivot

        def decide(cols, n_known, last):
            nonlocal pivot
            key, _, n, _ = cols
            near = (key[1:] == key[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            keep = np.zeros(len(key), bool)
            keep[1:] |= near
            keep[:-1] |= near
            keep[:n_known] = False
            if not last:
                keep[-1] = False
            key, h, n, pos = (c[keep] for c in cols)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            ph, pn = h[first].copy(), n[first].copy()
            if len(key):
                if pivot[0] == key[0]:
                    ph[0], pn[0] = pivot[1:]
                pivot = (key[-1], ph[-1], pn[-1])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, h, n, pos, ph[group], pn[group])], ["key", "h", "n", "pos", "p", "pn"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            known = 0
            if held is not None:
                known = len(held[0]) - 1
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[new] for c in cols]
            if len(cols[0]):
                yield decide(cols, known, False)
                held = [c[-2:].copy() for c in cols]
        if held is not None:
            yield decide(held, len(held[0]) - 1, True)

    return entries.repartition("key").sortWithinPartitions("key", "n", "h").mapInArrow(run, "key long, h long, n int, pos int, p long, pn int")


def full_sets(source: DataFrame, ats: DataFrame, n: int) -> DataFrame:
    """(h, tokens) of the documents in ats. Up to BROADCAST_IDS of them are broadcast, so that texts stay where they are."""
    picked = source.join(F.broadcast(ats) if ats.count() <= BROADCAST_IDS else ats, "at", "left_semi")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                sets = textnum.shingle_sets(*texts(piece.column(0)), n)
                yield pa.RecordBatch.from_arrays([pa.array([_set_hash(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["h", "tokens"])

    return picked.select("text").mapInArrow(run, "h long, tokens binary")


def _streamed(pairs: DataFrame, payloads: DataFrame, columns: list[str], read, test, n_rows: int) -> DataFrame:
    """The pairs (a, b) whose payloads pass test(read(row of a), read(row of b)). payloads: h and columns. n_rows: see in_tasks.

    Partners stream past a's payload, which alone is held; an a with many partners is dealt into shares."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / PIVOT_SHARE).cast("int").alias("shares"))
    of_b = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), F.col("b").alias("h"))
    of_a = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col("a").alias("h"))
    rows = of_b.withColumn("second", F.lit(True)).unionByName(of_a.withColumn("second", F.lit(False))).join(payloads, "h")

    def run(batches):
        mine, own = None, None
        for batch in batches:
            a, b = [], []
            parts = batch.columns[4:]
            for i, (pivot, share, h, second) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                if not second:
                    mine, own = (pivot, share), read(parts, i)
                elif mine == (pivot, share) and test(own, read(parts, i)):
                    a.append(pivot)
                    b.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = in_tasks(rows.select("a", "share", "h", "second", *columns).repartition("a", "share"), n_rows)
    return dealt.sortWithinPartitions("a", "share", "second", "h").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """The pairs (a, b), n_pairs in all, whose full sets link."""

    def read(parts, i):
        import numpy as np

        return np.frombuffer(parts[0][i].as_py(), np.uint64)

    def test(x, y):
        import numpy as np

        shared = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * shared >= percent * (len(x) + len(y) - shared)

    return _streamed(pairs, sets, ["tokens"], read, test, SET_ROWS * n_pairs)


def may_link(pairs: DataFrame, classes: DataFrame, percent: int, n_pairs: int) -> DataFrame:
    """The pairs (a, b), n_pairs in all, that their sets' outlines (h, n, outline) don't rule out."""

    def read(parts, i):
        import numpy as np

        return parts[0][i].as_py(), np.frombuffer(parts[1][i].as_py(), np.uint8).astype(np.int64)

    def test(x, y):
        import numpy as np

        (na, a), (nb, b) = x, y
        size = min(len(a), len(b))
        return not size or np.abs(folded(a, size) - folded(b, size)).sum() <= may_differ(na, nb, percent)

    return _streamed(pairs, classes, ["n", "outline"], read, test, OUTLINE_ROWS * n_pairs)


def open_lists(lists: DataFrame, comps: DataFrame) -> DataFrame:
    """The entries of lists whose members are in two components or more, with comp, the list's largest component (major),
    its members and its minor members (outside major)."""
    placed = lists.select("key", "h", "n", "pos").join(comps.withColumnsRenamed({"node": "h", "component": "comp"}), "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    each = placed.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("members"), F.count("*").alias("comps"))
    several = each.where("comps > 1").select("key", F.col("most.comp").alias("major"), "members", (F.col("members") - F.col("most.c")).alias("minors"))
    return placed.join(several, "key")


def _bound(na, nb, pa_, pb, percent: int):
    """Whether sets that share the elements at places pa_ and pb of their prefixes may link; -1 for a shared subset."""
    import numpy as np

    most = np.minimum(pa_, pb) + 1 + np.minimum(na - 1 - pa_, nb - 1 - pb)
    return (pa_ < 0) | (pb < 0) | (most >= -(-percent * (na + nb) // (100 + percent)))


PAIRS = "a long, b long, na int, nb int, pa int, pb int"


def _pairs(x, y, i, j):
    """Rows of PAIRS for members i of x and j of y (h, n and pos each), the smaller hash as a."""
    import numpy as np

    left, right = [c[i] for c in x[:3]], [c[j] for c in y[:3]]
    flip = right[0] < left[0]
    columns = [np.where(flip, v, u).astype(t) for u, v, t in zip(left, right, (np.int64, np.int32, np.int32), strict=True)], [np.where(flip, u, v).astype(t) for u, v, t in zip(left, right, (np.int64, np.int32, np.int32), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for ab in zip(*columns, strict=True) for c in ab], ["a", "b", "na", "nb", "pa", "pb"])


def pairs_of_short(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one list in different components that may link; lists of up to LONG_LIST members."""

    def run(batches):
        import numpy as np

        tail = None
        for batch in _and_none(batches):
            if batch is None:
                cols = tail
            else:
                cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                if tail is not None:
                    cols = [np.concatenate(x) for x in zip(tail, cols, strict=True)]
                if not len(cols[0]):
                    continue
                start = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on in the next batch
                tail, cols = [c[start:] for c in cols], [c[:start] for c in cols]
            if cols is None or not len(cols[0]):
                continue
            key, h, n, pos, comp = cols
            n = n.astype(np.int64)
            for d in range(1, LONG_LIST):
                i = np.flatnonzero((key[d:] == key[:-d]) & (comp[d:] != comp[:-d]) & (100 * n[:-d] >= percent * n[d:]))
                if len(i):
                    i = i[_bound(n[i], n[i + d], pos[i], pos[i + d], percent)]
                    yield _pairs((h, n, pos), (h, n, pos), i, i + d)

    return lists.select("key", "h", "n", "pos", "comp").repartition("key").sortWithinPartitions("key", "n", "h").mapInArrow(run, PAIRS)


def pairs_of_long(lists: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of a minor member of a list and any member of another component that may link; lists above LONG_LIST members.

    Minor members are dealt into blocks, all members into parts; a task's unit is a block and a part of one list. A block
    (some BLOCK members) is held, the part streams past it. nearest: of each minor member, in its first long list, only
    the pair of nearest outlines in each run of members that is compared at once. Else a pair leaves a list only if no lesser
    list that both members name holds it too; its places are given as -1, as its shared elements aren't counted."""
    blocks, parts = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil(F.col("members") / PART).cast("int")
    minor = F.col("comp") != F.col("major")
    entries = lists.withColumn("held", minor)
    if nearest:  # lists that are no minor member's first drop out
        first = lists.groupBy("h").agg(F.min(F.struct("pos", "key")).alias("first")).select("h", F.col("first.key").alias("first"))
        entries = lists.join(first, "h").withColumn("held", minor & (F.col("first") == F.col("key")))
        entries = entries.drop("minors").join(entries.where("held").groupBy("key").agg(F.count("*").alias("minors")), "key")
    named = lists.groupBy("h").agg(F.slice(F.sort_array(F.collect_list("key")), 1, NAMED_LISTS).alias("named"))
    entries = entries.join(classes.select("h", "outline"), "h").join(named, "h")
    names = ["h", "n", "pos", "comp", "outline", "named"]
    left = entries.where("held").select("key", F.pmod(F.xxhash64("h"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("side"), *names)
    right = entries.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.pmod(F.xxhash64("h", F.lit(1)), parts).cast("int").alias("part"), F.when(minor, 2).otherwise(1).alias("side"), *names)

    def arrays(batch):
        import numpy as np

        lines = [np.frombuffer(x, np.uint8) for x in batch.column(8).to_pylist()]
        known = np.array([len(x) > 0 for x in lines], bool)
        outline = np.zeros((len(lines), SHORT_OUTLINE), np.int16)
        for i, x in enumerate(lines):
            if len(x):
                x = folded(x.astype(np.int64), SHORT_OUTLINE)
                outline[i, : len(x)] = np.minimum(x, 1 << 12)
        width = np.array([min(len(x), SHORT_OUTLINE) for x in lines], np.int64)
        own = batch.column(9)
        names = np.full((len(lines), NAMED_LISTS), np.iinfo(np.int64).max)
        ends = np.asarray(own.offsets) - own.offsets[0].as_py()
        names[np.arange(NAMED_LISTS) < np.diff(ends)[:, None]] = np.asarray(own.flatten())
        return [*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (4, 5, 6, 7, 3)), outline, width * known, names]

    def apart(x, y, i, j):
        """Least symmetric difference by outlines, over the ranges that both have."""
        import numpy as np

        out = np.zeros(len(i), np.int64)
        wx, wy = x[6][i], y[6][j]
        for w in np.unique(np.minimum(wx, wy)).tolist():
            if w:
                for some in np.array_split(at := np.flatnonzero(np.minimum(wx, wy) == w), len(at) // 8192 + 1):
                    out[some] = np.abs(_narrow(x[5][i[some]], wx[some], w) - _narrow(y[5][j[some]], wy[some], w)).sum(1, dtype=np.int64)
        return out

    def elsewhere(x, y, i, j, key):
        """Which pairs share a named list of lesser key."""
        import numpy as np

        out = np.zeros(len(i), bool)
        for at in range(0, len(i), 4096):
            a, b = x[7][i[at : at + 4096]], y[7][j[at : at + 4096]]
            out[at : at + 4096] = ((a[:, :, None] == b[:, None, :]) & (a < key)[:, :, None]).any((1, 2))
        return out

    def run(batches):
        import numpy as np

        unit, held = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if keys[s] != unit:
                    unit, held = keys[s], None
                got = arrays(batch.slice(s, e - s))
                mine = got[4] == 0
                if mine.any():
                    some = [c[mine] for c in got]
                    held = some if held is None else [np.concatenate(x) for x in zip(held, some, strict=True)]
                if held is None or mine.all():
                    continue
                got = [c[~mine] for c in got]
                for t in range(0, len(got[0]), 256):
                    y = [c[t : t + 256] for c in got]
                    (h, n, pos, comp), (h2, n2, pos2, comp2) = ([c[:, None] for c in held[:4]], [c[None] for c in y[:4]])
                    fits = (comp != comp2) & (100 * np.minimum(n, n2) >= percent * np.maximum(n, n2)) & _bound(n, n2, pos, pos2, percent)
                    if not nearest:
                        fits &= (y[4] == 1)[None] | (h < h2)
                    i, j = np.nonzero(fits)
                    if not len(i):
                        continue
                    far = apart(held, y, i, j)
                    good = far <= may_differ(held[1][i], y[1][j], percent)
                    i, j, far = i[good], j[good], far[good]
                    if nearest and len(i):
                        order = np.lexsort((y[0][j], far, i))
                        new = np.ones(len(order), bool)
                        new[1:] = i[order][1:] != i[order][:-1]
                        i, j = i[order[new]], j[order[new]]
                    elif len(i):
                        first_here = ~elsewhere(held, y, i, j, unit[0])
                        i, j = i[first_here], j[first_here]
                    if len(i):
                        uncounted = np.full(len(i), -1)
                        yield _pairs([held[0][i], held[1][i], uncounted], [y[0][j], y[1][j], uncounted], np.arange(len(i)), np.arange(len(i)))

    rows = left.unionByName(right).repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", "side")
    return rows.mapInArrow(run, PAIRS)


def _narrow(rows, widths, size: int):
    """Outlines of the given widths, over size ranges."""
    import numpy as np

    out = rows[:, :size].copy()
    for w in np.unique(widths[widths > size]).tolist():
        at = widths == w
        out[at] = rows[at, :w].reshape(int(at.sum()), size, w // size).sum(2, dtype=np.int16)
    return out


def _and_none(batches):
    yield from batches
    yield None


def near_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies) of each document; component_id is the least id reachable by links.

    keys: also the id or else text hash (at), the text's hash and a component that is never null for a set."""
    import numpy as np

    source = _source(docs, id_col, text_col)
    both = written(set_stats(source, n), "sets")
    stats = both.where("not block").drop("block")
    counted = both.where("block").groupBy("h").agg(F.sum("n").alias("c"))
    often = counted.where(F.col("c") >= LEAST_FREQUENT).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT)
    frequent = np.sort(np.array([r.h for r in often.collect()], np.int64).view(np.uint64))
    measured = counted.where((F.col("h") >= 0) & (F.col("h") < (1 << 64) // MEASURED) & (F.col("c") < LEAST_FREQUENT)).agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 1.0
    sizes = {r.n: r.c for r in stats.where(F.col("n").between(1, 2 * MOST_LIGHT)).groupBy("n").agg(F.count_distinct("h").alias("c")).collect()}
    boundary = choose_boundary(sizes, percent, measured)
    classes = written(stats.where("n > 0").groupBy("h").agg(F.min("doc_id").alias("least_id"), F.min("at").alias("at"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("outline").alias("outline")), "classes", stats.count())
    n_classes = classes.count()
    lists = written(shared_lists(postings(source, n, percent, boundary, frequent), percent), "lists")

    def joined(comps: DataFrame | None, pairs: DataFrame, most: int | None = None) -> DataFrame:
        """Components by the edges so far and the pairs that link. most: how many pairs there are at most, if known."""
        pairs = written(pairs, "pairs", most)
        pairs = written(may_link(pairs, classes, percent, pairs.count()), "pairs")
        n_pairs = pairs.count()
        if comps is not None and not n_pairs:
            return comps
        ats = written(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct().join(classes, "h").select("at"), "ids", 2 * n_pairs)
        links = linked(pairs, full_sets(source, ats, n), percent, n_pairs).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if comps is None:
            return connected_components(links, n_pairs)
        links = written(links, "links")
        n_links = links.count()
        if not n_links:
            return comps
        return connected_components(links.unionByName(comps.select(F.col("node").alias("u"), F.col("component").alias("v"))), n_links + n_classes)

    near = 100 * F.col("pn").cast("long") >= percent * F.col("n").cast("long")
    star = lists.where((F.col("h") != F.col("p")) & near).select(F.col("p").alias("a"), F.col("h").alias("b")).distinct()
    first = joined(None, star, lists.count())
    long_lists = F.col("members") > LONG_LIST
    second = joined(first, pairs_of_long(written(open_lists(lists, first).where(long_lists), "lists"), classes, percent, True).select("a", "b").distinct())

    left = written(open_lists(lists, second), "lists")
    met = pairs_of_short(left.where(~long_lists), percent).unionByName(pairs_of_long(left.where(long_lists), classes, percent, False))
    met = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.min("pa").alias("light"), F.count("*").alias("c"))
    most = F.col("c") + F.least(F.col("na") - 1 - F.col("pa"), F.col("nb") - 1 - F.col("pb"))
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100.0 + percent) - F.lit(1e-9))
    final = joined(second, met.where((F.col("light") < 0) | (most >= need)).select("a", "b"))

    grouped = final.withColumnRenamed("node", "h").join(classes.select("h", "least_id"), "h")
    least = grouped.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = classes.select("h", "least_id", "n_copies").join(final.withColumnRenamed("node", "h"), "h", "left").join(least, "component", "left")
    of_class = of_class.select("h", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("component", "h").alias("component"), "n_copies")
    out = stats.drop("outline").withColumnRenamed("n", "n_shingles").join(of_class, "h", "left").withColumns({"component_id": F.coalesce("component_id", "doc_id"), "n_copies": F.coalesce("n_copies", F.lit(1).cast("long"))})
    return out.select("doc_id", "n_shingles", "component_id", "n_copies", *(["at", "text_hash", "component"] if keys else []))


def op3_jaccard_join(spark, sf_dir):
    """Components of the documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return near_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: Links from all pairs that share a shingle, then reachability; for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, coalesce(min(r.root), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY w.doc_id
"""
