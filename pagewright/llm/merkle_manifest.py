"""Merkle manifest of a dataset: a tree per source over its documents' digests, and a tree over the sources.

A node is the sha256 of up to FAN children's digests as hex text. Trees are stored in van Emde Boas layout: an aligned
subtree's levels are split at half height, the upper half first, then each lower subtree, both by the same rule; a node's
place follows from its level, its position and the number of leaves by arithmetic alone (`address`). Spark holds a row
for each aligned subtree of FAN^LEVELS leaves (a block, at most 140 KB). Construction builds all blocks of leaves, then
takes their roots as the leaves of the next round, until each tree is one block: a few rounds whatever the size. Proofs
come down the same way: the path of a block's root to the top is made once, in the block above, and joined to the block;
the siblings inside are read by their addresses. So the largest source is many blocks, and texts are read once, in the
JVM, and never moved.

Positions in a tree come from Spark's range partitioning (source, doc_id, digest): rows are numbered in their range, and
ranges are offset by the counts of those before, one row per range and source.

Defined results: nulls as `-`; null sources are one tree, the first; rows with equal doc_id stand in order of digest, null
ids first; repeated rows are leaves each; a row without an id isn't tampered with; a lone leaf is its tree's root; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX = 64  # characters of a digest as text
_BLOCKS = "tree string, block long, n long, nodes binary, root binary, items array<{}>, changed array<binary>"
_PATH = "array<struct<before:binary,after:binary>>"


# ---- address arithmetic


def height(n: int) -> int:
    """Levels above the leaves until one node is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def nodes_in(n: int, h: int) -> int:
    """Nodes of a subtree of n leaves and h levels above them."""
    return sum(-(-n // FAN**i) for i in range(h + 1))


def address(level: int, pos, n: int, h: int):
    """Places (from 0) of the nodes `pos` (an array) of a level in a subtree of n leaves and h levels above them. The upper
    half of the levels stands first, then the lower subtrees in order; all of these but the last are full."""
    import numpy as np

    if h == 0:
        return np.zeros(len(pos), np.int64)
    low = (h + 1) // 2 - 1  # levels above the leaves in a lower subtree
    upper = -(-n // FAN ** (low + 1)), h - low - 1
    if level > low:
        return address(level - low - 1, pos, *upper)
    wide, full = FAN**low, nodes_in(FAN**low, low)
    tree = pos // FAN ** (low - level)
    out = nodes_in(*upper) + tree * full
    inside, last = pos - tree * FAN ** (low - level), (n - 1) // wide
    for some, leaves in ((tree < last, wide), (tree == last, n - last * wide)):
        out[some] += address(level, inside[some], leaves, low)
    return out


@lru_cache(maxsize=64)
def addresses(n: int, h: int):
    """Places of each level's nodes in a block."""
    import numpy as np

    return [address(level, np.arange(-(-n // FAN**level)), n, h) for level in range(h + 1)]


# ---- blocks


def _block_height(n: int) -> int:
    """Levels of a block above its leaves, of a tree of n leaves in this round: whole blocks but in a tree's last round."""
    return LEVELS if n > BLOCK else height(n)


def packed(leaves: list[bytes], n: int) -> tuple[bytes, bytes]:
    """The block of some leaves of a tree of n, in its layout, and its root."""
    import numpy as np

    h = _block_height(n)
    out = np.empty((nodes_in(len(leaves), h), 32), np.uint8)
    level = leaves
    for i, places in enumerate(addresses(len(leaves), h)):
        if i:
            text = b"".join(level).hex().encode()
            level = [sha256(text[j : j + FAN * _HEX]).digest() for j in range(0, len(text), FAN * _HEX)]
        out[places] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
    return out.tobytes(), level[0]


def unpacked(nodes: bytes, count: int, n: int) -> list[bytes]:
    """Hex text of each level of a block, read by address."""
    import numpy as np

    held = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    return [held[places].tobytes().hex().encode() for places in addresses(count, _block_height(n))]


def siblings(levels: list[bytes], leaf: int) -> list[tuple[bytes, bytes]]:
    """For each level below a block's root: the digests of a leaf's run before its ancestor, and behind it."""
    out = []
    for text in levels[:-1]:
        run = leaf // FAN
        out.append((text[run * FAN * _HEX : leaf * _HEX], text[(leaf + 1) * _HEX : (run + 1) * FAN * _HEX]))
        leaf = run
    return out


def folded(digest: bytes, path) -> bytes:
    """The digest that a path leads to from a leaf."""
    for before, after in path:
        digest = sha256(before + digest.hex().encode() + after).digest()
    return digest


def _rows(batches):
    """Rows one by one, as blocks are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _grouped(batches, keys: int):
    """Record batches of rows with equal leading columns, which are sorted; one run of rows is held at a time."""
    import numpy as np

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        change = np.zeros(whole.num_rows - 1, bool)
        for i in range(keys):
            coded = whole.column(i).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change |= coded[1:] != coded[:-1]
        cut = [0, *(np.flatnonzero(change) + 1).tolist()]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield whole.slice(i, j - i)
        held = whole.slice(cut[-1])
    if held is not None:
        yield held


def blocks(leaves: DataFrame, item: str) -> DataFrame:
    """leaves: tree, pos, n, digest, item, changed. A row per aligned subtree of a round, with its leaves' items."""

    def run(batches):
        for some in _grouped(batches, 2):
            n = some.column(3)[0].as_py()
            nodes, root = packed(some.column(4).to_pylist(), n)
            one = [some.column(0).slice(0, 1), some.column(1).slice(0, 1), pa.array([n]), pa.array([nodes], pa.binary()), pa.array([root], pa.binary())]
            lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), pa.concat_arrays([some.column(i)])) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays([*one, *lists], ["tree", "block", "n", "nodes", "root", "items", "changed"])

    rows = leaves.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest", "item", "changed")
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, _BLOCKS.format(item))


def rounds(leaves: DataFrame, item: str) -> list[DataFrame]:
    """The blocks of the leaves, of these blocks' roots, and so on until each tree is one block."""
    out = [written(blocks(leaves, item), "merkle")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
        above = out[-1].where(F.col("n") > BLOCK).select("tree", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("digest"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("binary").alias("changed"))
        out.append(written(blocks(above, "string"), "merkle"))
    return out


def roots(found: list[DataFrame]) -> DataFrame:
    """tree and root of all trees."""
    out = None
    for level in found:
        some = level.where(F.col("n") <= BLOCK).select("tree", F.col("root").alias("digest"))
        out = some if out is None else out.unionByName(some)
    return out


def with_paths(found: list[DataFrame], start: DataFrame) -> DataFrame:
    """The blocks of the lowest round with their roots' paths to the top and the other columns of start (tree, path, ...)."""
    extra = [c for c in start.columns if c not in ("tree", "path")]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                count, above = len(row.column(4)[0]), row.column(5)[0].as_py()
                levels = unpacked(row.column(3)[0].as_py(), count, row.column(2)[0].as_py())
                paths = [[{"before": b, "after": a} for b, a in siblings(levels, j)] + above for j in range(count)]
                same = pa.array([0] * count)
                yield pa.RecordBatch.from_arrays(
                    [row.column(0).take(same), pa.array([row.column(1)[0].as_py() * BLOCK + j for j in range(count)]), pa.array(paths, batch.schema.field(5).type), *(row.column(k).take(same) for k in range(6, batch.num_columns))], ["tree", "block", "path", *extra]
                )

    down = None  # tree, block, path of blocks that have one above
    for level in reversed(found):
        whole = level.where(F.col("n") <= BLOCK).join(start, "tree")
        rows = whole if down is None else whole.unionByName(level.where(F.col("n") > BLOCK).join(down, ["tree", "block"]))
        if level is found[0]:
            return rows
        schema = rows.select("tree", "block", "path", *extra).schema
        down = rows.select("tree", "block", "n", "nodes", "items", "path", *extra).mapInArrow(run, schema)
    raise ValueError("no blocks")


# ---- documents


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """sha256 of some columns, each `-` if null, else its bytes' number, `:` and itself."""
    return F.unhex(F.sha2(F.concat(*(_field(c) for c in columns)).cast("binary"), 256))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, their place in their tree by order, and n, the tree's rows. Rows equal in all stand in any order, so
    their number spreads them over ranges too."""
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    ranged = written(numbered.repartitionByRange("tree", *order, "_row").sortWithinPartitions("tree", *order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), "leaves")
    held = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_least"))
    by_range = Window.partitionBy("tree").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("tree", "_range", (F.coalesce(F.sum("_n").over(by_range), F.lit(0)) - F.col("_least")).alias("_shift"), F.sum("_n").over(Window.partitionBy("tree")).alias("n"))
    return ranged.join(starts, ["tree", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def documents_leaves(docs: DataFrame) -> DataFrame:
    """tree, item (doc_id), digest, changed (the digest after tampering, null where there is none)."""
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null first
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("item"), leaf([*own, F.col("text")]).alias("digest"), F.when(hit, leaf([*own, F.translate("text", _UPPER, _LOWER)])).alias("changed"))


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The blocks of each source's tree by round, and those of the tree over the sources."""
    below = rounds(positions(leaves, ["item", "digest"]), "long")
    top = positions(roots(below).withColumnRenamed("tree", "item").withColumn("tree", F.lit("")), ["item"])
    return below, rounds(top.withColumn("changed", F.lit(None).cast("binary")), "string")


def proofs(below: list[DataFrame], above: list[DataFrame]) -> DataFrame:
    """Each leaf with its tree's root, the root of all, the digest of its siblings up to there, and where its tampered digest
    (or else its own) leads."""
    start = with_paths(above, roots(above).select("tree", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top")))

    def sources(batches):
        for row in _rows(batches):
            levels = unpacked(row["nodes"], len(row["items"]), row["n"])
            for i, item in enumerate(row["items"]):
                path = [{"before": b, "after": a} for b, a in siblings(levels, i)] + row["path"]
                yield pa.RecordBatch.from_pylist([{"tree": item, "path": path, "subroot": bytes.fromhex(levels[0][i * _HEX : (i + 1) * _HEX].decode()), "top": row["top"]}], pa_schema)

    pa_schema = pa.schema([("tree", pa.string()), ("path", pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))), ("subroot", pa.binary()), ("top", pa.binary())])
    by_source = start.select("items", "nodes", "n", "path", "top").mapInArrow(sources, f"tree string, path {_PATH}, subroot binary, top binary")
    rows = with_paths(below, written(by_source, "sources"))

    def documents(batches):
        for row in _rows(batches):
            yield _proven(row)

    out = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.select("items", "changed", "nodes", "n", "path", "subroot", "top").mapInArrow(documents, out)


def _proven(row: dict) -> pa.RecordBatch:
    """The result rows of a block's leaves. What lies above a run is joined, and folded, once for equal digests."""
    count, top = len(row["items"]), row["top"].hex()
    levels = unpacked(row["nodes"], count, row["n"])
    above = [(p["before"], p["after"]) for p in row["path"]]
    rest: dict[int, tuple[list, bytes]] = {}
    known: dict[tuple[int, bytes], str] = {}
    leaves, digests, ends = [], [], []
    for i in range(count):
        run = i // FAN
        if run not in rest:
            path = (siblings(levels[1:], run) if len(levels) > 1 else []) + above
            rest[run] = path, b"".join(b + a for b, a in path)
        path, beyond = rest[run]
        own = levels[0][i * _HEX : (i + 1) * _HEX].decode()
        at = row["changed"][i] or bytes.fromhex(own)
        before, after = b"", b""
        if len(levels) > 1:
            before, after = levels[0][run * FAN * _HEX : i * _HEX], levels[0][(i + 1) * _HEX : (run + 1) * FAN * _HEX]
            at = sha256(before + at.hex().encode() + after).digest()
        if (run, at) not in known:
            known[run, at] = folded(at, path).hex()
        leaves.append(own)
        digests.append(sha256(before + after + beyond).hexdigest())
        ends.append(known[run, at])
    same = [row["subroot"].hex()] * count, [top] * count
    return pa.RecordBatch.from_arrays(
        [pa.array(row["items"], pa.int64()), pa.array(leaves), *map(pa.array, same), pa.array(digests), pa.array(ends), pa.array([e == top for e in ends])], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    )


def op11_merkle_manifest(spark, sf_dir):
    """Manifest of all documents, and each one's proof, folded from its tampered or own leaf."""
    return proofs(*manifest(documents_leaves(table(spark, sf_dir, "documents"))))


def _sql_leaf(text: str) -> str:
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


SQL = f"""
WITH RECURSIVE
bits AS (SELECT DISTINCT doc_id, [4294967295] || flatten(list_transform(range(length(CAST(doc_id AS VARCHAR))),
           lambda i: list_transform(range(8), lambda b: (ord(CAST(doc_id AS VARCHAR)[i + 1]) >> b) & 1))) AS l FROM documents WHERE doc_id IS NOT NULL),
hit AS (SELECT doc_id FROM bits WHERE xor(list_reduce(l, lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295) % 5 = 0),
hashed AS (SELECT doc_id, source, {_sql_leaf("text")} AS leaf, CASE WHEN doc_id IN (SELECT doc_id FROM hit) THEN {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM documents),
leaves AS (SELECT doc_id, source, leaf, coalesce(changed, leaf) AS changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
nodes AS (SELECT 0 AS level, source, pos, leaf AS h FROM leaves UNION ALL
  SELECT level + 1, source, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY source) AS c FROM nodes) WHERE c > 1 GROUP BY level, source, pos // {FAN}),
trees AS (SELECT source, arg_max(h, level) AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM nodes GROUP BY source),
tops AS (SELECT 0 AS level, pos, subroot AS h FROM trees UNION ALL
  SELECT level + 1, pos // {FAN}, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM tops) WHERE c > 1 GROUP BY level, pos // {FAN}),
low AS (SELECT l.source, l.pos, 0 AS tier, n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < l.pos >> (4 * n.level)), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > l.pos >> (4 * n.level)), '') AS after
  FROM leaves l JOIN nodes n ON l.source IS NOT DISTINCT FROM n.source AND n.pos >> 4 = l.pos >> (4 * n.level + 4)
  JOIN (SELECT source, max(level) AS most FROM nodes GROUP BY source) m ON m.source IS NOT DISTINCT FROM l.source AND n.level < m.most GROUP BY ALL),
high AS (SELECT t.source, 1 AS tier, n.level, coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos < t.pos >> (4 * n.level)), '') AS before,
    coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (WHERE n.pos > t.pos >> (4 * n.level)), '') AS after
  FROM trees t JOIN tops n ON n.pos >> 4 = t.pos >> (4 * n.level + 4) AND n.level < (SELECT max(level) FROM tops) GROUP BY t.source, t.pos, n.level),
steps AS (SELECT * FROM low UNION ALL SELECT l.source, l.pos, tier, level, before, after FROM leaves l JOIN high h ON l.source IS NOT DISTINCT FROM h.source),
paths AS (SELECT source, pos, string_agg(before || after, '' ORDER BY tier, level) AS siblings, list(before || ',' || after ORDER BY tier, level) AS path FROM steps GROUP BY source, pos),
ends AS (SELECT l.doc_id, l.leaf, t.subroot, (SELECT arg_max(h, level) FROM tops) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce([l.changed] || coalesce(path, []), lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos)
SELECT *, folded_root = root AS verified FROM ends
"""
