"""Token ids in seekable zstandard files.

A file is a run of independent zstandard frames, each with a content checksum, that hold whole documents' ids (unsigned
little-endian integers of `width` bytes); then one skippable frame with the index (doc_id and id count of each document,
in order, and the number of documents of each frame); then the seek table of the public seekable format: a skippable
frame with compressed size, decompressed size and XXH64 checksum (low 32 bits) of each frame, and its footer. A reader
seeks to the end, then decompresses only the frames that hold the documents asked for.

Documents are dealt into ranges of id and text hash by one shuffle; each range is sorted and streamed into one file, so
a task holds one block of texts and one frame. Files are written under a name of the task's attempt and named in the returned
manifest, which is written out before it is used: a lost executor's half-made file is never read.

Defined results: a null text is empty and holds the end id only; repeated rows are written each, in the order of their
texts' hashes; null ids sort first; the literal of an added token is that token's id, as by the library; an empty table
gives no file and no rows; other columns are ignored."""

from __future__ import annotations

import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Results, joined
from .common import bytes_of, new_path, pieces, table, texts, written

#: Fixed values of the public zstandard and seekable formats.
SEEK_FRAME_MAGIC = 0x184D2A5E
INDEX_FRAME_MAGIC = 0x184D2A51
SEEK_FOOTER_MAGIC = 0x8F92EAB1

END_ID = 2
FRAME_BYTES = 1 << 17
BLOCK_BYTES = 8 << 20
#: Texts of about so many bytes make a file, until there are MOST_FILES; then files grow, as a file is streamed.
FILE_TEXT_BYTES = 48 << 20
MOST_FILES = 50_000
_MANIFEST = "bucket int, path string, width int, n_docs long, n_ids long, n_frames long, bytes long"


def filesystem(uri: str):
    """(file system, path in it) for a local path or a URI that pyarrow knows (file, hdfs, s3, gs, abfs ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:/") else (fs.LocalFileSystem(), uri)


class FrameWriter:
    """Writes documents' ids into one seekable file."""

    def __init__(self, sink, width: int, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.sink, self.width, self.frame_bytes = sink, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.open: list[bytes] = []
        self.size = self.bytes = self.n_ids = 0
        self.entries: list[tuple[int, int, int]] = []
        self.per_frame: list[int] = []
        self.ids: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.open.append(ids)
        self.size += len(ids)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.n_ids += len(ids) // self.width
        if self.size >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.open:
            raw = b"".join(self.open)
            packed = self.packer.compress(raw)
            self.sink.write(packed)
            self.bytes += len(packed)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.per_frame.append(len(self.open))
            self.open, self.size = [], 0

    def close(self) -> None:
        import numpy as np
        import zstandard

        self.flush()
        index = struct.pack("<BQQ", self.width, len(self.ids), len(self.per_frame)) + np.array(self.ids, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.per_frame, "<u8").tobytes()
        index = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(index)
        index = struct.pack("<II", INDEX_FRAME_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<III", *e) for e in [*self.entries, (len(index), 0, 0)])
        footer = struct.pack("<IBI", len(self.entries) + 1, 1 << 7, SEEK_FOOTER_MAGIC)
        tail = index + struct.pack("<II", SEEK_FRAME_MAGIC, len(table) + len(footer)) + table + footer
        self.sink.write(tail)
        self.bytes += len(tail)


class FrameReader:
    """Reads a seekable file: index first, then any documents, decompressing only their frames."""

    def __init__(self, source, size: int):
        import numpy as np
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        raw = self._at(size - 9 - n * entry, n * entry)
        self.entries = [struct.unpack_from("<III" if entry == 12 else "<II", raw, i * entry) for i in range(n)]
        self.offsets = np.concatenate([[0], np.cumsum([e[0] for e in self.entries])]).astype(np.int64)
        index = self._at(int(self.offsets[-2]) + 8, self.entries[-1][0] - 8)
        index = self.unpacker.decompress(index)
        self.width, docs, frames = struct.unpack_from("<BQQ", index)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 17)
        self.counts = np.frombuffer(index, "<u8", docs, 17 + 8 * docs).astype(np.int64)
        self.first_doc = np.concatenate([[0], np.cumsum(np.frombuffer(index, "<u8", frames, 17 + 16 * docs).astype(np.int64))])

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        """Bytes of frame k, checked against the seek table."""
        import xxhash

        packed, size, *checksum = self.entries[k]
        raw = self.unpacker.decompress(self._at(int(self.offsets[k]), packed), max_output_size=size)
        if len(raw) != size or checksum and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum[0]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return raw

    def documents(self, wanted: set[int] | None = None):
        """(place in the file, doc_id, ids as unsigned 32-bit integers) of the wanted documents (all if None)."""
        import numpy as np

        for k in range(len(self.first_doc) - 1):
            a, b = int(self.first_doc[k]), int(self.first_doc[k + 1])
            if wanted is not None and not wanted.intersection(self.doc_ids[a:b].tolist()):
                continue
            ids = np.frombuffer(self.frame(k), f"<u{self.width}").astype("<u4")
            ends = np.cumsum(self.counts[a:b])
            for i in range(a, b):
                if wanted is None or int(self.doc_ids[i]) in wanted:
                    yield i, int(self.doc_ids[i]), ids[ends[i - a] - self.counts[i] : ends[i - a]]


class ChunkEncoder:
    """Ids of texts by a tokenizers file. Distinct chunks are encoded once; what is kept of them is bounded in bytes."""

    def __init__(self, path: str):
        import json
        import os

        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.results = Results(self._encoded)
        rules = json.loads(self.tokenizer.to_str())
        before = rules.get("pre_tokenizer") or {}
        self.cuttable = not rules.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)

    def _encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks. Those of white space and one thing behind it are joined, encoded together and cut again where the
        tokens' byte lengths add up to the chunks'; should that not come out even, each is encoded by itself."""
        import numpy as np

        dtype, w = f"<u{self.width}", self.width
        out: list = [None] * len(chunks)
        alone, together = [], []
        for i, c in enumerate(chunks):
            (together if self.cuttable and c[0] <= 32 < c[-1] < 128 and len(c) < 1 << 10 else alone).append(i)
        parts = [together[i : i + 8192] for i in range(0, len(together), 8192)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b"".join([chunks[i] for i in part]).decode() for part in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum(self.n_bytes[ids])
            want = np.cumsum([len(chunks[i]) for i in part])
            at = np.minimum(np.searchsorted(ends, want), max(0, len(ends) - 1))
            if len(ends) and (ends[at] == want).all():
                packed = ids.astype(dtype).tobytes()
                cut = [0, *((at + 1) * w).tolist()]
                for i, a, b in zip(part, cut[:-1], cut[1:], strict=True):
                    out[i] = packed[a:b]
            else:
                alone += part
        for k in range(0, len(alone), 20_000):
            part = alone[k : k + 20_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([chunks[i].decode("utf-8", "replace") for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, dtype).tobytes()
        return out

    def block(self, column: pa.Array):
        """Each text's ids as bytes, with the end id. Next to an added token's literal white space is matched otherwise,
        so texts that hold one stay whole."""
        import numpy as np
        import pyarrow.compute as pc

        data, offs = texts(column)
        whole = np.full(len(column), not self.cuttable)
        for literal in self.literals:
            whole |= np.asarray(pc.fill_null(pc.match_substring(column, literal), False))
        raw, at = joined(self.results, data, offs, whole)
        raw, at, end = raw.tobytes(), at.tolist(), END_ID.to_bytes(self.width, "little")
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield raw[a:b] + end


_ENCODERS: dict = {}


def write_frames(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Writes docs in ascending id order to seekable files in folder; the manifest (a written table) has a row per file."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = min(MOST_FILES, max(1, -(-bytes_of(source) // file_text_bytes), source.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        from pyspark import TaskContext

        if tokenizer_path not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[tokenizer_path] = ChunkEncoder(tokenizer_path)
        encoder = _ENCODERS[tokenizer_path]
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        writer = None
        for batch in batches:
            for piece in pieces(batch, limit=BLOCK_BYTES):
                if writer is None:
                    bucket = TaskContext.get().partitionId()
                    name = f"{base}/ids-{bucket:06d}-{uuid.uuid4().hex}.zst"
                    writer = FrameWriter(sink := store.open_output_stream(name, compression=None), encoder.width)
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.block(piece.column(1)), strict=True):
                    writer.add(-(1 << 63) if doc_id is None else doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            row = [bucket, f"{folder}/{name.rpartition('/')[2]}", encoder.width, len(writer.ids), writer.n_ids, len(writer.entries), writer.bytes]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4), strict=True)], [c.split()[0] for c in _MANIFEST.split(", ")])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]  # rows of one id, or of none, may fill several files
    dealt = source.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return written(dealt.select("doc_id", "text").mapInArrow(run, _MANIFEST), "frames-manifest")


def read_frames(manifest: DataFrame, schema: str, made, wanted: set[int] | None = None) -> DataFrame:
    """Rows made(doc_id, start, ids) of every document (or the wanted ones) in the manifest's files, a task per file.

    start counts the ids of all documents before; the sums over the manifest (MOST_FILES rows at most) are taken on the
    driver."""
    spark = manifest.sparkSession
    files, start = [], 0
    for r in manifest.select("bucket", "path", "n_ids").orderBy("bucket").collect():
        files.append((r.path, start))
        start += r.n_ids
    names = [x.split()[0] for x in schema.split(", ")]
    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))

    def run(batches):
        import numpy as np

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = filesystem(path)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source, source.size())
                    starts = start + np.concatenate([[0], np.cumsum(reader.counts)])
                    rows = []
                    for i, doc_id, ids in reader.documents(wanted):
                        rows.append(made(None if doc_id == -(1 << 63) else doc_id, int(starts[i]), ids))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _arrow(schema))
                            rows = []
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], _arrow(schema))

    return listed.mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _crc(doc_id, start, ids):
    import zlib

    return doc_id, start, len(ids), zlib.crc32(ids.tobytes())


def op8_token_frames(spark, sf_dir):
    """Encodes and writes every document, then reads the files back: start, count and checksum of each one's ids."""
    import public_tokenizers as P

    manifest = write_frames(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), new_path(spark, "frames"))
    return read_frames(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", _crc)
