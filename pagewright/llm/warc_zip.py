"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file (with ZIP64 records, whatever its size) of two members stored without compression:
archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj, a line of JSON per record with its offset and
length in the archive member. A reader reads the end record, the ZIP64 locator and directory, the central directory and
the members' local headers, so it knows where each stored member's bytes begin; then it reads the index, and each
record by one range. Members that are compressed can't be read by ranges and are refused.

Pages with equal payloads (of min_bytes at least) are found by digest: the least page_id is the response, the others
revisit it. Only digests and ids are shuffled and grouped with map-side partials; payloads move once, to their package.
A task closes a package and begins another when it holds PACKAGE_BYTES, so packages, and the indexes that a task holds,
are bounded whatever the table. Packages are named by attempt and listed in a manifest that is written before it is read,
so work of lost executors is never read. Reading deals stretches of DEALT_BYTES of the packages evenly to tasks.

Defined results: a null payload is empty; every row is written; rows that repeat the response's id
and url are responses too; a null id counts as the largest; an empty table gives no package and no rows; other columns
are ignored."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, pieces, table, written
from .token_frames import filesystem

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed signatures of the public ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records after which a package is closed, and of a package that a task reads in one go.
PACKAGE_BYTES, DEALT_BYTES = 256 << 20, 16 << 20
_MANIFEST = "path string, n_records long, bytes long"


def record(kind: str, uri: str, page_id, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record, gzipped; a revisit has no payload."""
    body = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html"]
    if uri:
        head.append("WARC-Target-URI: " + "".join(c for c in uri if c not in "\r\n"))
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers and body of one gzipped record."""
    raw = gzip.decompress(raw)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


class PackageWriter:
    """Streams records into the archive member; the index and the directories follow at close."""

    def __init__(self, sink):
        self.sink, self.at, self.crc, self.index, self.records = sink, 0, 0, bytearray(), 0
        self.members: list[tuple[bytes, int, int, int]] = []
        self._local(ARCHIVE.encode())
        self.start = self.at

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _local(self, name: bytes) -> None:
        """Sizes and checksum follow the data (flag bit 3), in 64 bits."""
        self.header = self.at
        self._put(struct.pack("<4s5H3I2H", LOCAL, 45, 8, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def _end_member(self, name: bytes, crc: int, size: int) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", crc, size, size))
        self.members.append((name, crc, size, self.header))

    def add(self, raw: bytes, **fields) -> None:
        self.index += json.dumps(fields | {"offset": self.at - self.start, "length": len(raw)}).encode() + b"\n"
        self.records += 1
        self.crc = zlib.crc32(raw, self.crc)
        self._put(raw)

    def close(self) -> None:
        self._end_member(ARCHIVE.encode(), self.crc, self.at - self.start)
        self._local(INDEX.encode())
        self._put(self.index)
        self._end_member(INDEX.encode(), zlib.crc32(self.index), len(self.index))
        begin = self.at
        for name, crc, size, header in self.members:
            self._put(struct.pack("<4s6H3I5H2I", CENTRAL, 45, 45, 8, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, size, size, header))
        size, n, end64 = self.at - begin, len(self.members), self.at
        self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, size, begin))
        self._put(struct.pack("<4sIQI", LOCATOR, 0, end64, 1))
        self._put(struct.pack("<4s4H2IH", END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class PackageReader:
    """Members of a ZIP file and where their bytes begin, from its directories alone."""

    def __init__(self, source, size: int):
        self.source = source
        tail_at = max(0, size - 22 - 0xFFFF)
        tail = self._at(tail_at, size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("no end of central directory")
        *_, n, length, begin, _ = struct.unpack_from("<4s4H2IH", tail, end)
        if 0xFFFF in (n,) or 0xFFFFFFFF in (length, begin):
            magic, _, end64, _ = struct.unpack("<4sIQI", self._at(tail_at + end - 20, 20))
            if magic != LOCATOR:
                raise ValueError("no ZIP64 locator")
            magic, *_, n, length, begin = struct.unpack("<4sQHHIIQQQQ", self._at(end64, 56))
            if magic != END64:
                raise ValueError("no ZIP64 end of central directory")
        central, self.members, i = self._at(begin, length), {}, 0
        for _ in range(n):
            magic, _, _, _, method, _, _, crc, packed, plain, a, b, c, _, _, _, header = struct.unpack_from("<4s6H3I5H2I", central, i)
            if magic != CENTRAL:
                raise ValueError("damaged central directory")
            name = central[i + 46 : i + 46 + a].decode()
            extra, j = central[i + 46 + a : i + 46 + a + b], 0
            while j + 4 <= len(extra):
                kind, w = struct.unpack_from("<HH", extra, j)
                if kind == 1:  # 64-bit values, for those fields only that are full
                    values = iter(struct.unpack_from(f"<{w // 8}Q", extra, j + 4))
                    plain = next(values) if plain == 0xFFFFFFFF else plain
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                j += 4 + w
            self.members[name] = (method, packed, plain, crc, header)
            i += 46 + a + b + c

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def span(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many they are."""
        method, packed, plain, _, header = self.members[name]
        if method != 0 or packed != plain:
            raise ValueError(f"{name} isn't stored")
        magic, *_, a, b = struct.unpack("<4s5H3I2H", self._at(header, 30))
        if magic != LOCAL:
            raise ValueError(f"{name}: damaged local header")
        return header + 30 + a + b, plain

    def read(self, name: str) -> bytes:
        raw = self._at(*self.span(name))
        if zlib.crc32(raw) != self.members[name][3]:
            raise ValueError(f"{name} doesn't match its checksum")
        return raw


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record per page to ZIP packages in folder, one or more for each partition of the join that finds the
    revisits; the manifest (a written table) has a row per package."""
    raw = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), raw)
    keyed = source.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    same = keyed.where(F.col("size") >= min_bytes).select("digest", order.alias("o")).groupBy("digest").agg(F.min("o").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    same = written(same, "repeated")  # a table of its own, so that Spark splits a digest that a third of the pages have
    # the pages that revisit another one, by id: payloads stay out of this
    later = keyed.select("page_id", "url", "digest", order.alias("o")).join(same, "digest").where(F.col("o") != F.col("first")).select(F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), F.col("url").alias("later_url"), F.col("first.page_id").alias("refers_to")).distinct()
    joined = keyed.join(later, F.col("page_id").eqNullSafe(F.col("later_id")) & (F.col("digest") == F.col("later_digest")) & (F.col("url") == F.col("later_url")), "left")

    def run(batches):
        writer = None
        store, base = filesystem(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for piece in pieces(batch, "html", 4 << 20):
                if writer is None:
                    name = f"pages-{uuid.uuid4().hex}.wacz"
                    writer = PackageWriter(sink := store.open_output_stream(f"{base}/{name}", compression=None))
                for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    kind = "revisit" if revisit else "response"
                    writer.add(record(kind, url, page_id, payload, sha1_base32(payload), refers_to), page_id=page_id, type=kind)
                if writer.at >= package_bytes:
                    yield closed(writer, sink, name)
                    writer = None
        if writer is not None:
            yield closed(writer, sink, name)

    def closed(writer, sink, name):
        writer.close()
        sink.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([writer.records], pa.int64()), pa.array([writer.at], pa.int64())], ["path", "n_records", "bytes"])

    rows = joined.select("page_id", "url", "html", F.col("later_digest").isNotNull().alias("revisit"), "refers_to")
    return written(rows.mapInArrow(run, _MANIFEST), "packages")


def record_index(manifest: DataFrame) -> DataFrame:
    """(path, at, length, page_id) of every record, from the packages' directories and index members alone."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = filesystem(path)
                with store.open_input_file(name) as source:
                    reader = PackageReader(source, source.size())
                    start, size = reader.span(ARCHIVE)
                    lines = [json.loads(x) for x in reader.read(INDEX).splitlines()]
                    if any(x["offset"] + x["length"] > size for x in lines):
                        raise ValueError(f"{path}: the index points beyond the archive")
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([start + x["offset"] for x in lines], pa.int64()), pa.array([x["length"] for x in lines], pa.int64()), pa.array([x["page_id"] for x in lines], pa.int64())], ["path", "at", "length", "page_id"])

    files = manifest.select("path")
    return files.repartition(max(1, min(200_000, manifest.count()))).mapInArrow(run, "path string, at long, length long, page_id long")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Each record of the index by one range read: ids, digest, type, reference, and the payload if wanted."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())]
    arrow = pa.schema(fields if with_payload else fields[:5])

    def run(batches):
        open_path, source = None, None
        for batch in batches:
            rows = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if path != open_path:
                    if source is not None:
                        source.close()
                    store, name = filesystem(path)
                    open_path, source = path, store.open_input_file(name)
                source.seek(at)
                head, body = parse_record(source.read(length))
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if head["WARC-Type"] == "response" and (sha1_base32(body) != digest or len(body) != int(head["X-Payload-Length"])):
                    raise ValueError("a payload doesn't match its digest")
                number = lambda v: None if v in (None, "None") else int(v)
                row = {"page_id": number(head["WARC-Record-ID"][10:-1]), "payload_bytes": len(body) if head["WARC-Type"] == "response" else int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head["WARC-Refers-To"][10:-1]) if "WARC-Refers-To" in head else None}
                rows.append(row | {"url": head.get("WARC-Target-URI"), "payload": body} if with_payload else row)
            yield pa.RecordBatch.from_pylist(rows, arrow)
        if source is not None:
            source.close()

    dealt = index.repartition("path", F.expr(f"at div {DEALT_BYTES}")).sortWithinPartitions("path", "at")
    return dealt.mapInArrow(run, schema)


def op6_warc_zip(spark, sf_dir):
    """Writes every page to packages, then reads every record back."""
    manifest = write_packages(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_records(record_index(manifest))


#: The records that the packages must hold; base 32 is taken from the digest's bits.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[instr('0123456789abcdef', substr(x, i, 1))]), '') AS bits FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
