"""A batch sink that writes pages as one PDF file per partition: format("page-pdf").

Rows: page_w, page_h, draw_x, draw_y, draw_w, draw_h (points), caption, rotate, width, height, rgb (8-bit RGB bytes). Each
task streams its partition's pages in their order into a file of its own; sort within partitions by list and position
first. Images are stored as deflated RGB. On commit the driver writes a list of the parts; no page passes through it. The
path is a URI of any file system that pyarrow knows (file, hdfs, s3, gs, abfs ...), shared by the driver and executors."""

from __future__ import annotations

import contextlib
import json
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Part(WriterCommitMessage):
    name: str
    pages: int


def escaped(text: str) -> bytes:
    return text.encode("ascii", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


class PdfFile:
    """Streams pages; object offsets are kept for the cross-reference table."""

    def __init__(self, sink):
        self.sink, self.at, self.offsets, self.kids = sink, 0, [0, 0, 0], []
        self._put(b"%PDF-1.4\n")
        self._object(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")

    def _put(self, raw: bytes) -> None:
        self.sink.write(raw)
        self.at += len(raw)

    def _object(self, body: bytes) -> int:
        self.offsets.append(self.at)
        number = len(self.offsets) - 1
        self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))
        return number

    def _stream(self, head: bytes, raw: bytes) -> int:
        return self._object(b"<< %s /Length %d >>\nstream\n%s\nendstream" % (head, len(raw), raw))

    def page(self, row) -> None:
        image = self._stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode" % (row.width, row.height), zlib.compress(bytes(row.rgb)))
        draw = "q %.4f 0 0 %.4f %.4f %.4f cm /I Do Q\n" % (row.draw_w, row.draw_h, row.draw_x, row.draw_y)
        text = b"BT 0.3 g /F 10 Tf 24 33 Td (%s) Tj ET\n" % escaped(row.caption) if row.caption else b""
        content = self._stream(b"", draw.encode() + text)
        self.kids.append(self._object(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Rotate %d /Contents %d 0 R /Resources << /XObject << /I %d 0 R >> /Font << /F 3 0 R >> >> >>" % (row.page_w, row.page_h, row.rotate or 0, content, image)))

    def close(self) -> None:
        for number, body in ((1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(self.kids), b" ".join(b"%d 0 R" % k for k in self.kids)))):
            self.offsets[number] = self.at
            self._put(b"%d 0 obj\n%s\nendobj\n" % (number, body))
        start, n = self.at, len(self.offsets)
        self._put(b"xref\n0 %d\n0000000000 65535 f \n" % n + b"".join(b"%010d 00000 n \n" % o for o in self.offsets[1:]) + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (n, start))


class PagePdfWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def _store(self):
        """(file system, folder in it), made on the machine that uses it."""
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:/") else (fs.LocalFileSystem(), self.folder)
        store.create_dir(base, recursive=True)
        return store, base

    def write(self, rows):
        store, base = self._store()
        name, out, sink = f"part-{uuid.uuid4().hex}.pdf", None, None
        for row in rows:
            if out is None:
                sink = store.open_output_stream(f"{base}/{name}", compression=None)
                out = PdfFile(sink)
            out.page(row)
        if out is None:
            return Part("", 0)
        out.close()
        sink.close()
        return Part(name, len(out.kids))

    def commit(self, messages):
        store, base = self._store()
        with store.open_output_stream(f"{base}/_parts.json", compression=None) as f:
            f.write(json.dumps([[m.name, m.pages] for m in messages if m and m.pages]).encode())

    def abort(self, messages):
        store, base = self._store()
        for m in messages:
            if m and m.name:
                with contextlib.suppress(FileNotFoundError):
                    store.delete_file(f"{base}/{m.name}")


class PagePdf(DataSource):
    @classmethod
    def name(cls):
        return "page-pdf"

    def writer(self, schema, overwrite):
        return PagePdfWriter(self.options["path"])
