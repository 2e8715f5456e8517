"""Plain documents as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars


def write_plain(docs: DataFrame, text: Column, folder: str, width: int = scalars.WRAP_WIDTH) -> None:
    """Writes each row's Markdown text as a wrapped plain document; lines end by CRLF, a file per partition."""
    body = F.regexp_replace(scalars.plain_document(text, width), "\\r\\n$", "")
    docs.select(body.alias("value")).write.option("lineSep", "\r\n").text(folder)
