"""Format identification from a file's first bytes and its extension, as one CASE over BINARY."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import RAW_EXTENSIONS, extension

TGA_EXTENSIONS = ("tga", "tpic", "icb", "vda", "vst")
ICON_EXTENSIONS = ("ico", "cur")

#: Formats by magic bytes (hexadecimal) at a place, in the order in which they are tried.
MAGIC = (
    ("jpeg", ((1, "FFD8FF"),)),
    ("png", ((1, "89504E470D0A1A0A"),)),
    ("gif", ((1, "474946"),)),
    ("webp", ((1, "52494646"), (9, "57454250"))),
    ("psd", ((1, "38425053"),)),
    ("qoi", ((1, "716F6966"),)),
    ("raw", ((1, "464F5662"),)),
    ("raw", ((2, "4D524D"),)),
    ("raw", ((1, "46554A4946494C4D"),)),
    ("jp2", ((1, "0000000C6A502020"),)),
    ("jp2", ((1, "FF4FFF51"),)),
    ("jxl", ((1, "FF0A"),)),
    ("bmp", ((1, "424D"),)),
)
TIFF_MAGIC = ("49492A00", "4D4D002A")
RAW_VERSIONS = ("4949524F", "4D4D4F52", "49495253", "49495500")
WHITE_SPACE = ("09", "0A", "0B", "0C", "0D", "20", "A0")


def _at(head: Column, place: int, code: str) -> Column:
    return F.substr(head, F.lit(2 * place - 1), F.lit(len(code))) == code


def iso_format(head: Column) -> Column:
    """Of a file whose first box is ftyp, by its brands; null if it isn't one or no brand is known. head: hexadecimal."""
    size = F.conv(F.substr(head, F.lit(1), F.lit(8)), 16, 10).cast("long")
    length = F.least(F.when(size == 0, F.lit(32)).otherwise(size), F.lit(64), (F.length(head) / 2).cast("long"))
    brands = F.lower(F.decode(F.unhex(F.substr(head, F.lit(17), F.greatest(F.lit(0), length - 8).cast("int") * 2)), "ISO-8859-1"))
    brand = F.trim(F.lower(F.decode(F.unhex(F.substr(head, F.lit(17), F.lit(8))), "ISO-8859-1")))
    found = (
        F.when((brand == "crx") | brands.contains("crx "), "cr3").when((brand == "jxl") | brands.contains("jxl "), "jxl")
        .when(brand.startswith("avi") | brands.contains("avif") | brands.contains("avis"), "avif")
        .when(brand.startswith("hei") | brand.startswith("hev") | brand.isin("mif1", "msf1", "mif2") | brands.contains("heic") | brands.contains("mif1"), "heic")
    )
    return F.when(_at(head, 5, "66747970"), found)


def sniff(content: Column, path: Column) -> Column:
    """The format of a file. Only its first 64 bytes are looked at; they are cut off before anything else."""
    head, ext = F.hex(F.substring(content, 1, 64)), extension(path)
    out = F.when(head.isNull() | (F.length(head) < 8), "unknown")
    for name, codes in MAGIC:
        fits = F.lit(True)
        for place, code in codes:
            fits = fits & _at(head, place, code)
        out = out.when(fits, name)
    tiff = _at(head, 1, TIFF_MAGIC[0]) | _at(head, 1, TIFF_MAGIC[1])
    raw_name, icon, tga = ext.isin(*RAW_EXTENSIONS), ext.isin(*ICON_EXTENSIONS), ext.isin(*TGA_EXTENSIONS)
    second = F.substr(head, F.lit(3), F.lit(2))
    pnm = _at(head, 1, "50") & second.between("31", "37") & F.substr(head, F.lit(5), F.lit(2)).isin(*WHITE_SPACE)
    text = F.decode(F.unhex(head), "ISO-8859-1")
    return (
        out.when(iso_format(head).isNotNull(), iso_format(head))
        .when(tiff & (_at(head, 9, "4352") | raw_name), "raw").when(tiff, "tiff")
        .when(F.substr(head, F.lit(1), F.lit(8)).isin(*RAW_VERSIONS), "raw").when(pnm, "pnm")
        .when(tga, "tga").when(icon, "ico")
        .when(text.rlike("^(?i)[\\s\\x0B\\xA0]*<(\\?xml|svg)"), "svg").when(raw_name, "raw").otherwise("unknown")
    )
