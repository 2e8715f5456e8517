"""Column expressions over paths, captions, reasons, numbers and text. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file extensions that are accepted, and the quality presets (longest edge in pixels, JPEG quality).
PHOTO_EXTENSIONS = ("jpg", "jpeg", "jpe", "jfif", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif", "hif", "avif", "psd", "psb", "tga", "tpic", "qoi", "pnm", "pam", "pbm", "pgm", "ppm", "ico", "cur")
RAW_EXTENSIONS = ("3fr", "arq", "arw", "cap", "cr2", "cr3", "crw", "dcr", "dng", "eip", "erf", "fff", "iiq", "k25", "kdc", "mdc", "mef", "mos", "mrw", "nef", "nrw", "orf", "ori", "pef", "ptx", "pxn", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw", "x3f")
DOCUMENT_EXTENSIONS = ("pdf",)
ACCEPTED_EXTENSIONS = PHOTO_EXTENSIONS + RAW_EXTENSIONS + DOCUMENT_EXTENSIONS
PRESETS = {"smaller": (1200, 65), "balanced": (1600, 75), "higher": (2048, 82)}
DEFAULT_PRESET = "balanced"
CAPTION_LENGTH = 110
WRAP_WIDTH = 78
THUMBNAIL_EDGE = 360


def basename(path: Column) -> Column:
    """What follows the last slash of either kind."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the name; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def extension_when_dropped(path: Column) -> Column:
    """As extension(), but a name that only starts with a dot has one: dropped items are judged this way."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def accepted(path: Column) -> Column:
    return extension(path).isin(*ACCEPTED_EXTENSIONS)


def accepted_when_dropped(path: Column) -> Column:
    return F.coalesce(path != "", F.lit(False)) & extension_when_dropped(path).isin(*ACCEPTED_EXTENSIONS)


def absolute(path: Column) -> Column:
    """Whether a request names a file by an absolute path; a missing one doesn't."""
    return F.coalesce(F.startswith(path, F.lit("/")), F.lit(False))


def is_pdf(path: Column) -> Column:
    return extension(path) == "pdf"


def kind(path: Column) -> Column:
    return F.when(is_pdf(path), "pdf").otherwise("image")


def natural_key(name: Column) -> Column:
    """A key whose binary order compares digit runs as numbers (of any length) and the rest as lower-cased text."""
    runs = F.regexp_extract_all(F.lower(name), F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def coded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 4, "0"), digits)).otherwise(run)

    return F.array_join(F.transform(runs, coded), "")


def norm_rotation(value: Column) -> Column:
    """A turn as 0, 90, 180 or 270: the nearest quarter (halves go up); what isn't a finite number is 0."""
    number = value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(1e15))
    return F.when(finite, F.pmod((F.floor(number / 90 + 0.5) * 90).cast("long"), F.lit(360)).cast("int")).otherwise(0)


def norm_degrees(value: Column) -> Column:
    """A turn reduced to 0..359 without snapping."""
    return F.pmod(value, F.lit(360))


def sanitized(text: Column, longest: int = CAPTION_LENGTH) -> Column:
    """Printable ASCII with single spaces, cut to the length with three dots."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20-\x7E]", " "), r"\s+", " "))
    return F.when(F.length(clean) > longest, F.concat(F.substring(clean, 1, longest - 3), F.lit("..."))).otherwise(clean)


def caption(name: Column, label: Column, longest: int = CAPTION_LENGTH) -> Column:
    return sanitized(F.when(F.coalesce(label, F.lit("")) != "", F.concat(name, F.lit(" - "), label)).otherwise(name), longest)


def reason_code(message: Column, pdf: Column, user_facing: Column) -> Column:
    """Why a file was skipped, by the first pattern that its error message fits."""
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(m.rlike("(?i)ENOENT|no such file"), "file_not_found")
        .when(m.rlike("(?i)EACCES|EPERM|permission"), "no_permission")
        .when(~pdf & user_facing, F.concat(F.lit("decoder:"), m))
        .when(~pdf, "not_readable_image")
        .when(m.rlike("(?i)encrypt|password"), "password_protected")
        .when(m.rlike("(?i)no pages"), "no_pages")
        .otherwise("not_readable_pdf")
    )


def preset(name: Column) -> Column:
    """The preset's name, or the default one's."""
    return F.when(name.isin(*PRESETS), name).otherwise(DEFAULT_PRESET)


def _of_preset(name: Column, place: int) -> Column:
    values = F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[place])])
    return values[preset(name)]


def max_edge(name: Column) -> Column:
    return _of_preset(name, 0)


def jpeg_quality(name: Column) -> Column:
    return _of_preset(name, 1)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def size_text(n_bytes: Column) -> Column:
    kb = F.floor(n_bytes / 1024 + 0.5)
    tenths = F.floor(kb * 10 / 1024 + 0.5)
    return F.when(kb >= 1024, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" MB"))).otherwise(F.concat(kb.cast("string"), F.lit(" KB")))


def html_escaped(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def ready_text(images: Column, pdfs: Column) -> Column:
    """What a list of files says about itself."""
    return (
        F.when((images == 0) & (pdfs == 0), "Nothing added yet").when(pdfs == 0, F.concat(plural(images, "photo"), F.lit(" ready")))
        .when(images == 0, F.concat(plural(pdfs, "PDF"), F.lit(" ready"))).otherwise(F.concat(plural(images, "photo"), F.lit(" + "), plural(pdfs, "PDF"), F.lit(" ready")))
    )


def status_text(images: Column, pdfs: Column, pages: Column, n_bytes: Column, skipped: Column) -> Column:
    """What a finished build says: files by kind, pages, size and how many were skipped."""
    parts = F.concat_ws(" + ", F.when(images > 0, plural(images, "photo")), F.when(pdfs > 0, plural(pdfs, "PDF")))
    tail = F.when(skipped > 0, F.concat(F.lit(" "), plural(skipped, "file"), F.lit(" skipped."))).otherwise("")
    return F.concat(F.lit("PDF saved — "), parts, F.lit(", "), plural(pages, "page"), F.lit(", "), size_text(n_bytes), F.lit("."), tail)


def default_name(day: Column, first_path: Column) -> Column:
    """Photos-<day>.pdf beside the first input."""
    name = F.concat(F.lit("Photos-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".pdf"))
    return F.concat_ws("/", F.nullif(directory(first_path), F.lit("")), name)


def cache_key(path: Column, length: Column, modified: Column) -> Column:
    """Path, size and time of change; null when the file is missing."""
    return F.when(length.isNotNull() & modified.isNotNull(), F.concat_ws("|", path, length.cast("string"), modified.cast("string")))


def data_url(jpeg: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.regexp_replace(F.base64(jpeg), "[\r\n]", ""))


def ascii_folded(text: Column) -> Column:
    """Dashes, curly quotes, ellipsis and no-break space as ASCII."""
    return F.replace(F.translate(text, "–—‘’“” ", "--''\"\" "), F.lit("…"), F.lit("..."))


#: The line patterns of the Markdown clean-up and what stands for them, in their order.
MARKDOWN = (
    (r"^#{1,6}\s+", ""),
    (r"^>\s?", "    "),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"`([^`]*)`", "$1"),
    (r"^<(https?:[^>]+)>$", "$1"),
)


def markdown_stripped(line: Column) -> Column:
    for pattern, by in MARKDOWN:
        line = F.regexp_replace(line, pattern, by)
    return F.regexp_replace(line, r"\s+$", "")


def wrapped(line: Column, width: int = WRAP_WIDTH) -> Column:
    """The line's words in lines of at most `width`, longer words whole; an array of lines."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, word: Column) -> Column:
        over = (acc["now"] != "") & (F.length(acc["now"]) + 1 + F.length(word) > width)
        joined = F.when(acc["now"] == "", word).otherwise(F.concat(acc["now"], F.lit(" "), word))
        return F.struct(F.when(over, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(over, word).otherwise(joined).alias("now"))

    # a line of single spaces is cut by one pattern: the most that fits and ends before a space or the end, or a longer word
    single = F.split(F.rtrim(F.regexp_replace(line, rf"(?s)([^ ]{{{width + 1},}}|.{{1,{width}}})(?: |\z)", "$1\n"), F.lit("\n")), "\n")
    folded = F.aggregate(F.split(line, " "), start, step, lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]))
    return F.when(F.length(line) <= width, F.array(line)).when(line.rlike("^ |  | $|\n"), folded).otherwise(single)


def plain_document(text: Column, width: int = WRAP_WIDTH) -> Column:
    """A Markdown text as wrapped ASCII lines ended by CRLF, with at most one blank line in a row."""
    lines = F.flatten(F.transform(F.split(ascii_folded(text), "\n"), lambda line: wrapped(markdown_stripped(line), width)))
    return F.concat(F.regexp_replace(F.array_join(lines, "\r\n"), "(\r\n){3,}", "\r\n\r\n"), F.lit("\r\n"))
