"""Text functions, each a column expression that stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the Web platform trims it: Unicode white space and the byte-order mark.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim(text: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def round_half_up(x: Column) -> Column:
    """Nearest integer, halves towards positive infinity."""
    return F.floor(x + 0.5)


def decode_text(content: Column) -> Column:
    """Text of a file: UTF-16 by its mark, else UTF-8 without its mark, malformed parts replaced."""
    utf8 = F.make_valid_utf8(content.cast("string"))
    return (
        F.when(F.startswith(content, F.lit(b"\xff\xfe")) | F.startswith(content, F.lit(b"\xfe\xff")), F.decode(_whole_units(content), "UTF-16"))
        .when(F.startswith(content, F.lit(b"\xef\xbb\xbf")), F.make_valid_utf8(F.substr(content, F.lit(4)).cast("string")))
        .otherwise(utf8)
    )


def _whole_units(content: Column) -> Column:
    """An odd last byte is no character."""
    return F.substr(content, F.lit(1), (F.octet_length(content) / 2).cast("int") * 2)


def fence(text: Column) -> Column:
    return F.concat(F.lit("```text\n"), text, F.lit("\n```"))


def format_bytes(n: Column) -> Column:
    """Rounded to the nearest, ties to the larger; null for a null size."""
    kb = 1024
    return (
        F.when(n.isNull(), F.lit(None).cast("string"))
        .when(n < kb, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < kb**2, F.format_string("%.1f KB", n / F.lit(float(kb))))
        .when(n < kb**3, F.format_string("%.1f MB", n / F.lit(float(kb**2))))
        .otherwise(F.format_string("%.2f GB", n / F.lit(float(kb**3))))
    )


#: Markdown marks taken off, in order: (pattern, replacement).
RAW_STEPS = (
    (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^#{1,6}\s+", ""),
    (r"\*\*([^*]+)\*\*", "$1"),
    (r"\*([^*]+)\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"(?m)^>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"\n{3,}", "\n\n"),
)


def raw_text(markdown: Column) -> Column:
    """Markdown as plain text."""
    for pattern, to in RAW_STEPS:
        markdown = F.regexp_replace(markdown, pattern, to)
    return trim(markdown)


#: Blocks of Arabic script.
RTL = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"


def text_dir(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")).rlike(RTL), "rtl").otherwise("ltr")


def esc(text: Column) -> Column:
    """HTML entities for the five characters that need them; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def markdown_html(markdown: Column) -> Column:
    """A small part of Markdown as HTML, raw HTML escaped: headings, bold, italics, code, links, line breaks."""
    out = esc(markdown)
    for level in range(6, 0, -1):
        out = F.regexp_replace(out, rf"(?m)^#{{{level}}}\s+(.+)$", f"<h{level}>$1</h{level}>")
    out = F.regexp_replace(out, r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"\*([^*\n]+)\*", "<em>$1</em>")
    out = F.regexp_replace(out, r"`([^`\n]+)`", "<code>$1</code>")
    out = F.regexp_replace(out, r"\[([^\]\n]*)\]\(([^)\s]*)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(out, r"\n", "<br>\n")


def words(text: Column) -> Column:
    return F.filter(F.split(trim(text), SPACE + "+"), lambda w: w != "")


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def zip_entry_name(name: Column) -> Column:
    """A safe archive name: unsafe characters as one underscore, no leading dots, the extension now ``md``."""
    out = F.regexp_replace(name, r'[\x00-\x1f\x7f/\\<>:"|?*]', "_")
    out = F.regexp_replace(out, r"_{2,}", "_")
    out = F.substring(trim(F.regexp_replace(out, r"^\.+", "")), 1, 240)
    stem = F.regexp_replace(out, r"(?s)^(.+)\.[^.]*$", "$1")
    return F.concat(F.when(stem == "", "converted").otherwise(stem), F.lit(".md"))


def download_name(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit(".md")) | F.endswith(name, F.lit(".txt")), name).otherwise(F.concat(name, F.lit(".md")))


def paste_name(stamp: Column, rand: Column, mime: Column) -> Column:
    """Name of a pasted image, its extension by media type."""
    kinds = F.create_map(*(F.lit(x) for pair in PASTE_EXTENSIONS.items() for x in pair))
    return F.concat(F.lit("pasted-"), export_stamp(stamp), F.lit("-"), F.substring(rand, 1, 5), F.lit("."), F.coalesce(F.element_at(kinds, mime), F.lit("png")))


#: Extensions of pasted images.
PASTE_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/bmp": "bmp", "image/tiff": "tiff", "image/gif": "gif", "image/svg+xml": "svg"}


def export_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd-HHmm")


def short_engine(engine: Column) -> Column:
    """Display name of an engine."""
    out = None
    for part, name in (("whisper", "Whisper"), ("moonshine", "Moonshine"), ("tesseract", "Tesseract"), ("rapidocr", "RapidOCR"), ("pdf-inspector", "PDF")):
        out = (F if out is None else out).when(F.contains(engine, F.lit(part)), name)
    return out.when(engine == "anydoc", "Office").when(engine == "text", "Text").otherwise(engine)


def meta_line(engine: Column, size: Column, duration_ms: Column, category: Column, confidence: Column) -> Column:
    """engine, size, duration if any, and the confidence of images, with dots between."""
    return F.concat_ws(
        " • ",
        short_engine(engine),
        format_bytes(size),
        F.when(duration_ms > 0, F.format_string("%.1fs duration", duration_ms / 1000.0)),
        F.when((category == "image") & confidence.isNotNull(), F.format_string("OCR %d%% conf", round_half_up(confidence * 100).cast("long"))),
    )


def effective_language(key: Column) -> Column:
    return F.when(key == "auto", "en").otherwise(key)


def parse_model(key: Column) -> Column:
    """family and tier of a model key, split at its last dash."""
    return F.struct(F.regexp_extract(key, r"^(.*)-[^-]*$", 1).alias("family"), F.substring_index(key, "-", -1).alias("tier"))


def size_label(n: Column) -> Column:
    return F.concat(F.greatest(F.lit(1), round_half_up(n / F.lit(1048576.0))).cast("string"), F.lit(" MB"))


#: Phases of a job as shown.
PHASES = {"reading": "Detecting…", "analyzing": "Extracting text…", "preprocessing": "Cleaning image…", "ocr": "Recognizing pages…", "asr": "Transcribing…", "model": "Downloading model…", "done": "Done"}


def phase_label(phase: Column) -> Column:
    """Shown name of a phase; others as they are."""
    names = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    return F.coalesce(F.element_at(names, phase), phase)


def mime(format: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.element_at(kinds, format), F.lit(""))


#: Media types of the audio and video formats.
MIME = {"wav": "audio/wav", "mp3": "audio/mpeg", "flac": "audio/flac", "ogg": "audio/ogg", "aiff": "audio/aiff", "m4a": "audio/mp4", "mp4": "video/mp4", "mov": "video/quicktime", "webm": "video/webm"}
