"""What a file is, by its bytes; one CASE expression, first match wins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import pandas_function
from ..functions.text import extension
from .archive import package_kind

# Signatures, formats, labels, confidences and reasons.
_PREFIXES = [
    ("255044462d", "document", "pdf", "PDF document", 0.99),
    ("7b5c727466", "document", "rtf", "Rich Text Format", 0.99),
]
_IMAGES = [
    ("89504e470d0a1a0a", "image", "png", "PNG image", 0.99),
    ("ffd8ff", "image", "jpeg", "JPEG image", 0.99),
    ("474946383761", "image", "gif", "GIF image", 0.98),
    ("474946383961", "image", "gif", "GIF image", 0.98),
    ("424d", "image", "bmp", "BMP image", 0.98),
    ("49492a00", "image", "tiff", "TIFF image", 0.98),
    ("4d4d002a", "image", "tiff", "TIFF image", 0.98),
]
_AUDIO = [
    ("664c6143", "audio", "flac", "FLAC audio", 0.99),
    ("4f676753", "audio", "ogg", "Ogg audio", 0.9),
    ("494433", "audio", "mp3", "MP3 audio", 0.99),
]
_ZIP_KINDS = {
    "epub": ("document", "epub", "EPUB ebook", 0.99, None),
    "odt": ("document", "odt", "OpenDocument text", 0.99, None),
    "ods": ("document", "ods", "OpenDocument spreadsheet", 0.99, None),
    "odp": ("document", "odp", "OpenDocument presentation", 0.99, None),
    "docx": ("document", "docx", "Word document", 0.99, None),
    "pptx": ("document", "pptx", "PowerPoint presentation", 0.99, None),
    "xlsx": ("document", "xlsx", "Excel workbook", 0.99, None),
    "zip": ("unsupported", "zip", "ZIP archive (unrecognized package)", 0.5, "Unsupported archive, or a password-protected Office file that cannot be opened."),
}


def _info(category: str, format: str, label: str, confidence: float, reason: str | None = None) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(format).alias("format"), F.lit(confidence).cast("double").alias("confidence"), F.lit(label).alias("label"), F.lit(reason).cast("string").alias("reason"))


def _starts(content: Column, prefix: str) -> Column:
    return F.startswith(content, F.lit(bytes.fromhex(prefix)))


def _at(content: Column, offset: int, text: str) -> Column:
    return F.substr(content, F.lit(offset + 1), F.lit(len(text))) == F.lit(text.encode())


def is_zip(content: Column) -> Column:
    return _starts(content, "504b0304") | _starts(content, "504b0506") | _starts(content, "504b0708")


def is_wav(content: Column) -> Column:
    return (F.octet_length(content) >= 12) & _starts(content, "52494646") & _at(content, 8, "WAVE")


def sniff_text(content: Column) -> Column:
    """Whether the first 2048 bytes look like text: a byte-order mark, or at most one byte in twenty a control."""
    head = F.decode(F.substr(content, F.lit(1), F.lit(2048)), "ISO-8859-1")
    n = F.length(head)
    control = n - F.length(F.regexp_replace(head, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    marked = _starts(content, "efbbbf") | _starts(content, "fffe") | _starts(content, "feff")
    # printable bytes are all but the controls, so a share under 5 % makes the other over 85 %
    return F.coalesce((F.octet_length(content) > 0) & (marked | (control / n <= 0.05)), F.lit(False))


def _literal(info: Info) -> str:
    category, format, label, confidence, reason = info if len(info) == 5 else (*info, None)
    quoted = lambda x: "cast(NULL AS string)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"named_struct('category', {quoted(category)}, 'format', {quoted(format)}, 'confidence', {confidence}D, 'label', {quoted(label)}, 'reason', {quoted(reason)})"


Info = tuple[str, str, str, float, str | None]
_EMPTY = ("unsupported", "empty", "Empty file", 1.0, "This file is empty (0 bytes).")
_UNKNOWN = ("unknown", "unknown", "Unrecognized file", 0.2, "This file type is not supported.")


def _rules(content: Column, name: Column, strict: bool) -> list[tuple[Column, Info | None]]:
    """Conditions in order and what a file then is; None stands for a ZIP file's package."""
    signed = lambda kinds: [(_starts(content, prefix), (category, format, label, confidence, None)) for prefix, category, format, label, confidence in kinds]
    riff, ftyp, brand = _starts(content, "52494646"), _at(content, 4, "ftyp"), F.decode(F.substr(content, F.lit(9), F.lit(4)), "ISO-8859-1")
    sync = F.hex(F.substr(content, F.lit(1), F.lit(2))).rlike("^FF[EF]")
    text = sniff_text(content)
    return [
        (content.isNull() | (F.octet_length(content) == 0), _EMPTY),
        *signed(_PREFIXES),
        (is_zip(content), None),
        *signed(_IMAGES),
        (riff & _at(content, 8, "WEBP"), ("image", "webp", "WebP image", 0.99, None)),
        (ftyp & F.lower(brand).isin("heic", "heix", "heif", "mif1", "hevc"), ("image", "heic", "HEIC image", 0.6, "HEIC may not render in this browser.")),
        (ftyp & brand.isin("m4a ", "m4b ", "mp4a"), ("audio", "m4a", "AAC/M4A audio", 0.9, None)),
        (ftyp & (brand == "qt  "), ("video", "mov", "QuickTime video", 0.9, None)),
        (ftyp, ("video", "mp4", "MP4 video/audio", 0.9, None)),
        (is_wav(content), ("audio", "wav", "WAV audio", 0.99, None)),
        (_starts(content, "464f524d") & _at(content, 8, "AIFF"), ("audio", "aiff", "AIFF audio", 0.99, None)),
        *signed(_AUDIO),
        (sync if strict else sync & ~_starts(content, "fffe"), ("audio", "mp3", "MP3 audio", 0.9, None)),
        (_starts(content, "1a45dfa3"), ("video", "webm", "WebM/Matroska video", 0.9, None)),
        (riff & _at(content, 8, "AVI "), ("unsupported", "avi", "AVI video", 0.9, "AVI audio extraction is not supported in browsers.")),
        (_starts(content, "3026b2758e66cf11"), ("unsupported", "wmv", "WMV/ASF video", 0.9, "WMV audio extraction is not supported in browsers.")),
        (_starts(content, "d0cf11e0a1b11ae1"), ("document", "ole", "OLE compound document", 0.9, None)),
        (text & (extension(name) == "csv"), ("document", "csv", "CSV file", 0.8, None)),
        (text, ("text", "text", "Plain text", 0.8, None)),
    ]


def classify(content: Column, name: Column, zip_kind: Column | None = None, strict: bool = False) -> Column:
    """``detected`` struct of a file. ``zip_kind`` is the package kind of ZIP files (see ``package_kind``); without it
    they are unrecognized archives. ``strict`` keeps a defect: UTF-16LE text with its mark counts as MP3."""
    package = _info(*_ZIP_KINDS["zip"])
    for key, kind in _ZIP_KINDS.items():
        if zip_kind is not None:
            package = F.when(zip_kind == key, _info(*kind)).otherwise(package)
    out = None
    for condition, info in _rules(content, name, strict):
        out = (F if out is None else out).when(condition, package if info is None else _info(*info))
    return out.otherwise(_info(*_UNKNOWN))


#: What a file can be, by the numbers that ``classified`` gives.
_ZIPS = list(_ZIP_KINDS)


@pandas_function("int")
def _settled(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The number of each file's kind; that of a ZIP file (its content is there) by its package, below zero."""
    for codes, contents in batches:
        yield pd.Series([code if data is None else -1 - _ZIPS.index(package_kind(data)) for code, data in zip(codes, contents, strict=True)], dtype="int32")


def classified(files: DataFrame, strict: bool = False) -> DataFrame:
    """``files`` (name, content) with ``detected``, in one pass. The rules are tried once for each file: Python gets the number
    of the rule that holds, and the bytes of files with a ZIP signature only. So what uses ``detected`` never tries them
    again."""
    content = F.col("content")
    rules, code = _rules(content, F.col("name"), strict), None
    for k, (condition, _) in enumerate(rules):
        code = (F if code is None else code).when(condition, k)
    zipped = F.when(is_zip(content), content)
    infos = [*(info or _ZIP_KINDS["zip"] for _, info in rules), _UNKNOWN, *(_ZIP_KINDS[key] for key in reversed(_ZIPS))]
    # one text: as columns these constants would take longer to build than small tables to convert
    known = F.expr(f"array({', '.join(map(_literal, infos))})")
    settled = files.withColumn("_code", _settled(code.otherwise(len(rules)), zipped))
    at = F.when(F.col("_code") < 0, F.col("_code") + len(infos)).otherwise(F.col("_code"))
    return settled.withColumn("detected", F.get(known, at)).drop("_code")
