"""ZIP archives: directory, stored entries, and a writer of stored archives. Neither ZIP64 nor comments beyond
the scanned end are read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
SCANNED = 66_000
MOST_ENTRIES = 200_000


class Entry(NamedTuple):
    name: str
    method: int
    offset: int
    compressed_size: int
    size: int


def read_entries(data: bytes) -> list[Entry] | None:
    """Entries of the central directory, or None of anything but a whole ZIP file."""
    at = data.rfind(END, max(0, len(data) - SCANNED))
    if len(data) < 22 or at < 0 or at + 22 > len(data):
        return None
    count, _, start = struct.unpack_from("<HII", data, at + 10)
    if count > MOST_ENTRIES:
        return None
    out = []
    for _ in range(count):
        if data[start : start + 4] != CENTRAL or start + 46 > len(data):
            return None
        method, = struct.unpack_from("<H", data, start + 10)
        packed, size, name, extra, comment = struct.unpack_from("<IIHHH", data, start + 20)
        offset, = struct.unpack_from("<I", data, start + 42)
        if start + 46 + name > len(data):
            return None
        out.append(Entry(data[start + 46 : start + 46 + name].decode("utf-8", "replace"), method, offset, packed, size))
        start += 46 + name + extra + comment
    return out


def _body(data: bytes, entry: Entry) -> bytes | None:
    if data[entry.offset : entry.offset + 4] != LOCAL or entry.offset + 30 > len(data):
        return None
    name, extra = struct.unpack_from("<HH", data, entry.offset + 26)
    start = entry.offset + 30 + name + extra
    return data[start : start + entry.compressed_size] if start + entry.compressed_size <= len(data) else None


def read_stored(data: bytes, entry: Entry) -> bytes | None:
    """Bytes of an entry kept without compression, else None."""
    return _body(data, entry) if entry.method == 0 else None


#: Bytes that a compressed part may inflate to; a larger one is an error.
MOST_BYTES = 1 << 28


def inflated(packed: bytes, window: int = 15, most: int = MOST_BYTES) -> bytes:
    """Deflated bytes inflated, what a damaged end leaves of them included; more than ``most`` raise."""
    unpack = zlib.decompressobj(window)
    out = unpack.decompress(packed, most)
    if unpack.unconsumed_tail and unpack.decompress(unpack.unconsumed_tail, 1):
        raise ValueError(f"a part of over {most} bytes")
    return out


def read_entry(data: bytes, entry: Entry, most: int = MOST_BYTES) -> bytes | None:
    """Bytes of a stored or deflated entry; one of over ``most`` raises."""
    body = _body(data, entry)
    if body is None or entry.method == 0:
        return body
    if entry.method != 8:
        return None
    return inflated(body, -15, most)


# Media types of packages whose first entry names them, and entries that others have.
_TYPES = {"application/epub+zip": "epub", "application/vnd.oasis.opendocument.text": "odt", "application/vnd.oasis.opendocument.spreadsheet": "ods", "application/vnd.oasis.opendocument.presentation": "odp"}
_PARTS = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx"}


def package_kind(data: bytes | None) -> str:
    entries = read_entries(bytes(data or b"")) or []
    named = next((e for e in entries if e.name == "mimetype"), None)
    if named and (body := read_stored(bytes(data), named)) is not None and (kind := _TYPES.get(body.decode("latin-1").strip())):
        return kind
    names = {e.name for e in entries}
    return next((kind for part, kind in _PARTS.items() if part in names), "zip")


def build_zip(files: list[tuple[str, bytes]]) -> bytes:
    """A stored archive in the given order, without times."""
    body, directory = bytearray(), bytearray()
    for name, data in files:
        raw = name.encode()
        sizes = struct.pack("<IIIHH", zlib.crc32(data), len(data), len(data), len(raw), 0)
        directory += CENTRAL + struct.pack("<HHHHHH", 20, 20, 0, 0, 0, 0) + sizes + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + raw
        body += LOCAL + struct.pack("<HHHHH", 20, 0, 0, 0, 0) + sizes + raw + data
    return bytes(body + directory + END + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(directory), len(body), 0))


class ZipEntries:
    """SQL: ``FROM files, LATERAL zip_entries(content)``; no rows for what is no ZIP file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        yield from read_entries(bytes(content or b"")) or []


class ZipContents:
    """SQL: ``FROM files, LATERAL zip_contents(content)``: name, content; null for an entry that cannot be read."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        data = bytes(content or b"")
        for entry in read_entries(data) or []:
            try:
                yield entry.name, read_entry(data, entry)
            except (ValueError, zlib.error):
                yield entry.name, None


def register(spark: SparkSession) -> None:
    """Make ``zip_entries`` and ``zip_contents`` known to SQL."""
    spark.udtf.register("zip_contents", udtf(ZipContents, returnType="name string, content binary"))
    spark.udtf.register("zip_entries", udtf(ZipEntries, returnType="name string, method int, local_offset bigint, compressed_size bigint, size bigint"))
