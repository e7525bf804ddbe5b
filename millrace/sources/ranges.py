"""Reading files by ranges of bytes, and archives' directories and entries by them.

A file is opened where Arrow reads it (``file:``, ``s3:``, ``gs:``, ``hdfs:`` with its library); of an archive come its last
bytes, its directory, and the ranges of the wanted entries, nothing else."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive

ENTRIES = "path string, length long, no int, name string, method int, local_offset long, compressed_size long, size long, crc long, error string, bytes_read long"


@lru_cache(64)
def _system(scheme: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(scheme)[0]


class Ranged:
    """A file's ranges; ``read`` counts the bytes that were asked for."""

    def __init__(self, path: str) -> None:
        path = path.replace("file:///", "/") if path.startswith("file:///") else path.removeprefix("file:")
        if "://" in path:
            scheme, rest = path.split("://", 1)
            self.file = _system(f"{scheme}://{rest.split('/', 1)[0]}/").open_input_file(rest if scheme in ("s3", "gs") else "/" + rest.split("/", 1)[1])
        else:
            self.file = fs.LocalFileSystem().open_input_file(unquote(path))
        self.size, self.read = self.file.size(), 0

    def at(self, start: int, size: int) -> bytes:
        size = max(0, min(size, self.size - start))
        self.read += size
        return self.file.read_at(size, start) if size else b""

    def __enter__(self) -> Ranged:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def directory(file: Ranged) -> list[tuple] | None:
    """(name, method, local offset, compressed size, size, CRC) of each entry, or None of what is no whole archive."""
    start = max(0, file.size - archive.SCANNED)
    tail = file.at(start, archive.SCANNED)
    end = tail.rfind(archive.END)
    if file.size < 22 or end < 0 or end + 22 > len(tail):
        return None
    count, size, first = struct.unpack_from("<HII", tail, end + 10)
    if count > archive.MOST_ENTRIES:
        return None
    # the directory often lies in what has been read
    data = tail[first - start :] if first >= start else file.at(first, max(size, 1))
    out, at = [], 0
    for _ in range(count):
        if data[at : at + 4] != archive.CENTRAL or at + 46 > len(data):
            return None
        (method,) = struct.unpack_from("<H", data, at + 10)
        crc, packed, whole, name, extra, comment = struct.unpack_from("<IIIHHH", data, at + 16)
        (offset,) = struct.unpack_from("<I", data, at + 42)
        if at + 46 + name > len(data):
            return None
        out.append((data[at + 46 : at + 46 + name].decode("utf-8", "replace"), method, offset, packed, whole, crc))
        at += 46 + name + extra + comment
    return out


def archive_entries(files: DataFrame, path_col: str = "path") -> DataFrame:
    """A row for each entry of each archive: path, length, no, name, method, local_offset, compressed_size, size, crc; of what is
    no archive or cannot be opened a row with ``error``. ``bytes_read`` of an archive stands in its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    with Ranged(path) as file:
                        found = directory(file)
                        for no, e in enumerate(found or []):
                            rows.append((path, file.size, no, *e, None, 0 if no else file.read))
                        if not found:
                            rows.append((path, file.size, *[None] * 7, None if found == [] else "no archive", file.read))
                except (OSError, pa.ArrowInvalid) as e:
                    rows.append((path, *[None] * 8, str(e)[:200], 0))
                kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.int64())
                names = [f.strip().split()[0] for f in ENTRIES.split(",")]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + 10_000]], t) for k, t in enumerate(kinds)], names=names)

    return files.select(F.col(path_col).cast("string")).mapInArrow(run, ENTRIES)


def archives_at(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Entries of the archives under ``path``. Spark lists the files; their contents are not read by it."""
    return archive_entries(spark.read.format("binaryFile").options(**options).load(path).select("path"))


def entry_contents(entries: DataFrame, most: int = archive.MOST_BYTES) -> DataFrame:
    """``entries`` (any rows of ``archive_entries``) with content, problem and bytes_read of it: each entry's own range. Filter the
    rows first: what is not asked for is not read. An entry of over ``most`` bytes, of another method than stored and
    deflated, damaged, or with another checksum has no content but a problem. Deal the rows out with ``repartition``
    where one archive is large."""
    names = entries.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.drop("bytes_read").schema.fields) + ", content binary, problem string, bytes_read long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str, Ranged] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                get = lambda c, row=row: row.column(names.index(c))[0].as_py()
                content = problem = None
                read = 0
                if get("local_offset") is not None:
                    try:
                        if held is None or held[0] != get("path"):
                            if held:
                                held[1].file.close()
                            held = get("path"), Ranged(get("path"))
                        before = held[1].read
                        content = _entry(held[1], get("method"), get("local_offset"), get("compressed_size"), get("size"), get("crc"), most)
                        read = held[1].read - before
                    except (OSError, ValueError, zlib.error, struct.error) as e:
                        problem = str(e)[:200] or type(e).__name__
                columns = [c for c, name in zip(row.columns, names, strict=True) if name != "bytes_read"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([content], pa.binary()), pa.array([problem]).cast(pa.string()), pa.array([read])], names=[*(n for n in names if n != "bytes_read"), "content", "problem", "bytes_read"])
        if held:
            held[1].file.close()

    return entries.mapInArrow(run, schema)


def _entry(file: Ranged, method: int, offset: int, packed: int, size: int, crc: int, most: int) -> bytes:
    if max(packed, size) > most:
        raise ValueError(f"an entry of over {most} bytes")
    head = file.at(offset, 30)
    if head[:4] != archive.LOCAL or len(head) < 30:
        raise ValueError("no local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    body = file.at(offset + 30 + name + extra, packed)
    if len(body) < packed:
        raise ValueError("the archive ends within the entry")
    if method not in (0, 8):
        raise ValueError(f"method {method}")
    out = body if method == 0 else archive.inflated(body, -15, most)
    if zlib.crc32(out) != crc:
        raise ValueError("another checksum")
    return out
