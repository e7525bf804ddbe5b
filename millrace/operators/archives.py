"""One stored archive written by many tasks.

Entries come in parts, so that no row must hold a whole entry. Each part's place in the file is a running sum over all parts and
headers; the CRC-32 of an entry comes from those of its parts by arithmetic of polynomials: a checksum moved behind n bytes is its
product with x^8n, and an entry's is the sum (exclusive or) of its parts' so moved. Moving each part by its end in
the file first, backward, and the sum by the entry's end afterwards takes one aggregation and no order. Bodies, headers and the directory
are rows of (offset, data) that tasks write into one file, each at its place.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..sources.archive import CENTRAL, END, LOCAL
from ..sources.scratch import settled
from .offsets import running

#: Fixed value: the polynomial of CRC-32, its bits reflected.
POLYNOMIAL = 0xEDB88320
#: x to this power is 1: the polynomial is primitive.
PERIOD = (1 << 32) - 1
MOST_ENTRIES, MOST_BYTES = 0xFFFF, 0xFFFFFFFF
#: Files that a writing task holds open.
OPEN_FILES = 64


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements, modulo that of CRC-32; the highest bit is x^0."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint64(bit) & np.uint64(1), b, np.uint64(0))
        b = b >> np.uint64(1) ^ np.where(b & np.uint64(1), np.uint64(POLYNOMIAL), np.uint64(0))
    return out


def moved(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Checksums moved behind ``n_bytes`` bytes, or before them if negative."""
    power = (np.asarray(n_bytes, np.int64) % PERIOD * 8 % PERIOD).astype(np.uint64)
    out, square = np.asarray(crc, np.uint64).copy(), np.full(len(power), 1 << 30, np.uint64)  # x^1
    while power.any():
        out = np.where(power & np.uint64(1), _times(square, out), out)
        square = _times(square, square)
        power >>= np.uint64(1)
    return out


def _moved(crc: pd.Series, n_bytes: pd.Series) -> pd.Series:
    return pd.Series(moved(crc.to_numpy(), n_bytes.to_numpy()).astype(np.int64))


def placed(parts: DataFrame, order: list[str], part_order: list[str], name: str, data: str, by: Column) -> tuple[DataFrame, DataFrame]:
    """Parts (archive, offset, data), and for each entry (archive, its ``order`` columns, name, start, size, crc); ``by`` gives the
    archive's number.

    ``order`` tells entries apart and sorts them, ``part_order`` sorts an entry's parts; all parts of an entry name it alike.
    Null data is empty."""
    move = F.pandas_udf(_moved, "long")
    body = F.coalesce(F.col(data), F.lit(b""))
    rows = parts.select(by.cast("long").alias("archive"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"p{i}") for i, c in enumerate(part_order)), F.encode(name, "UTF-8").alias("name"), body.alias("data"))
    entry, within = [f"o{i}" for i in range(len(order))], [f"p{i}" for i in range(len(part_order))]
    # bodies by themselves first; the headers before each are as many as entries before it
    rows = running(rows.withColumn("n", F.octet_length("data").cast("long")), [*entry, *within], "n", "body", ["archive"])
    rows = rows.withColumn("crc", move(F.crc32("data"), -(F.col("body") + F.col("n"))))
    sums = rows.groupBy("archive", *entry).agg(F.first("name").alias("name"), F.min("body").alias("body"), F.sum("n").alias("size"), F.bit_xor("crc").alias("crc"))
    sums = sums.withColumns({"crc": move("crc", F.col("body") + F.col("size")), "head": (30 + F.octet_length("name")).cast("long")})
    entries = settled(running(sums, entry, "head", "heads", ["archive"]), "entries").withColumn("start", F.col("body") + F.col("heads"))
    heads = entries.select(F.col("archive").alias("_archive"), *(F.col(c).alias(f"_{c}") for c in entry), (F.col("heads") + F.col("head")).alias("heads"))
    same = F.col("archive") == F.col("_archive")
    for c in entry:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(heads, same).select("archive", (F.col("body") + F.col("heads")).alias("offset"), "data"), entries.select("archive", *entry, "name", "start", "size", "crc")


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local and directory headers of entries (archive, name, start, size, crc, place in the directory, where that begins)."""
    for batch in batches:
        archives, offsets, out = [], [], []
        for archive, name, start, size, crc, place, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sizes = struct.pack("<IIIHH", crc, size, size, len(name), 0)
            archives += [archive, archive]
            offsets += [start, at + place]
            out.append(LOCAL + struct.pack("<HHHHH", 20, 0, 0, 0, 0) + sizes + name)
            out.append(CENTRAL + struct.pack("<HHHHHH", 20, 20, 0, 0, 0, 0) + sizes + struct.pack("<HHHII", 0, 0, 0, 0, start) + name)
        yield pa.RecordBatch.from_arrays([pa.array(archives, pa.int64()), pa.array(offsets, pa.int64()), pa.array(out, pa.binary())], names=["archive", "offset", "data"])


def segments(parts: DataFrame, order: list[str], part_order: list[str], name: str, data: str, by: Column | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The archives of ``parts`` as (archive, offset, data) without gaps, and their sizes. ``by`` gives the number of a part's
    archive; without it there is one, 0, even of no entries. All are made together, whatever their number. More entries or bytes
    than the format's plain form can count raise."""
    spark = parts.sparkSession
    bodies, entries = placed(parts, order, part_order, name, data, F.lit(0) if by is None else by)
    entries = settled(running(entries.withColumn("dir", (46 + F.octet_length("name")).cast("long")), [f"o{i}" for i in range(len(order))], "dir", "place", ["archive"]), "directories")
    # a row for each archive
    found = entries.groupBy("archive").agg(F.count("*"), F.max(F.col("start") + 30 + F.octet_length("name") + F.col("size")), F.sum("dir")).collect()
    found = [tuple(x) for x in found] or ([(0, 0, 0, 0)] if by is None else [])
    for _, n, ends, long in found:
        if n > MOST_ENTRIES or ends + long > MOST_BYTES:
            raise ValueError(f"{n} entries in {ends + long} bytes are too many for one archive: split it")
    last = [(k, ends + long, bytearray(END + struct.pack("<HHHHIIH", 0, 0, n, n, long, ends, 0))) for k, n, ends, long in found]
    begins = spark.createDataFrame([(k, ends) for k, _, ends, _ in found], "archive long, at long")
    headers = entries.join(F.broadcast(begins), "archive").select("archive", "name", "start", "size", "crc", "place", "at").mapInArrow(_headers, "archive long, offset long, data binary")
    return bodies.where(F.octet_length("data") > 0).unionByName(headers).unionByName(spark.createDataFrame(last, "archive long, offset long, data binary")), {k: at + len(end) for k, at, end in last}


class PlacedFile(DataSource):
    """Writes rows of (file, offset, data) into files, on a file system that all executors share; option ``files`` is a JSON list of
    (number, path, size). Tasks write beside each other at their offsets; the files have their names when all are done."""

    @classmethod
    def name(cls) -> str:
        return "placed_file"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(json.loads(self.options["files"]), overwrite)


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, files: list[tuple[int, str, int]], overwrite: bool) -> None:
        self.files, self.size = {}, sum(size for _, _, size in files)
        for number, path, size in files:
            path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
            if "://" in path:
                raise ValueError("offsets can be written where files are; on other stores join the parts of segments()")
            if os.path.exists(path) and not overwrite:
                raise FileExistsError(path)
            self.files[number] = path, f"{path}.{uuid.uuid4().hex}"
            with open(self.files[number][1], "wb") as f:
                f.truncate(size)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n, opened = 0, {}
        try:
            for batch in iterator:
                for number, at, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    if number not in opened:
                        if len(opened) >= OPEN_FILES:
                            self._close(opened)
                        opened[number] = os.open(self.files[number][1], os.O_WRONLY)
                    done = 0
                    while done < len(data):
                        done += os.pwrite(opened[number], memoryview(data)[done:], at + done)
                    n += len(data)
        finally:
            self._close(opened)
        return Written(n)

    @staticmethod
    def _close(opened: dict[int, int]) -> None:
        while opened:
            file = opened.popitem()[1]
            try:
                os.fsync(file)
            finally:
                os.close(file)

    def commit(self, messages: list[Written | None]) -> None:
        if sum(m.n for m in messages if m) != self.size:
            self.abort(messages)
            raise ValueError("segments leave gaps or overlap")
        for path, part in self.files.values():
            os.replace(part, path)

    def abort(self, messages: list[Written | None]) -> None:
        for _, part in self.files.values():
            if os.path.exists(part):
                os.remove(part)


class Written(WriterCommitMessage):
    def __init__(self, n: int) -> None:
        self.n = n


def write_placed(rows: DataFrame, path: str, size: int, overwrite: bool = False) -> None:
    """Write rows of (offset, data), which cover it, as one file of ``size`` bytes."""
    _write(rows.select(F.lit(0).cast("long").alias("archive"), "offset", "data"), [(0, path, size)], overwrite)


def _write(rows: DataFrame, files: list[tuple[int, str, int]], overwrite: bool) -> None:
    rows.sparkSession.dataSource.register(PlacedFile)
    rows.write.format("placed_file").option("files", json.dumps(files)).mode("overwrite" if overwrite else "append").save()


def write_archive(parts: DataFrame, path: str, order: list[str], part_order: list[str], name: str = "name", data: str = "data", overwrite: bool = False) -> int:
    """Write ``parts`` as one stored archive at ``path``; its size. No entries make an archive of none."""
    rows, sizes = segments(parts, order, part_order, name, data)
    _write(rows, [(0, path, sizes[0])], overwrite)
    return sizes[0]


def write_archives(parts: DataFrame, folder: str, by: Column, order: list[str], part_order: list[str], name: str = "name", data: str = "data", overwrite: bool = False) -> int:
    """Write ``parts`` as stored archives ``folder``/``by``.zip, all in one pass over them; their number."""
    rows, sizes = segments(parts, order, part_order, name, data, by)
    if sizes:
        _write(rows, [(k, f"{folder}/{k}.zip", size) for k, size in sizes.items()], overwrite)
    return len(sizes)
