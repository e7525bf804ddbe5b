"""Token ids in wavelet-matrix files, one for each shard of ascending ids.

A file holds a header, the shard's document ids and lengths, and for each bit of the ids, highest first, a bit
plane cut into blocks: each is compressed by itself, and the header has where it lies and the ones before it. So
``WaveletMatrix`` answers access, rank (counting), and select (occurrence lookup) from one compressed file, of
which ``access`` reads the header and a block of each plane. Tasks take ranges of document ids, cut by Spark's range
partitioning, encode their documents and cut their files where the tokens they count are enough; files in order of
their names hold all documents in ascending order.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import small_batches, steps, texts
from .store import fresh_path, materialize
from .tokens import encoder, vocabulary

MAGIC = b"WMX2"
#: Bits of a plane's block.
BLOCK = 1 << 15
#: Blocks of a plane that a reader keeps.
KEPT = 64
#: Tokens a shard holds when it is closed, but for its last document.
SHARD_TOKENS = 2_000_000
#: A shard's number is its task's number and its place among that task's shards.
_TASK, _GROUP = 24, 34


class Plane:
    """Bits in blocks, with the ones before each block and in the end of all; a block is fetched when it is met."""

    def __init__(self, ones: np.ndarray, fetch: Callable[[int], np.ndarray]) -> None:
        self.ones, self.fetch, self.held = ones, fetch, {}

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        """Of packed bits."""
        step = BLOCK // 8
        counts = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), step), dtype=np.int64) if len(bits) else np.zeros(0, np.int64)
        return cls(np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), lambda k: bits[k * step : (k + 1) * step])

    def block(self, k: int) -> np.ndarray:
        if k not in self.held:
            if len(self.held) >= KEPT:
                self.held.clear()
            self.held[k] = self.fetch(k)
        return self.held[k]

    def bit(self, at: int) -> int:
        return int(self.block(at // BLOCK)[at % BLOCK // 8]) >> at % 8 & 1

    def rank1(self, at: int) -> int:
        """Ones before position ``at``."""
        k, rest = divmod(at, BLOCK)
        if not rest:
            return int(self.ones[k])
        bits = self.block(k)
        part = int(bits[rest // 8] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0
        return int(self.ones[k]) + int(np.bitwise_count(bits[: rest // 8]).sum(dtype=np.int64)) + part

    def select(self, bit: int, nth: int) -> int:
        """Position of the nth one or zero."""
        before = self.ones if bit else np.arange(len(self.ones)) * BLOCK - self.ones
        k = int(np.searchsorted(before[:-1], nth, side="right")) - 1
        found = np.flatnonzero(np.unpackbits(self.block(k), bitorder="little") == bit)
        return k * BLOCK + int(found[nth - int(before[k])])

    def bits(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint8), *(self.fetch(k) for k in range(len(self.ones) - 1))])


class WaveletMatrix:
    """Bit planes of a sequence of unsigned integers."""

    def __init__(self, n: int, planes: list[Plane], zeros: list[int]) -> None:
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length() if len(ids) else 1)
        kind = np.uint16 if bits <= 16 else np.uint32
        left, planes, zeros = ids.astype(kind), [], []
        for k in reversed(range(bits)):
            ones = (left & kind(1 << k)) != 0
            planes.append(Plane.of(np.packbits(ones, bitorder="little")))
            zeros.append(int(len(left) - np.count_nonzero(ones)))
            left = np.concatenate([left[~ones], left[ones]])
        return cls(len(left), planes, zeros)

    def _step(self, plane: int, bit: int, at: int) -> int:
        ones = self.planes[plane].rank1(at)
        return self.zeros[plane] + ones if bit else at - ones

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for k, plane in enumerate(self.planes):
            bit = plane.bit(at)
            value = value << 1 | bit
            at = self._step(k, bit, at)
        return value

    def _span(self, value: int, end: int) -> tuple[int, int]:
        start = 0
        if value >> len(self.planes):
            return 0, 0
        for k in range(len(self.planes)):
            bit = value >> (len(self.planes) - 1 - k) & 1
            start, end = self._step(k, bit, start), self._step(k, bit, end)
        return start, end

    def rank(self, value: int, end: int | None = None) -> int:
        """How often ``value`` occurs before position ``end``."""
        start, end = self._span(value, self.n if end is None else end)
        return end - start

    def select(self, value: int, nth: int) -> int:
        """Position of the nth occurrence (from 0)."""
        start, end = self._span(value, self.n)
        if not 0 <= nth < end - start:
            raise IndexError(nth)
        at = start + nth
        for k in reversed(range(len(self.planes))):
            bit = value >> (len(self.planes) - 1 - k) & 1
            at = self.planes[k].select(bit, at - self.zeros[k] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence: planes undone from the last, each partition reversed."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k, plane in reversed(list(enumerate(self.planes))):
            ones = np.unpackbits(plane.bits(), count=self.n, bitorder="little").view(bool)
            back = np.empty_like(values)
            back[~ones] = values[: self.zeros[k]]
            back[ones] = values[self.zeros[k] :] | kind(1 << (len(self.planes) - 1 - k))
            values = back
        return values.astype(np.uint32)


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """One shard's file. Null document ids are kept as such."""
    tree, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1, write_checksum=True)
    known = np.array([x is not None for x in doc_ids], bool)
    parts = [np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.packbits(known).tobytes(), np.array(lengths, "<i8").tobytes()]
    for plane in tree.planes:
        parts += [plane.fetch(k).tobytes() for k in range(len(plane.ones) - 1)]
    packed = [pack.compress(p) for p in parts]
    head = struct.pack("<QQI", len(doc_ids), tree.n, len(tree.planes)) + np.array(tree.zeros, "<u8").tobytes()
    head += b"".join(plane.ones.astype("<u8").tobytes() for plane in tree.planes) + np.array([len(p) for p in packed], "<u8").tobytes()
    body = io.BytesIO()
    body.write(MAGIC + struct.pack("<QI", len(head), zlib.crc32(head)) + head)
    for p in packed:
        body.write(p)
    body = body.getvalue()
    return body + struct.pack("<I", zlib.crc32(body))


def open_file(read: Callable[[int, int], bytes]) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """Document ids, lengths and tokens of a shard, of which ``read`` gives so many bytes from a place on. Blocks of
    tokens are read when they are met; a damaged header or block raises."""
    start = len(MAGIC) + struct.calcsize("<QI")
    first = read(0, start)
    size, check = struct.unpack("<QI", first[len(MAGIC) :]) if len(first) == start else (0, 0)
    if first[: len(MAGIC)] != MAGIC or zlib.crc32(head := read(start, size)) != check:
        raise ValueError("not a whole wavelet-matrix file")
    docs, n, planes = struct.unpack_from("<QQI", head)
    blocks = -(-n // BLOCK)
    numbers = np.frombuffer(head, "<u8", offset=struct.calcsize("<QQI")).astype(np.int64)
    zeros, ones, sizes = numbers[:planes].tolist(), numbers[planes : planes * (blocks + 2)].reshape(planes, blocks + 1), numbers[planes * (blocks + 2) :]
    places = start + size + np.concatenate([[0], np.cumsum(sizes)])
    unpack = zstandard.ZstdDecompressor()

    def part(k: int) -> bytes:
        try:
            return unpack.decompress(read(int(places[k]), int(sizes[k])))
        except zstandard.ZstdError as e:
            raise ValueError("a damaged block") from e

    known = np.unpackbits(np.frombuffer(part(1), np.uint8), count=docs).astype(bool)
    doc_ids = [x if k else None for x, k in zip(np.frombuffer(part(0), "<i8").tolist(), known, strict=True)]
    made = [Plane(ones[k], lambda b, k=k: np.frombuffer(part(3 + k * blocks + b), np.uint8)) for k in range(planes)]
    return doc_ids, np.frombuffer(part(2), "<i8"), WaveletMatrix(n, made, zeros)


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """``open_file`` of a file that is there as a whole, and is checked as a whole."""
    if zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("not a whole wavelet-matrix file")
    return open_file(lambda at, size: data[at : at + size])


def _write(folder: str, path: str, end_id: int, shard_tokens: int):
    """Shard files from rows (doc_id, text) in ascending order. A file gets its name when it is whole, so a task
    that is run again, or twice at once, leaves one good file for each shard."""
    end = struct.pack("<I", end_id)

    def put(shard: int, ids: list, lengths: list, parts: list) -> tuple:
        data = write_file(ids, lengths, np.frombuffer(b"".join(parts), "<u4"))
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, name = f"{root}/.{shard}-{uuid.uuid4().hex}", f"{root}/{shard:016d}.wmx"
        with store.open_output_stream(part) as f:
            f.write(data)
        try:
            store.move(part, name)
        except OSError:  # some stores do not replace: the other attempt's file is the same
            if store.get_file_info(name).type != pafs.FileType.File:
                raise
            store.delete_file(part)
        return shard, len(ids), sum(lengths), len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path).each, TaskContext.get().partitionId() << _TASK
        ids, lengths, parts, held = [], [], [], 0
        done: list[tuple] = []
        for batch in steps(batches):
            for key, found in zip(batch.column(0).to_pylist(), encode(texts(batch.column(1), lower=False)), strict=True):
                found += end
                ids.append(key)
                lengths.append(len(found) // 4)
                parts.append(found)
                held += lengths[-1]
                if held >= shard_tokens:
                    done.append(put(shard, ids, lengths, parts))
                    shard, ids, lengths, parts, held = shard + 1, [], [], [], 0
        if ids:
            done.append(put(shard, ids, lengths, parts))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.int64()) for k in range(4)], names=["shard", "docs", "tokens", "bytes"])

    return run


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode all documents into the files of a shared folder. Returns the folder and the manifest: shard, docs,
    tokens, bytes. Rows of one id, however many, are dealt by their texts."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a guess at the tokens sets the number of tasks; files are cut by the true count
    tasks = max(1, round((rows.agg(F.sum(F.length("text"))).first()[0] or 0) / 4 / shard_tokens))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = small_batches(rows).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return folder, materialize(dealt.mapInArrow(_write(folder, path or vocabulary(), end_id, shard_tokens), "shard long, docs long, tokens long, bytes long"), "manifest")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ids, lengths, tree = read_file(data)
            tokens, ends = tree.decode(), np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            shard = int(name.rpartition("/")[2].partition(".")[0])
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The manifest has a row for each shard; its
    running totals are those of groups of a thousand tasks, of which one task adds up the sums, and within them."""
    files = spark.read.format("binaryFile").load(folder + "/*.wmx").select("path", "content")
    group = F.shiftright("shard", _GROUP).alias("group")
    before = lambda col, order: F.coalesce(F.sum(col).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = manifest.groupBy(group).agg(F.sum("tokens").alias("tokens")).select("group", before("tokens", W.orderBy("group")).alias("ahead"))
    starts = manifest.select("shard", group, before("tokens", W.partitionBy(group).orderBy("shard")).alias("inner")).join(groups, "group").select("shard", (F.col("ahead") + F.col("inner")).alias("first"))
    rows = files.mapInArrow(_documents, "shard long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(starts, "shard").select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write and read back. Null texts are empty (their end id alone); null ids come first; repeated rows and
    equal ids stand side by side in any order; an empty table has no files and no rows."""
    spark = docs.sparkSession
    folder, manifest = write_shards(docs, id_col, text_col, path, end_id, shard_tokens)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, folder, manifest)
