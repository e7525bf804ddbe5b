"""Exact deduplication by Grace hash partitioning.

Map tasks collapse the repeated texts that they meet, so a text that a third of all rows share travels about once
per task. The rest is dealt out by SHA-256 of the normalised text. A reduce task keeps an
open-addressing table that compares complete content; when the table outgrows its memory, its entries and
all further records go to spill files by further hash bits, and each file is treated in the same way.

Only counts and ids come back: documents meet their group by (digest, id), pre-aggregated, and groups
large enough to skew that join are at most ``HOT_PARTS`` in number, so they are broadcast.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, small_batches, steps, texts
from .store import fresh, materialize, meet

#: Bytes of distinct text that a table may hold before it goes to spill files.
TABLE_BYTES = 32 << 20
FAN_OUT = 16
#: Bytes of texts that a map task holds back for their copies.
HELD_BYTES = 8 << 20


class OpenTable:
    """Open addressing with linear probing. A slot's hash only saves comparisons: equality is that of the
    complete content."""

    def __init__(self) -> None:
        self.slots: list[int | None] = [None] * 1024
        self.entries: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, text: bytes, top: int | None, rows: int, ties: int) -> None:
        mask, hashed = len(self.slots) - 1, int.from_bytes(digest[8:16], "little")
        at = hashed & mask
        while (k := self.slots[at]) is not None:
            e = self.entries[k]
            if e[0] == digest:
                if e[1] != text:
                    raise ValueError("two different texts have one SHA-256; their rows can't be told apart")
                e[3] += rows
                if top == e[2]:
                    e[4] += ties
                elif e[2] is None or top is not None and top > e[2]:
                    e[2], e[4] = top, ties
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.entries)
        self.entries.append([digest, text, top, rows, ties])
        self.bytes += len(text) + 200
        if 2 * len(self.entries) > len(self.slots):
            self.grow()

    def grow(self) -> None:
        self.slots = [None] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, e in enumerate(self.entries):
            at = int.from_bytes(e[0][8:16], "little") & mask
            while self.slots[at] is not None:
                at = (at + 1) & mask
            self.slots[at] = k


def resolve(records: Iterator[tuple], limit: int, folder: str, level: int = 0) -> Iterator[tuple]:
    """(digest, text, top, rows, ties) of each distinct text. ``folder`` is the task's own scratch for spill
    files: read by nobody else, gone with the task."""
    table = OpenTable()
    for record in records:
        table.add(*record)
        # the last level has used up the digest's bits: what is left there is one text
        if table.bytes > limit and len(table.entries) > 1 and level < 8:
            break
    else:
        yield from map(tuple, table.entries)
        return
    names = [os.path.join(folder, f"{level}-{k}") for k in range(FAN_OUT)]
    files = [open(name, "wb") for name in names]  # noqa: SIM115
    put = [pickle.Pickler(f, protocol=5) for f in files]
    for part in (table.entries, records):
        for r in part:
            p = put[r[0][16 + level] % FAN_OUT]
            p.dump(tuple(r))
            p.clear_memo()
    for f in files:
        f.close()
    del table
    for name in names:
        yield from resolve(_read(name), limit, folder, level + 1)
        os.remove(name)


def _read(name: str) -> Iterator[tuple]:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.Unpickler(f).load()
            except EOFError:
                return


def _collapse(limit: int):
    """A row for each distinct text, with its largest id, its rows and how many have that id. A task holds back ``limit``
    bytes of texts; when they are more, those met once so far go on, and those that repeat stay for their next copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        size = 0
        for batch in steps(batches, 1000):
            for text, key in zip(texts(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                if (e := found.get(text)) is None:
                    found[text] = [key, 1, 1]
                    size += len(text)
                    continue
                e[1] += 1
                if key == e[0]:
                    e[2] += 1
                elif e[0] is None or key is not None and key > e[0]:
                    e[0], e[2] = key, 1
            if size > limit:
                kept = {t: e for t, e in found.items() if e[1] > 1}
                if (size := sum(map(len, kept))) > limit // 2:
                    kept, size = {}, 0
                yield from sent({t: e for t, e in found.items() if t not in kept})
                found = kept
        yield from sent(found)

    def sent(found: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        keys = list(found)
        for i in range(0, len(keys), 1000):
            part = keys[i : i + 1000]
            rows = [found[t] for t in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(t).digest() for t in part], pa.binary()), pa.array(part, pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))],
                names=["digest", "text", "top", "rows", "ties"],
            )

    return run


def _grace(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (r for batch in steps(batches, 256) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            out: list[tuple] = []
            for digest, _, top, rows, ties in resolve(records, limit, folder):
                out.append((digest, top, rows, ties))
                if len(out) == 10_000:
                    yield _groups(out)
                    out = []
            yield _groups(out)

    return run


def _groups(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kinds[k]) for k in range(4)], names=["digest", "keep_id", "group_size", "ties"])


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct text (A-Z lower-cased, null as empty): digest, keep_id (its largest id; null
    only if no row has one), group_size, ties (rows that have that id)."""
    local = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_collapse(HELD_BYTES), "digest binary, text binary, top long, rows long, ties long")
    return local.repartition("digest").mapInArrow(_grace(table_bytes), "digest binary, keep_id long, group_size long, ties long")


def _digest(column: int):
    return lambda batch: [[hashlib.sha256(t).digest() for t in texts(batch.column(column))]]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. The largest id of a group stays; null is below every id. Of repeated rows (equal
    id and text) exactly one is kept. An empty table gives an empty result."""
    rows = append(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), [T.StructField("digest", T.BinaryType())], _digest(1)).select("doc_id", "digest")
    copies = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    found = materialize(groups(docs, id_col, text_col, table_bytes).withColumn("size", F.col("group_size")), "grace-groups")
    met = meet(copies, found, "digest", "size", found.agg(F.sum("size")).first()[0] or 0)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc_id", "keep_id", "group_size", (first & (F.col("copy") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts, with its columns unchanged.

    The row with the largest id stays; where rows repeat id and text, one of them."""
    (digest, keep, ties) = fresh(docs, "digest", "keep_id", "ties")
    marked = append(docs, [T.StructField(digest, T.BinaryType())], _digest(docs.columns.index(text_col)))
    found = groups(docs, id_col, text_col, table_bytes).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep), F.col("ties").alias(ties))
    # keepers have distinct (digest, id), so the join is even whatever the sizes of the groups
    match = (marked[digest] == found[digest]) & marked[id_col].cast("long").eqNullSafe(found[keep])
    kept = marked.join(found, match).select(*(marked[c] for c in docs.columns), marked[digest], found[ties])
    single = kept.where(F.col(ties) == 1).select(*docs.columns)
    again = kept.where(F.col(ties) > 1).dropDuplicates([digest]).select(*docs.columns)
    return single.unionByName(again)
