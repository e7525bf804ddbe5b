"""Packing of documents into sequences by swap-based local search.

Pieces are dealt at random into groups of bounded size. A group starts from best fit with the longest pieces
first; then the emptiest underfull bin gives pieces away: it moves one to a bin with room, exchanges one for a
smaller one, or two for one. Each step raises the sum of squared fills, a bounded integer, so the search ends, and
bins that come out empty are gone. Bins that stay well underfull are dealt out again with those of other
groups, so that what each group leaves over does not add up.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import small_batches, steps, texts
from .store import materialize
from .tokens import encoder, vocabulary

CAPACITY = 4096
GROUP = 5000
ROUNDS = 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece: longest first, into the fullest bin with room."""
    bins, rooms, used = np.empty(len(sizes), np.int64), [], 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(rooms, (size, -1))
        if at == len(rooms):
            room, b = capacity, used
            used += 1
        else:
            room, b = rooms.pop(at)
        bins[k] = b
        if room > size:
            insort(rooms, (room - size, b))
    return bins


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """The local search; the result has no more bins than ``bins``."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    bound, stuck = -(-int(sizes.sum()) // capacity), set()
    pieces = np.flatnonzero(fill[bins] < capacity)  # full bins stay as they are
    while np.count_nonzero(fill) > bound:
        open_bins = [b for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist() if b not in stuck]
        if not open_bins:
            break
        victim = min(open_bins, key=fill.__getitem__)
        if _give(victim, sizes, bins, fill, pieces, capacity):
            stuck.clear()
        else:
            stuck.add(victim)
    return bins


def _give(victim: int, sizes: np.ndarray, bins: np.ndarray, fill: np.ndarray, pieces: np.ndarray, capacity: int) -> bool:
    """One step that takes from ``victim``, or False."""
    own = sorted(pieces[bins[pieces] == victim].tolist(), key=lambda k: -sizes[k])
    room = capacity - fill
    room[(fill < fill[victim]) | (fill == 0)] = 0  # others that are emptier would lower the squares
    room[victim] = 0
    others = pieces[bins[pieces] != victim]
    size, slack = sizes[others], room[bins[others]]

    def shift(piece: int, to: int) -> None:
        fill[bins[piece]] -= sizes[piece]
        fill[to] += sizes[piece]
        bins[piece] = to

    for k in own:
        fits = np.flatnonzero(room >= sizes[k])
        if len(fits):
            shift(k, int(fits[np.argmin(room[fits])]))
            return True
    seen: set[int] = set()
    for given in [[k] for k in own] + [[a, b] for i, a in enumerate(own) for b in own[i + 1 :]]:
        total = int(sizes[given].sum())
        if total in seen:
            continue
        seen.add(total)
        gain = total - size
        ok = np.flatnonzero((gain > 0) & (gain <= slack))
        if len(ok):
            taken = int(others[ok[np.argmax(gain[ok])]])
            to = int(bins[taken])
            shift(taken, victim)
            for k in given:
                shift(k, to)
            return True
    return False


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    return improve(sizes, best_fit(sizes, capacity), capacity)


def _pieces(path: str, end_id: int, capacity: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = encoder(path)
        for batch in steps(batches):
            out = []
            for key, ids in zip(batch.column(0).to_pylist(), found.each(texts(batch.column(1), lower=False)), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        found.forget()

    return run


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all documents; a text without tokens is its end id alone."""
    return small_batches(docs).select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pieces(path, end_id, capacity), PIECES)


def _group(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")  # rows of a group come in any order
        sizes = table.column("length").to_numpy()
        bins = pack(sizes, capacity)
        order = np.lexsort((np.arange(len(bins)), bins))
        runs = np.cumsum(sizes[order]) - sizes[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = runs - runs[first][np.cumsum(first) - 1]
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        return pa.table({"uid": table.column("uid"), "grp": table.column("grp"), "bin": bins, "offset": offset, "fill": fill})

    return run


def assign(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """uid, sequence_id, offset of the pieces (uid, length), none longer than ``capacity``."""
    done, left = None, rows
    for turn in range(rounds):
        groups = -(-left.count() // group) or 1
        dealt = left.select("uid", "length", F.pmod(F.xxhash64(F.lit(turn), "uid"), F.lit(groups)).alias("grp"))
        packed = materialize(dealt.groupBy("grp").applyInArrow(_group(capacity), "uid long, grp long, bin long, offset long, fill long"), "packed")
        last = turn == rounds - 1 or groups == 1
        # bins with an eighth or more of their room left meet those of other groups
        kept = packed if last else packed.where(F.col("fill") > capacity - capacity // 8)
        kept = kept.select("uid", (F.lit(turn << 56) + F.shiftleft("grp", 24) + F.col("bin")).alias("sequence_id"), "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        left = packed.where(F.col("fill") <= capacity - capacity // 8).select("uid").join(rows, "uid").select("uid", "length")
    return done


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document.

    Null texts are empty; null and repeated ids are packed like any other row; an empty table packs to nothing.
    Only documents longer than ``capacity`` are cut."""
    found = pieces(docs, id_col, text_col, path or vocabulary(), end_id, capacity)
    # the row number is fixed by the written table, so that repeated rows stay apart on any later read
    rows = materialize(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return rows.join(assign(rows.select("uid", "length"), capacity, group), "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
