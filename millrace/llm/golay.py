"""SimHash near-duplicates found by Golay-code fuzzy hashing.

The binary Golay code (23, 12, 7) is perfect: every 23-bit word decodes to one of 4096 codewords. The words
within one bit of a word decode to one or to six codewords; two words that differ in two bits or fewer share one
of these, as a word between them is within one bit of both. A 64-bit fingerprint is cut into three segments
(22, 21 and 21 bits, padded with zeros). If two fingerprints differ in four bits at most, either

* each segment holds two errors at most: they share a codeword in every segment, key (c0, c1, c2); or
* one segment holds three or four, so that of the other two one is equal and the other has one error at most:
  key (segment i as it is, codeword of segment j).

Equal keys give candidates; Hamming distance verifies them. Fingerprints are made distinct first, and within a
key's group a search that only visits what is not linked yet emits a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .arrow import append, small_batches, steps, texts
from .components import components
from .store import fresh, materialize, meet

WIDTH = 4
DISTANCE = 4
SEED = 42
CUTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xAE3
#: Fingerprints whose keys are made at once.
CHUNK = 2048


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Of a lower-cased text: bit b is set if it is in over half the hashes of its shingles."""
    words = text.split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= width:
        return hash64(b" ".join(words), SEED)
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for i in range(0, n, 65_536):
        part = words[i : min(i + 65_536, n) + width - 1]
        ones += _ones(np.array([hash64(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))], np.uint64))
    return _majority(ones, n)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def of_set(found: np.ndarray) -> int:
    """Fingerprint of a set of hashes."""
    return _majority(sum(_ones(found[i : i + 65_536]) for i in range(0, len(found), 65_536)), len(found))


def add_fingerprints(docs: DataFrame, name: str, text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with its fingerprint, a long with the same 64 bits."""
    at = docs.columns.index(text_col)

    def make(batch: pa.RecordBatch) -> list:
        return [pa.array(np.array([fingerprint(t, width) for t in texts(batch.column(at))], np.uint64).view(np.int64), pa.int64())]

    return append(docs, [T.StructField(name, T.LongType())], make)


@cache
def _patterns() -> np.ndarray:
    """The error pattern of up to three bits for each syndrome."""
    rest = np.zeros(2048, np.int64)
    for n in range(1, 4):
        for bits in combinations(range(23), n):
            word = sum(1 << b for b in bits)
            rest[_syndrome(np.array([word]))[0]] = word
    return rest


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the division by the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where(left >> bit & 1, left ^ GENERATOR << (bit - 11), left)
    return left


@cache
def _decoder() -> np.ndarray:
    """For each of the 2**23 words the 12 message bits of the codeword nearest to it."""
    out, step = np.empty(1 << 23, np.uint16), 1 << 16
    for at in range(0, 1 << 23, step):  # bit by bit over all words at once would take some 400 MB
        words = np.arange(at, at + step, dtype=np.int64)
        out[at : at + step] = (words ^ _patterns()[_syndrome(words)]) >> 11
    return out


def nearby(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords (n, 6) that each word or a word within one bit of it decodes to, and which of the six count."""
    flips = np.array([0, *(1 << b for b in range(width))])
    found = np.sort(_decoder()[words[:, None] ^ flips].astype(np.int64), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~new, axis=1, kind="stable")[:, :6]
    return np.take_along_axis(found, order, 1), np.take_along_axis(new, order, 1)


def keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row) of all keys of the fingerprints (uint64)."""
    segments = [((prints >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in CUTS]
    (a, ka), (b, kb), (c, kc) = near = [nearby(s, w) for s, (_, w) in zip(segments, CUTS, strict=True)]
    triple = a[:, :, None, None] << 24 | b[:, None, :, None] << 12 | c[:, None, None, :]
    kept = ka[:, :, None, None] & kb[:, None, :, None] & kc[:, None, None, :]
    yield triple[kept], np.nonzero(kept)[0]
    for i in range(3):
        for j in range(3):
            if i != j:
                code, kept = near[j]
                tag = (3 * i + j + 1) << 40
                yield (tag | segments[i][:, None] << 12 | code)[kept], np.nonzero(kept)[0]


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for i in range(0, len(prints), CHUNK):
            part = prints[i : i + CHUNK]
            for key, row in keys(part.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def linked(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints of one group."""
    if len(prints) == 2:
        return [(0, 1)] if int(prints[0] ^ prints[1]).bit_count() <= distance else []
    edges, left = [], np.arange(1, len(prints))
    todo, start = [0], prints
    while True:
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(start[left] ^ start[at]) <= distance
            for k in left[near]:
                edges.append((at, int(k)))
                todo.append(int(k))
            left = left[~near]
        if not len(left):
            return edges
        todo, left = [int(left[0])], left[1:]


def _verify(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a group may reach over batches."""
        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if key[0] == key[-1]:
                continue  # the group goes on, perhaps
            cut = int(np.searchsorted(key, key[-1]))
            yield from _groups(key[:cut], fp[:cut], distance)
            key, fp = key[cut:], fp[cut:]
        yield from _groups(key, fp, distance)

    return run


def _groups(key: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(at)
    u, v = [], []
    pairs = at[:-1][sizes == 2]
    if len(pairs):
        close = np.bitwise_count((fp[pairs] ^ fp[pairs + 1]).view(np.uint64)) <= distance
        u.append(fp[pairs][close])
        v.append(fp[pairs + 1][close])
    for k in np.flatnonzero(sizes > 2):
        part = fp[at[k] : at[k + 1]]
        if edges := linked(part.view(np.uint64), distance):
            e = np.array(edges)
            u.append(part[e[:, 0]])
            v.append(part[e[:, 1]])
    if u and sum(map(len, u)):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])


def _keyed(prints: DataFrame) -> DataFrame:
    """(key, fp) of all keys of distinct fingerprints (column fp, long), dealt and sorted by key."""
    # a fingerprint has some 180 keys: a table that fits one partition must not be spread from one task
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return prints.select("fp").repartition(tasks, "fp").mapInArrow(_emit, "key long, fp long").repartition("key").sortWithinPartitions("key")


def _linked(prints: DataFrame, distance: int) -> DataFrame:
    """(u, root) of the distinct fingerprints that links of ``distance`` bits or fewer (4 at most) connect."""
    if not 0 <= distance <= 4:
        raise ValueError("the keys cover distances of 0 to 4 bits")
    return components(_keyed(prints), make=_verify(distance))


def classes(prints: DataFrame, id_col: str, distance: int = DISTANCE, edges: DataFrame | None = None) -> DataFrame:
    """One row per distinct fingerprint: fp, component_id (smallest id reachable; null if no row there has one), root,
    id (its own smallest) and n (its rows).

    ``edges`` (u, v) replaces the links by distance."""
    least = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("id"), F.count("*").alias("n")), "fingerprints")
    roots = _linked(least, distance) if edges is None else components(edges)
    # a fingerprint without links stands for itself
    rooted = materialize(least.join(roots, least["fp"] == roots["u"], "left").select(least["fp"], "id", "n", F.coalesce("root", least["fp"]).alias("root")), "roots")
    first = rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("prints"))
    return meet(rooted, first, "root", "prints", rooted.count()).select("fp", "component_id", "root", "id", "n")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null or wordless texts have fingerprint zero and are linked like any other. Rows with a null id take part;
    ids of a component are compared without them. Repeated rows come out as often as they came in."""
    rows = materialize(add_fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "fp", "text", width).select("doc_id", "fp"), "prints")
    found = materialize(classes(rows, "doc_id", distance).select("fp", "component_id", "n"), "classes")
    return meet(rows, found, "fp", "n", found.agg(F.sum("n")).first()[0] or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _marks(width: int):
    """Of (id, text): id, the text's node, the fingerprint of its set of runs and its minhash keys, in one pass. Texts of
    fewer than ``width`` words are alike only if equal and have neither fingerprint nor keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            fp, prints, keys, short = [], [], [], []
            for text in texts(batch.column(1)):
                fp.append(jaccard.node(text))
                short.append(len(text.split(None, width)) < width)
                found = None if short[-1] else jaccard.shingles(text, width)
                prints.append(0 if found is None else of_set(found))
                keys.append(None if found is None else jaccard.bands(found))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64), mask=m) for x, m in ((fp, None), (prints, np.array(short, bool)))]
            arrays = [batch.column(0), *longs, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "print", "keys"])

    return run


def _minhash_keys(marks: DataFrame) -> DataFrame:
    return marks.select(F.explode("keys").alias("key"), "fp")


def _print_keys(marks: DataFrame, distance: int) -> DataFrame:
    """(key, fp): nodes whose fingerprints links of ``distance`` bits or fewer connect share a key."""
    nodes = materialize(marks.where("print IS NOT NULL").select(F.col("print").alias("fp"), F.col("fp").alias("node")).distinct(), "nodes")
    found = materialize(classes(nodes, "node", distance).select("fp", "root", "n"), "classes")
    joined = meet(nodes, found, "fp", "n", found.agg(F.sum("n")).first()[0] or 0)
    return materialize(joined.select(F.xxhash64(F.lit("fingerprint"), "root").alias("key"), F.col("node").alias("fp")), "print-keys")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE, similarity: float | None = None) -> DataFrame:
    """``docs`` without all but one document of each component, columns unchanged.

    With ``similarity`` documents are linked by that Jaccard similarity of runs of ``width`` words. Candidates are what
    links of fingerprints connect, and what shares a minhash key, as 4 bits are far less than that similarity allows;
    each is judged exactly.

    The row with the smallest id stays (null ids only where no row has another); between rows of one id the one
    with the smallest fingerprint, and of rows equal in both any one."""
    fp, key, one = fresh(docs, "fp", "keeper_fp", "keeper_id")
    edges = None
    if similarity is None:
        marked = add_fingerprints(docs, fp, text_col, width)
        rows = materialize(marked.select(F.col(fp).alias("fp"), F.col(id_col).cast("long").alias("doc_id")), "prints")
    else:
        marked = jaccard.add_nodes(docs, fp, text_col)
        marks = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_marks(width), "doc_id long, fp long, print long, keys array<long>")
        marks = materialize(marks, "marks")
        rows = marks.select("fp", "doc_id")
        keys = _minhash_keys(marks).unionByName(_print_keys(marks, distance))
        edges = jaccard.links(marked.select(F.col(fp).alias("fp"), F.col(text_col).alias("text")), keys, similarity, width)
    found = classes(rows, "doc_id", distance, edges)
    holds = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("fp").alias(key), F.first("component_id").alias(one))
    many = rows.groupBy("fp", "doc_id").agg(F.count("*").alias("n"))
    kept = holds.join(many, (F.col(key) == many["fp"]) & F.col(one).eqNullSafe(many["doc_id"])).select(key, one, "n")
    kept = materialize(kept.withColumnRenamed("n", f"{key}_n"), "keepers")
    met = marked.join(kept, (marked[fp] == kept[key]) & marked[id_col].cast("long").eqNullSafe(kept[one])).select(*(marked[c] for c in docs.columns), kept[key], kept[f"{key}_n"])
    single = met.where(F.col(f"{key}_n") == 1).select(*docs.columns)
    return single.unionByName(met.where(F.col(f"{key}_n") > 1).dropDuplicates([key]).select(*docs.columns))
