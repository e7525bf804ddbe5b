"""Near copies by Jaccard similarity of word shingles.

A text is the set of its runs of five words (64-bit hashes; a shorter text is one run as a whole), without case A-Z
and without regard to white space. Candidates share a key: one for all that close SimHash fingerprints connect (see
``golay``), and ``BANDS`` keys, each made of ``ROWS`` minhashes, by which a pair of similarity s is missed with
probability (1 - s ** ROWS) ** BANDS, 7e-6 at 0.8 and less above. Every candidate is then judged by its exact
similarity, in two rounds: neighbours in each group first, which ties most copies together; then every group that still
holds several components, by a search that only visits what is not linked yet. No member of a group goes unjudged. Keys
that crowd are salted for the first round; for the second a group of over ``BUCKET`` sets is dealt into buckets, the
blocks of its largest component against those of the others, which all pairs of different components share, and never
meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append, steps, texts
from .components import components
from .store import HOT_PARTS, materialize, meet

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 5
SEED = 42
#: Sets of a bucket, for each of its two sides.
BUCKET = 1024
#: A key is crowded if it has over 1/HOT_PARTS of all rows, judged by one in PROBE texts, and CROWD of these at least;
#: its members are then linked in SALTS parts.
PROBE, CROWD, SALTS = 64, 50, 64
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (3, BANDS * ROWS), dtype=np.uint64)
_FACTOR, _SHIFT, _MIX = _RANDOM[0] | np.uint64(1), _RANDOM[1], (_RANDOM[2] | np.uint64(1)).reshape(BANDS, ROWS)


def node(text: bytes) -> int:
    """Hash of a lower-cased text's words."""
    return xxhash.xxh64_intdigest(b" ".join(text.split()), SEED)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of a lower-cased text's runs of ``width`` words, sorted, each once."""
    words = text.split()
    if len(words) < width:
        return np.array([node(text)] if words else [], np.uint64)
    hash64, n, parts = xxhash.xxh64_intdigest, len(words) - width + 1, []
    for i in range(0, n, 65_536):
        part = words[i : min(i + 65_536, n) + width - 1]
        parts.append(np.array([hash64(s, SEED) for s in map(b" ".join, zip(*(part[k:] for k in range(width)), strict=False))], np.uint64))
    return np.unique(np.concatenate(parts))


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 512):
        low = np.minimum(low, (found[i : i + 512] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1))
    return (low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def add_nodes(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with its node, a long."""
    at = docs.columns.index(text_col)
    return append(docs, [T.StructField(name, T.LongType())], lambda batch: [pa.array(np.array([node(t) for t in texts(batch.column(at))], np.uint64).view(np.int64), pa.int64())])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 200):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in texts(batch.column(1))], pa.binary())], names=["fp", "items"])

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, u, v) from rows sorted by key: members of groups of several, with the next; g tells groups of other members apart."""

    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        g, u, v = [], [], []
        for k in np.flatnonzero(np.diff(at) > 1):
            part = np.unique(fp[at[k] : at[k + 1]])
            if len(part) > 1:
                g.append(np.full(len(part), np.uint64(xxhash.xxh64_intdigest(part.tobytes(), SEED))).view(np.int64))
                u.append(part)
                v.append(np.append(part[1:], part[-1]))
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (g, u, v)], names=["g", "u", "v"])

    keys, fps = [], []
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        if keys and k[-1] == keys[0][0]:  # the group goes on, perhaps
            keys.append(k)
            fps.append(f)
            continue
        key, fp = np.concatenate([*keys, k]), np.concatenate([*fps, f])
        cut = int(np.searchsorted(key, key[-1]))
        yield from groups(key[:cut], fp[:cut])
        keys, fps = [key[cut:]], [fp[cut:]]
    if keys:
        yield from groups(np.concatenate(keys), np.concatenate(fps))


def _judge(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
            close = np.array([similarity(x, y) >= least for x, y in zip(a, b, strict=True)], bool)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(close)) for c in batch.columns[:2]], names=["u", "v"])

    return run


def linked(items: list[np.ndarray], roots: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges that connect all sets that links of similarity ``least`` connect; sets of one root count as connected."""
    sizes, open_ = np.array([len(x) for x in items]), np.ones(len(items), bool)
    edges, indexed, left = [], 0, len(items)
    shingle = owner = np.empty(0)
    for first in range(len(items)):
        if not open_[first]:
            continue
        todo, open_[first], left = [first], False, left - 1
        while todo and left:
            at = todo.pop()
            if not indexed or left < indexed // 2:  # postings of what is left
                alive = np.flatnonzero(open_)
                shingle, owner, indexed = np.concatenate([items[k] for k in alive]), np.repeat(alive, sizes[alive]), left
                order = np.argsort(shingle, kind="stable")
                shingle, owner = shingle[order], owner[order]
            lo, hi = np.searchsorted(shingle, items[at], "left"), np.searchsorted(shingle, items[at], "right")
            met = [owner[i:j] for i, j in zip(lo, hi, strict=True) if i < j]
            both = np.bincount(np.concatenate(met), minlength=len(items)) if met else np.zeros(len(items), np.int64)
            close = open_ & (both / np.maximum(1, sizes + sizes[at] - both) >= least)
            edges += [(at, int(k)) for k in np.flatnonzero(close)]
            close |= open_ & (roots == roots[at])
            todo += np.flatnonzero(close).tolist()
            open_ &= ~close
            left -= int(close.sum())
    return edges


def _search(least: float):
    """Rows (g, u, root, items) come sorted by g; a group may reach over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            if edges := linked(items, np.array(root), least):
                yield pa.RecordBatch.from_arrays([pa.array([fp[k[i]] for k in edges], pa.int64()) for i in (0, 1)], names=["u", "v"])

        now, fp, root, items = None, [], [], []
        for batch in batches:
            for g, u, r, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now:
                    yield from flush()
                    now, fp, root, items = g, [], [], []
                fp.append(u)
                root.append(r)
                items.append(np.frombuffer(x, np.uint64))
        yield from flush()

    return run


def links(marked: DataFrame, keys: DataFrame, least: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """(u, v) between distinct nodes of ``marked`` (fp, a long of ``add_nodes``; text): enough links of similarity
    ``least`` or more to connect all that such links between nodes that share one of ``keys`` (key, fp) connect."""
    edge = "u long, v long"
    members = materialize(_first_links(keys).distinct(), "members")
    # rows of one node have one set: the exchange between keeps the two Python passes out of one task
    own = marked.join(members.select(F.col("u").alias("fp")).distinct(), "fp", "left_semi").select("fp", "text").dropDuplicates(["fp"])
    sets = materialize(own.mapInArrow(_sets(width), "fp long, items binary"), "sets")
    one, other = (sets.select(F.col("fp").alias(x), F.col("items").alias(f"{x}_items")) for x in "uv")
    pairs = members.where("u <> v").select("u", "v").distinct()
    edges = materialize(pairs.join(one, "u").join(other, "v").select("u", "v", "u_items", "v_items").mapInArrow(_judge(least), edge), "links")
    labels = members.select("g", "u").distinct().join(components(edges), "u", "left").select("g", "u", F.coalesce("root", "u").alias("root"))
    rest = materialize(_buckets(materialize(labels, "labels")), "buckets").join(one, "u").select("g", "u", "root", "u_items")
    more = rest.repartition("g").sortWithinPartitions("g").mapInArrow(_search(least), edge)
    return edges.unionByName(materialize(more, "links"))


def _first_links(keys: DataFrame) -> DataFrame:
    """(g, u, v): each member u of a group with the next, v. Groups of equal members are one, but for crowded keys."""
    probe = materialize(keys.where(F.pmod(F.xxhash64("fp"), F.lit(PROBE)) == 0).groupBy("key").agg(F.count("*").alias("n")), "probe")
    total = probe.agg(F.sum("n")).first()[0] or 0
    crowded = F.broadcast(probe.where(F.col("n") > max(total / HOT_PARTS, CROWD)).select("key"))  # fewer than HOT_PARTS
    plain = keys.join(crowded, "key", "left_anti").distinct().repartition("key").sortWithinPartitions("key").mapInArrow(_members, "g long, u long, v long")
    crowd = keys.join(crowded, "key").distinct().withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    after = F.lead("fp").over(W.partitionBy("key", "salt").orderBy("fp"))
    chains = crowd.select(F.col("key").alias("g"), F.col("fp").alias("u"), F.coalesce(after, "fp").alias("v"))
    heads = crowd.groupBy("key", "salt").agg(F.min("fp").alias("u"))
    first = heads.groupBy("key").agg(F.min("u").alias("v"))
    return plain.unionByName(chains).unionByName(heads.join(first, "key").select(F.col("key").alias("g"), "u", "v"))


def _buckets(labels: DataFrame) -> DataFrame:
    """(g, u, root): the members of groups (g, u, root) of several components, dealt so that any two members of a group
    in different components share a bucket, now g; no bucket has many more than two BUCKETs."""
    sizes = labels.groupBy("g", "root").agg(F.count("*").alias("c"))
    groups = sizes.groupBy("g").agg(F.count("*").alias("roots"), F.sum("c").alias("n"), F.max_by("root", "c").alias("big"), F.max("c").alias("c")).where("roots > 1")
    groups = materialize(groups.withColumn("size", F.col("n")), "groups")
    parts = lambda n: F.ceil(n / BUCKET).cast("long")
    rows = meet(labels, groups, "g", "size", labels.count()).withColumn("big", F.col("root") == F.col("big"))
    rows = rows.withColumn("bigs", parts(F.col("c"))).withColumn("others", parts(F.col("n") - F.col("c")))
    own = F.pmod(F.xxhash64("u"), F.when(F.col("big"), F.col("bigs")).otherwise(F.col("others")))

    def bucket(kind: int, a, b):
        return F.xxhash64("g", F.lit(kind), a, b)

    each = lambda n, make: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), make)
    of_big = each("others", lambda y: bucket(1, own, y))
    of_other = F.concat(each("bigs", lambda x: bucket(1, x, own)), each("others", lambda y: bucket(0, F.least(y, own), F.greatest(y, own))))
    small = F.col("n") <= BUCKET
    dealt = F.when(small, F.array(F.xxhash64("g"))).when(F.col("big"), of_big).otherwise(of_other)
    return rows.select(F.explode(dealt).alias("g"), "u", "root")
