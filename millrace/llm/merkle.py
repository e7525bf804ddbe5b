"""Merkle manifest of a dataset: hash trees of 16 children over the documents of each source, and a tree over the sources.

A leaf is the hash of a row's fields. Sorted runs of leaves give each its coordinate (tree, place). Nodes are stored as
Parquet by level. A pass reads one level in order and streams out the next three: rows of a chunk, 4096 neighbours, come
sorted to one task, which holds no more than the runs that are still open. Proofs come out of the store the same way, from
the top: nodes of three levels and the path above their chunk are merged by coordinate, and each node of the lowest
level leaves with its path. So neither a tree nor a level is ever in one place, and a source that holds a third of all rows is cut
into chunks like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runs import numbered
from .store import fresh_path, materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node: 1 << FAN.
FAN = 4
#: Levels that a pass handles; a chunk is (1 << FAN) ** STEP neighbours.
STEP = 3
CHUNK = FAN * STEP
HEX = 64

PATH = "array<struct<at int, run string>>"
UPPER, CAMELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """SHA-256 of fields in turn: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def tampered(text: Column, id_col: Column, every: int = 5) -> Column:
    """``text`` with A-Z lower-cased where ``every`` divides the CRC-32 of the decimal id; null elsewhere."""
    return F.when(F.crc32(id_col.cast("string").cast("binary")) % every == 0, F.translate(text, UPPER, CAMELS))


@dataclass(frozen=True)
class Store:
    """Nodes of many trees under ``path``, a folder for each level; ``most``: leaves of the largest tree."""

    spark: SparkSession
    path: str
    most: int

    SCHEMA = "tree long, pos long, hash string, size long"

    def level(self, k: int) -> DataFrame:
        """tree, pos, hash, size (nodes of the tree on this level)."""
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/level={k}")

    @property
    def bases(self) -> list[int]:
        """Levels at which a pass begins."""
        k, out = self.most, []
        while k > 1 or not out:
            out.append(STEP * len(out))
            k = -(-k >> CHUNK)
        return out

    def top(self) -> DataFrame:
        """tree, hash: the one node that remains of each tree."""
        found = None
        for k in range(self.height + 1):
            now = self.level(k).where("size = 1").select("tree", "hash")
            found = now if found is None else found.unionByName(now)
        return found

    @property
    def height(self) -> int:
        n, k = self.most, 0
        while n > 1:
            n, k = -(-n >> FAN), k + 1
        return k


def _parents(batches: Iterator[pa.RecordBatch], wanted: int) -> Iterator[pa.RecordBatch]:
    """Nodes of the next ``wanted`` levels over rows (tree, pos, hash, size) sorted by tree and pos, whole chunks each.

    A level's open run is closed when its next node belongs to another parent, and closing a run hands the parent to
    the level above; so at most a run for each level is held."""
    out: list[tuple[int, int, int, str, int]] = []
    held: list[tuple[int, int, list[str], int] | None] = [None] * wanted

    def add(level: int, tree: int, pos: int, node: str, size: int) -> None:
        if level == wanted or size == 1:
            return
        now = held[level]
        if now and (now[0], now[1]) != (tree, pos >> FAN):
            close(level)
            now = None
        if now:
            now[2].append(node)
        else:
            held[level] = (tree, pos >> FAN, [node], size)

    def close(level: int) -> None:
        if now := held[level]:
            held[level] = None
            tree, pos, run, size = now
            size = -(-size >> FAN)
            node = _hash("".join(run))
            out.append((level + 1, tree, pos, node, size))
            add(level + 1, tree, pos, node, size)

    def flush() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["above", "tree", "pos", "hash", "size"])

    last = None
    for batch in batches:
        for tree, pos, node, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (chunk := (tree, pos >> CHUNK)) != last:
                for level in range(wanted):
                    close(level)
                last = chunk
            add(0, tree, pos, node, size)
        yield flush()
    for level in range(wanted):
        close(level)
    yield flush()


def _chunks(df: DataFrame, *order: str) -> DataFrame:
    keyed = df.withColumn("chunk", F.shiftright("pos", CHUNK)) if "chunk" not in df.columns else df
    return keyed.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", *order)


def build(leaves: DataFrame, path: str) -> Store:
    """Store of the trees over ``leaves`` (tree, pos, hash, size): level 0 and all above, until a node remains of each tree."""
    spark = leaves.sparkSession
    leaves.select("tree", "pos", "hash", "size").write.parquet(f"{path}/level=0")
    store = Store(spark, path, 1)
    most = store.level(0).agg(F.max("size")).first()[0] or 1
    store = Store(spark, path, most)
    for base in store.bases:
        wanted = min(STEP, store.height - base)
        if wanted <= 0:
            continue
        rows = _chunks(store.level(base).where("size > 1"), "pos").select("tree", "pos", "hash", "size")
        made = rows.mapInArrow(lambda b, wanted=wanted: _parents(b, wanted), "above int, tree long, pos long, hash string, size long")
        pass_path = f"{path}/pass={base}"
        made.write.partitionBy("above").parquet(pass_path)
        for k in range(1, wanted + 1):  # a level is a folder of its own, as the passes leave it
            _move(spark, f"{pass_path}/above={k}", f"{path}/level={base + k}")
    return store


def _move(spark: SparkSession, old: str, new: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    if not a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b):
        raise RuntimeError(f"{old} could not become {new}")


#: A row of the merge: nodes of the levels above come before the lowest, whose rows carry what the caller wants back.
MERGED = "tree long, chunk long, rank int, pos long, hash string, size long"


def _merge(batches: Iterator[pa.RecordBatch], emit: Callable[[list], pa.RecordBatch], extra: int) -> Iterator[pa.RecordBatch]:
    """Paths of the lowest nodes of each chunk. Rows: tree, chunk, rank, pos, hash, size, upper path, extra columns,
    sorted by all but hash; rank 0 is the path above the chunk, then levels from the highest to the lowest (rank STEP)."""
    last, upper = None, []
    runs: dict[tuple[int, int], list[str]] = {}
    cached: dict[int, list] = {}
    open_run: list[tuple] = []
    out: list = []

    def above(level: int, pos: int) -> list[dict]:
        """Path from node ``pos`` of ``level`` (0: the chunk's lowest) upward; runs of that level and above are whole."""
        if level == STEP:
            return upper
        run = runs.get((level, pos >> FAN))
        rest = above(level + 1, pos >> FAN)
        return [{"at": pos & ((1 << FAN) - 1), "run": "".join(run)}, *rest] if run else rest

    def settle() -> None:
        if not open_run:
            return
        parent = open_run[0][1] >> FAN
        whole = "".join(x[2] for x in open_run)
        if parent not in cached:
            cached.clear()
            cached[parent] = above(1, parent)
        rest = cached[parent]
        alone = open_run[0][3] == 1  # a tree of one leaf has no run
        for tree, pos, node, _, *more in open_run:
            out.append((tree, pos, node, rest if alone else [{"at": pos & ((1 << FAN) - 1), "run": whole}, *rest], *more))
        open_run.clear()

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tree, chunk, rank, pos, node, size, path = row[:7]
            if (tree, chunk) != last:
                settle()
                last, upper = (tree, chunk), []
                runs.clear()
                cached.clear()
            if rank == 0:
                upper = path
            elif rank < STEP:
                runs.setdefault((STEP - rank, pos >> FAN), []).append(node)
            else:
                if open_run and open_run[0][1] >> FAN != pos >> FAN:
                    settle()
                open_run.append((tree, pos, node, size, *row[7 : 7 + extra]))
        yield emit(out)
        out.clear()
    settle()
    yield emit(out)


def _paths_batch(out: list) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.string())]))
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), pa.array([x[3] for x in out], kind)], names=["tree", "pos", "hash", "path"])


def extract(store: Store, base: int, uppers: DataFrame, emit: Callable[[list], pa.RecordBatch] = _paths_batch, schema: str = f"tree long, pos long, hash string, path {PATH}", lowest: DataFrame | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """What ``emit`` makes of the nodes of level ``base`` and their paths to the top. ``uppers``: tree, chunk, path above it.
    ``lowest``: that level's rows with ``extra`` columns, where ``emit`` needs some."""
    rows = lowest if lowest is not None else store.level(base).where("size > 1")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    nothing = [F.lit(None).cast(kinds[c]).alias(c) for c in extra]
    key = ["tree", "chunk", "rank", "pos", "hash", "size", "path"]
    no_path = F.lit(None).cast(PATH).alias("path")
    merged = uppers.select("tree", "chunk", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("size"), "path", *nothing)
    merged = merged.unionByName(rows.select("tree", F.shiftright("pos", CHUNK).alias("chunk"), F.lit(STEP).alias("rank"), "pos", "hash", "size", no_path, *extra))
    for k in range(1, STEP):
        if base + k <= store.height:
            up = store.level(base + k).where("size > 1")  # a run of one is a run, unless the node is the tree's last
            merged = merged.unionByName(up.select("tree", F.shiftright("pos", CHUNK - FAN * k).alias("chunk"), F.lit(STEP - k).alias("rank"), "pos", "hash", "size", no_path, *nothing))
    dealt = merged.select(*key, *extra).repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", "rank", "pos")
    return dealt.mapInArrow(lambda b, n=len(extra): _merge(b, emit, n), schema)


def paths(store: Store, tops: DataFrame) -> DataFrame:
    """tree, chunk, path: what stands above each chunk of leaves; ``tops``: tree, path above the tree itself."""
    found: DataFrame | None = None
    for base in reversed(store.bases):
        if found is not None:
            below = materialize(found.select("tree", F.col("pos").alias("chunk"), "path"), "paths")
        trees = store.level(base).where("pos = 0" if base == 0 else "pos = 0 and size > 1")
        low = trees.where(F.col("size") <= 1 << CHUNK).select("tree")
        uppers = tops.join(low, "tree").select("tree", F.lit(0).cast("long").alias("chunk"), "path")
        uppers = uppers if found is None else uppers.unionByName(below)
        if base == 0:
            return uppers
        found = extract(store, base, uppers)
    raise AssertionError("a store has a lowest level")


@dataclass(frozen=True)
class Manifest:
    """``rows``: tree, pos, hash, size and the caller's columns for each document; ``store``: their trees; ``top``: the one
    tree (number 0) whose leaves, in the order of sources, are the trees' last nodes."""

    rows: DataFrame
    store: Store
    top: Store

    def root(self) -> str | None:
        """The dataset's hash; None for no documents."""
        found = self.top.top().first()
        return found and found["hash"]


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", source_col: str = "source", path: str | None = None, **more: Column) -> Manifest:
    """Hash ``docs`` and store the trees under ``path`` (by default a folder of this application).

    Leaves of a source ascend by id, null first; rows that repeat an id by their hashes. A null source is one of its own
    and the first. ``more`` are columns to keep with each row. The texts are read once and never shuffled."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "manifest")
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), leaf(*(F.col(c) for c in fields)).alias("hash"), *(c.alias(name) for name, c in more.items()))
    rows = materialize(rows, "hashed")  # sorting samples its input, which is not to be the texts
    placed = numbered(rows, ["source"], ["id", "hash"], "leaves", "pos", "size", "tree")
    placed.write.parquet(f"{path}/rows")
    placed = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    store = build(placed, f"{path}/nodes")
    roots = store.top()
    n = roots.count()
    top = build(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash", F.lit(n).cast("long").alias("size")), f"{path}/sources")
    return Manifest(placed, store, top)


def _top_paths(found: Manifest) -> DataFrame:
    """tree, path: from each source's last node to the root."""
    nothing = found.top.spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.expr(f"cast(array() as {PATH})").alias("path"))
    above = paths(found.top, nothing)
    met = extract(found.top, 0, above, lowest=found.top.level(0))
    return materialize(met.select(F.col("pos").alias("tree"), "path"), "source-paths")


def fold(node: str, path: Sequence[dict]) -> str:
    """Root that ``node`` leads to when it takes its place in the runs of ``path``."""
    for step in path:
        cut = HEX * step["at"]
        node = _hash(step["run"][:cut] + node + step["run"][cut + HEX :])
    return node


def siblings(path: Sequence[dict]) -> str:
    """The others of each run, level by level, left to right."""
    return "".join(s["run"][: HEX * s["at"]] + s["run"][HEX * (s["at"] + 1) :] for s in path)


def _judged(root: str, depth: int) -> Callable[[list], pa.RecordBatch]:
    """``depth``: steps of each path that lie above its own tree."""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_())

    def emit(out: list) -> pa.RecordBatch:
        rows = []
        for _, _, node, path, doc_id, changed in out:
            folded = fold(changed or node, path)
            own = path[len(path) - depth] if depth else None
            subroot = own["run"][HEX * own["at"] : HEX * (own["at"] + 1)] if own else root
            rows.append((doc_id, node, subroot, root, _hash(siblings(path)), folded, folded == root))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))

    return emit


def proofs(found: Manifest) -> DataFrame:
    """tree, pos, hash, path for each leaf; a path's steps (place in the run, the run's nodes in turn) lead to the root."""
    return extract(found.store, 0, paths(found.store, _top_paths(found)), lowest=found.rows)


def verify(found: Manifest, id_col: str = "id", changed: str = "changed") -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified. The root is folded from the
    leaf in column ``changed``, where there is one, in place of the stored leaf."""
    root = found.root() or ""
    above = paths(found.store, _top_paths(found))
    rows = found.rows.withColumnsRenamed({id_col: "doc_id"})
    return extract(found.store, 0, above, _judged(root, found.top.height), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean", rows, ("doc_id", changed))


def judge(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: Sequence[str] = FIELDS, every: int = 5) -> DataFrame:
    """One row for each document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The proof of a row whose tampered text differs leads to another root. A null in any field has a mark of its own, so it differs
    from an empty text. An empty table gives an empty result; columns of other names play no part."""
    text = tampered(F.col(text_col), F.col(id_col), every)
    other = [text if c == text_col else F.col(c) for c in fields]
    found = manifest(docs, fields, id_col, source_col, changed=F.when(text.isNotNull(), leaf(*other)))
    return verify(found)
