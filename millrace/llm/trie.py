"""Trie of conversation prefixes by heavy-path decomposition.

A node is a distinct sequence of first turns. It is known by its depth and two 64-bit sums (exclusive or) of its turns'
hashes, each salted with its place, so prefixes of one conversation come from running sums over blocks of places, and
neither a long conversation nor a crowded prefix meets in one task. Texts are hashed where they are read and go no
further.

The heavy child of a node is the one with most members. A conversation whose last node is a leaf stands for the one heavy
path that ends there: it takes the part of its nodes below its last light one. A light node has at most half of
its parent's members, so no conversation meets more than log2(conversations) of them. Subtree sums go over
paths from the deepest level of light nodes to the root's path: suffix sums along a path's array, cut in blocks; then each
path's first node hands its sum to its parent on another path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import numbered
from .store import fresh_path, materialize, meet

#: Places of a path or conversation that one running sum covers.
BLOCK = 4096
#: Characters of a list of ids that are one row.
PIECE = 1 << 16
#: Rebuilt conversations: families of FAMILY ids share first turns, as many as their CRC-32 modulo SHARED says.
FAMILY, SHARED = 5, 9

NODE = ("d", "p", "q")
NO_HASH = hashlib.sha256(b"").hexdigest()


def _blocks(rows: DataFrame, group: str, place: str, descending: bool, **sums: str) -> DataFrame:
    """``rows`` with running sums in order of ``place`` (from 0, dense) within ``group``: of each column named as a value of
    ``sums`` under its key. Longs starting with ``x`` are summed by exclusive or, others added."""
    total = {n: (F.bit_xor if c.startswith("x") else F.sum)(c) for n, c in sums.items()}
    join = {n: (lambda a, b: a.bitwiseXOR(b)) if c.startswith("x") else (lambda a, b: a + b) for n, c in sums.items()}
    cut = rows.withColumn("_block", F.floor(F.col(place) / BLOCK).cast("long"))
    order = F.col(place).desc() if descending else F.col(place).asc()
    inside = W.partitionBy(group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = cut.withColumns({n: f.over(inside) for n, f in total.items()})
    # groups of one block, which are most, have nothing carried to them
    held = cut.groupBy(group, "_block").agg(*(f.alias(f"_{n}") for n, f in total.items()))
    before = W.partitionBy(group).orderBy(F.col("_block").desc() if descending else F.col("_block").asc()).rowsBetween(W.unboundedPreceding, -1)
    carried = held.withColumns({f"_{n}": (F.bit_xor if c.startswith("x") else F.sum)(f"_{n}").over(before) for n, c in sums.items()}).where(F.col(f"_{next(iter(sums))}").isNotNull())
    met = summed.join(carried, [group, "_block"], "left")
    return met.withColumns({n: join[n](F.col(n), F.coalesce(F.col(f"_{n}"), F.lit(0))) for n in sums}).drop("_block", *(f"_{n}" for n in sums))


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, pos (from 0, by turn, null first), role, said (SHA-256 of the text), bytes, group_rows (turns of it in all).

    Null roles and texts are empty ones. Turns of one number go by role, then by the hash of the text. Rows without a
    conversation belong to none."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.sha2(text, 256).alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    rows = materialize(rows, "said")  # sorting samples its input, which is not to be the texts
    return numbered(rows, ["conv_id"], ["turn", "role", "said"], "turns").drop("turn")


def plain(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv_id, d, role, said, bytes, total) and (conv_id, total)."""
    told = materialize(told, "told")
    whole = told.where("pos = 0").select("conv_id", F.col("group_rows").alias("total"))
    return told.select("conv_id", (F.col("pos") + 1).alias("d"), "role", "said", "bytes", F.col("group_rows").alias("total")), whole


def rebuilt(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their family's first one, in the form of ``plain``."""
    told = materialize(told, "told")
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = told.where("pos = 0").select("conv_id", F.col("group_rows").alias("n"), shared.alias("h"), base.alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "families")
    mine = meet(told.where(F.col("pos") >= shared), convs.select("conv_id", "n", "h", "taken", "total").withColumn("size", F.col("n")), "conv_id", "size", told.count())
    mine = mine.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "role", "said", "bytes", "total")
    first = told.where((F.col("pos") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("base"), "pos", "role", "said", "bytes")
    lent = first.join(convs.select("base", "conv_id", "taken", "total"), "base").where("pos < taken").select("conv_id", (F.col("pos") + 1).alias("d"), "role", "said", "bytes", "total")
    return mine.unionByName(lent), convs.select("conv_id", "total")


def _node(*names: str) -> Column:
    return F.struct(*(F.col(c).alias(n) for c, n in zip(names, NODE, strict=True)))


def _steps(told: DataFrame) -> DataFrame:
    """Each conversation's nodes: conv_id, d, node, parent, bytes, total."""
    salted = told.withColumns({"x": F.xxhash64(F.lit(1), "d", "role", "said"), "xx": F.xxhash64(F.lit(2), "d", "role", "said"), "place": F.col("d") - 1}).drop("role", "said")
    found = _blocks(salted, "conv_id", "place", False, p="x", q="xx")
    found = found.withColumns({"up": F.col("d") - 1, "pp": F.col("p").bitwiseXOR(F.col("x")), "qq": F.col("q").bitwiseXOR(F.col("xx"))})
    return found.select("conv_id", "d", _node("d", "p", "q").alias("node"), _node("up", "pp", "qq").alias("parent"), "bytes", "total")


def _root() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(n) for n in NODE))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, which come in order, as comma-joined pieces (node, first id, text)."""
    last, held, first, size, out = None, [], 0, 0, []

    def close() -> None:
        if held:
            out.append((*last, first, ",".join(held)))
            held.clear()

    for batch in batches:
        for d, p, q, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, p, q) != last or size > PIECE:
                close()
                last, first, size = (d, p, q), conv, 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        yield _table(out, (*NODE, "first", "text"))
        out = []
    close()
    yield _table(out, (*NODE, "first", "text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, which come in order; a piece at a time is held."""
    last, state, out = None, None, []
    for batch in batches:
        for d, p, q, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (d, p, q) != last:
                if last:
                    out.append((*last, state.hexdigest()))
                last, state = (d, p, q), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _table(out, (*NODE, "ends_sha256"))
        out = []
    if last:
        out.append((*last, state.hexdigest()))
    yield _table(out, (*NODE, "ends_sha256"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    kinds = [pa.string() if n in ("text", "ends_sha256") else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))


def endings(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id). Ids are sorted by ranges and joined to pieces before they meet by node, so
    where very many conversations end in one node, its task streams a few pieces."""
    fields = ", ".join(f"{c} long" for c in NODE)
    rows = ends.select("node.*", "conv_id")
    pieces = rows.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_lists, f"{fields}, first long, text string")
    found = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(_hashed, f"{fields}, ends_sha256 string")
    return found.select(_node(*NODE).alias("node"), "ends_sha256")


def _nodes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """node, parent, conv_id (smallest member), n_convs, bytes, n_children, heavy."""
    found = steps.groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nothing = F.lit(None).cast(found.schema["parent"].dataType)
    found = found.unionByName(root.select(_root().alias("node"), nothing.alias("parent"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes")))
    found = materialize(found, "nodes")
    # of children with equally many members the one with the smallest id is heavy
    kids = found.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("c"), "node")).alias("best"))
    kids = materialize(kids, "children")
    counts = kids.select(F.col("parent").alias("node"), "n_children")
    heavy = kids.select(F.col("best.node").alias("node"), F.lit(True).alias("heavy"))
    met = found.join(counts, "node", "left").join(heavy, "node", "left")
    return met.withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "heavy": F.coalesce("heavy", F.lit(False))})


def _paths(steps: DataFrame, nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, path, head, level): the heavy path of each node, named by the conversation that ends it, the depth of its
    first node, and the light nodes from the root to there."""
    ends = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("node.d").alias("depth"))
    ends = materialize(ends, "path-ends")
    total = steps.count()
    kept = meet(steps.select(F.col("conv_id").alias("path"), "node", "d"), ends.withColumn("size", F.col("depth")), "path", "size", total).drop("depth")
    kept = materialize(kept, "path-steps")
    light = nodes.where("not heavy and node.d > 0").select("node", F.col("n_convs").alias("size"))
    crossed = meet(kept, materialize(light, "light"), "node", "size", total)
    heads = ends.join(crossed.groupBy("path").agg(F.max("d").alias("head"), F.count("*").alias("level")), "path", "left")
    heads = materialize(heads.select("path", "depth", F.coalesce("head", F.lit(0).cast("long")).alias("head"), F.coalesce("level", F.lit(0).cast("long")).alias("level")), "heads")
    own = meet(kept, heads.withColumn("size", F.col("depth")), "path", "size", total).where("d >= head").select("node", "path", "head", "level")
    first = heads.where("head = 0").select(_root().alias("node"), "path", "head", "level")
    return own.unionByName(first)


def _sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens, summed over subtrees, level by level of light nodes."""
    spark, path = nodes.sparkSession, fresh_path(nodes.sparkSession, "levels")
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")})
    nodes.write.partitionBy("level").parquet(path)
    schema = nodes.drop("level").schema
    deepest = spark.read.schema(nodes.schema).parquet(path).agg(F.max("level")).first()[0]
    out, handed = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = spark.read.schema(schema).parquet(f"{path}/level={level}")
        if handed is not None:
            rows = rows.join(handed, "node", "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")}).drop("_leaves", "_saved")
        placed = rows.withColumn("place", F.col("node.d") - F.col("head"))
        done = materialize(_blocks(placed, "path", "place", True, n_leaves="leaves", saved_tokens="saved"), "sums")
        handed = done.where("place = 0 and parent is not null").groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        out = done if out is None else out.unionByName(done)
    return out


def trie(told: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node, from (conv_id, d, role, said, bytes, total) and (conv_id, total) as ``plain`` makes them:
    conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. No conversations have no nodes."""
    steps = materialize(_steps(told), "steps")
    nodes = materialize(_nodes(steps, convs), "nodes")
    ends = steps.where("d = total").select("node", "conv_id").unionByName(convs.where("total = 0").select(_root().alias("node"), "conv_id"))
    found = nodes.join(_paths(steps, nodes, convs), "node")
    found = _sums(found)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if found is None:
        return told.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns))
    parents = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    below = meet(found.where("parent is not null"), parents, "parent", "size", nodes.count())
    root = found.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    met = below.unionByName(root).join(endings(ends), "node", "left")
    return met.withColumns({"depth": F.col("node.d"), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_HASH))}).select(*columns)


def judge(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations."""
    return trie(*rebuilt(turns(conversations)))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    return trie(*plain(turns(conversations, id_col, turn_col, role_col, text_col)))
