"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize, meet

#: Edges that a task contracts at once.
BLOCK = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the given edges, without the roots themselves."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(before, root):
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each block of edges by a star forest that connects the same nodes."""
    u, v, held = [], [], 0

    def flush() -> pa.RecordBatch:
        x, y = forest(np.concatenate(u), np.concatenate(v))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
        if held >= BLOCK:
            yield flush()
            u, v, held = [], [], 0
    if held:
        yield flush()


def components(edges: DataFrame, rounds: int = 60, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """(u, root) for every node of ``edges`` (long columns u, v; no nulls), root being the smallest node reachable.
    ``make`` makes the edges from the rows of ``edges`` in the Python pass that contracts them: two passes chained in a
    task would hold two workers for each core, and workers stay.

    Each step aggregates before it shuffles and joins a minimum back; the minima of nodes with very many neighbours are
    few and go to all tasks instead. Nothing is collected. Stars come out after about log(diameter) rounds; running
    out of ``rounds`` raises instead of returning half-merged components."""
    spark = edges.sparkSession
    found = edges.mapInArrow(lambda batches: contract(make(batches)), "u long, v long") if make else edges.select("u", "v").mapInArrow(contract, "u long, v long")
    now = materialize(found, "edges")
    state, before = None, None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        # as many edges with one sum of hashes: nearly always the same ones, which a join then settles
        same = mark == state and not now.join(before, ["u", "v"], "left_anti").take(1)
        if before is not None:
            discard(spark, before)
        if same or not mark[0]:
            return now.select("u", F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())
        state, last = mark, now
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = meet(both, least, "u", "n", 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # after a large step every edge points from the larger to the smaller node
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, least, "u", "n", 2 * mark[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        now = materialize(small, "edges")
        discard(spark, large)
        before = last
    raise RuntimeError(f"components did not settle in {rounds} rounds")
