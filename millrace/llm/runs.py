"""Numbers of rows inside groups, however large a group is: sorted runs, and sums of the runs before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import fresh, materialize

#: ``monotonically_increasing_id`` is the partition's number times this, and the row's number in it.
SHIFT = 33


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "runs", number: str = "pos", size: str = "group_rows", rank: str | None = None) -> DataFrame:
    """``rows`` with ``number`` (from 0) in the ascending ``order`` within its ``group`` (nulls first), ``size``, the rows of
    the group, and, if ``rank`` is named, the group's own number in the order of ``group``.

    Rows are dealt by ranges of group and order, so a group that holds most rows is many tasks' work. Each sorted run is
    written once; the runs' counts, a row for each group in each run, tell how many rows come before. Rows equal in group
    and order are dealt on by their places in the input."""
    tie, at, run, first, held, before = fresh(rows, "tie", "at", "run", "first", "held", "before")
    # the places are hashed, so that equal rows do not leave in the order in which they came, task by task
    keyed = rows.withColumn(tie, F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, tie)]
    runs = materialize(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie).withColumn(at, F.monotonically_increasing_id()), name).withColumn(run, F.shiftright(at, SHIFT))
    held_by = runs.groupBy(*group, run).agg(F.min(at).alias(first), F.count("*").alias(held))
    inside = W.partitionBy(*group)
    spans = held_by.withColumn(before, F.coalesce(F.sum(held).over(inside.orderBy(run).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn(size, F.sum(held).over(inside))
    kept = [c for c in rows.columns if c not in group]
    if rank:
        groups = held_by.select(*group).distinct()
        ranks = groups.orderBy(*(F.col(c).asc_nulls_first() for c in group)).withColumn(at, F.monotonically_increasing_id())
        ranks = materialize(ranks, f"{name}-groups").withColumn(run, F.shiftright(at, SHIFT))
        # runs of groups are as few as tasks: their sums are one small window
        sums = ranks.groupBy(run).agg(F.min(at).alias(first), F.count("*").alias(held)).withColumn(before, F.coalesce(F.sum(held).over(W.orderBy(run).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        ranks = ranks.join(sums, run).select(*group, (F.col(at) - F.col(first) + F.col(before)).alias(rank))
        spans = spans.join(ranks.withColumnsRenamed({c: f"_{c}" for c in group}), _same(group)).drop(*(f"_{c}" for c in group))
    spans = materialize(spans.drop(held), f"{name}-spans").withColumnsRenamed({c: f"_{c}" for c in (*group, run)})
    met = runs.join(spans, _same([*group, run]))
    return met.select(*group, *kept, (F.col(at) - F.col(first) + F.col(before)).alias(number), size, *([rank] if rank else []))


def _same(names: list[str]):
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out
