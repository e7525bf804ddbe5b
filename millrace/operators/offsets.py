"""Running sums and places over a whole table in one order, by sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: ``monotonically_increasing_id`` is the partition's number times this power of two, and the row's number in it.
SHIFT = 33


def running(rows: DataFrame, order: list[str], size: str | None = None, to: str = "offset", group: list[str] | None = None, total: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``size`` (None: the count) of all rows before in ``order``, within ``group`` if there is one, and
    ``total``, the whole sum of its group.

    Rows are dealt by ranges of group and order and sorted where they are, each run is written once, and the sums of runs, a row
    for each group and task, are added up by a window. Inside a run a window goes over rows of one group in one run."""
    group = group or []
    one = F.col(size) if size else F.lit(1)
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    tie = F.xxhash64(F.monotonically_increasing_id())  # rows equal in all keys may lie in several runs
    runs = rows.withColumns({"_size": one.cast("long"), "_tie": tie}).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    runs = settled(runs.drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "runs").withColumn("_run", F.shiftright("_at", SHIFT))
    held = runs.groupBy(*group, "_run").agg(F.sum("_size").alias("_held"))
    inside = W.partitionBy(*group) if group else W.partitionBy()
    sums = held.withColumn("_before", F.coalesce(F.sum("_held").over(inside.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_held").over(inside))
    sums = settled(sums.drop("_held").withColumnsRenamed({c: f"_{c}_" for c in (*group, "_run")}), "run-sums")
    same = F.col("_run") == F.col("__run_")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    upto = W.partitionBy(*group, "_run").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    met = runs.join(sums, same).withColumn(to, F.col("_before") + F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    return met.select(*rows.columns, to, *([total] if total else []))
