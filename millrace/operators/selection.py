"""Order statistics of groups without a group in one place: ranges are counted, and the one that holds the rank is sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import settled

#: Bits of the value that a round settles, and rows of a group's range that a task may sort.
BITS, SORTED = 12, 100_000


def upper_median(rows: DataFrame, group: str, value: str, to: str = "median", bits: int = BITS, most: int = SORTED) -> DataFrame:
    """(group, to): the middle of each group's values (long), the upper of two; nulls do not count, and groups without any
    other are not there.

    Values are counted by their leading bits, a row for each group and range and task, and a window over a group's few ranges
    finds the range that holds the middle and how many values are before it. Where that range has more than ``most`` rows,
    the next bits are counted within it; equal values never need sorting. At the end ranges of at most ``most`` rows are
    ranked by a window. A group that holds nearly all rows costs what others cost: a few counts."""
    # unsigned order: the sign is turned, so that shifted values are ranges in order
    cut = F.col("value").bitwiseXOR(F.lit(-(1 << 63)))
    kept = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).cast("long").alias("value"))
    kept = settled(kept, "selection")
    sizes = kept.groupBy("group").agg(F.count("*").alias("n")).select("group", F.floor(F.col("n") / 2).cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"), "n")
    state, shift, done, out = settled(sizes, "selection-ranks"), 64, [], None
    while True:
        done.append((state.where(F.col("n") <= most), shift))
        open_ = state.where(F.col("n") > most)
        if not open_.take(1):
            break
        within, shift = _inside(kept, open_, cut, shift), max(0, shift - bits)
        counts = within.withColumn("next", F.shiftrightunsigned(cut, shift)).groupBy("group", "rank", "next").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("group").orderBy(F.col("next").bitwiseXOR(F.lit(-(1 << 63)))).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("before", before).where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        state = settled(found.select("group", (F.col("rank") - F.col("before")).alias("rank"), F.col("next").alias("prefix"), "n"), "selection-ranks")
        if shift == 0:  # all bits are settled: a range is one value
            out = state.select("group", F.col("prefix").bitwiseXOR(F.lit(-(1 << 63))).alias(to))
            break
    for small, at in done:
        inside = _inside(kept, small, cut, at)
        ranked = inside.withColumn("k", F.row_number().over(W.partitionBy("group").orderBy("value"))).where(F.col("k") == F.col("rank") + 1)
        part = ranked.select("group", F.col("value").alias(to))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("group", group) if group != "group" else out


def _inside(kept: DataFrame, state: DataFrame, cut, shift: int) -> DataFrame:
    """Rows of the groups in ``state`` whose value begins as its prefix does, with the rank."""
    ranks = state.select(F.col("group").alias("_group"), "rank", "prefix")
    met = kept.join(ranks, F.col("group").eqNullSafe(F.col("_group")))
    return met.where((F.lit(True) if shift >= 64 else F.shiftrightunsigned(cut, shift) == F.col("prefix"))).select("group", "value", "rank")
