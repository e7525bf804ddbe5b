"""Audio arithmetic and order statistics as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import round_half_up

CHUNK_SECONDS, OVERLAP_SECONDS, RATE = 30, 2, 16_000


def chunk_bounds(n: Column, size: int = CHUNK_SECONDS * RATE, overlap: int = OVERLAP_SECONDS * RATE) -> Column:
    """Array of (chunk_no, start, end) of ``n`` samples: windows that overlap, until one reaches the end."""
    hop = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(1 + F.ceil((n - size) / F.lit(float(hop)))).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("chunk_no"), (k.cast("long") * hop).alias("start"), F.least(k.cast("long") * hop + size, n.cast("long")).alias("end")))


def duration_seconds(samples: Column) -> Column:
    return round_half_up(samples / float(RATE)).cast("long")


def upper_median(values: Column) -> Column:
    """Middle value, the upper of two; 0 of none."""
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)).otherwise(F.lit(0))
