"""The first entry of a catalog that a text contains, by Aho-Corasick automata over shards of the catalog."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import settled

#: Bytes of patterns in one automaton, which all tasks hold.
SHARD = 4 << 20


def _automaton(patterns: list[tuple[str, int]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for text, order in patterns:
        if order < found.get(text, (order + 1,))[0]:
            found.add_word(text, (order,))
    found.make_automaton()
    return found


def first_contained(rows: DataFrame, text: str, patterns: DataFrame, pattern: str = "pattern", order: str = "ord", to: str = "found", shard: int = SHARD) -> DataFrame:
    """``rows`` with ``to``, the least ``order`` (long) of the patterns that occur in column ``text``; null if none does.

    The catalog is cut into shards of ``shard`` bytes by order, so the first shard with a match has the answer and later ones
    read only the texts that are still without. A text is read once by an automaton, however many patterns it has. Empty patterns
    occur in every text that is not null; null patterns, and those without an order, in none. Patterns that are
    longer than a shard are one of their own."""
    spark = rows.sparkSession
    kept = patterns.where(F.col(pattern).isNotNull() & F.col(order).isNotNull()).select(F.col(pattern).cast("string").alias("p"), F.col(order).cast("long").alias("o"))
    kept = settled(kept.groupBy("p").agg(F.min("o").alias("o")), "patterns")
    # sums of ranges of the order first: no window goes over the whole catalog
    ends = kept.agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.sum(F.octet_length("p")).alias("size")).first()
    shards = _shards(kept, ends, shard)
    schema = T.StructType([*rows.schema.fields, T.StructField(to, T.LongType())])
    kind = to_arrow_schema(schema)
    at, out, left = rows.columns.index(text), None, rows.withColumn(to, F.lit(None).cast("long"))
    for lo, hi in shards:
        # of a shard's bytes
        found = [(r.p, r.o) for r in kept.where((F.col("o") >= lo) & (F.col("o") <= hi)).collect()]
        shared = spark.sparkContext.broadcast(found)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            machine, always = _automaton([x for x in shared.value if x[0]]), min((o for p, o in shared.value if not p), default=None)
            for batch in batches:
                met = []
                for value in batch.column(at).cast(pa.large_binary()).to_pylist():
                    best = None
                    if value is not None:
                        hits = (o for _, (o,) in machine.iter(value.decode("utf-8", "replace"))) if len(machine) else ()
                        best = min((o for o in (always, min(hits, default=None)) if o is not None), default=None)
                    met.append(best)
                columns = [c.cast(f.type) for c, f in zip(batch.columns[:-1], kind, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(met, pa.int64())], names=kind.names)

        if out is None and len(shards) == 1:
            return left.mapInArrow(run, schema)
        done = settled(left.mapInArrow(run, schema), "contained")
        hit = done.where(F.col(to).isNotNull())
        out, left = hit if out is None else out.unionByName(hit), done.where(F.col(to).isNull())
    return left if out is None else out.unionByName(left)


def _shards(kept: DataFrame, ends, shard: int, ranges: int = 4096) -> list[tuple[int, int]]:
    """Ranges of order of at most ``shard`` bytes each, but for single orders."""
    if ends.lo is None:
        return []
    if ends.size <= shard or ends.lo == ends.hi:
        return [(ends.lo, ends.hi)]
    width = max(1, -(-(ends.hi - ends.lo + 1) // ranges))
    sizes = kept.groupBy(F.floor((F.col("o") - F.lit(ends.lo)) / width).cast("long").alias("r")).agg(F.sum(F.octet_length("p")).alias("n"), F.min("o").alias("lo"), F.max("o").alias("hi")).orderBy("r").collect()
    out, held = [], 0
    for r in sizes:
        if r.n > shard and r.lo < r.hi:
            inner = kept.where((F.col("o") >= r.lo) & (F.col("o") <= r.hi))
            out += _shards(inner, inner.agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.sum(F.octet_length("p")).alias("size")).first(), shard, ranges)
            held = shard
        elif out and held + r.n <= shard:
            out[-1], held = (out[-1][0], r.hi), held + r.n
        else:
            out.append((r.lo, r.hi))
            held = r.n
    return out
