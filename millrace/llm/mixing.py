"""Mixing sources to target weights, with DataFrame functions only.

Each document gets an exponential key, -ln(u) / quality (Efraimidis and Spirakis), u being a hash of its id, so
that reruns agree. Quality is a column of the documents, or where none is named a stand-in made from the text. Complete epochs of a source come first; the rest of its target is filled with the documents of
the smallest keys, by a prefix sum. Rows of one id follow each other by size and a hash of the text; rows equal in all that are
as good as each other, and as many of them are taken as the budget holds. The prefix sum has two levels: sums of sorted runs
(ranges of source and key, a task each, equal rows dealt on), and a running sum inside the one run of each source in which
its budget ends. No task ever sorts a whole source, texts are read once and not sorted, and the documents meet only
a table with one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runs import SHIFT, numbered
from .store import fresh, materialize

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
EPOCHS = 2
SEED = 17
#: What orders the rows of a source.
ORDER = ("key", "id", "size", "content")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """1 to 2: most for an ordinary mean length of words; a stand-in where no quality score is at hand."""
    return F.when(size > 0, 1 + F.exp(-F.pow((F.length(text) / size - 6.5) / 3, F.lit(2)))).otherwise(1.0)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size) with target: ``budget`` times all sizes shared by weight, no target above
    ``epochs`` times its size, the excess shared again by weight.

    That fixpoint fills sources in the order of cap / weight: a source is capped if its share of what the sources
    before it leave is its cap or more, and the first one that isn't fixes the level for all after it. The
    windows hold one row for each source."""
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sharing = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / sharing)
    open_level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    return level.select("source", "source_size", F.least("cap", F.coalesce(open_level * F.col("weight"), F.col("cap"))).alias("target"))


def _keyed(rows: DataFrame, seed: int) -> DataFrame:
    """(source, id, size, content, weight) with key."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return rows.withColumn("key", -F.log(uniform) / F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-9)))


def _runs(rows: DataFrame, seed: int) -> DataFrame:
    """(source, key, id, size, content) in sorted runs, with ``at``, which rises with them over all runs."""
    # equal rows are dealt on by their places
    keyed = _keyed(rows, seed).select("source", *ORDER).withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    keys = [F.col(c).asc_nulls_first() for c in ("source", *ORDER, "tie")]
    return materialize(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()), "mixing-runs").withColumn("run", F.shiftright("at", SHIFT))


def plan(runs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Of sorted runs: one row for each source with its size, target and epochs, and the ``at`` up to which rows are taken
    once more. A row joins the last epoch if its middle is within the budget, so a source ends within half a document of its
    target."""
    spans = materialize(runs.groupBy("source", "run").agg(F.sum("size").alias("held"), F.max("at").alias("ends")), "spans")
    sources = targets(spans.groupBy("source").agg(F.sum("held").alias("source_size")), weights, budget, epochs)
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = materialize(sources.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "sources")
    upto = W.partitionBy("source").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumns({"before": F.coalesce(F.sum("held").over(upto), F.lit(0)), "sooner": F.max("ends").over(upto)})
    same = spans["source"].eqNullSafe(sources["source"])
    last = spans.join(sources, same).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("held"))).select(spans["source"].alias("at_source"), F.col("run").alias("at_run"), "before", "rest", "sooner")
    last = materialize(last, "last-runs")
    inside = runs.join(last, runs["source"].eqNullSafe(last["at_source"]) & (runs["run"] == last["at_run"]))
    order = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2
    cut = inside.withColumn("middle", middle).where(F.col("middle") <= F.col("rest")).groupBy("source").agg(F.max("at").alias("cut")).withColumnRenamed("source", "cut_source")
    ends = last.join(cut, last["at_source"].eqNullSafe(cut["cut_source"]), "left").select("at_source", F.coalesce("cut", "sooner").alias("cut"))
    return materialize(sources.join(ends, sources["source"].eqNullSafe(ends["at_source"]), "left").select("source", "source_size", "target", "epochs", "cut"), "mixing-plan")


def _planned(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({c: f"plan_{c}" for c in found.columns})


def drawn(runs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``runs`` with their source's plan and ``copies``."""
    met = runs.join(_planned(found), F.col("source").eqNullSafe(F.col("plan_source")))
    return met.withColumn("copies", F.col("plan_epochs") + F.coalesce(F.col("at") <= F.col("plan_cut"), F.lit(False)).cast("long"))


def _cuts(runs: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with the last row that is taken, and of rows like it, how many there are and how many are taken."""
    row = F.struct(*ORDER)
    ends = runs.join(found.select(F.col("cut").alias("at")), "at").select(F.col("source").alias("end_source"), row.alias("end"), F.col("at").alias("end_at"))
    ends = materialize(ends, "mixing-ends")
    like = runs.join(ends, F.col("source").eqNullSafe(F.col("end_source")) & row.eqNullSafe(F.col("end")))
    counts = like.groupBy("end_source").agg(F.max("end").alias("last"), F.count("*").alias("like_it"), F.count_if(F.col("at") <= F.col("end_at")).alias("most"))
    return materialize(found.join(counts, F.col("source").eqNullSafe(F.col("end_source")), "left").drop("end_source"), "mixing-cuts")


def _weight(docs: DataFrame, text_col: str, size: Column, quality_col: str | None) -> Column:
    return F.col(quality_col).cast("double") if quality_col else quality(F.col(text_col), size)


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality_col: str | None, *more: Column) -> DataFrame:
    text, size = F.col(text_col), words(F.col(text_col))
    return docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("id"), size.alias("size"), F.xxhash64(text).alias("content"), _weight(docs, text_col, size, quality_col).alias("weight"), *more)


def judge(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED, quality_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    Null texts have size 0; documents without a source form a source of their own, ranked last. Rows that repeat an id, or
    have none, are taken one by one like others. A null quality is 1, one of 0 or less the least. An empty table gives an
    empty result; sources of size 0 get 0."""
    rows = materialize(_rows(docs, id_col, source_col, text_col, quality_col), "sizes")  # one pass over the texts
    runs = _runs(rows, seed)
    met = drawn(runs, plan(runs, weights, budget, epochs))
    return met.select(F.col("id").alias("doc_id"), "size", F.col("plan_source_size").alias("source_size"), F.col("plan_target").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: int = SEED, quality_col: str | None = None) -> DataFrame:
    """``docs`` as the mix takes them: each document as often as its epochs say, columns unchanged. Of rows that repeat id and
    text at the very end of a source's budget, those of the least hashes of all columns."""
    (whole,) = fresh(docs, "whole")
    rows = _rows(docs, id_col, source_col, text_col, quality_col, F.struct(*docs.columns).alias(whole))
    runs = _runs(materialize(rows.drop(whole), "sizes"), seed)
    found = _cuts(runs, plan(runs, weights, budget, epochs))
    met = _keyed(rows, seed).join(_planned(found), F.col("source").eqNullSafe(F.col("plan_source")))
    row, last = F.struct(*ORDER), F.col("plan_last")
    within = F.coalesce(row <= last, F.lit(False))
    out = met.withColumn("copies", F.col("plan_epochs") + within.cast("long"))
    if found.where("most < like_it").take(1):
        shared = last.isNotNull() & row.eqNullSafe(last) & (F.col("plan_most") < F.col("plan_like_it"))
        alike = met.where(shared).select("plan_source", "plan_epochs", "plan_most", F.xxhash64(F.to_json(F.col(whole))).alias("hashed"), whole)
        alike = numbered(alike, ["plan_source"], ["hashed"], "mixing-alike", "pos", "alike_rows").withColumn("copies", F.col("plan_epochs") + (F.col("pos") < F.col("plan_most")).cast("long"))
        out = out.where(~shared).select(whole, "copies").unionByName(alike.select(whole, "copies"))
    return out.where("copies > 0").select(whole, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(f"{whole}.*")
