"""Export of conversions: unique names, one Markdown text, one archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim, zip_entry_name
from ..sources.archive import build_zip


#: Parts in which the rows of one name are numbered.
PARTS = 64


def unique_names(rows: DataFrame, name: str, order: str, to: str = "entry") -> DataFrame:
    """Repeats of a name are numbered before their extension, in the order of ``order``, a number; the numbered names are
    not checked again. A name that very many rows share is numbered in ranges of ``order``, each by itself, after the
    rows of the ranges before it."""
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    width = max(((ends.hi or 0) - (ends.lo or 0) + 1) / PARTS, 1e-9)
    dealt = rows.withColumn("_part", F.coalesce(F.floor((F.col(order) - F.lit(ends.lo or 0)) / F.lit(width)), F.lit(-1)))
    sizes = dealt.groupBy(name, "_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(name).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    met = dealt.withColumn("_at", F.row_number().over(W.partitionBy(name, "_part").orderBy(order)))
    both = before.select(F.col(name).alias("_name_"), F.col("_part").alias("_part_"), "_before")
    nth = met.join(both, met[name].eqNullSafe(both["_name_"]) & (met["_part"] == both["_part_"])).withColumn("_nth", F.col("_before") + F.col("_at") - 1)
    numbered = F.regexp_replace(F.col(name), r"\.md$", "")
    entry = F.when((F.col("_nth") == 0) | ~F.endswith(name, F.lit(".md")), F.col(name)).otherwise(F.concat(numbered, F.lit(" ("), F.col("_nth").cast("string"), F.lit(").md")))
    return nth.withColumn(to, entry).drop("_nth", "_part", "_at", "_name_", "_part_", "_before")


def combined_markdown(order: Column, name: Column, markdown: Column, status: Column) -> Column:
    """Aggregate: the successful conversions in order, a heading each; empty without any."""
    part = F.struct(order.alias("o"), F.concat(F.lit("## "), name, F.lit("\n\n\n\n"), trim(markdown)).alias("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.when(status == "ok", part))), lambda p: p["t"])
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, "\n\n"), F.lit("\n"))).otherwise("")


def archives(results: DataFrame, group: str, order: str) -> DataFrame:
    """(group, zip): the successful conversions of each group as a stored archive. An archive is one value and so one
    task's work; group exports that are too large for one."""
    named = unique_names(results.where("status = 'ok'").withColumn("_name", F.concat_ws("\x00", F.col(group).cast("string"), zip_entry_name(F.col("file_name")))), "_name", order, "_entry")
    kept = named.select(F.col(group).cast("string").alias("group"), F.element_at(F.split("_entry", "\x00"), -1).alias("entry"), "markdown", F.col(order).cast("string").alias("o"), F.col(order).alias("sort"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sort", kind="stable")
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "zip": [build_zip([(n, m.encode()) for n, m in zip(pdf["entry"], pdf["markdown"].fillna(""), strict=True)])]})

    return kept.groupBy("group").applyInPandas(pack, "group string, zip binary")


def write_text(df: DataFrame, path: str, text_col: str = "text") -> None:
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
