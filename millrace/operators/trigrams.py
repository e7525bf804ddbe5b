"""Substring search that skips blocks: each block of rows has a bitmap of the hashed trigrams in its texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .history import matches

#: Bits of a block's bitmap, in words of 64, and characters of text that a block holds.
WORDS, BLOCK = 1 << 14, 32 << 20


def _grams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(WORDS * 64))


@dataclass(frozen=True)
class TrigramIndex:
    """Rows under ``path``/rows, a folder for each block, and the bitmaps' set words under ``path``/bits (word, bits, block)."""

    spark: SparkSession
    path: str
    columns: tuple[str, ...]
    schema: T.StructType

    def blocks(self, query: str) -> DataFrame:
        """Blocks that have every trigram of ``query``, and so may have it; a query of fewer letters than three is in any."""
        wanted = query.strip().lower()
        grams = sorted({wanted[i : i + 3] for i in range(len(wanted) - 2)})
        if not grams:
            return self.spark.read.parquet(f"{self.path}/blocks").select("block")
        slots = self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_slot(F.col("gram")).alias("slot")).distinct()
        need = slots.groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("mask"))
        rows = [(r.word, r.mask) for r in need.collect()]
        bits = self.spark.read.parquet(f"{self.path}/bits").where(F.col("word").isin([w for w, _ in rows]))
        met = F.lit(False)
        for word, mask in rows:
            met = met | ((F.col("word") == word) & (F.col("bits").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long")))
        return bits.where(met).groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(rows)).select("block")

    def search(self, query: str) -> DataFrame:
        """Rows in which ``query`` occurs, whatever the case: ``contains`` over the blocks that may have it. Only their
        folders are read."""
        found = [f"{self.path}/rows/block={r[0]}" for r in self.blocks(query).collect()]
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows")
        rows = reader.parquet(*found) if found else self.spark.createDataFrame([], self.schema)
        return rows.where(matches(query, *map(F.col, self.columns))).drop("block")


def build(rows: DataFrame, path: str, columns: Sequence[str], block: int = BLOCK) -> TrigramIndex:
    """Write ``rows`` and the index of their text ``columns`` under ``path``, in blocks of about ``block`` characters. A block is a
    run of the input, so what lies together, as of one source or day, is skipped together. Bits are or-ed in each task before they
    meet; a block has WORDS of them at most, whatever its texts. Null texts have no letters."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(sum((F.coalesce(F.length(c), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long")))).first()[0] or 0
    placed = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-size // block)), "_at")
    placed.drop("_at").withColumn("block", F.spark_partition_id()).write.partitionBy("block").parquet(f"{path}/rows")
    stored = spark.read.schema(_with_block(rows)).parquet(f"{path}/rows")
    grams = stored.select("block", F.explode(F.flatten(F.array(*(F.coalesce(_grams(F.col(c)), F.array().cast("array<string>")) for c in columns)))).alias("gram"))
    slots = grams.select("block", _slot(F.col("gram")).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    words = slots.groupBy("block", F.floor(F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
    # sorted, so that a query reads the row groups of its own words
    words.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/bits")
    stored.groupBy("block").agg(F.count("*").alias("n")).write.parquet(f"{path}/blocks")
    return TrigramIndex(spark, path, tuple(columns), _with_block(rows))


def _with_block(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("block", T.IntegerType())])
