"""The corpus pipeline: toxicity, exact and near deduplication, mixing, packing.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the next stage's
documents, with the columns of ``documents``, or the packed pieces in the end. SQL can express neither the toxicity
model, the fingerprints' hash, nor the packing, so ``ORACLE_SQL`` is None; the tests hold each stage against a
brute-force version.

In every stage an empty table stays empty, columns of any other name pass unchanged, and texts of any length are read
whole. A null text counts as empty, and a null id as one that is below all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import golay, grace, jaccard, mixing, packing, toxicity
from millrace.llm.store import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated rows get one score and stay or go together; without labels all stay."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null and empty ones among them, one row with the largest id stays."""
    return grace.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links connect one row with the smallest id stays; texts without words link only to each other. Links are
    similarities of ``jaccard.SIMILARITY`` or more, judged exactly between candidates by fingerprints and by minhashes."""
    return golay.dedup(docs, width=jaccard.WIDTH, similarity=jaccard.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words, or without a source where all else fills the mix, go."""
    return mixing.mix(docs, weights=(3, 1, 2), budget=1.5, epochs=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's pieces; repeated rows are packed as often as they occur, a text without tokens as its end alone."""
    return packing.pack_documents(docs, end_id=1, capacity=4096)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies), ("source_mixing", mix_sources), ("best_fit_packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
