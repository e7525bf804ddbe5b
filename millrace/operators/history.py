"""The keyed history of conversions: its operations on tables, and its store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import trim, words
from ..sources.changelog import ChangeLog
from ..sources.schema import RESULT

MOST_IN_MEMORY = 200


def latest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """The last row of each key by ``version`` columns. Aggregated before the shuffle, so a key with very many
    versions costs one row a task."""
    names = rows.columns
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*version)).alias("_row"))
    return picked.select("_row.*")


def upsert(history: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``history`` with ``changes``; a change replaces the row of its key."""
    both = history.withColumn("_version", F.lit(0)).unionByName(changes.withColumn("_version", F.lit(1)))
    return latest(both, key, "_version").drop("_version")


def delete(history: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return history.join(ids.select(key).distinct(), key, "left_anti")


def listed(history: DataFrame) -> DataFrame:
    """Newest first; rows without a time last."""
    return history.orderBy(F.coalesce(F.col("created_at").cast("double"), F.lit(0.0)).desc(), "id")


def newest(history: DataFrame, most: int = MOST_IN_MEMORY) -> DataFrame:
    return listed(history).limit(most)


def matches(query: str, *columns: Column) -> Column:
    """Whether a trimmed query occurs in any of the columns, whatever the case; an empty one matches all."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return out


def search(history: DataFrame, query: str) -> DataFrame:
    body = F.when(F.col("status") == "error", F.col("error.message")).otherwise(F.col("markdown"))
    return history.where(matches(query, F.col("file_name"), F.col("detected.label"), F.col("metadata.engine"), body))


def exportable(history: DataFrame) -> DataFrame:
    return history.where(F.col("status") == "ok")


def edited(history: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """``history`` after edits (id, text): the trimmed text where the untrimmed one differs. Of several edits of a row the
    last by ``order`` counts, else the largest text."""
    new = edits.groupBy("id").agg((F.max_by("text", order) if order else F.max("text")).alias("_text"))
    met = history.join(new, "id", "left")
    changed = F.col("_text").isNotNull() & ~F.col("_text").eqNullSafe(F.col("markdown"))
    return met.withColumn("markdown", F.when(changed, trim(F.col("_text"))).otherwise(F.col("markdown"))).drop("_text").select(*history.columns)


def session(rows: DataFrame, sequence: str) -> DataFrame:
    """Results of a session as they are shown: the one that came last is first."""
    return rows.orderBy(F.col(sequence).desc())


def last(jobs: Column, n: int) -> Column:
    """The last ``n`` of an array, all of a shorter one."""
    return F.slice(jobs, F.greatest(F.size(jobs) - n, F.lit(0)) + 1, n)


def summary(history: DataFrame) -> DataFrame:
    """One row: conversions, those that can be exported, those that failed, and the words of the former."""
    ok = F.col("status") == "ok"
    count = F.sum(F.when(ok, F.size(words(F.col("markdown")))).otherwise(0))
    return history.agg(F.count("*").alias("n"), F.count_if(ok).alias("exportable"), F.count_if(~ok).alias("failed"), F.coalesce(count, F.lit(0)).alias("words"))


def combined(session: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the session and of the store, repeats and all."""
    return session.unionByName(stored, allowMissingColumns=True)


class Store:
    """History under a path as a log of changes (``ChangeLog``): what is added or deleted is written, nothing else. Runs of
    changes are merged after every few of them, or by ``log.merge_in_background()`` with ``merging`` off."""

    def __init__(self, spark: SparkSession, path: str, merging: bool = True) -> None:
        self.log, self.merging = ChangeLog(spark, path, RESULT, ("id",)), merging

    def read(self) -> DataFrame:
        return self.log.read()

    def _merged(self) -> None:
        while self.merging and self.log.merge():
            pass

    def add(self, results: DataFrame) -> None:
        """Upsert; failed conversions are not kept. ``results`` are evaluated once. Of rows that share an id, as of a file that
        is in the input twice, one is kept."""
        self.log.put(exportable(results))
        self._merged()

    def delete(self, ids: DataFrame) -> None:
        self.log.delete(ids)
        self._merged()

    def clear(self) -> None:
        self.log.clear()


def ranked(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows with their rank. The limit is applied in each task before the one that ranks."""
    return rows.orderBy(*order).limit(most).withColumn("rn", F.row_number().over(W.orderBy(*order)))
