"""Structured Streaming around conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import Store
from ..operators.recognition import Engines
from ..plans.convert import Options, convert
from ..sources.files import scan_stream

#: Seconds without a sign of life after which a job counts as timed out.
INACTIVE = 60


def convert_arrivals(spark: SparkSession, path: str, store: Store, checkpoint: str, engines: Engines | None = None, options: Options | None = None, per_batch: int | None = None) -> StreamingQuery:
    """Convert files as they arrive and upsert each batch's results; a batch that runs again writes the same rows."""

    def batch(files: DataFrame, _: int) -> None:
        store.add(convert(files, engines, options))

    return scan_stream(spark, path, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(events: DataFrame, job: str = "id", ts: str = "ts") -> DataFrame:
    """The last event of each job; on a stream, in update mode."""
    others = [c for c in events.columns if c != job]
    return events.groupBy(job).agg(F.max_by(F.struct(*others), ts).alias("last")).select(job, "last.*")


def known_jobs(events: DataFrame, jobs: DataFrame, job: str = "id") -> DataFrame:
    """Events of jobs that are registered; others are dropped."""
    return events.join(jobs.select(job), job, "left_semi")


def active_spans(events: DataFrame, job: str = "id", ts: str = "ts", seconds: int = INACTIVE, late: str | None = None) -> DataFrame:
    """(job, started, times_out, n): spans of activity; each event puts the timeout off by ``seconds``."""
    source = events.withWatermark(ts, late) if late else events
    spans = source.groupBy(job, F.session_window(ts, f"{seconds} seconds")).agg(F.count("*").alias("n"))
    return spans.select(job, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("times_out"), "n")
