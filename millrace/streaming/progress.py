"""Messages of jobs as a stream: which of them count, and how far the jobs are.

A message counts if its job was requested, and arrives while the request still waits: requests and messages are two streams,
joined within a span of event time, so that both sides' state is bounded by watermarks. What comes too late or belongs to no
request is dropped, and counted: metrics are observed as the batches pass, and a listener adds them up.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def answered(requests: DataFrame, messages: DataFrame, job: str = "id", ts: str = "ts", late: str = "10 seconds", within: str = "60 seconds") -> DataFrame:
    """Messages (their columns) of requested jobs that come not before the request and less than ``within`` behind it; on two
    streams, each at most ``late`` behind. A job that is requested twice within that span has its messages twice. Rows
    without a job or time belong to none."""
    asked = requests.select(F.col(job).alias("_job"), F.col(ts).alias("_asked")).withWatermark("_asked", late)
    said = messages.withWatermark(ts, late)
    between = (F.col(job) == F.col("_job")) & (F.col(ts) >= F.col("_asked")) & (F.col(ts) < F.col("_asked") + F.expr(f"INTERVAL {within}"))
    return said.join(asked, between).select(*messages.columns)


def counted(rows: DataFrame, name: str, **more) -> DataFrame:
    """``rows``, observed: ``n`` rows and further aggregates under ``name``, for a ``Progress`` to gather."""
    return rows.observe(name, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in more.items()))


class Progress(StreamingQueryListener):
    """Sums of what ``counted`` observes, of rows read, and of rows that came too late for state, by stream. Use as a context: it
    listens while it is open."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.sums, self.rows, self.late, self.ended = spark, Counter(), Counter(), Counter(), {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            now = event.progress
            key = now.name or str(now.id)
            self.rows[key] += now.numInputRows
            self.late[key] += sum(s.numRowsDroppedByWatermark for s in now.stateOperators)
            for name, row in now.observedMetrics.items():
                for field, value in row.asDict().items():
                    self.sums[name, field] += value or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.ended[str(event.id)] = event.exception

    def __enter__(self) -> Progress:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_: object) -> None:
        # events arrive behind the batches: wait for those of what has run
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)


def percents(messages: DataFrame, job: str = "id", done: str = "done", total: str = "total", order: str = "ts") -> DataFrame:
    """(job, percent, n): how far each job is by its last message: 0 to 100, half a percent up; null where done or total is not known; on
    a stream in update mode."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.floor(100 * F.col("last.done") / F.col("last.total") + 0.5)))
    last = messages.groupBy(job).agg(F.max_by(F.struct(F.col(done).alias("done"), F.col(total).alias("total")), order).alias("last"), F.count("*").alias("n"))
    return last.select(job, F.when((F.col("last.total") > 0) & F.col("last.done").isNotNull(), share).cast("int").alias("percent"), "n")
