"""Jobs that fall silent: each yields a timeout while the stream goes on.

A job's open spans of activity are its state. Events may come in any order: spans grow and merge as late ones fill gaps. When time
passes the end of a span, the job has been silent for long enough: a row of error code ``timeout`` goes out, and of a job without
spans nothing is kept. In event time spans are session windows that the watermark ends (so a replayed stream gives the same rows);
in processing time a timer stands at the end of a job's first span, which the clock passes whether anything arrives or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import INACTIVE

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merged(spans: list[tuple[float, float, int]], gap: float) -> list[tuple[float, float, int]]:
    """Spans (first, last, events) in order, those joined whose silence between is shorter than ``gap``."""
    out: list[tuple[float, float, int]] = []
    for first, last, n in sorted(spans):
        if out and first - out[-1][1] < gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


def _stamp(micros: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=int(micros))


class Silence(StatefulProcessor):
    """Spans of ``job`` that the clock ends."""

    def __init__(self, job: str, seconds: float) -> None:
        self.job, self.gap = job, int(seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "first long, last long, n long")

    def _read(self) -> list[tuple[int, int, int]]:
        return [tuple(map(int, s)) for s in self.spans.get()]

    def _keep(self, before: int | None, spans: list[tuple[int, int, int]]) -> None:
        """Store ``spans``, and move the timer from ``before`` to the end of the first, which is over first."""
        at = self._ends(spans[0]) if spans else None
        if at != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        if spans:
            self.spans.put(spans)
        else:
            self.spans.clear()

    def _ends(self, span: tuple[int, int, int]) -> int:
        """Milliseconds at which a span is over, not before its last microsecond."""
        return -(-(span[1] + self.gap) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        spans = self._read()
        before = self._ends(spans[0]) if spans else None
        now = timerValues.getCurrentProcessingTimeInMs() * 1000
        for pdf in rows:
            spans = merged([*spans, (now, now, len(pdf))], self.gap)
        self._keep(before, spans)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # time may have passed the ends of later spans, too, whose timers do not stand yet
        now = timerValues.getCurrentProcessingTimeInMs()
        at = max(now, expiredTimerInfo.getExpiryTimeInMs())
        over, rest = [], []
        for s in self._read():
            (over if self._ends(s) <= at else rest).append(s)
        self._keep(None, rest)  # this timer is gone
        if over:
            yield pd.DataFrame({
                self.job: [key[0]] * len(over), "code": "timeout",
                "started": [_stamp(s[0]) for s in over], "times_out": [_stamp(s[1] + self.gap) for s in over], "n": [s[2] for s in over],
            })

    def close(self) -> None:
        pass


def live_timeouts(events: DataFrame, job: str = "id", ts: str = "ts", seconds: float = INACTIVE, late: str | None = "0 seconds") -> DataFrame:
    """Of a stream of events: (job, code, started, times_out, n) for each span of activity that ``seconds`` of silence
    end. ``late``: how far behind events may come in event time; None takes the clock instead. Events that are later than
    that may be left out, and are where their own silence is over; rows without a job or time count nowhere. The stream keeps its state in RocksDB, off the heap."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.where(F.col(job).isNotNull())
    if late is not None:
        return _by_watermark(rows.where(F.col(ts).isNotNull()).withWatermark(ts, late), job, ts, seconds)
    kind = events.schema[job].dataType
    out = T.StructType([T.StructField(job, kind), T.StructField("code", T.StringType()), T.StructField("started", T.TimestampType()), T.StructField("times_out", T.TimestampType()), T.StructField("n", T.LongType())])
    return rows.select(job).groupBy(job).transformWithStateInPandas(statefulProcessor=Silence(job, seconds), outputStructType=out, outputMode="Append", timeMode="ProcessingTime")


def _by_watermark(rows: DataFrame, job: str, ts: str, seconds: float) -> DataFrame:
    """Spans as session windows: they are merged where the state is kept, and no job's rows go to Python one job at a time.
    Session windows that touch are one, so that they are a microsecond shorter than the silence, and end that much earlier."""
    spans = rows.groupBy(job, F.session_window(ts, f"{round(seconds * 1_000_000) - 1} microseconds").alias("span")).agg(F.count("*").alias("n"))
    return spans.select(job, F.lit("timeout").alias("code"), F.col("span.start").alias("started"), (F.col("span.end") + F.expr("INTERVAL '0.000001' SECOND")).alias("times_out"), "n")


def replayed(events: DataFrame, path: str, ts: str = "ts", batches: int = 8) -> DataFrame:
    """``events`` as a stream that comes in the order of ``ts``, in about ``batches`` batches; ``path`` is for its files."""
    ends = events.agg(F.min(F.unix_micros(ts)).alias("lo"), F.max(F.unix_micros(ts)).alias("hi")).first()
    if ends.lo is None:
        events.write.parquet(path)
        return events.sparkSession.readStream.schema(events.schema).parquet(path)
    width = (ends.hi - ends.lo) // batches + 1
    for k in range(batches):
        part = events.where((F.unix_micros(ts) >= ends.lo + k * width) & (F.unix_micros(ts) < ends.lo + (k + 1) * width))
        part.write.mode("append").parquet(path)
    reader = events.sparkSession.readStream.schema(events.schema)
    files = len([1 for f in events.sparkSession.read.parquet(path).inputFiles()])
    return reader.option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream that ends gives, written under ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
