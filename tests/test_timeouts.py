import random
import time

import pytest
from millrace.streaming import timeouts
from pyspark.sql import functions as F


def test_spans_merge():
    assert timeouts.merged([(5, 5, 1), (0, 0, 1), (9, 9, 1), (20, 20, 1)], 5) == [(0, 0, 1), (5, 9, 2), (20, 20, 1)]
    assert timeouts.merged([(0, 10, 3), (2, 4, 1)], 5) == [(0, 10, 4)] and timeouts.merged([], 5) == []


@pytest.fixture
def put(spark, tmp_path):
    """Batches of (job, seconds): a stream that takes one at a time."""

    def write(batches):
        for k, rows in enumerate(batches):
            at = str(tmp_path / "in")
            spark.createDataFrame(rows, "id string, s double").coalesce(1).write.mode("append").parquet(at)
        return spark.readStream.schema("id string, s double").option("maxFilesPerTrigger", 1).parquet(at).select("id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))

    return write


def found(spark, tmp_path, stream):
    return timeouts.drained(stream, str(tmp_path / "out"), str(tmp_path / "state"))


def spans(rows):
    return sorted((r.id, r.started.timestamp() - 1000, r.times_out.timestamp() - 1000, r.n, r.code) for r in rows)


def test_silence_ends_spans_in_event_time(spark, tmp_path, put):
    # a is silent from 30 on while the stream goes on to 500; its later events are a span of their own; one comes late and joins two
    batches = [[("a", 0.0), ("a", 30.0), ("b", 10.0)], [("b", 60.0), ("c", 100.0)], [("c", 155.0), ("c", 130.0), ("b", 200.0)], [("a", 300.0), ("d", 500.0), (None, 1.0)]]
    rows = found(spark, tmp_path, timeouts.live_timeouts(put(batches), seconds=60, late="20 seconds")).collect()
    want = [("a", 0.0, 90.0, 2), ("a", 300.0, 360.0, 1), ("b", 10.0, 120.0, 2), ("b", 200.0, 260.0, 1), ("c", 100.0, 215.0, 3)]
    assert spans(rows) == [(*w, "timeout") for w in want]  # d is not silent yet


def test_random_events_against_brute_force(spark, tmp_path, put):
    rng = random.Random(2)
    events = sorted(((f"j{rng.randrange(5)}", float(rng.randrange(2000))) for _ in range(200)), key=lambda e: e[1])
    batches = [rng.sample(events[k : k + 40], len(events[k : k + 40])) for k in range(0, 200, 40)]
    rows = found(spark, tmp_path, timeouts.live_timeouts(put(batches), seconds=45, late="0 seconds")).collect()
    end, want = events[-1][1], []
    for job in {j for j, _ in events}:
        at = [(s, s, 1) for j, s in events if j == job]
        want += [(job, a, b + 45, n, "timeout") for a, b, n in timeouts.merged(at, 45) if b + 45 <= end]
    assert spans(rows) == sorted(want)


def test_the_clock_ends_spans_while_nothing_arrives(spark, tmp_path, put):
    stream = timeouts.live_timeouts(put([[("a", 0.0), ("a", 5.0), ("b", 1.0)]]), seconds=2, late=None)
    running = stream.writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("silent").count() < 2:
            time.sleep(1)
        rows = spark.table("silent").collect()
        left = running.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        running.stop()
    assert sorted((r.id, r.n, r.code) for r in rows) == [("a", 2, "timeout"), ("b", 1, "timeout")]
    assert all((r.times_out - r.started).total_seconds() == 2 for r in rows) and left == 0


def test_no_events(spark, tmp_path):
    empty = spark.createDataFrame([], "id string, ts timestamp")
    stream = timeouts.live_timeouts(timeouts.replayed(empty, str(tmp_path / "in")))
    assert found(spark, tmp_path, stream).collect() == []


def test_event_time_runs_no_python_for_each_job(spark, put):
    stream = timeouts.live_timeouts(put([[("a", 0.0)]]), seconds=60, late="20 seconds")
    assert "transformwithstate" not in stream._jdf.queryExecution().logical().toString().lower()
