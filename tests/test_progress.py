import pytest
from millrace.streaming import progress, timeouts
from pyspark.sql import functions as F


@pytest.fixture
def stream(spark, tmp_path):
    def write(name, batches):
        for rows in batches:
            spark.createDataFrame(rows, "id string, s long, n int").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        read = spark.readStream.schema("id string, s long, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        return read.select("id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "n")

    return write


def test_unknown_late_and_overdue_messages_are_dropped_and_counted(spark, tmp_path, stream):
    requests = stream("asked", [[("a", 0, 0), ("b", 10, 0)], [("c", 200, 0)], [("c", 400, 0)], [("c", 500, 0)]])
    # x was never asked; a's message at 70 is overdue; b's at 15 comes when all of that time is over
    messages = stream("said", [[("a", 0, 1), ("a", 30, 2), ("x", 20, 3), ("a", 70, 4)], [("c", 230, 5), (None, 230, 6)], [("c", 401, 8)], [("b", 15, 7)]])
    with progress.Progress(spark) as seen:
        said = progress.counted(messages, "said", least=F.min("n"))
        found = progress.counted(progress.answered(requests, said, within="60 seconds"), "answered")
        rows = timeouts.drained(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.id, r.n) for r in rows.collect()) == [("a", 1), ("a", 2), ("c", 5), ("c", 8)]
    assert seen.sums["said", "n"] == 8 and seen.sums["answered", "n"] == 4
    assert sum(seen.late.values()) >= 1 and sum(seen.rows.values()) == 13


def test_percents(spark):
    rows = [("a", 1, 1, 8), ("a", 2, 3, 8), ("b", 1, 9, 4), ("c", 1, -1, 4), ("d", 1, 1, 0), ("e", 1, None, 4), ("f", 3, 1, 200)]
    frame = spark.createDataFrame(rows, "id string, ts int, done int, total int")
    assert {r.id: (r.percent, r.n) for r in progress.percents(frame).collect()} == {"a": (38, 2), "b": (100, 1), "c": (0, 1), "d": (None, 1), "e": (None, 1), "f": (1, 1)}
