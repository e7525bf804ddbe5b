import random
import threading

import pytest
from millrace.sources.changelog import ChangeLog, Run
from pyspark.sql import functions as F

SCHEMA = "id long, v string"


@pytest.fixture
def log(spark, tmp_path):
    return ChangeLog(spark, f"file://{tmp_path}/log", SCHEMA, fan=3)


def rows(spark, found):
    return spark.createDataFrame(found, SCHEMA)


def state(log):
    return {r.id: r.v for r in log.read().collect()}


def test_random_changes_against_a_dict(spark, log):
    rng, want = random.Random(4), {}
    for step in range(14):
        kind = rng.random()
        if kind < 0.65:
            new = {rng.randrange(12): f"{step}" for _ in range(3)}
            log.put(rows(spark, [*new.items()]))
            want |= new
        elif kind < 0.9:
            gone = [rng.randrange(12) for _ in range(3)]
            log.delete(rows(spark, [(k, None) for k in gone]))
            want = {k: v for k, v in want.items() if k not in gone}
        else:
            log.clear()
            want = {}
        if step % 4 == 3:
            log.merge()
        if step == 9:
            log.compact()
            assert len(log.runs()) == 1 and not log.read().where("v IS NULL").count()
        assert state(log) == want
    log.vacuum(0)
    assert state(log) == want


def test_a_commit_writes_its_own_rows_only(spark, log):
    log.put(spark.range(20_000).select("id", F.lit("old").alias("v")))
    log.put(rows(spark, [(5, "new")]))
    first, second = log.runs()
    assert spark.read.parquet(f"{log.path}/data/{second.data}").count() == 1
    assert spark.read.parquet(f"{log.path}/data/{first.data}").count() == 20_000
    assert log.read().where("v = 'new'").count() == 1 and log.read().count() == 20_000


def test_reads_stand_still_while_others_write(spark, log):
    log.put(rows(spark, [(1, "a"), (2, "b")]))
    before = log.read()
    log.delete(rows(spark, [(1, None)]))
    log.compact()
    log.vacuum()  # what was just covered stays for reads like this one
    assert before.count() == 2 and state(log) == {2: "b"}


def test_many_writers_take_numbers_of_their_own(spark, log):
    def write(k):
        log.put(rows(spark, [(k, "x"), (100, f"{k}")]))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = state(log)
    assert set(found) == {0, 1, 2, 3, 4, 100} and [r.hi for r in log.runs()] == [0, 1, 2, 3, 4]
    assert log.merge_in_background().result() == 2 and state(log) == found
    assert [(r.lo, r.hi) for r in log.runs()] == [(0, 4)]


def test_a_number_is_taken_once(log):
    assert log._create("log/x", {"by": 1}) and not log._create("log/x", {"by": 2})


def test_a_writer_that_died_is_waited_for_and_passed_over(spark, log):
    log.put(rows(spark, [(1, "a")]))
    log._fs.create(log._at(f"log/{1:020d}"), False).close()
    log.put(rows(spark, [(2, "b")]))
    assert state(log) == {1: "a"}  # the writer of the second commit may still be at it
    log._fs.setTimes(log._at(f"log/{1:020d}"), 1, 1)
    assert state(log) == {1: "a", 2: "b"}


def test_runs_of_about_one_size_are_due(log, monkeypatch):
    sizes = lambda *mb: [Run(i, i, str(i), m << 20) for i, m in enumerate(mb)]
    for mb, want in [((100, 0, 1), None), ((100, 1, 0, 1), (1, 3)), ((2, 2, 2, 90), (0, 2)), ((5, 9, 4, 30, 20, 59), (3, 5)), ((1, 1), None)]:
        monkeypatch.setattr(log, "runs", lambda mb=mb: sizes(*mb))
        due = log.due()
        assert (due and (due[0].lo, due[-1].hi) or None) == want, mb


def test_changes_for_a_follower(spark, log):
    log.put(rows(spark, [(1, "a"), (2, "b")]))
    seen = log.put(rows(spark, [(3, "c")]))
    log.put(rows(spark, [(1, "new")]))
    log.delete(rows(spark, [(3, None)]))
    assert sorted((r.id, r.v, r._gone) for r in log.changes(seen).collect()) == [(1, "new", False), (3, None, True)]
    assert log.changes(99).count() == 0


def test_repeated_and_null_keys(spark, log):
    log.put(spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "lost", 3), (2, None, 1)], "id long, v string, at int").select("id", "v"))
    assert set(state(log)) == {1, 2}
    first = state(log)
    log.put(rows(spark, [(1, "b"), (1, "a")]))
    assert state(log) == first
    log.put(spark.createDataFrame([], SCHEMA))
    assert state(log) == first


def test_nothing_written_yet(log):
    assert state(log) == {} and not log.merge() and log.vacuum(0) == 0
