import hashlib
import os

import pytest

from millrace.llm import grace

ROWS = [(1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "Äb"), (5, "äb"), (6, None), (7, ""), (8, " "), (9, "long " * 50_000), (10, "LONG " * 50_000), (None, "n"), (None, "N"), (None, "same text"), (11, "r"), (11, "r"), (11, "R"), *[(100 + i, "hot copy") for i in range(40)]]


def lower(text):
    return (text or "").encode().lower()


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out, seen = [], set()
    for i, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        kept = i == keep and lower(t) not in seen
        if kept:
            seen.add(lower(t))
        out.append((str(i), str(keep), len(ids), kept, hashlib.sha256(lower(t)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("table_bytes", [1, 600, 64 << 20])
def test_judge(spark, table_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in grace.judge(docs, table_bytes=table_bytes).collect())
    assert got == expected(ROWS)


def test_dedup_keeps_one_row_of_each_group_and_its_columns(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, digest int").repartition(3)
    got = grace.dedup(docs).collect()
    assert got[0].asDict().keys() == {"doc_id", "text", "digest"}
    assert sorted(lower(r.text) for r in got) == sorted({lower(t) for _, t in ROWS})
    keep = {lower(t): max((i for i, x in ROWS if lower(x) == lower(t) and i is not None), default=None) for _, t in ROWS}
    assert all(r.doc_id == keep[lower(r.text)] for r in got)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert grace.judge(docs).collect() == [] and grace.dedup(docs).collect() == []


@pytest.mark.parametrize("held", [1, 300, 5000])
def test_tasks_hold_back_texts_that_repeat(spark, monkeypatch, held):
    monkeypatch.setattr(grace, "HELD_BYTES", held)
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k % 900} of some length") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in grace.judge(docs).collect())
    assert got == expected(rows)


def test_spill_recursion(tmp_path):
    records = [(hashlib.sha256(t).digest(), t, k, 1, 1) for k, t in enumerate(str(i % 700).encode() for i in range(3000))]
    got = sorted(grace.resolve(iter(records), 5000, str(tmp_path)))
    assert len(got) == 700 and sum(r[3] for r in got) == 3000 and not os.listdir(tmp_path)


def test_table_compares_complete_content():
    table = grace.OpenTable()
    table.add(b"d" * 32, b"one", 1, 1, 1)
    with pytest.raises(ValueError):
        table.add(b"d" * 32, b"two", 2, 1, 1)
