import math
import re

import pytest

from millrace.llm import mixing

ROWS = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 4}" if i % 4 else "hot") for i in range(400)] + [(1000, None, "s1"), (1001, "a b", None), (None, "x y z", "s2"), (1002, "", "none"), (1003, "  ", "none"), (1004, "q\x0bq\x0cq é q", "z"), (7, "r r", "s3"), (7, "r r", "s3"), (1005, "t " * 30_000, "big")]


def reshare(sizes, weights, budget, epochs):
    """The contract's loop, source by source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, free = {}, budget * sum(sizes.values()), set(names)
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > epochs * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        for s in over:
            target[s] = epochs * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("budget", [1.5, 0.3, 2.0])
def test_judge(spark, budget):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    got = mixing.judge(docs, budget=budget).collect()
    assert len(got) == len(ROWS)
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(i), str(s), len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in ROWS)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = reshare(sizes, (3, 1, 2), budget, 2)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sizes[s] and own[0].target == pytest.approx(expected[s])
        largest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - expected[s]) <= largest
        assert all(r.taken in {0, r.size, 2 * r.size} for r in own)
        # complete epochs come before any fraction
        copies = {r.copies for r in own}
        assert max(copies) - min(copies) <= 1
    again = mixing.judge(docs.repartition(5), budget=budget).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_fraction_is_a_prefix_of_the_keys(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    rows = docs.select("source", docs.doc_id.alias("id"), mixing.words(docs.text).alias("size")).selectExpr("*", "0L AS content", "1.0D as weight")
    runs = mixing._runs(rows, mixing.SEED)
    met = mixing.drawn(runs, mixing.plan(runs)).collect()
    for s in ("hot", "s1", "s2"):
        own = sorted((r.key, r.id, r.size, r.copies) for r in met if r.source == s and r.id is not None)
        copies = [c for *_, c in own]
        assert copies == sorted(copies, reverse=True)


@pytest.mark.parametrize("ids", [lambda i: None if i % 2 else i, lambda i: 7, lambda i: None])
def test_rows_that_share_an_id_are_taken_one_by_one(spark, ids):
    # half without an id, or one id for all; a third of the rows equal in all columns
    rows = [(ids(i), "ten words " * 5 + ("" if i % 3 == 0 else str(i)), "s") for i in range(2000)] + [(i, "ten words " * 5, "t") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for budget in (0.3, 1.5):
        got = mixing.judge(docs, budget=budget).collect()
        for s in "st":
            own = [r for r in got if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 11
            assert max(r.copies for r in own) - min(r.copies for r in own) <= 1
        assert sorted(map(str, mixing.judge(docs.repartition(3), budget=budget).collect())) == sorted(map(str, got))
        mixed = mixing.mix(docs, budget=budget).collect()
        for s in "st":
            assert sum(len(r.text.split()) for r in mixed if r.source == s) == sum(r.taken for r in got if r.source == s)


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "1 as copies", "2 as key")
    got = mixing.mix(docs).collect()
    taken = sum(r.taken for r in mixing.judge(docs).collect())
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "copies", "key"}
    assert sum(len((r.text or "").split()) for r in got) == taken


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.judge(docs).collect() == [] and mixing.mix(docs).collect() == []


def test_draw_is_weighted_by_a_quality_column(spark):
    rows = [(i, "w " * (1 + i % 5), "s", [4.0, 0.25, None, -1.0][i % 4]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, grade double")
    got = {r.doc_id: r for r in mixing.judge(docs, budget=0.5, epochs=1, quality_col="grade").collect()}
    uniform = {r.doc_id: r.u for r in docs.selectExpr("doc_id", f"(shiftrightunsigned(xxhash64({mixing.SEED}, doc_id), 11) + 0.5D) / {1 << 53}D AS u").collect()}
    # brute force: keys ascending, documents whose middle is within the target
    keys = sorted((-math.log(uniform[i]) / max({None: 1.0}.get(q, q), 1e-9), i) for i, _, _, q in rows)
    held, expected = 0, set()
    for _, i in keys:
        size = 1 + i % 5
        if held + size / 2 <= got[i].target:
            expected.add(i)
        held += size
    assert {i for i, r in got.items() if r.copies} == expected
    share = [sum(i % 4 == k for i in expected) / 500 for k in range(4)]
    assert share[0] > 0.85 and share[1] < 0.35 and share[1] < share[2] < share[0] and share[3] == 0
    assert mixing.mix(docs, budget=0.5, epochs=1, quality_col="grade").count() == len(expected)
