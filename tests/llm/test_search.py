import math
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import search


def brute(rows, every, k):
    split = [Counter((t or "").encode().lower().split()) for _, t in rows]
    n, mean = len(rows), sum(sum(c.values()) for c in split) / max(len(rows), 1)
    df = Counter(w for c in split for w in c)
    out = []
    for i, q in {(i, t) for i, t in rows if i is not None and i % every == 0}:
        found = []
        for (j, _), c in zip(rows, split, strict=True):
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (search.K1 + 1) / (c[w] + search.K1 * (1 - search.B + search.B * sum(c.values()) / mean)) for w in sorted(set((q or "").encode().lower().split())) if w in c)
            if s > 0:
                found.append((-round(s, 9), j is None, j or 0, j))
        out += [(i, rank + 1, j, -s) for rank, (s, _, _, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard_docs", "block_terms"), [(8000, 600_000), (40, 400), (9, 600_000)])
def test_top_k_is_exact(spark, shard_docs, block_terms):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    p = 1 / np.arange(1, 121)
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in range(400)]
    rows += [(None, rows[10][1]), (500, None), (600, ""), (700, "only here"), (7, rows[7][1]), (7, rows[7][1]), (900, "W1 " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rank", "2 as score").repartition(3)
    got = sorted(map(tuple, search.judge(docs, every=10, k=5, shard_docs=shard_docs, block_terms=block_terms).collect()))
    expected = brute(rows, 10, 5)
    assert [x[:3] for x in got] == [x[:3] for x in expected]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in expected])


def test_copies_tie_by_id(spark):
    rows = [(i, "the same text") for i in range(300)] + [(7, "the same text"), (None, "the same text"), (1000, "another the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, search.judge(docs, every=100, k=9, shard_docs=10).collect()))
    expected = brute(rows, 100, 9)
    assert [x[:3] for x in got] == [x[:3] for x in expected]


def topics(n):
    rng = np.random.default_rng(10)
    return [b" ".join(rng.choice([b"x%d" % i for i in range(50 * (j % 8), 50 * (j % 8) + 50)], 40)) + b" topic%d" % (j % 8) * 9 for j in range(n)]


def test_pruning_skips_blocks():
    found = topics(4000)
    made = search.Builder()
    for i, text in enumerate(found):
        made.add(i, text)
    shard = made.shard()
    shard = search.Shard.load(shard.keys, shard.dump())
    shard.prepare(40)
    for j in (5, 77):
        at = np.searchsorted(shard.keys, np.unique([np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64) for w in set(found[j].split())]))
        shard.scored = 0
        best = shard.search(at, np.ones(len(at)), [], 10)
        # a topic's 500 documents fill some 9 of 63 blocks; the others are never scored
        assert best[0][2] == j and len(best) == 10 and shard.scored <= 10 * search.BLOCK
        # a heap that nothing here can enter lets every block be skipped
        shard.scored = 0
        full = [(-1e6, False, x) for x in range(10)]
        assert shard.search(at, np.ones(len(at)), full, 10) == full and shard.scored == 0


def test_near_scores_leave_few_to_score_exactly(monkeypatch):
    found, shards = topics(3000), []
    for part in (found[:1500], found[1500:]):
        made = search.Builder()
        for i, text in enumerate(part):
            made.add(i if i % 50 else None, text)
        shard = made.shard()
        shards.append(search.Shard.load(shard.keys, shard.dump()))
    rng = np.random.default_rng(3)
    for common, cells in ((32, 12_000_000), (2, 12_000_000), (32, 3000), (32, 0)):
        monkeypatch.setattr(search, "COMMON", common)
        monkeypatch.setattr(search, "CELLS", cells)
        plain = near = [[] for _ in range(150)]
        for shard in shards:
            shard.prepare(40)
            asked = [np.unique(np.searchsorted(shard.keys, [np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64) for w in set(found[7 * j].split())])) for j in range(150)]
            asked = [at[at < len(shard.keys)] for at in asked]
            weights = [rng.uniform(0.1, 9, len(at)) for at in asked]
            plain = [shard.search(at, w, b, 10) for at, w, b in zip(asked, weights, plain, strict=True)]
            exact, enter = [], shard._enter
            shard._enter = lambda places, *rest, exact=exact, enter=enter: exact.append(len(places)) or enter(places, *rest)
            near = shard.search_all(list(zip(asked, weights, near, strict=True)), 10)
            assert near == plain and sum(exact) <= 30 * len(asked)
            assert not shard.weight.any()


def test_long_texts_bound_shards(spark):
    docs = spark.createDataFrame([(i, "word another " * 50) for i in range(20)], "doc_id long, text string").coalesce(1)
    assert search.build(docs, shard_words=1000).count() == 2
    assert search.build(docs.where("doc_id < 0")).count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert search.judge(docs).collect() == []
    nothing = spark.createDataFrame([(100, None), (200, " "), (None, "a b")], "doc_id long, text string")
    assert search.judge(nothing).collect() == []
