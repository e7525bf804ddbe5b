import numpy as np

from millrace.llm import golay, jaccard

from .test_jaccard import kept_by_brute_force, plain_set


def near_copies():
    rng, rows = np.random.default_rng(11), []
    for _ in range(25):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(150, 400))]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "last"]))]
    return [*rows, (900, "a b"), (901, None)]


def test_set_prints_are_those_of_distinct_runs():
    for _, text in near_copies()[:4]:
        own = text.encode()
        assert golay.of_set(jaccard.shingles(own, 5)) == golay.fingerprint(own, 5)
    long = np.random.default_rng(3).integers(0, 2**63, 70_000).astype(np.uint64)
    bits = [sum((int(x) >> b) & 1 for x in long.tolist()) for b in (0, 5, 62)]
    assert [golay.of_set(long) >> b & 1 for b in (0, 5, 62)] == [int(2 * n > len(long)) for n in bits]


def test_fingerprints_alone_give_candidates(spark, monkeypatch):
    rows = near_copies()
    prints = {i: golay.of_set(jaccard.shingles(t.encode(), 5)) for i, t in rows if len(plain_set(t)) > 1}
    close = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    expected = {i for i, _ in rows} - {j for _, j in close}
    assert len(close) > 10 and kept_by_brute_force(rows) <= expected
    # without a minhash key
    monkeypatch.setattr(golay, "_minhash_keys", lambda marks: marks.selectExpr("fp AS key", "fp").where("false"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in golay.dedup(docs, width=5, similarity=0.8).collect()} == expected
