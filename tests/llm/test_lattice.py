import json
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import lattice
from millrace.llm.tokens import vocabulary


def cuts(word, inner, final):
    """All cuts of a word with their probability."""
    if word in final:
        yield [(word, True)], final[word]
    for k in range(1, len(word)):
        if (p := word[:k]) in inner:
            for rest, q in cuts(word[k:], inner, final):
                yield [(p, False), *rest], inner[p] * q


def test_forward_and_expected_uses_match_enumeration():
    inner = {b"a": 0.1, b"b": 0.05, b"ab": 0.2, b"ba": 0.1, b"aba": 0.02}
    final = {b"a": 0.1, b"b": 0.1, b"ab": 0.05, b"bab": 0.03}
    pieces = lattice.Pieces(*lattice._numbered(inner, final), np.log([*inner.values(), *final.values()]), math.log(0.4))
    words = [b"a", b"ab", b"abab", b"ba", b"babab", b"aababab", b"bab"]
    own = np.array([0.3, 0.0, 0.01, 0.2, 0.001, 0.0, 0.5])
    counts, discount = np.arange(1.0, len(words) + 1), 0.6
    expected, logs, keeps = np.zeros(pieces.none), [], []
    for word, p, c in zip(words, own, counts, strict=True):
        ways = list(cuts(word, inner, final))
        total = sum(q for _, q in ways)
        logs.append(math.log(0.4 * total + p))
        keeps.append(max(c * p / (0.4 * total + p) - discount, 0))
        for way, q in ways:
            for piece, last in way:
                expected[(pieces.final if last else pieces.inner)[piece]] += (c - keeps[-1]) * q / total
    assert pieces.log_probs([*words, b"xyz"], lattice._log(np.append(own, 0))).tolist() == pytest.approx([*logs, -math.inf])
    got = np.zeros(pieces.none)
    assert pieces.expect(words, counts, lattice._log(own), discount, got) == pytest.approx(keeps)
    assert got == pytest.approx(expected)


def test_vocabulary_reads_every_word():
    inner, final = lattice.ranked_pieces(vocabulary())
    assert len(inner) + len(final) >= 49_000 and b"the" in final
    pieces = lattice.first_pieces(vocabulary())
    assert (pieces.log_probs([w.encode() for w in ("the", "żółw", "中文", "a" * 3000, "\x00é")] + [b"\xff\xc0"], np.full(6, -np.inf)) > -math.inf).all()


def test_many_words_find_the_same_pieces_as_few(monkeypatch):
    rng = np.random.default_rng(4)
    pieces = lattice.first_pieces(vocabulary())
    words = list({"".join(rng.choice(["the", "ung", "é", "qu", "a", "中", "ing"], rng.integers(1, 7))).encode() for _ in range(4000)})
    none = np.full(len(words), -np.inf)
    many = pieces.log_probs(words, none)
    monkeypatch.setattr(lattice, "FEW", 10**9)
    assert many == pytest.approx(pieces.log_probs(words, none), abs=1e-9)


def test_judge(spark):
    rows = [(i, ["the cat sat", "The CAT ran off", "der hund lief", "le chien court vite"][i % 4] + f" w{i % 13}") for i in range(120)]
    rows += [(500, None), (501, ""), (None, "the hund"), (502, "the " * 50_000), (503, "unknownword x y"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n").repartition(3)
    got = lattice.judge(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    words = lambda t: (t or "").encode().lower().split()
    c = Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    expected = [(str(i), held(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), None]), 5)) for i, t in rows]
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(expected)
    assert all(-math.inf < r.score < 0 for r in got)


def test_score_matches_brute_force(spark, tmp_path):
    """All steps over again with dictionaries and enumerated cuts."""
    vocab = ["a", "b", "ab", "ba", "a</w>", "b</w>", "ab</w>", "aba</w>"]
    (path := tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {x: k for k, x in enumerate(vocab)}}}))
    rows = [(i, ["ab ab a", "aba b", "abba ba", "b", "", "babab ab"][i % 6]) for i in range(40)] + [(41, "c abc"), (46, None), (None, "a aab")]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    words = lambda t: (t or "").encode().split()
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in words(t))
    ends = held.count(False)
    n1, n2 = (sum(n == k for n in c.values()) for k in (1, 2))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    inner, final = lattice.ranked_pieces(str(path))
    weight = {(p, last): 1 / (100 + r) for last, part in ((False, inner), (True, final)) for p, r in part.items()}
    prob = {p: x / sum(weight.values()) for p, x in weight.items()}
    kept, trained = {w: max(n - discount, 0) for w, n in c.items()}, sum(c.values())
    total = trained + ends + 1
    left = lambda: (trained - sum(kept.values()) + 0.5) / total
    split = lambda: ({p: prob[p, False] for p in inner}, {p: prob[p, True] for p in final})
    for _ in range(lattice.ROUNDS):
        uses, opened = Counter(), left()
        for w, n in c.items():
            ways = list(cuts(w, *split()))
            rest, own = sum(q for _, q in ways), kept[w] / total
            kept[w] = max(n * own / (own + opened * rest) - discount, 0)
            for way, q in ways:
                for piece in way:
                    uses[piece] += (n - kept[w]) * q / rest
        prob = {p: (uses[p] + 0.01) / (sum(uses.values()) + 0.01 * len(prob)) for p in prob}
    end = (ends + 0.5) / total
    score = lambda t: math.log10(end) + sum(math.log10(left() * sum(q for _, q in cuts(w, *split())) + kept.get(w, 0) / total) for w in words(t))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.score) for r in lattice.judge(docs, path=str(path)).collect())
    expected = sorted((str(i), score(t)) for i, t in rows)
    assert [x for x, _ in got] == [x for x, _ in expected]
    assert [x for _, x in got] == pytest.approx([x for _, x in expected])


def test_hot_and_cold_words_agree(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the cat w{i % 7} v{i % 3}") for i in range(60)], "doc_id long, text string")
    a = sorted(map(tuple, lattice.judge(docs).collect()))
    monkeypatch.setattr(lattice, "HOT_WORDS", 1)  # no word is hot
    b = sorted(map(tuple, lattice.judge(docs).collect()))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5:] for x in a] == [pytest.approx(x[5:]) for x in b]


def test_probabilities_of_words_stay_below_one(spark):
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["a", "b", "ab", "c", "the"] * 20)], "doc_id long, text string")
    best = {r.text: r.score for r in lattice.judge(docs).join(docs, "doc_id").collect()}
    assert sum(10**x for x in best.values()) < 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.judge(docs).collect() == []
    only = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    assert len(lattice.judge(only).collect()) == 1


def test_words_read_alone_and_side_by_side_agree(monkeypatch):
    pieces = lattice.first_pieces(lattice.vocabulary())
    pieces.open, pieces.total = -1.0, 1000.0
    rng = np.random.default_rng(4)
    for size in (1, 2, 7, 63, 64, 65, 300):
        words = [bytes(rng.choice(np.frombuffer("the ing an été".encode().replace(b" ", b""), np.uint8), size)) for _ in range(6)]
        counts, whole = np.array([1.0, 2, 3, 4, 5, 6]), np.log(np.array([0.5, 1, 2, 3, 0.1, 6]) / 1000)
        found = []
        for few, window in ((0, 1 << 15), (99, 1 << 15), (99, 20)):
            monkeypatch.setattr(lattice, "FEW", few)
            monkeypatch.setattr(lattice, "WINDOW", window)
            sums = np.zeros(pieces.none + 1)
            kept = pieces.expect(words, counts, whole, 0.4, sums)
            found.append((pieces.log_probs(words, whole), kept, sums))
        for other in found[1:]:
            assert all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in zip(found[0], other, strict=True))


def test_a_word_of_a_megabyte():
    import time
    import tracemalloc

    pieces = lattice.first_pieces(lattice.vocabulary())
    word = ("中文没有空格" * 60_000).encode()[:1_000_000]
    began = time.process_time()
    assert pieces.log_probs([word], np.array([-np.inf]))[0] < -1e5
    assert time.process_time() - began < 20
    tracemalloc.start()
    sums = np.zeros(pieces.none + 1)
    pieces.expect([word[:100_000]], np.array([1.0]), np.array([-np.inf]), 0.5, sums)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sums.sum() > 3e4 and most < 60e6


def test_base_needs_no_fit(spark, monkeypatch):
    rows = [(i, "some words %d here again" % (i % 7)) for i in range(40)] + [(40, None), (None, "words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = lattice.judge(docs).drop("score").collect()
    monkeypatch.setattr(lattice, "fit", None)
    found = lattice.judge(docs, score=False)
    key = lambda r: (r[0] is None, r[0])
    assert "score" not in found.columns and sorted(found.collect(), key=key) == sorted(whole, key=key)
