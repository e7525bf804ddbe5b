import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import toxicity


def corpus():
    rng = np.random.default_rng(6)
    parts = ["ta", "ri", "no", "be", "lu", "so", "ke", "mi"]
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.integers(5, 60))]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(1 + len(words) // 12):
                words.insert(rng.integers(0, len(words)), rng.choice(["grokfool", "Vexidiot", "grokscum"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    extra = [(None, "grokfool " * 4), (2000, None), (2001, ""), (2002, "  "), (2003, "tari nobe " * 40_000), (3, docs[3][1])]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string").selectExpr("*", "1 as score", "'x' as label")
    marks = spark.createDataFrame([*labels, (3, 0), (5000, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.judge(frame, marks).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = toxicity.reject(frame, marks)
    assert kept.columns == frame.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score < 0.5)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, x in labels]
    a, b = (sorted(map(tuple, toxicity.judge(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned))
    assert a == b


def test_no_labels_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.judge(frame, none).collect()}) == 1
    assert toxicity.judge(frame.limit(0), none).collect() == []


def brute(toxic, ordinary, word):
    """The model by dictionaries, n-gram by n-gram."""
    n, pad = toxicity.ORDER, "\x00" * (toxicity.ORDER - 1)

    def grams(counter):
        out = Counter()
        for w, c in counter.items():
            s = f"{pad}{w}\x01"
            for k in range(n - 1, len(s)):
                out[s[k - n + 1 : k + 1]] += c
        return out

    own = [grams(toxic), grams(ordinary)]
    levels = {n: own[0] + own[1]}
    for k in range(n - 1, 0, -1):
        level = Counter()
        for g in levels[k + 1]:
            level[g[1:]] += 1
        levels[k] = level
    discount = {k: toxicity._discount(np.array(list(v.values()))) for k, v in levels.items()}

    def shared(g):
        if not g:
            return 1 / len(levels[1])
        same = {x: c for x, c in levels[len(g)].items() if x[:-1] == g[:-1]}
        d = discount[len(g)]
        return (max(same.get(g, 0) - d, 0) + d * len(same) * shared(g[1:])) / sum(same.values())

    def ratio(g):
        p = []
        for c in own:
            same = [v for x, v in c.items() if x[:-1] == g[:-1]]
            total, rest = sum(same), sum(min(v, toxicity.DISCOUNT) for v in same)
            p.append((max(c.get(g, 0) - toxicity.DISCOUNT, 0) + rest * shared(g)) / total if total else shared(g))
        return np.log(p[0] / p[1])

    s = f"{pad}{word}\x01"
    return np.log(1 - toxicity.MIX + toxicity.MIX * np.exp(sum(ratio(s[k - n + 1 : k + 1]) for k in range(n - 1, len(s)))))


def test_model_matches_brute_force():
    toxic, ordinary = Counter({"abcdefg": 5, "abd": 2, "ba": 1, "abcdefx": 3}), Counter({"abcdef": 2, "ab": 7, "bad": 1, "abcdefg": 1})
    model = toxicity.Model(toxic, ordinary)
    for word in [*toxic, *ordinary]:
        assert model.words([word])[0] == pytest.approx(brute(toxic, ordinary, word), abs=1e-5)
    assert model.words(["zzz"])[0] < 1


def test_scores_of_texts_match_brute_force():
    toxic, ordinary = Counter({"abcdefg": 5, "abd": 2, "ba": 1}), Counter({"abcdef": 2, "ab": 7, "bad": 1})
    model = toxicity.Model(toxic, ordinary)
    model.slope, model.offset = 2.5, -0.5
    found = ["abd ab ab", "", "ba abcdefg abcdefg bad", "ABD ab"]
    expected = []
    for text in found:
        words = text.lower().split()
        mean = sum(brute(toxic, ordinary, w) for w in words) / max(1, len(words))
        expected.append(1 / (1 + np.exp(0.5 - 2.5 * mean)))
    assert toxicity.Scorer(model).scores(t.lower().encode() for t in found) == pytest.approx(expected, abs=1e-4)


def test_training_and_scoring_see_the_same_words(spark):
    # other white space than ASCII's parts no words; malformed UTF-8 is a letter like any other
    odd = "grok\x85fool\u00a0x"
    docs = spark.createDataFrame([(i, odd if i % 2 else f"calm w{i}") for i in range(1, 80)], "doc_id long, text string")
    docs = docs.unionByName(spark.sql("SELECT 900L doc_id, cast(X'67726f6bff20ff' AS string) text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 80)] + [(900, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.judge(docs, labels).collect()}
    assert got[5].predicted == 1 and got[6].predicted == 0 and len(got) == 80
    assert toxicity.words_of(odd.encode()) == [odd.encode()]


def test_reject_of_no_rows(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, score int")
    assert toxicity.reject(frame, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []
