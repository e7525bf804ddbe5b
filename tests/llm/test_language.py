import math
import zlib

import numpy as np

from millrace.llm import language


def phrases(symbols, reference):
    """Greedy longest matches by substring search."""
    s, r, at, n = "".join(symbols), "".join(reference), 0, 0
    while at < len(s):
        k = 1
        while at + k <= len(s) and s[at : at + k] in r:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_tables_parse_as_brute_force():
    rng = np.random.default_rng(7)
    for size in (1, 5, 200):
        reference = rng.integers(2, 6, size).tolist()
        steps, width = language.table(language.automaton(reference), 8), 8
        for _ in range(20):
            text = rng.integers(2, 7, rng.integers(1, 60)).tolist()
            at = ended = 0
            for c in [*text, width - 1, width - 1]:
                value = int(steps[at + c])
                ended += value & 3
                at = value >> 2
            assert ended + (at > 0) == phrases(map(str, text), map(str, reference))


def make(rng, kinds, n):
    return " ".join("".join(rng.choice(kinds, rng.integers(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(8)
    kinds = {"aa": ["ta", "ri", "no"], "bb": ["sch", "ung", "ei"], "cc": ["مر", "حب", "ا"]}
    docs = [(i, make(rng, kinds[lang], int(rng.integers(4, 80))), lang) for i in range(300) for lang in [["aa", "bb", "cc"][i % 3]]]
    extra = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "TA RI", None), (None, "ta ri no", "aa"), (1004, make(rng, kinds["bb"], 40_000), None), (5, docs[5][1], "cc")]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred", "'' as score")
    got = language.judge(frame).collect()
    assert len(got) == len(docs) + len(extra)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    truth = {i: lang for i, _, lang in docs}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]) > 0.97
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (1000, 1001, 1002))
    assert by[1003].lang_pred == "aa" and by[1004].lang_pred == "bb" and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_match_brute_force():
    rng = np.random.default_rng(11)
    samples = {"aa": [make(rng, ["ta", "ri", "nö"], 150)], "bb": [make(rng, ["sch", "ung", "ei"], 40)], "cc": [make(rng, ["مر", "حب", "ا"], 90)], "dd": ["漢字仮名 交文" * 30]}
    model = language.Model(samples)
    found = [make(rng, ["ta", "sch", "مر", "漢"], n) for n in (1, 3, 40, 400)] + [make(rng, ["ta", "ri", "nö"], 900), "漢字", "ŧŧŧ", "Ta, RI! nö"] + [make(rng, ["ung", "ei", "nö"], int(rng.integers(1, 300))) for _ in range(30)]
    totals, letters = model.phrases(found)
    names, scores = model.predict(found)
    for k, text in enumerate(found):
        symbols = [chr(x + 48) for x in model.symbol[np.frombuffer(" ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()).encode() + b" " * (not text[-1].isalpha()), np.uint8)]]
        costs = []
        for j, learnt in enumerate(model.learnt):
            assert totals[j, k] == (c := phrases(symbols, [chr(x + 48) for x in learnt]))
            costs.append(c * math.log2(len(learnt) + 2))
        order = sorted(range(4), key=lambda j: costs[j])
        assert names[k] == model.names[order[0]] and math.isclose(scores[k], costs[order[1]] / (costs[order[0]] + costs[order[1]]))
        assert letters[k] == sum(map(str.isalpha, text))


def test_scripts_are_told_apart_letter_by_letter():
    rng = np.random.default_rng(12)
    hans = ["".join(map(chr, rng.integers(0x4E00, 0x5200, 400))) for _ in range(2)]
    model = language.Model({"x": [hans[0]], "y": [hans[1]]})
    assert model.predict([hans[0][50:90], hans[1][200:230]])[0] == ["x", "y"]


def test_long_documents_are_learnt_beyond_their_beginnings(spark):
    rows = [(i, "kopf " * 4000 + ("innen " if lang == "aa" else "außen ") * 4000, lang) for i in range(60) for lang in [["aa", "bb"][i % 2]]]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict(["innen innen", "außen außen"])[0] == ["aa", "bb"]


def test_malformed_text(spark):
    docs = spark.createDataFrame([(i, "ta ri no") for i in range(9)], "doc_id long, text string").selectExpr("doc_id", "'aa' lang", "CASE WHEN doc_id = 8 THEN cast(X'746120ff' AS string) ELSE text END text")
    assert {r.lang_pred for r in language.judge(docs).collect()} == {"aa"}


def test_nothing_labelled_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.judge(frame).collect()] == ["und"]
    assert language.judge(frame.limit(0)).collect() == []


def test_chunks_cover_whole_texts():
    model = language.Model({"x": ["ab " * 400], "y": ["cd " * 400]})
    text = "ab " * 5000 + "cd " * 20_000
    assert model.predict([text, "ab", text[:9000]])[0] == ["y", "x", "x"]
