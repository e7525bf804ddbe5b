from collections import Counter, defaultdict

import corpus_pipeline
from millrace.llm import mixing, packing, toxicity

from .test_jaccard import kept_by_brute_force

SF = "/root/testdata/sf0.001"


def lower(text):
    return (text or "").encode().lower()


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], SF).cache())
    assert all(s.columns == docs.columns for s in states[:-1])
    rows = [s.collect() for s in states]
    # toxicity: those that score under a half, of its own input
    scores = {r.doc_id: r.score for r in toxicity.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in rows[1]} == {i for i, x in scores.items() if x < 0.5}
    # exact copies: the largest id of each text
    largest = {}
    for r in rows[1]:
        largest[lower(r.text)] = max(largest.get(lower(r.text), -1), r.doc_id)
    assert {r.doc_id for r in rows[2]} == set(largest.values())
    # near copies: the smallest id of what similarities of 0.8 or more connect
    assert {r.doc_id for r in rows[3]} == kept_by_brute_force(sorted((r.doc_id, r.text) for r in rows[2]))
    # mixing: as often as the operator says
    copies = {r.doc_id: r.copies for r in mixing.judge(states[3]).collect()}
    assert Counter(r.doc_id for r in rows[4]) == Counter({i: n for i, n in copies.items() if n})
    # packing: all pieces of all documents, without gaps
    pieces = packing.pieces(states[4], "doc_id", "text", packing.vocabulary(), 1, 4096).collect()
    assert Counter((p.doc_id, p.piece, p.ids_crc32) for p in pieces) == Counter((p.doc_id, p.piece, p.ids_crc32) for p in rows[5])
    bins = defaultdict(list)
    for p in rows[5]:
        bins[p.sequence_id].append((p.offset, p.length))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= 1.02 * sum(p.length for p in pieces) / 4096 + 1
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == Counter(p.doc_id for p in rows[5])


def stages(spark, tmp_path, docs):
    """The pipeline over these documents, of which none is labelled."""
    folder = tmp_path / "in"
    folder.mkdir()
    docs.write.parquet(f"{folder}/documents.parquet")
    (folder / "labels.parquet").symlink_to(f"{SF}/labels.parquet")
    states = [spark.read.parquet(f"{folder}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        states.append(stage(spark, states[-1], str(folder)).cache())
    return states


def test_odd_rows_and_columns(spark, tmp_path):
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, "the cat sat on the mat today", "s1"), (2, "The cat sat on the mat today", "s1"), (2, "The cat sat on the mat today", "s1"), (3, None, None), (4, "", "s2"), (None, "no id but some words here", "s2"), (None, None, None), (5, long, "s2"), (6, long + " more", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("doc_id + 1000000 AS doc_id", "text", "source", "1 AS score", "'x' AS fp", "2 AS digest", "3 AS copies", "4 AS uid")
    states = stages(spark, tmp_path, docs)
    assert all(s.columns == docs.columns for s in states[:-1])
    found = [sorted(str(r.doc_id and r.doc_id - 1_000_000) for r in s.collect()) for s in states]
    # of the copies one of the rows of id 2 stays; null and empty texts are one group, of which the largest id stays
    assert found[2] == ["2", "4", "5", "6", "None"]
    # of the two long texts the smaller id stays; a text without words is like no other
    assert found[3] == ["2", "4", "5", "None"]
    assert set(found[4]) <= set(found[3]) and set(found[5]) == set(found[4])


def test_no_documents(spark, tmp_path):
    states = stages(spark, tmp_path, spark.createDataFrame([], "doc_id long, text string, source string"))
    assert [s.count() for s in states] == [0] * 6
