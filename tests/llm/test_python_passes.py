import pyarrow as pa

from millrace.llm import components as stars
from millrace.llm import golay, jaccard


def passes(node) -> int:
    """Python passes that one task of the plan's last stage chains."""
    if "Exchange" in node.nodeName():
        return 0
    below = [passes(node.children().apply(k)) for k in range(node.children().size())]
    return node.nodeName().startswith("MapInArrow") + sum(below)


def test_links_are_judged_and_contracted_in_one_python_pass(spark, monkeypatch):
    """Each chained pass holds a worker of its own for every core, and workers stay."""
    chained, write = [], stars.materialize

    def watched(df, name):
        chained.append(passes(df._jdf.queryExecution().executedPlan()))
        return write(df, name)

    prints = [0, 1, 3, 1 << 40, 0x7FFF << 20, 0x7FFE << 20, 0b11111]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(stars, "materialize", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.fp: r.component_id for r in golay.classes(docs, "doc_id").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(chained) == 1
    assert got == {0: 0, 1: 0, 3: 0, 1 << 40: 0, 0b11111: 0, 0x7FFF << 20: 4, 0x7FFE << 20: 4}


def test_components_of_made_edges(spark):
    def make(batches):
        for batch in batches:
            u = batch.column(0)
            yield pa.RecordBatch.from_arrays([u, pa.array([x // 10 * 10 for x in u.to_pylist()], pa.int64())], names=["u", "v"])

    got = {r.u: r.root for r in stars.components(spark.range(1, 30).toDF("n"), make=make).collect()}
    assert {k: v for k, v in got.items() if k != v} == {n: n // 10 * 10 for n in range(1, 30) if n % 10}


def test_sets_are_made_apart_from_nodes(spark, monkeypatch):
    chained, write = [], jaccard.materialize

    def watched(df, name):
        if name == "sets":
            chained.append(passes(df._jdf.queryExecution().executedPlan()))
        return write(df, name)

    words = [f"w{k}" for k in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "  ".join(words)), (4, "something else that is alike to none")]
    monkeypatch.setattr(jaccard, "materialize", watched)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = golay.dedup(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8)
        assert {r.doc_id for r in kept.collect()} == {1, 4}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert chained == [1]
