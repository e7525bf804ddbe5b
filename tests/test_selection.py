import random

import pytest
from millrace.operators import contained, selection, trigrams
from pyspark.sql import functions as F


@pytest.mark.parametrize(("most", "bits"), [(100_000, 12), (20, 12), (1, 5), (0, 20)])
def test_upper_median_against_brute_force(spark, most, bits):
    rng = random.Random(most)
    rows = [("hot", rng.randrange(-1000, 1000)) for _ in range(900)] + [("same", 7)] * 80 + [(f"g{k % 9}", rng.choice([-(2**63), 2**63 - 1, 0, -1, 5])) for k in range(60)]
    rows += [("none", None), (None, 3), (None, 9), ("one", -4), ("two", 1), ("two", 2)]
    frame = spark.createDataFrame(rows, "user string, v long").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted(v for k, v in rows if k == g and v is not None)
        if own:
            want[g] = own[len(own) // 2]
    found = selection.upper_median(frame, "user", "v", "m", bits=bits, most=most)
    assert {r.user: r.m for r in found.collect()} == want and found.count() == len(want)
    assert selection.upper_median(frame.limit(0), "user", "v").collect() == []


def test_searches_skip_blocks(spark, tmp_path):
    rows = [(k, f"Block {k // 50} " + ("Éclair rare" if k == 77 else "common words"), "x" if k % 2 else None) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, text string, source string").orderBy("id").coalesce(1)
    index = trigrams.build(frame, str(tmp_path / "i"), ("text", "source"), block=1200)
    assert index.blocks("common").count() == spark.read.parquet(f"{tmp_path}/i/blocks").count() > 4
    assert index.blocks(" éclair ").count() == 1 and [r.id for r in index.search(" éclair ").collect()] == [77]
    files = index.search("Éclair").inputFiles()
    assert len({f.rsplit("/", 2)[1] for f in files}) == 1
    for q in ("", "x", "BLOCK 3", "words", "nowhere at all", "k 1 c", "%", "_"):
        low = q.strip().lower()
        want = [r[0] for r in rows if low in r[1].lower() or low in (r[2] or "")]
        assert sorted(r.id for r in index.search(q).collect()) == want, q
    empty = trigrams.build(frame.limit(0), str(tmp_path / "e"), ("text",))
    assert empty.search("abc").collect() == [] and index.search("x").columns == ["id", "text", "source"]


@pytest.mark.parametrize("shard", [1 << 20, 30, 1])
def test_first_entry_against_brute_force(spark, shard):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    patterns = [(word(rng.randrange(2, 6)), rng.randrange(1000)) for _ in range(60)] + [(None, 1), ("zz", None)]
    texts = [(k, word(rng.randrange(0, 12)), "other") for k in range(150)] + [(900, None, "null"), (901, "", "empty")]
    frame = spark.createDataFrame(texts, "id long, text string, found string").repartition(3)
    catalog = spark.createDataFrame(patterns, "pattern string, ord long")
    want = {k: min((o for p, o in patterns if p is not None and o is not None and t is not None and p in t), default=None) for k, t, _ in texts}
    found = contained.first_contained(frame, "text", catalog, to="entry", shard=shard)
    assert {r.id: r.entry for r in found.collect()} == want and found.count() == len(texts)


def test_catalogs_of_nothing_and_of_the_empty_text(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    none = spark.createDataFrame([], "pattern string, ord long")
    assert [r.found for r in contained.first_contained(frame, "text", none).collect()] == [None, None]
    empty = spark.createDataFrame([("", 5), ("a", 9)], "pattern string, ord long")
    assert {r.id: r.found for r in contained.first_contained(frame, "text", empty).collect()} == {1: 5, 2: None}
    assert contained.first_contained(frame.limit(0), "text", empty).where(F.col("id") > 0).collect() == []
