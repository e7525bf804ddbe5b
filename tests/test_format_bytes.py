from collections import Counter

from millrace.plans import catalogue


def test_query_keeps_ties_and_nulls(spark, tmp_path):
    rows = [(1280, "1.3 KB"), (1792, "1.8 KB"), (2304, "2.3 KB"), (256, "256 B"), (None, None), (2000, "2.0 KB"), (1310720, "1.3 MB")]
    spark.createDataFrame([(n,) for n, _ in rows], "n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, catalogue.format_bytes(spark, str(tmp_path)).collect()))
    assert not Counter(rows) - got and sum(got.values()) == len(rows) + len(catalogue.SIZES)
