import pyarrow as pa
from pyspark.sql import types as T

from millrace.llm.arrow import append, steps, texts


def test_texts_of_slices():
    rows = [None if i % 7 == 0 else f"ÄBC é {i} " * (i % 5) for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], names=["t"])
    got = [x for part in steps(iter([batch])) for x in texts(part.column(0))]
    assert got == [(x or "").encode().lower() for x in rows]
    got = [x for part in steps(iter([batch])) for x in texts(part.column(0), lower=False)]
    assert got == [(x or "").encode() for x in rows]


def test_append_keeps_all_rows(spark):
    df = spark.range(0, 5000, 1, 2).selectExpr("id", "concat('T', id) as t")
    got = append(df, [T.StructField("u", T.BinaryType())], lambda b: [texts(b.column(1))]).collect()
    assert sorted((r.id, bytes(r.u).decode()) for r in got) == [(i, f"t{i}") for i in range(5000)]
