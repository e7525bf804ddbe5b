import duckdb
import numpy as np
import pytest
from millrace.plans.catalogue import ORACLE_SQL, QUERIES
from pyspark.sql import types as T


@pytest.mark.parametrize("name", ["box_geometry", "median3"])
def test_vectors_are_scaled_in_their_own_precision(spark, tmp_path, name):
    # hundredths and 127ths: single and double precision put many of them on different sides of a whole number
    rng = np.random.default_rng(3)
    values = np.where(np.arange(64) < 32, rng.integers(-40, 40, (400, 64)) / 100, rng.integers(80, 170, (400, 64)) / 127 - 1).astype(np.float32)
    kind = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], kind).write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = QUERIES[name](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(tuple(map(int, r)) for r in want)
