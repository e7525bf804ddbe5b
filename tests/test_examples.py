import duckdb
import pytest
from millrace.plans.catalogue import EXAMPLES, ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(EXAMPLES))
def test_examples_equal_their_sql(spark, name):
    made, sql = EXAMPLES[name]
    found = made(spark, "")
    names = sorted(found.columns)
    want = duckdb.connect().execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
    assert sorted(map(str, (tuple(r) for r in found.select(*names).collect()))) == sorted(map(str, want))


def test_every_query_reads_a_table():
    assert not set(EXAMPLES) & set(QUERIES) and set(ORACLE_SQL) <= set(QUERIES)
