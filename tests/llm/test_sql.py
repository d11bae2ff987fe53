import duckdb
import pytest

from lodestrata.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = c.sql(ORACLE_SQL[name]), QUERIES[name](spark, sf)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for r in want.select(*got.columns).fetchall())
