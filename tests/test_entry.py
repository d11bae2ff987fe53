import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(catalog.SQL[name])
    got = catalog.QUERIES[name](spark, sf)
    names = sorted(got.columns)
    assert sorted(want.columns) == names
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == sorted(tuple(plain(r[want.columns.index(n)]) for n in names) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
