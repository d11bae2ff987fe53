"""Queries read whole tables."""

from collections import Counter

import duckdb
import pytest

from lodestrata.plans import catalog, catalog_more  # noqa: F401 - registers its queries in catalog
from lodestrata.sources.json_records import chunks

SF = "/root/testdata/sf0.01"


def test_set_find_element_builds_every_set(spark):
    rows = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey").collect()
    assert max(r.o_orderkey for r in rows) > 2000
    multiples = Counter(r.o_custkey for r in rows if r.o_orderkey % 4 == 0)
    want = {r.o_custkey for r in rows if multiples[r.o_custkey] <= 1}
    assert want and {r.o_custkey for r in catalog.QUERIES["set_find_element"](spark, SF).collect()} == want


def test_hash_index_cross_indexes_every_customer(spark):
    got = {r.c_custkey for r in catalog.QUERIES["hash_index_cross"](spark, SF).collect()}
    urgent = {r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").filter("o_orderpriority = '1-URGENT'").collect()}
    customers = spark.read.parquet(f"{SF}/customer.parquet").collect()
    nations = {r.c_nationkey for r in customers if r.c_mktsegment == "MACHINERY"}
    want = {r.c_custkey for r in customers if r.c_custkey in urgent and r.c_nationkey in nations}
    assert any(k % 5 for k in want) and got == want


def test_json_array_chunks_keeps_its_keys_without_a_join(spark, tmp_path):
    """Keys come along with the elements: a join back was broadcast at any size, mixed customers that share an order key, and lost null keys."""
    rows = [(3, 1), (2, 1), (2, 2), (None, 2), (10, 2), (7, None), (None, 4), (5, 2), (5, 2)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = [tuple(r) for r in c.sql(catalog.SQL["json_array_chunks"]).fetchall()]
    got = catalog.QUERIES["json_array_chunks"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len(want) == len(rows)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_keep_columns(spark):
    df = spark.createDataFrame([("a", 1, '[1, "x", null]'), ("b", 2, "[]"), ("c", None, "[[3]]")], "k string, v int, value string")
    got = chunks(df, keep=["k", "v"])
    assert got.columns == ["record", "k", "v", "position", "value"]
    assert sorted((r.k, r.v, r.position, r.value) for r in got.collect()) == [("a", 1, 0, "1"), ("a", 1, 1, '"x"'), ("a", 1, 2, "null"), ("c", None, 0, "[3]")]
    with pytest.raises(ValueError, match="value"):
        chunks(df, keep=["value"])


def test_chunks_lose_no_large_array_in_silence(spark):
    texts = spark.range(1).selectExpr("""concat('[1, "', repeat('a', 20000100), '"]') AS value""", """concat('["', array_join(array_repeat(repeat('a', 100000), 250), '","'), '"]') AS longer""")
    assert chunks(texts, "longer").selectExpr("count(value)", "sum(length(value))").first()[:] == (250, 250 * 100002)
    with pytest.raises(Exception, match="a text of 20000107 bytes"):
        chunks(texts).count()
