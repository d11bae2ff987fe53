"""The operators as queries on the star-schema tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import display_key, find_in_map, find_in_set, to_text, version_time
from ..operators import algebra, diff, history, query, state, validate
from ..operators.dataset import Dataset, Reference, normalize
from ..operators.index import HashIndex, IntSet, PrefixIndex, UniqueKeyIndex
from ..sources.json_records import find_key, ingest, passthrough
from .paths import values
from .schema import from_spark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer { nation, orders: [ { lines: [...] } ] }: two aggregations, each before it is joined."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice", F.coalesce("lines", F.array()).alias("lines"))).alias("orders"))
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.struct("n_nationkey", "n_name", F.struct("r_regionkey", "r_name").alias("region")).alias("nation"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "nation", F.coalesce("orders", F.array()).alias("orders"))


def star(spark: SparkSession, sf_dir: str) -> Dataset:
    names = ("region", "nation", "customer", "orders")
    return Dataset({t: table(spark, sf_dir, t) for t in names}, {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "orders": ("o_orderkey",)}, (Reference("nation", "region", "n_regionkey", "r_regionkey"), Reference("customer", "nation", "c_nationkey", "n_nationkey"), Reference("orders", "customer", "o_custkey", "c_custkey")))


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.col("o_orderkey") % 7 == 0
    return table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 1").withColumn("o_totalprice", F.when(changed, F.col("o_totalprice") + 100).otherwise(F.col("o_totalprice"))).withColumn("o_orderstatus", F.when(changed, "X").otherwise(F.col("o_orderstatus")))


def third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return after(spark, sf_dir).filter("o_orderkey % 10 <> 2").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, "NONE").otherwise(F.col("o_orderpriority")))


_FROM = "f AS (SELECT * FROM orders WHERE o_orderkey % 10 <> 0)"
_TO = "t AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 100 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 1)"
_THIRD = "u AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 9 = 0 THEN 'NONE' ELSE o_orderpriority END AS o_orderpriority FROM t WHERE o_orderkey % 10 <> 2)"
_NAMES = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_KEY = ["o_orderkey"]


# Keyed access.


@register("SELECT * FROM orders WHERE o_orderkey = 42")
def pk_lookup(spark, d):
    return UniqueKeyIndex(table(spark, d, "orders"), _KEY).match(42)


@register("SELECT p.probe, o.* FROM (SELECT s_suppkey * 7 AS probe FROM supplier) p LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = p.probe")
def pk_lookup_batch(spark, d):
    probe = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("probe"))
    return UniqueKeyIndex(table(spark, d, "orders"), _KEY, only=F.col("o_orderstatus") == "F").match_all(probe, ["probe"])


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return UniqueKeyIndex(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).duplicates()


@register("SELECT DISTINCT c_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_returnflag = 'R'")
def hash_index_nested(spark, d):
    index = HashIndex(customers(spark, d), "", ["c_mktsegment", "orders.element.o_orderstatus", "orders.element.lines.element.l_returnflag"], distinct=True)  # keyed by c_custkey
    return index.find("BUILDING", "F", "R").select("c_custkey", "c_name")


@register("SELECT DISTINCT o_orderkey, o_orderstatus, o_totalprice FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE n_name = (SELECT min(n_name) FROM nation) AND l_returnflag = 'A'")
def hash_index_select_nested(spark, d):
    first = table(spark, d, "nation").agg(F.min("n_name").alias("first"))
    index = HashIndex(customers(spark, d), "orders.element", ["nation.n_name", "orders.element.lines.element.l_returnflag"])
    return index.find_all(first.withColumn("flag", F.lit("A")), ["first", "flag"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("SELECT DISTINCT c.c_custkey FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN customer p ON p.c_nationkey = c.c_nationkey WHERE o.o_orderpriority = '1-URGENT' AND p.c_mktsegment = 'MACHINERY'")
def hash_index_cross(spark, d):
    return _orders_and_peers(spark, d, table(spark, d, "customer"))


def _orders_and_peers(spark, d, c):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderpriority")).alias("orders"))
    p = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nk")).agg(F.collect_set(F.struct("c_mktsegment")).alias("peers"))
    nested = c.join(o, F.col("c_custkey") == F.col("o_custkey")).join(p, F.col("c_nationkey") == F.col("nk"))
    return HashIndex(nested, "", ["orders.element.o_orderpriority", "peers.element.c_mktsegment"]).find("1-URGENT", "MACHINERY").select("c_custkey")


@register("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'red')")
def prefix_search(spark, d):
    return PrefixIndex(table(spark, d, "part"), "p_name").with_prefix("Red").select("p_partkey", "p_name")


@register("SELECT DISTINCT p_partkey FROM (SELECT p_partkey, unnest(string_split(lower(p_type), ' ')) AS k FROM part) WHERE starts_with(k, 's')")
def prefix_tokens(spark, d):
    return PrefixIndex(table(spark, d, "part"), "p_type", keys=lambda c: F.split(c, " ")).with_prefix("S").select("p_partkey")


@register("WITH m AS (SELECT c_custkey, c_name FROM customer WHERE starts_with('customer#000000012345', lower(c_name))) SELECT c_custkey, c_name FROM m WHERE length(c_name) = (SELECT max(length(c_name)) FROM m)")
def longest_prefix(spark, d):
    return PrefixIndex(table(spark, d, "customer"), "c_name").longest_match("Customer#000000012345").select("c_custkey", "c_name")


@register("SELECT DISTINCT p_size AS value FROM part WHERE p_partkey % 3 = 0")
def int_set_distinct(spark, d):
    return IntSet(table(spark, d, "part"), "p_size", where=F.col("p_partkey") % 3 == 0).values


@register("SELECT count(DISTINCT p_size) AS cardinality FROM part WHERE p_partkey % 3 = 0")
def int_set_cardinality(spark, d):
    return IntSet(table(spark, d, "part"), "p_size", where=F.col("p_partkey") % 3 == 0).cardinality()


@register("SELECT o_custkey, max(CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END) AS price FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END) <= 1")
def set_find_element(spark, d):
    return _sets_of_orders(table(spark, d, "orders"))


def _sets_of_orders(orders):
    o = orders.groupBy("o_custkey").agg(F.collect_set(F.struct((F.col("o_orderkey") % 4).alias("m"), "o_totalprice")).alias("s"))
    return o.filter(F.size(F.filter("s", lambda x: x["m"] == 0)) <= 1).select("o_custkey", find_in_set(F.col("s"), m=0)["o_totalprice"].alias("price"))


@register("SELECT c_nationkey, max(c_acctbal) AS best FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey")
def map_find_value(spark, d):
    m = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_acctbal").alias("b")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "b"))).alias("m"))
    return m.select("c_nationkey", find_in_map(F.col("m"), key="BUILDING").alias("best")).filter("best IS NOT NULL")


# Scans and filters.


@register("SELECT 'nation' AS type, n_nationkey::BIGINT AS key FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey = 3")
def field_match_any(spark, d):
    s = star(spark, d)
    s = Dataset({"nation": s.types["nation"].withColumnRenamed("n_nationkey", "nationkey"), "customer": s.types["customer"].withColumnRenamed("c_nationkey", "nationkey"), "region": s.types["region"]})
    found = query.field_match_all(s, "nationkey", "3")
    return found["nation"].select(F.lit("nation").alias("type"), F.col("nationkey").cast("long").alias("key")).unionByName(found["customer"].select(F.lit("customer").alias("type"), F.col("c_custkey").alias("key")))


@register("SELECT * FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
def field_match_type(spark, d):
    return query.field_match(table(spark, d, "customer"), "c_mktsegment", "HOUSEHOLD")


@register("SELECT 'customer' AS type, (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)) AS matches UNION ALL SELECT 'orders', (SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)))")
def query_and(spark, d):
    return query.match_counts(query.query_and(star(spark, d), [("customer", "c_mktsegment", "BUILDING"), ("region", "r_regionkey", "1")]))


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def browse_page(spark, d):
    return query.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 2, 25)


@register("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def filter_columns(spark, d):
    s = star(spark, d)
    schemas = {t: x for n, df in s.types.items() for t, x in from_spark(n, df.schema, s.keys[n]).items()}
    renamed = Dataset({t[:1].upper() + t[1:]: df for t, df in s.types.items()})
    return query.TypeFilter().exclude("Orders", "o_totalprice").exclude("Orders", "o_orderpriority").apply(renamed, schemas).types["Orders"]


@register("SELECT r_regionkey, r_name FROM region")
def filter_recursive(spark, d):
    s = star(spark, d)
    renamed = Dataset({t[:1].upper() + t[1:]: df for t, df in s.types.items()})
    schemas = {t: x for n, df in s.types.items() for t, x in from_spark(n, df.schema).items()}
    return query.TypeFilter().exclude_all().include_recursive("Region").apply(renamed, schemas).types["Region"]


@register("SELECT l_returnflag AS value, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def path_values(spark, d):
    return values(customers(spark, d), "orders.element.lines.element.l_returnflag").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# Reference graph.


@register("WITH o AS (SELECT * FROM orders WHERE o_totalprice > 400000), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)) SELECT 'orders' AS type, count(*) AS records FROM o UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'region', count(*) FROM r")
def closure_children(spark, d):
    s = star(spark, d)
    return Dataset(s.children({"orders": s.types["orders"].filter("o_totalprice > 400000")})).counts()


@register("WITH o AS (SELECT * FROM orders WHERE o_totalprice > 60000), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice <= 60000)) SELECT c_custkey, c_name FROM c")
def closure_orphans(spark, d):
    s = star(spark, d)
    return s.unreferenced(s.children({"orders": s.types["orders"].filter("o_totalprice > 60000")}))["customer"].select("c_custkey", "c_name")


@register("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def closure_referrers(spark, d):
    s = star(spark, d)
    return s.referrers({"region": s.types["region"].filter("r_regionkey = 2")})["orders"].select("o_orderkey")


@register("SELECT 'Customer' AS type, count(*) AS records FROM (SELECT DISTINCT c_custkey FROM customer) UNION ALL SELECT 'Nation', count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'Region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def normalized_types(spark, d):
    flat = customers(spark, d).drop("orders")
    types, _ = normalize(flat, from_spark("Customer", flat.schema, ["c_custkey"]), "Customer")
    return Dataset(types).counts()


# Aggregates of a state.


@register("SELECT 'region' AS type, count(*) AS records FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def type_counts(spark, d):
    return star(spark, d).counts()


@register("SELECT 'orders' AS type, (SELECT count(*) FROM orders) AS records, true AS same")
def checksum_equal(spark, d):
    a = Dataset({"orders": table(spark, d, "orders")}).checksum()
    b = Dataset({"orders": table(spark, d, "orders").repartition(7)}).checksum().withColumnRenamed("checksum", "other")
    return a.join(b, ["type", "records"]).select("type", "records", (F.col("checksum") == F.col("other")).alias("same"))


# Change.


@register(f"WITH {_FROM}, {_TO} SELECT * FROM t EXCEPT SELECT * FROM f")
def delta_added(spark, d):
    return state.delta(before(spark, d), after(spark, d)).added


@register(f"WITH {_FROM}, {_TO} SELECT * FROM f EXCEPT SELECT * FROM t")
def delta_removed(spark, d):
    return state.delta(before(spark, d), after(spark, d)).removed


@register(f"WITH {_FROM}, {_TO} SELECT * FROM t")
def apply_delta(spark, d):
    return state.apply(before(spark, d), state.delta(before(spark, d), after(spark, d)))


@register(f"WITH {_FROM} SELECT * FROM f")
def apply_reverse_delta(spark, d):
    return state.apply(after(spark, d), state.delta(before(spark, d), after(spark, d)).reverse())


@register(f"WITH {_FROM}, {_TO} SELECT coalesce(f.o_orderkey, t.o_orderkey) AS o_orderkey, CASE WHEN f.o_orderkey IS NULL THEN 'added' WHEN t.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change, f.o_totalprice AS price_before, t.o_totalprice AS price_after FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey WHERE f.o_orderkey IS NULL OR t.o_orderkey IS NULL OR f.o_orderstatus <> t.o_orderstatus OR f.o_totalprice <> t.o_totalprice")
def change_classification(spark, d):
    return state.changes(before(spark, d), after(spark, d), _KEY).select("o_orderkey", "change", F.col("before.o_totalprice").alias("price_before"), F.col("after.o_totalprice").alias("price_after"))


@register("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def dedup_records(spark, d):
    return state.dedup(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@register(f"WITH e AS (SELECT {_NAMES}, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' ELSE 'upsert' END AS action FROM (SELECT * REPLACE ('Z' AS o_orderstatus) FROM orders WHERE o_orderkey % 4 = 0) UNION ALL SELECT * REPLACE ('Y' AS o_orderstatus), 10000000 + o_orderkey, 'upsert' FROM orders WHERE o_orderkey % 20 = 0 AND o_orderkey % 3 = 0 UNION ALL SELECT * REPLACE ('I' AS o_orderstatus), 20000000 + o_orderkey, 'insert' FROM orders WHERE o_orderkey % 10 IN (0, 1) AND o_orderkey % 4 <> 0), {_FROM}, l AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS r FROM e) SELECT {_NAMES} FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l WHERE action <> 'insert') UNION ALL SELECT {_NAMES} FROM l WHERE r = 1 AND action = 'upsert' UNION ALL SELECT {_NAMES} FROM l WHERE r = 1 AND action = 'insert' AND o_orderkey NOT IN (SELECT o_orderkey FROM f)")
def incremental_upsert(spark, d):
    o = table(spark, d, "orders")
    status = lambda df, s, seq, action: df.withColumn("o_orderstatus", F.lit(s)).withColumn("seq", seq).withColumn("action", action)
    key = F.col("o_orderkey")
    e = status(o.filter("o_orderkey % 4 = 0"), "Z", key, F.when(key % 5 == 0, "delete").otherwise("upsert"))
    e = e.unionByName(status(o.filter("o_orderkey % 20 = 0 AND o_orderkey % 3 = 0"), "Y", key + 10000000, F.lit("upsert")))
    e = e.unionByName(status(o.filter("o_orderkey % 10 IN (0, 1) AND o_orderkey % 4 <> 0"), "I", key + 20000000, F.lit("insert")))
    return state.mutate(before(spark, d), e, _KEY)


# Difference.


@register(f"WITH {_FROM}, {_TO} SELECT CASE WHEN f.o_orderkey IS NULL THEN 'to_only' WHEN t.o_orderkey IS NULL THEN 'from_only' ELSE 'matched' END AS side, count(*) AS n FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey GROUP BY ALL")
def diff_match(spark, d):
    return diff.match(before(spark, d), after(spark, d), _KEY).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_FROM}, {_TO}, p AS (SELECT f.o_orderstatus AS a, t.o_orderstatus AS b FROM f JOIN t ON f.o_orderkey = t.o_orderkey WHERE t.o_orderkey % 7 = 0) SELECT 'o_totalprice' AS path, 2 * count(*) AS score, count(*) AS records FROM p UNION ALL SELECT 'o_orderstatus', 2 * count(*), count(*) FROM p WHERE a <> b")
def diff_field_scores(spark, d):
    return diff.field_totals(diff.field_scores(before(spark, d), after(spark, d), _KEY))


def _nested(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_totalprice")).alias("orders"))


@register(f"WITH {_FROM}, {_TO}, k AS (SELECT o_custkey FROM f INTERSECT SELECT o_custkey FROM t), v AS (SELECT o_custkey, 'orders.element.o_orderkey' AS path, o_orderkey::VARCHAR AS value, 1 AS s FROM f UNION ALL SELECT o_custkey, 'orders.element.o_orderkey', o_orderkey::VARCHAR, -1 FROM t UNION ALL SELECT o_custkey, 'orders.element.o_orderstatus', o_orderstatus, 1 FROM f UNION ALL SELECT o_custkey, 'orders.element.o_orderstatus', o_orderstatus, -1 FROM t UNION ALL SELECT o_custkey, 'orders.element.o_totalprice', o_totalprice::VARCHAR, 1 FROM f UNION ALL SELECT o_custkey, 'orders.element.o_totalprice', o_totalprice::VARCHAR, -1 FROM t), c AS (SELECT o_custkey, path, value, abs(sum(s)) AS n FROM v WHERE o_custkey IN (SELECT o_custkey FROM k) GROUP BY ALL) SELECT path, sum(n)::BIGINT AS score, count(DISTINCT o_custkey) AS records FROM c WHERE n > 0 GROUP BY path")
def diff_nested_scores(spark, d):
    return diff.field_totals(diff.field_scores(_nested(before(spark, d)), _nested(after(spark, d)), ["o_custkey"]))


@register(f"WITH {_FROM}, {_TO} SELECT 'orders' AS type, count(CASE WHEN f.o_orderkey = t.o_orderkey THEN 1 END) AS matched, count(CASE WHEN t.o_orderkey IS NULL THEN 1 END) AS from_only, count(CASE WHEN f.o_orderkey IS NULL THEN 1 END) AS to_only, (2 * count(CASE WHEN f.o_orderkey = t.o_orderkey AND t.o_orderkey % 7 = 0 THEN 1 END) + 2 * count(CASE WHEN f.o_orderstatus <> t.o_orderstatus THEN 1 END))::BIGINT AS score FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey")
def diff_type_totals(spark, d):
    return diff.summary({"orders": (before(spark, d), after(spark, d), _KEY)})


@register(f"WITH {_FROM}, {_TO}, k AS (SELECT o_custkey FROM f INTERSECT SELECT o_custkey FROM t), a AS (SELECT * FROM f WHERE o_custkey IN (SELECT * FROM k)), b AS (SELECT * FROM t WHERE o_custkey IN (SELECT * FROM k)) SELECT CASE WHEN b.o_orderkey IS NULL THEN 'from_only' WHEN a.o_orderkey IS NULL THEN 'to_only' WHEN a.o_orderstatus = b.o_orderstatus AND a.o_totalprice = b.o_totalprice THEN 'equal' ELSE 'modified' END AS outcome, count(*) AS n FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.o_orderkey = b.o_orderkey GROUP BY ALL")
def diff_elements(spark, d):
    return diff.element_diff(_nested(before(spark, d)), _nested(after(spark, d)), ["o_custkey"], ["orders.element.o_orderkey"], ["orders.element.o_orderstatus", "orders.element.o_totalprice"])


@register(f"WITH {_FROM}, {_TO}, p AS (SELECT f.o_orderstatus AS a, t.o_orderstatus AS b, t.o_orderkey % 7 = 0 AS changed, t.o_orderpriority AS priority FROM f JOIN t ON f.o_orderkey = t.o_orderkey) SELECT 'o_orderpriority' AS path, count(*)::BIGINT AS score, count(*) AS records FROM p WHERE priority IS NOT NULL UNION ALL SELECT 'o_totalprice', 2 * count(*), count(*) FROM p WHERE changed UNION ALL SELECT 'o_orderstatus', 2 * count(*), count(*) FROM p WHERE a <> b")
def diff_missing_field(spark, d):
    scores = diff.field_scores(before(spark, d).drop("o_orderpriority"), after(spark, d), _KEY)
    return diff.field_totals(scores)


@register(f"WITH {_FROM}, {_TO}, k AS (SELECT o_custkey FROM f INTERSECT SELECT o_custkey FROM t), a AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM f WHERE o_custkey IN (FROM k)), b AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM t WHERE o_custkey IN (FROM k)), x AS ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a)) SELECT 'orders.element' AS path, count(*) AS score, count(DISTINCT o_custkey) AS records FROM x")
def diff_shortcut(spark, d):
    return diff.field_totals(diff.field_scores(_nested(before(spark, d)), _nested(after(spark, d)), ["o_custkey"], shortcuts=["orders.element"]))


@register(f"WITH {_FROM}, {_TO} SELECT f.o_orderkey AS f_o_orderkey, t.o_orderkey + 1000000000 AS t_o_orderkey FROM f JOIN t ON f.o_custkey = t.o_custkey AND f.o_orderdate = t.o_orderdate AND f.o_orderstatus = t.o_orderstatus AND f.o_totalprice = t.o_totalprice AND f.o_orderpriority = t.o_orderpriority")
def equal_under_other_keys(spark, d):
    return diff.equal_pairs(before(spark, d), after(spark, d).withColumn("o_orderkey", F.col("o_orderkey") + 1000000000), _KEY)


# History.


def _log(spark, d):
    return history.log([(1, before(spark, d)), (2, after(spark, d)), (3, third(spark, d))], _KEY)


@register(f"WITH {_FROM}, {_TO}, {_THIRD}, x AS (SELECT 2::BIGINT AS version, CASE WHEN f.o_orderkey IS NULL THEN 'added' WHEN t.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey WHERE f.o_orderkey IS NULL OR t.o_orderkey IS NULL OR f.o_totalprice <> t.o_totalprice UNION ALL SELECT 3, CASE WHEN u.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END FROM t LEFT JOIN u ON t.o_orderkey = u.o_orderkey WHERE u.o_orderkey IS NULL OR t.o_orderpriority <> u.o_orderpriority) SELECT version, change, count(*) AS n FROM x GROUP BY ALL")
def history_counts(spark, d):
    return history.counts(_log(spark, d))


@register(f"WITH {_FROM}, {_TO}, {_THIRD} SELECT 3::BIGINT AS version, CASE WHEN f.o_orderkey IS NULL THEN 'added' WHEN u.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change, count(*) AS n FROM f FULL JOIN u ON f.o_orderkey = u.o_orderkey WHERE f.o_orderkey IS NULL OR u.o_orderkey IS NULL OR f.o_totalprice <> u.o_totalprice OR f.o_orderstatus <> u.o_orderstatus OR f.o_orderpriority <> u.o_orderpriority GROUP BY ALL")
def history_double_snapshot(spark, d):
    return history.counts(history.log([(1, before(spark, d)), (3, third(spark, d))], _KEY))


@register(f"WITH {_TO} SELECT * FROM t")
def history_asof(spark, d):
    return history.as_of(third(spark, d), _log(spark, d), 2, _KEY)


@register(f"WITH {_FROM} SELECT * FROM f")
def history_asof_first(spark, d):
    return history.as_of(third(spark, d), _log(spark, d), 1, _KEY)


@register("SELECT 2::BIGINT AS version, 'updated' AS change, o_orderkey FROM orders WHERE o_orderkey = 63 UNION ALL SELECT 3, 'updated', o_orderkey FROM orders WHERE o_orderkey = 63")
def history_key_timeline(spark, d):
    return history.timeline(_log(spark, d), _KEY, 63).select("version", "change", "o_orderkey")


@register(f"WITH {_FROM}, {_TO}, {_THIRD}, x AS (SELECT 2::BIGINT AS version, coalesce(f.o_orderkey, t.o_orderkey) % 10 AS last FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey WHERE f.o_orderkey IS NULL OR t.o_orderkey IS NULL OR f.o_totalprice <> t.o_totalprice UNION ALL SELECT 3, t.o_orderkey % 10 FROM t LEFT JOIN u ON t.o_orderkey = u.o_orderkey WHERE u.o_orderkey IS NULL OR t.o_orderpriority <> u.o_orderpriority) SELECT version, last, count(*) AS n FROM x GROUP BY version, last UNION ALL SELECT version, NULL, count(*) FROM x GROUP BY version")
def history_group(spark, d):
    return history.grouped(_log(spark, d).withColumn("last", F.col("o_orderkey") % 10), ["last"]).drop("level")


@register("SELECT DISTINCT o_orderkey, o_orderkey::VARCHAR AS display FROM orders WHERE o_orderkey = 77")
def history_key_search(spark, d):
    return history.search(history.key_index(_log(spark, d), third(spark, d), _KEY), _KEY, "77")


# Algebra.


@register(f"WITH {_FROM}, {_TO} SELECT * FROM f UNION SELECT * FROM t")
def combine_union(spark, d):
    return algebra.combine([Dataset({"orders": before(spark, d)}), Dataset({"orders": after(spark, d)})]).types["orders"]


@register(f"WITH {_FROM}, {_TO} SELECT * FROM f UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)")
def combine_pk(spark, d):
    return algebra.combine([Dataset({"orders": before(spark, d)}), Dataset({"orders": after(spark, d)})], {"orders": _KEY}).types["orders"]


@register("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def combine_include_keys(spark, d):
    return algebra.include_keys(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


@register("SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def combine_exclude_keys(spark, d):
    return algebra.exclude_keys(table(spark, d, "orders"), table(spark, d, "customer").filter("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"])


_SHARDS = "o AS (SELECT *, o_orderkey % 4 AS shard FROM orders), c AS (SELECT DISTINCT shard, customer.* FROM customer JOIN o ON o_custkey = c_custkey), n AS (SELECT DISTINCT shard, nation.* FROM nation JOIN c ON c_nationkey = n_nationkey), r AS (SELECT DISTINCT shard, region.* FROM region JOIN n ON n_regionkey = r_regionkey)"


def _by_shard(whole: Dataset) -> DataFrame:
    parts = [df.groupBy(F.lit(t).alias("type"), F.col("shard").cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("records")) for t, df in whole.types.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(f"WITH {_SHARDS} SELECT 'orders' AS type, shard::INT AS shard, count(*) AS records FROM o GROUP BY ALL UNION ALL SELECT 'customer', shard::INT, count(*) FROM c GROUP BY ALL UNION ALL SELECT 'nation', shard::INT, count(*) FROM n GROUP BY ALL UNION ALL SELECT 'region', shard::INT, count(*) FROM r GROUP BY ALL")
def split_by_key(spark, d):
    return _by_shard(algebra.split_all(star(spark, d), 4, {"orders": F.pmod("o_orderkey", F.lit(4))}))


@register("SELECT * FROM orders WHERE o_orderkey = 1033")
def lookup_by_display_key(spark, d):
    o = table(spark, d, "orders")
    return UniqueKeyIndex(o, _KEY).match(*query.parse_key("1033", [o.schema["o_orderkey"].dataType]))


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice + 1 FROM orders WHERE o_orderstatus = 'P'")
def patch_records(spark, d):
    s = star(spark, d)
    source = Dataset({**s.types, "orders": s.types["orders"].withColumn("o_totalprice", F.col("o_totalprice") + 1)}, s.keys, s.references)
    return algebra.patch(s, source, "orders", {"o_orderstatus": "P"}).types["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("SELECT 'customer' AS type, count(*) AS records FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice < 50000) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_totalprice < 50000")
def copy_accepted(spark, d):
    return algebra.copy(star(spark, d), {"orders": F.col("o_totalprice") < 50000}).counts().filter("type IN ('customer', 'orders')")


@register("SELECT 'customer' AS type, count(*) AS records FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) < 50000) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_totalprice >= 50000")
def exclude_with_referenced(spark, d):
    s = star(spark, d)
    return algebra.exclude_with_referenced(s, "orders", s.types["orders"].filter("o_totalprice < 50000")).counts().filter("type IN ('customer', 'orders')")


@register("SELECT 'customer' AS type, count(*) AS records FROM customer UNION ALL SELECT 'region', count(*) FROM region")
def combine_ignored_types(spark, d):
    s = star(spark, d)
    return algebra.combine([s, Dataset({"customer": s.types["customer"].filter("c_custkey % 2 = 0")})], ignore=["nation", "orders"]).counts()


@register("WITH s AS (SELECT unnest(range(4))::INT AS shard) SELECT 'orders' AS type, shard, (SELECT count(*) FROM orders) AS records FROM s UNION ALL SELECT 'customer', shard, (SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) FROM s")
def split_replicated(spark, d):
    return _by_shard(algebra.split_all(star(spark, d), 4, {"orders": F.pmod("o_orderkey", F.lit(4))}, everywhere=["orders"])).filter("type IN ('orders', 'customer')")


@register(f"WITH {_FROM} SELECT * FROM f WHERE o_orderkey % 3 <> 0 UNION ALL SELECT * REPLACE ('N' AS o_orderstatus) FROM orders WHERE o_orderkey % 6 = 0")
def carry_over(spark, d):
    o = table(spark, d, "orders")
    return state.carry_over(before(spark, d), o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 6 = 0").withColumn("o_orderstatus", F.lit("N")), _KEY)


# Checks.


@register(f"WITH {_FROM}, {_TO}, c AS (SELECT (SELECT count(*) FROM f) AS before, (SELECT count(*) FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)) AS added, (SELECT count(*) FROM f WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)) AS removed, (SELECT count(*) FROM f JOIN t USING (o_orderkey) WHERE f.o_totalprice <> t.o_totalprice) AS updated) SELECT *, 100.0::DOUBLE * added / before AS added_percent, 100.0::DOUBLE * removed / before AS removed_percent, 100.0::DOUBLE * updated / before AS updated_percent FROM c")
def validate_percent_change(spark, d):
    return validate.change_percentages(before(spark, d), after(spark, d), _KEY)


@register("SELECT NULLIF(o_custkey, 7) AS o_custkey, o_orderkey FROM orders WHERE o_custkey = 7")
def validate_null_keys(spark, d):
    return validate.null_key_rows(table(spark, d, "orders").select(F.nullif("o_custkey", F.lit(7)).alias("o_custkey"), "o_orderkey"), ["o_custkey", "o_orderkey"])


@register("SELECT o_orderkey, 2 AS n FROM orders WHERE o_orderkey % 50 = 1")
def validate_new_duplicates(spark, d):
    o = table(spark, d, "orders")
    added = o.filter("o_orderkey % 50 = 1").select("o_orderkey")
    return validate.new_duplicates(o, o.select("o_orderkey").unionByName(added), added, _KEY).withColumn("n", F.col("n").cast("int"))


@register(f"WITH {_FROM}, {_TO} SELECT t.o_orderkey FROM f JOIN t USING (o_orderkey) WHERE f.o_totalprice <> t.o_totalprice AND NOT (t.o_totalprice < 200000)")
def validate_modification(spark, d):
    return state.modified(before(spark, d), after(spark, d), _KEY, F.col("after.o_totalprice") < 200000).select("o_orderkey")


def _outcomes(spark, now: Dataset, before: Dataset | None, *validators) -> DataFrame:
    return spark.createDataFrame([(o.name, o.status) for o in (v(now, before) for v in validators)], "name string, status string")


@register("SELECT 'minimum_count(orders)' AS name, CASE WHEN (SELECT count(*) FROM orders) >= 100 THEN 'PASSED' ELSE 'FAILED' END AS status UNION ALL SELECT 'minimum_count(region)', CASE WHEN (SELECT count(*) FROM region) >= 100 THEN 'PASSED' ELSE 'FAILED' END")
def validate_minimum_count(spark, d):
    return _outcomes(spark, star(spark, d), None, validate.minimum_count("orders", 100), validate.minimum_count("region", 100))


# JSON, text, versions.


@register("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_find_key(spark, d):
    return find_key(table(spark, d, "events"), ["k"], "props").select("event_id", "k")


@register("SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS names, json_extract_string(props, '$.k') AS k FROM events")
def json_passthrough(spark, d):
    rest = F.col("single_values")
    return passthrough(table(spark, d, "events"), [], "props").select("event_id", F.array_join(F.array_sort(F.map_keys(rest)), ",").alias("names"), rest["k"].alias("k"))


@register("SELECT json_extract_string(props, '$.k') AS k FROM events")
def json_ingest(spark, d):
    from pyspark.sql import types as T

    return ingest(table(spark, d, "events"), T.StructType([T.StructField("k", T.StringType())]), "props")


@register()
def stringify_json(spark, d):
    c = customers(spark, d)
    return c.select("c_custkey", to_text(c).alias("json"))


@register("SELECT o_orderkey, o_orderkey::VARCHAR || ':' || o_orderstatus AS display FROM orders")
def display_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", display_key(F.col("o_orderkey"), F.col("o_orderstatus")).alias("display"))


@register("SELECT v AS version, strptime(substr(v::VARCHAR, 1, 14), '%Y%m%d%H%M%S') AS at FROM (SELECT 20240101000000000 + n_nationkey * 100000 + 1 AS v FROM nation)")
def version_timestamp(spark, d):
    v = table(spark, d, "nation").select((F.lit(20240101000000001) + F.col("n_nationkey") * 100000).alias("version"))
    return v.select("version", version_time(F.col("version")).alias("at"))
