"""More operators as queries: versions in a store, cycles, evolved and null-keyed states, access to collections, algebra."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import records as R
from ..operators import algebra, diff, history, state, validate
from ..operators.dataset import Dataset, normalize
from ..operators.index import CurrentIndex, Find, HashIndex, PrefixIndex, UniqueKeyIndex
from ..operators.lifecycle import Consumer, Handle, Producer, type_overview
from ..operators.objects import ByVersion, ColumnUsage
from ..operators.query import TypeFilter
from ..sources.json_records import chunks, discover, flat_records, ingest
from ..sources.store import Store
from .catalog import _FROM, _KEY, _THIRD, _TO, _log, _outcomes, after, before, customers, register, star, table, third
from .schema import from_spark


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only in a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}"
    return f"{where}/store-{uuid.uuid4().hex}"


def _state(df: DataFrame, version: int = 0) -> Dataset:
    return Dataset({"orders": df}, {"orders": ("o_orderkey",)}, (), version)


def _three(spark: SparkSession, d: str) -> Store:
    """A store of three versions: a snapshot of the first, deltas between them, a snapshot of the third."""
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    store.publish(_state(after(spark, d)), 2, store.snapshot(1), snapshot=False)
    store.publish(_state(third(spark, d)), 3, store.load(2))
    store.announce(3)
    return store


# Versions.


@register(f"WITH {_FROM} SELECT * FROM f")
def store_snapshot(spark, d):
    return _three(spark, d).snapshot(1).types["orders"]


@register(f"WITH {_FROM} SELECT o_orderkey, o_totalprice FROM f")
def store_snapshot_columns(spark, d):
    return _three(spark, d).snapshot(1, ["orders"], {"orders": ["o_orderkey", "o_totalprice"]}).types["orders"]


@register(f"WITH {_FROM}, {_TO} SELECT * FROM t")
def store_delta_step(spark, d):
    return _three(spark, d).load(2).types["orders"]


@register(f"WITH {_FROM}, {_TO}, {_THIRD} SELECT * FROM f")
def store_reverse_steps(spark, d):
    store = _three(spark, d)
    return store.load(1, store.snapshot(3)).types["orders"]


@register("SELECT * FROM (VALUES (1, 'none to 2', 'snapshot', 1::BIGINT), (2, 'none to 2', 'delta', 2), (1, '1 to 3', 'delta', 2), (2, '1 to 3', 'delta', 3), (1, '3 to 1', 'reverse', 3), (2, '3 to 1', 'reverse', 2), (1, 'none to 9', 'snapshot', 3), (1, '1 to 3, one delta at most', 'snapshot', 3)) v(step, way, kind, version)")
def store_plan(spark, d):
    store = _three(spark, d)
    plans = {"none to 2": store.plan(None, 2), "1 to 3": store.plan(1, 3), "3 to 1": store.plan(3, 1), "none to 9": store.plan(None, 9), "1 to 3, one delta at most": store.plan(1, 3, max_deltas=1)}
    return spark.createDataFrame([(i, way, kind, v) for way, steps in plans.items() for i, (kind, v) in enumerate(steps, 1)], "step int, way string, kind string, version long")


@register(f"WITH {_FROM}, {_TO}, {_THIRD} SELECT * FROM u")
def store_compact(spark, d):
    store = _three(spark, d)
    store.compact(3, 2)
    return store.snapshot(3).types["orders"]


@register("SELECT * FROM (VALUES ('orders', 'added', 2::BIGINT), ('orders', 'removed', 2), ('orders', 'added', 3), ('orders', 'removed', 3), ('orders', 'snapshot', 3)) v(type, kind, version)")
def store_clean(spark, d):
    """What is stored once all snapshots but the newest are dropped."""
    store = _three(spark, d)
    store.clean(keep=1)
    return store.footprint().filter("files > 0").select("type", "kind", "version")


@register(f"WITH {_FROM}, {_TO} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderkey % 3 AS o_clerk FROM t")
def apply_delta_evolved(spark, d):
    """A column goes and another comes; the state moves over the stored delta."""
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    store.publish(_state(_evolved(spark, d)), 2, store.snapshot(1), snapshot=False)
    return store.load(2, store.snapshot(1)).types["orders"]


def _evolved(spark, d):
    return after(spark, d).drop("o_orderpriority").withColumn("o_clerk", F.col("o_orderkey") % 3)


@register(f"WITH {_FROM} SELECT * FROM f")
def apply_reverse_delta_evolved(spark, d):
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    store.publish(_state(_evolved(spark, d)), 2, store.snapshot(1))
    return store.load(1, store.snapshot(2)).types["orders"]


@register("SELECT * FROM (VALUES ('o_clerk', 'added'), ('o_orderpriority', 'removed')) v(field, change)")
def schema_changes(spark, d):
    return spark.createDataFrame(history.schema_changes(before(spark, d), _evolved(spark, d)), "field string, change string")


# Cycles.


@register("SELECT * FROM (VALUES (1, 'published'), (2, 'nothing changed'), (3, 'failed, nothing left'), (4, 'published over the first')) v(cycle, outcome)")
def producer_cycles(spark, d):
    """A first cycle, one without a change, one that a validator stops, one that goes on from the first."""
    store = Store(spark, _folder(spark))
    p, rows = Producer(store, [validate.duplicate_keys("orders", _KEY)]), []
    first = p.run_cycle(lambda _: _state(before(spark, d)))
    rows.append((1, "published" if store.versions() == [first] == [store.announced()] else "wrong"))
    again = p.run_cycle(lambda _: _state(before(spark, d).repartition(3)))
    rows.append((2, "nothing changed" if again is None and store.versions() == [first] else "wrong"))
    try:
        p.run_cycle(lambda _: _state(before(spark, d).unionByName(after(spark, d).filter("o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0"))))
        rows.append((3, "wrong"))
    except validate.ValidationError:
        rows.append((3, "failed, nothing left" if store.versions() == [first] and p.current.version == first and not store.footprint().filter(f"version <> {first}").count() else "wrong"))
    second = p.run_cycle(lambda _: _state(after(spark, d)))
    rows.append((4, "published over the first" if store.versions() == [first, second] and store.manifest(second).base == first else "wrong"))
    return spark.createDataFrame(rows, "cycle int, outcome string")


@register(f"WITH {_FROM}, {_TO}, {_THIRD} SELECT * FROM u")
def producer_restore(spark, d):
    """A producer goes on from a restored version; a consumer follows over its delta."""
    folder = _folder(spark)
    first = Producer(Store(spark, folder)).run_cycle(lambda _: _state(before(spark, d)))
    consumer = Consumer(Store(spark, folder))
    consumer.refresh()
    p = Producer(Store(spark, folder), snapshot_every=100)
    p.restore(first)
    p.cycles = 1
    p.run_cycle(lambda _: _state(third(spark, d)))
    return consumer.refresh_later().result().types["orders"]


@register("WITH l AS (SELECT * FROM orders WHERE o_orderkey % 4 <> 0), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM l) OR c_custkey NOT IN (SELECT o_custkey FROM orders)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c) OR n_nationkey NOT IN (SELECT c_nationkey FROM customer)) SELECT 'orders' AS type, count(*) AS records FROM l UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'region', count(*) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n) OR r_regionkey NOT IN (SELECT n_regionkey FROM nation)")
def incremental_cycle(spark, d):
    """Every fourth order is deleted; customers, nations and regions that only those needed go with them."""
    p = Producer(Store(spark, _folder(spark)), check_integrity=False)
    p.run_cycle(lambda _: star(spark, d))
    events = table(spark, d, "orders").filter("o_orderkey % 4 = 0").withColumn("seq", F.lit(1)).withColumn("action", F.lit("delete"))
    p.run_incremental("orders", events, _KEY)
    return p.current.counts()


@register("SELECT * FROM (VALUES ('announced'), ('populated'), ('staged'), ('validated'), ('published'), ('cycle_start')) v(event)")
def producer_listeners(spark, d):
    seen = []
    p = Producer(Store(spark, _folder(spark)), listeners=[lambda event, version, details: seen.append((event,))])
    p.run_cycle(lambda _: _state(before(spark, d)))
    return spark.createDataFrame(seen, "event string")


@register("SELECT 'orders' AS type, 1 AS compacted, (SELECT count(*) FROM orders WHERE o_orderkey % 10 <> 0) AS records")
def compaction_cycle(spark, d):
    p = Producer(Store(spark, _folder(spark)))
    p.run_cycle(lambda _: _state(before(spark, d).repartition(6)))
    found = p.run_compaction_cycle(least=64 << 20)
    return p.current.counts().select("type", F.lit(len(found)).alias("compacted"), "records")


# States with null keys, other columns, evolved fields.


def _null_keyed(df: DataFrame) -> DataFrame:
    """Customers' orders by day, the customer unknown for some: a key with nulls."""
    return df.select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")


_NULLED = "SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM"


@register(f"WITH {_FROM}, {_TO}, a AS ({_NULLED} f), b AS ({_NULLED} t) SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice")
def change_classification_null_keys(spark, d):
    return state.changes(_null_keyed(before(spark, d)), _null_keyed(after(spark, d)).select("o_totalprice", "o_orderstatus", "o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"]).select("o_custkey", "o_orderkey", "change")


@register(f"WITH {_FROM}, {_TO}, a AS ({_NULLED} f), b AS ({_NULLED} t) SELECT CASE WHEN a.o_orderkey IS NULL THEN 'to_only' WHEN b.o_orderkey IS NULL THEN 'from_only' ELSE 'matched' END AS side, count(*) AS n FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey GROUP BY ALL")
def diff_match_null_keys(spark, d):
    return diff.match(_null_keyed(before(spark, d)), _null_keyed(after(spark, d)), ["o_custkey", "o_orderkey"]).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {_FROM}, {_TO} {_NULLED} f")
def history_asof_null_keys(spark, d):
    keys = ["o_custkey", "o_orderkey"]
    a, b = _null_keyed(before(spark, d)), _null_keyed(after(spark, d))
    return history.as_of(b, history.log([(1, a), (2, b)], keys), 1, keys)


@register(f"WITH {_FROM}, {_TO} SELECT 'first' AS step, o_orderkey, o_totalprice FROM (SELECT * FROM f WHERE o_orderkey IN (SELECT o_orderkey FROM (FROM f INTERSECT FROM t)) UNION ALL SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)) UNION ALL SELECT 'second', o_orderkey, o_totalprice FROM t")
def patch_two_step(spark, d):
    a, b = before(spark, d), after(spark, d)
    one, two = state.two_steps(a, b, _KEY)
    first = state.apply(a, one)
    second = state.apply(first, two)
    return first.select(F.lit("first").alias("step"), "o_orderkey", "o_totalprice").unionByName(second.select(F.lit("second").alias("step"), "o_orderkey", "o_totalprice"))


# Difference and history.


@register("SELECT type, n AS matched, 0::BIGINT AS from_only, 0::BIGINT AS to_only, score FROM (SELECT 'region' AS type, count(*) AS n, 0::BIGINT AS score FROM region UNION ALL SELECT 'nation', count(*), 0 FROM nation UNION ALL SELECT 'customer', count(*), 2 * count(CASE WHEN c_custkey % 11 = 0 THEN 1 END) FROM customer)")
def diff_auto(spark, d):
    """Types with a primary key are found and compared by themselves; a type without one is left out."""
    a = star(spark, d)
    b = Dataset({**a.types, "customer": a.types["customer"].withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))}, a.keys, a.references)
    drop = lambda s: Dataset(s.types, {t: k for t, k in s.keys.items() if t != "orders"}, s.references)
    return diff.overview(diff.summary(diff.keyed_types(drop(a), drop(b))))


def _lists(orders: DataFrame, descending: bool) -> DataFrame:
    e = F.struct("o_orderkey", "o_orderstatus", "o_totalprice")
    return orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(e), not descending).alias("orders"))


@register(f"WITH {_FROM}, {_TO}, x AS (SELECT o_custkey, md5(string_agg(o_orderkey || ' ' || o_orderstatus || ' ' || o_totalprice, ',' ORDER BY o_orderkey)) AS h FROM f GROUP BY 1), y AS (SELECT o_custkey, md5(string_agg(o_orderkey || ' ' || o_orderstatus || ' ' || o_totalprice, ',' ORDER BY o_orderkey)) AS h FROM t GROUP BY 1) SELECT x.o_custkey AS f_o_custkey, y.o_custkey AS t_o_custkey FROM x JOIN y USING (h)")
def equal_unordered_lists(spark, d):
    """Customers whose orders are alike, in whatever order the lists have them."""
    return diff.equal_pairs(_lists(before(spark, d), False), _lists(after(spark, d), True), ["o_custkey"], unordered=True)


@register(f"WITH {_FROM}, {_TO}, {_THIRD}, x AS (SELECT 2::BIGINT AS version, CASE WHEN f.o_orderkey IS NULL THEN 'added' WHEN t.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END AS change, coalesce(f.o_orderkey, t.o_orderkey) AS o_orderkey FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey WHERE f.o_orderkey IS NULL OR t.o_orderkey IS NULL OR f.o_totalprice <> t.o_totalprice UNION ALL SELECT 3, CASE WHEN u.o_orderkey IS NULL THEN 'removed' ELSE 'updated' END, t.o_orderkey FROM t LEFT JOIN u ON t.o_orderkey = u.o_orderkey WHERE u.o_orderkey IS NULL OR t.o_orderpriority <> u.o_orderpriority) SELECT * FROM x WHERE o_orderkey IN (SELECT s_suppkey * 7 FROM supplier)")
def history_of_keys(spark, d):
    wanted = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("o_orderkey"))
    return history.of_keys(_log(spark, d), _KEY, wanted).select("version", "change", "o_orderkey")


@register(f"WITH {_FROM}, {_TO} SELECT coalesce(t.o_orderstatus, f.o_orderstatus) || '-' || coalesce(f.o_orderkey, t.o_orderkey) AS name FROM f FULL JOIN t ON f.o_orderkey = t.o_orderkey WHERE f.o_orderkey IS NULL OR t.o_orderkey IS NULL OR f.o_totalprice <> t.o_totalprice")
def history_named(spark, d):
    log = history.log([(1, before(spark, d)), (2, after(spark, d))], _KEY)
    return history.named(log, lambda r: F.concat(r["o_orderstatus"], F.lit("-"), r["o_orderkey"].cast("string"))).select("name")


@register(f"WITH {_FROM}, {_TO}, {_THIRD} SELECT version, count(*) AS n FROM (SELECT 3::BIGINT AS version FROM t LEFT JOIN u ON t.o_orderkey = u.o_orderkey WHERE u.o_orderkey IS NULL OR t.o_orderpriority <> u.o_orderpriority) GROUP BY version")
def history_keep_newest(spark, d):
    first = history.log([(1, before(spark, d)), (2, after(spark, d))], _KEY)
    return history.extend(first, after(spark, d), third(spark, d), 3, _KEY, keep=1).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


# Algebra.


@register("SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey + 100000000, o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def combine_cascade(spark, d):
    """A second input numbers nations and customers of its own; by their names they are the first's, so its orders come to refer to the first's customers."""
    a, far = star(spark, d), 50_000_000
    b = Dataset(
        {
            "nation": a.types["nation"].withColumn("n_nationkey", F.col("n_nationkey") + far),
            "customer": a.types["customer"].withColumn("c_custkey", F.col("c_custkey") + far).withColumn("c_nationkey", F.col("c_nationkey") + far),
            "orders": a.types["orders"].filter("o_orderkey % 2 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000).withColumn("o_custkey", F.col("o_custkey") + far),
        },
        a.keys, a.references,
    )
    first = Dataset({t: (df.withColumn("n_nationkey", F.col("n_nationkey").cast("long")) if t == "nation" else df.withColumn("c_nationkey", F.col("c_nationkey").cast("long")) if t == "customer" else df) for t, df in a.types.items()}, a.keys, a.references)
    return algebra.combine([first, b], {"nation": ["n_name"], "customer": ["c_name", "c_nationkey"]}).types["orders"].select("o_orderkey", "o_custkey")


@register("SELECT count(*) AS records, count(DISTINCT o_orderkey) AS orders, 4::BIGINT AS shards, true AS even FROM orders")
def split_by_key_hash(spark, d):
    """Each order is in one shard, the same whatever the layout, and shards are about even."""
    o = UniqueKeyIndex(table(spark, d, "orders"), _KEY)
    whole = algebra.split_all(Dataset({"orders": o.df}, {"orders": ("o_orderkey",)}), 4).types["orders"]
    sizes = whole.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("shards"), (F.max("n") < 1.3 * F.min("n")).alias("even"))
    same = whole.join(o.df.repartition(5).select(F.col("o_orderkey").alias("k"), o.key_hash(4).alias("h")), (F.col("k") == F.col("o_orderkey")) & (F.col("h") == F.col("shard")))
    return sizes.join(F.broadcast(same.agg(F.countDistinct("o_orderkey").alias("orders")))).select("records", "orders", "shards", "even")  # a row each


@register("SELECT shard::INT AS shard, (SELECT count(*) FROM orders) // 3 + CASE WHEN shard < (SELECT count(*) FROM orders) % 3 THEN 1 ELSE 0 END AS n FROM (SELECT unnest(range(3)) AS shard)")
def split_by_place(spark, d):
    return algebra.split_by_place(table(spark, d, "orders"), 3).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT * FROM orders WHERE o_orderkey % 3 <> 0")
def combine_exclude_records(spark, d):
    o = table(spark, d, "orders")
    return algebra.exclude_records(o, o.filter("o_orderkey % 3 = 0").select(*reversed(o.columns)))


@register("SELECT * FROM orders WHERE o_orderkey % 3 = 0")
def combine_include_records(spark, d):
    o = table(spark, d, "orders")
    return algebra.include_records(o, o.filter("o_orderkey % 3 = 0"))


@register("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN o_custkey + 7000000 ELSE o_custkey END AS o_custkey FROM orders")
def copy_records(spark, d):
    c = table(spark, d, "customer").filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_custkey") + 7_000_000)
    return algebra.copy_records(table(spark, d, "orders"), {"o_custkey": c}).select("o_orderkey", "o_custkey")


@register("SELECT 'small' AS output, count(*) AS n FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT 'keys', count(*) FROM orders")
def filter_outputs(spark, d):
    out = algebra.write_outputs(table(spark, d, "orders"), {"small": lambda df: df.filter("o_totalprice < 50000"), "keys": lambda df: df.select("o_orderkey")}, _folder(spark))
    return out["small"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("small").alias("output"), "n").unionByName(out["keys"].agg(F.count(F.lit(1)).alias("n")).select(F.lit("keys").alias("output"), "n"))


@register("SELECT 'Region' AS type, 'r_regionkey,r_name' AS columns UNION ALL SELECT 'Nation', 'n_nationkey,n_name'")
def filter_text_rules(spark, d):
    s = star(spark, d)
    renamed = Dataset({t[:1].upper() + t[1:]: df for t, df in s.types.items()})
    schemas = {t: x for n, df in renamed.types.items() for t, x in from_spark(n, df.schema).items()}
    kept = TypeFilter.parse("-*\n+Region\n+Nation.n_nationkey\n+Nation.n_name").apply(renamed, schemas)
    return spark.createDataFrame([(t, ",".join(df.columns)) for t, df in kept.types.items()], "type string, columns string")


# Aggregates.


@register("SELECT 'customer' AS type, 'c_mktsegment' AS field, 0::BIGINT AS nulls, count(DISTINCT c_mktsegment) AS distinct_values, max(strlen(c_mktsegment))::BIGINT AS max_bytes, sum(strlen(c_mktsegment))::BIGINT AS total_bytes FROM customer UNION ALL SELECT 'customer', 'c_name', 0, count(DISTINCT c_name), max(strlen(c_name)), sum(strlen(c_name))::BIGINT FROM customer UNION ALL SELECT 'customer', 'odd', count(*) - count(CASE WHEN c_custkey % 2 = 1 THEN 1 END), count(DISTINCT CASE WHEN c_custkey % 2 = 1 THEN c_custkey END), max(CASE WHEN c_custkey % 2 = 1 THEN strlen(c_custkey::VARCHAR) END), sum(CASE WHEN c_custkey % 2 = 1 THEN strlen(c_custkey::VARCHAR) END)::BIGINT FROM customer")
def field_statistics(spark, d):
    c = table(spark, d, "customer").select("c_name", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 1, F.col("c_custkey")).alias("odd"))
    return Dataset({"customer": c}).field_statistics()


@register("SELECT 'orders' AS type, (SELECT count(*) FROM orders) AS records, true AS same")
def checksum_common_schema(spark, d):
    """Equal content in the columns that both states have, whatever else either has."""
    o = table(spark, d, "orders")
    a, b = Dataset({"orders": o.withColumn("extra", F.lit(1)), "other": o.limit(1)}), Dataset({"orders": o.drop("o_orderstatus").select(*reversed(o.drop("o_orderstatus").columns))})
    common = a.common_columns(b)
    theirs = b.checksum(common).withColumnRenamed("checksum", "other")
    return a.checksum(common).join(theirs, ["type", "records"]).select("type", "records", (F.col("checksum") == F.col("other")).alias("same"))


@register("SELECT * FROM (VALUES ('orders', 'o_orderkey', 2::BIGINT), ('orders', 'o_totalprice', 1), ('customer', 'c_name', 1)) v(type, field, reads)")
def column_usage(spark, d):
    s = star(spark, d)
    usage = ColumnUsage(s)
    usage.observe(s.types["orders"].select("o_orderkey"))
    usage.observe(s.types["orders"].filter("o_totalprice > 10").select("o_orderkey"))
    usage.observe(s.types["customer"].select("c_name"))
    return usage.report()


@register(f"WITH {_FROM}, {_TO} SELECT 'count_variance(orders)' AS name, CASE WHEN 100 * abs((SELECT count(*) FROM t) - (SELECT count(*) FROM f)) / (SELECT count(*) FROM f) <= 1 THEN 'PASSED' ELSE 'FAILED' END AS status UNION ALL SELECT 'count_variance(orders)', 'SKIPPED' UNION ALL SELECT 'duplicate_keys(orders)', 'PASSED' UNION ALL SELECT 'duplicate_keys(orders)', 'FAILED' UNION ALL SELECT 'null_keys(orders)', 'PASSED' UNION ALL SELECT 'percent_change(orders)', 'FAILED' UNION ALL SELECT 'object_modification(orders)', 'FAILED'")
def validate_outcomes(spark, d):
    """The validators' outcomes on two states."""
    a, b = _state(before(spark, d)), _state(after(spark, d))
    got = _outcomes(spark, b, a, validate.count_variance("orders", 1), validate.duplicate_keys("orders", _KEY), validate.duplicate_keys("orders", ["o_custkey"]), validate.null_keys("orders", _KEY), validate.percent_change("orders", updated=0.5), validate.object_modification("orders", F.col("after.o_orderstatus") != "X"))
    return got.unionByName(_outcomes(spark, b, None, validate.count_variance("orders", 1)))


# Indexes.


@register("SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_3'")
def find_typed(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").select("n_nationkey", F.struct("n_name").alias("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return Find(c).using("c_mktsegment").using("nation.n_name").matches("BUILDING", "NATION_3").select("c_custkey", "c_name")


@register("SELECT o_orderkey FROM orders WHERE o_orderkey = 77")
def find_unique_null_parts(spark, d):
    """A null part of a key is dropped with its path."""
    return Find(table(spark, d, "orders")).using("o_orderkey", "o_custkey").unique(77, None).select("o_orderkey")


@register("SELECT o_orderkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 100 = 1 GROUP BY ALL")
def hash_index_contains(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return HashIndex(o, "", ["o_orderstatus"]).contains(o.filter("o_orderkey % 100 = 1"), "F").groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n")
def hash_index_count(spark, d):
    return spark.createDataFrame([(HashIndex(table(spark, d, "orders"), "", ["o_orderstatus"], distinct=True).count("F"),)], "n long")


@register(f"WITH {_FROM}, {_TO} SELECT 1::BIGINT AS version, o_orderstatus, count(*) AS n FROM f WHERE o_orderstatus = 'O' GROUP BY ALL UNION ALL SELECT 2, o_orderstatus, count(*) FROM t WHERE o_orderstatus = 'O' GROUP BY ALL")
def index_follows_versions(spark, d):
    """An index that is built anew as its consumer moves on."""
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    store.publish(_state(after(spark, d)), 2, store.snapshot(1))
    consumer = Consumer(store)
    index, cached, out = CurrentIndex(lambda: consumer.state, "orders", lambda df: HashIndex(df, "", ["o_orderstatus"], distinct=True)), ByVersion(lambda s: s.version), None
    for v in (1, 2):
        consumer.refresh(v)
        rows = index.get().find("O").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(cached.of(consumer.state)).cast("long").alias("version"), "o_orderstatus", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@register(f"WITH {_FROM} SELECT * FROM f WHERE o_orderkey = 77")
def pk_lookup_at_version(spark, d):
    """A key looked up in a historical state."""
    return UniqueKeyIndex(history.as_of(third(spark, d), _log(spark, d), 1, _KEY), _KEY).match(77)


@register("SELECT o_orderkey, o_orderkey = 77 AS hit FROM orders WHERE o_orderkey < 100")
def key_matches(spark, d):
    index = UniqueKeyIndex(table(spark, d, "orders"), _KEY)
    return index.df.filter("o_orderkey < 100").select("o_orderkey", index.key_matches(77).alias("hit"))


@register("SELECT p AS prefix, EXISTS (SELECT 1 FROM part WHERE lower(p_name) = p) AS found FROM (SELECT lower(min(p_name)) AS p FROM part UNION ALL SELECT 'no such part')")
def prefix_contains(spark, d):
    p = table(spark, d, "part")
    index, first = PrefixIndex(p, "p_name"), p.agg(F.lower(F.min("p_name"))).first()[0]
    return spark.createDataFrame([(x, index.contains(x)) for x in (first, "no such part")], "prefix string, found boolean")


# Collections.


def _collected(spark, d) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("l"))
    return o


_LISTS = "l AS (SELECT o_custkey, list(o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)"


@register(f"WITH {_LISTS} SELECT o_custkey, len(l)::INT AS size, l[1] AS first, l[3] AS third, list_contains(l, 'P') AS has, coalesce(list_position(l, 'F'), 0)::INT - 1 AS at, CASE WHEN list_contains(l, 'F') THEN len(l) - list_position(list_reverse(l), 'F') ELSE -1 END::INT AS last_at FROM l")
def list_access(spark, d):
    x = F.col("l")
    return _collected(spark, d).select("o_custkey", F.size(x).alias("size"), R.element_at(x, 0).alias("first"), R.element_at(x, 2).alias("third"), F.array_contains(x, "P").alias("has"), R.index_of(x, "F").alias("at"), R.last_index_of(x, F.lit("F")).alias("last_at"))


@register(f"WITH {_LISTS} SELECT o_custkey, len(list_distinct(l))::INT AS size, list_contains(l, 'O') AND list_contains(l, 'F') AS both_there, len(list_distinct(l)) = 2 AND list_contains(l, 'O') AND list_contains(l, 'F') AS is_open_and_final FROM l")
def set_access(spark, d):
    wanted = F.array(F.lit("O"), F.lit("F"))
    return _collected(spark, d).select("o_custkey", F.size(F.array_distinct("l")).alias("size"), R.contains_all(F.col("l"), wanted).alias("both_there"), R.same_sets(F.col("l"), wanted).alias("is_open_and_final"))


@register("SELECT c_nationkey, count(DISTINCT c_mktsegment)::INT AS size, bool_or(c_mktsegment = 'BUILDING') AS has_key, max(CASE WHEN c_mktsegment = 'BUILDING' THEN n END) AS value, bool_or(n = 1) AS has_value FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def map_access(spark, d):
    m = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("m"))
    x = F.col("m")
    return m.select("c_nationkey", F.size(x).alias("size"), R.map_contains(x, key="BUILDING").alias("has_key"), R.find_in_map(x, key="BUILDING").alias("value"), R.map_contains(x, value=F.lit(1).cast("long")).alias("has_value"))


@register("SELECT o_orderkey, o_orderstatus IS NULL AS missing, o_orderstatus = 'F' AS is_f, CASE WHEN o_orderstatus < 'O' THEN -1 WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS compared FROM orders")
def scalar_access(spark, d):
    x = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", x.isNull().alias("missing"), R.same(x, F.lit("F")).alias("is_f"), R.compared(x, F.lit("O")).alias("compared"))


@register(f"WITH {_LISTS} SELECT o_custkey, 'q' AS missing, o_custkey::VARCHAR AS shown, 0::BIGINT AS gone FROM l")
def missing_data(spark, d):
    """A reader's schema over a state that lacks some of it: defaults, nulls, and an empty type."""
    from pyspark.sql import types as T

    s = Dataset({"orders": _collected(spark, d).drop("l").withColumn("shown", F.col("o_custkey").cast("string"))})
    wanted = {"orders": T.StructType([T.StructField("o_custkey", T.LongType()), T.StructField("missing", T.StringType()), T.StructField("shown", T.StringType())]), "absent": T.StructType([T.StructField("x", T.LongType())])}
    got = s.with_defaults(wanted, {"orders": {"missing": "q"}})
    return got.types["orders"].join(F.broadcast(got.types["absent"].agg(F.count(F.lit(1)).alias("gone"))))  # one row


# Text and JSON.


@register(r"SELECT c_custkey, chr(10) || '  c_custkey: ' || c_custkey || chr(10) || '  name: ' || c_name || chr(10) || '  nation: ' || n_name || chr(10) || '  tags: ' || chr(10) || '    e0: ' || c_mktsegment || chr(10) || '    e1: x' || chr(10) || '  gone: null' AS text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def stringify_lines(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", F.col("c_name").alias("name"), F.struct("n_name").alias("nation"), F.array("c_mktsegment", F.lit("x")).alias("tags"), F.lit(None).cast("string").alias("gone"))
    return c.select("c_custkey", R.to_lines(c).alias("text"))


@register("SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"none\":null}' AS json FROM nation")
def stringify_json_flat(spark, d):
    n = table(spark, d, "nation").select("n_name", "n_nationkey", F.lit(None).cast("string").alias("none"))
    return n.select("n_nationkey", R.to_text(n).alias("json"))


@register("SELECT 'k' AS field, 'bigint' AS kind")
def json_discover(spark, d):
    texts = table(spark, d, "events").select(F.col("props").alias("value")).unionByName(spark.createDataFrame([("{damaged",)], "value string"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in discover(texts)], "field string, kind string")


@register("SELECT o_custkey, position::INT AS position, l[position + 1] AS value FROM (SELECT o_custkey, l, unnest(range(len(l))) AS position FROM (SELECT o_custkey, list(o_orderkey::VARCHAR ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey))")
def json_array_chunks(spark, d):
    nulls = F.array_repeat(F.lit(None).cast("long"), F.count_if(F.col("o_orderkey").isNull()).cast("int"))
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_json(F.concat(F.sort_array(F.collect_list("o_orderkey")), nulls)).alias("value"))
    return chunks(o, keep=["o_custkey"]).select("o_custkey", "position", F.nullif("value", F.lit("null")).alias("value"))




@register("SELECT o_orderkey, 'A' || o_orderkey AS id, o_orderstatus AS status, o_orderkey % 3 AS m FROM orders")
def json_remap(spark, d):
    """Fields from other paths, and a function over a field."""
    from pyspark.sql import types as T

    texts = table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", F.struct(F.struct("o_orderstatus").alias("b")).alias("a"), (F.col("o_orderkey") % 3).alias("m"), F.col("o_orderkey").alias("id"))).alias("value"))
    schema = T.StructType().add("o_orderkey", "long").add("id", "string").add("status", "string").add("m", "long")
    return ingest(texts, schema, remap={"status": "a.b.o_orderstatus"}, processors={"id": lambda c: F.concat(F.lit("A"), c)})


@register("SELECT c_nationkey, c_mktsegment AS key, count(*) AS value FROM customer GROUP BY ALL")
def json_maps(spark, d):
    """Maps written as objects and as lists of entries, both read as maps."""
    from pyspark.sql import types as T

    m = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n")).groupBy("c_nationkey").agg(F.collect_list(F.struct(F.col("c_mktsegment").alias("key"), F.col("n").alias("value"))).alias("m"))
    texts = m.select(F.when(F.col("c_nationkey") % 2 == 0, F.to_json(F.struct("c_nationkey", F.map_from_entries("m").alias("m")))).otherwise(F.to_json(F.struct("c_nationkey", "m"))).alias("value"))
    schema = T.StructType([T.StructField("c_nationkey", T.IntegerType()), T.StructField("m", T.MapType(T.StringType(), T.LongType()))])
    return ingest(texts, schema).select("c_nationkey", F.explode("m").alias("key", "value"))


@register("SELECT c_custkey, true AS same FROM customer")
def flat_record_round_trip(spark, d):
    """Each nested customer as one self-contained text, and back."""
    c = customers(spark, d)
    back = flat_records(c.select(R.to_text(c).alias("value")), c.schema).select("record.*")
    a, b = (x.select("c_custkey", R.record_id(x, sets=True).alias(n)) for x, n in ((c, "a"), (back, "b")))
    return a.join(b, "c_custkey").select("c_custkey", (F.col("a") == F.col("b")).alias("same"))


@register("SELECT 'Customer' AS type, count(*) AS records FROM customer UNION ALL SELECT 'Nation', count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'Region', count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def flat_record_dump(spark, d):
    """Self-contained texts dumped into the types of a dataset."""
    c = customers(spark, d).drop("orders")
    records = flat_records(c.select(R.to_text(c).alias("value")), c.schema).select("record.*")
    return Dataset(normalize(records, from_spark("Customer", c.schema), "Customer")[0]).counts()


@register("SELECT 'orders' AS type, (SELECT count(*) FROM orders) AS records, 6 AS fields, 'o_orderkey' AS key UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM (DESCRIBE customer))::INT, 'c_custkey' UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), 3, 'n_nationkey' UNION ALL SELECT 'region', (SELECT count(*) FROM region), 2, 'r_regionkey'")
def types_overview(spark, d):
    return type_overview(star(spark, d)).withColumn("fields", F.col("fields").cast("int"))


@register(f"WITH {_FROM}, {_TO} SELECT 'held' AS of, * FROM f UNION ALL SELECT 'handle', * FROM t")
def handles_and_held_states(spark, d):
    """A state that is held stays what it was as the consumer moves on; a handle goes with the consumer."""
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    consumer = Consumer(store)
    held, handle = consumer.refresh(1).types["orders"], Handle(consumer, "orders")
    store.publish(_state(after(spark, d)), 2, store.snapshot(1))
    store.announce(2)
    consumer.refresh()
    return held.select(F.lit("held").alias("of"), "*").unionByName(handle.get().select(F.lit("handle").alias("of"), "*"))


@register("SELECT * FROM (VALUES ('pinned', 1::BIGINT), ('announced', 2), ('failed, stays', 2), ('not again', 2)) v(step, version)")
def consumer_refreshes(spark, d):
    """A pinned consumer, one that follows, one whose refresh fails and isn't tried again by itself."""
    store = Store(spark, _folder(spark))
    store.publish(_state(before(spark, d)), 1)
    store.publish(_state(after(spark, d)), 2, store.snapshot(1))
    store.announce(2)
    rows = [("pinned", Consumer(store, pinned=1).refresh().version)]
    c = Consumer(store, allow_snapshot=False)
    rows.append(("announced", c.refresh().version))
    store.publish(_state(third(spark, d)), 3)  # a snapshot only: no chain leads there
    store.announce(3)
    try:
        c.refresh()
    except LookupError:
        rows.append(("failed, stays", c.state.version))
    rows.append(("not again", c.refresh().version))
    return spark.createDataFrame(rows, "step string, version long")
