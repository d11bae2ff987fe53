import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.records import find_in_map, last_index_of, literal, record_id, to_text
from lodestrata.operators import algebra, diff, history, query, state
from lodestrata.operators.dataset import Dataset, Reference, normalize
from lodestrata.operators.index import HashIndex, PrefixIndex, UniqueKeyIndex
from lodestrata.plans.schema import parse


@pytest.fixture(scope="module")
def nested(spark):
    rows = [(1, 1.1, ["one"]), (1, 1.1, ["1"]), (2, 2.2, ["two", "twenty", "two hundred"]), (3, 3.3, ["three", "thirty"]), (4, 4.4, ["four"]), (4, 4.5, ["four", "forty"]), (5, 5.0, []), (6, 6.0, [None])]
    return spark.createDataFrame([(a, b, [None if x is None else (x,) for x in c]) for a, b, c in rows], "a int, b double, ab array<struct<v: string>>")


@pytest.mark.parametrize("query_, want", [((1, "one"), [1.1]), ((2, "twenty"), [2.2]), ((4, "four"), [4.4, 4.5]), ((4, "forty"), [4.5]), ((0, "none"), [])])
def test_hash_index(nested, query_, want):
    assert sorted(r.b for r in HashIndex(nested, "a", ["a", "ab.element.v"]).find(*query_).collect()) == want


def test_hash_index_deduplicates_and_rejects_null(spark, nested):
    twice = spark.createDataFrame([(1, ["A", "B", "A"])], "id int, l array<string>")
    assert HashIndex(twice, "", ["l.element"]).find("A").count() == 1
    with pytest.raises(ValueError):
        HashIndex(nested, "", ["a"]).find(None)


def test_hash_index_selects_nested(nested):
    assert [r.v for r in HashIndex(nested, "ab.element", ["ab.element.v"]).find("four").collect()] == ["four"]


def test_unique_key(spark):
    df = spark.createDataFrame([(1, ("a",)), (2, ("b",)), (2, ("b",)), (None, ("c",))], "id int, n struct<value: string>")
    index = UniqueKeyIndex(df, ["id", "n"])
    assert index.match(1, "a").count() == 1 and index.match(1).count() == 0 and index.match(2, "b").count() == 1
    assert index.has_duplicates() and [r.n for r in index.duplicates().collect()] == [2]


def test_prefix(spark):
    df = spark.createDataFrame([(1, "The Matrix"), (2, "the"), (3, "Theory"), (4, None)], "id int, t string")
    index = PrefixIndex(df, "t")
    assert sorted(r.id for r in index.with_prefix("THE").collect()) == [1, 2, 3] and index.with_prefix("").count() == 3
    assert [r.id for r in index.longest_match("the matrix reloaded").collect()] == [1]
    assert index.contains("THEORY") and not index.contains("th")


def test_literals():
    assert literal(" 2 ", T.IntegerType()) is None and literal("99999999999", T.IntegerType()) is None and literal("7", T.LongType()) == 7
    assert literal("x", T.BooleanType()) is False and literal("TRUE", T.BooleanType()) is True and literal("1.5", T.FloatType()) == 1.5


def test_field_match_over_types(spark):
    s = Dataset({"A": spark.createDataFrame([(1, 100), (2, 200)], "id int, a int"), "B": spark.createDataFrame([("1", 1.1), ("2", 2.2)], "id string, b float")})
    found = query.field_match_all(s, "id", "2")
    assert {t: df.count() for t, df in found.items()} == {"A": 1, "B": 1}
    assert query.field_match(s.types["B"], "b", "2.2").count() == 1


def test_record_identity(spark):
    df = spark.createDataFrame([(None, 1, {"a": 1, "b": 2}), (1, None, {"b": 2, "a": 1})], "x int, y int, m map<string,int>")
    a, b = [r[0] for r in df.select(record_id(df)).collect()]
    assert a != b
    only = [r[0] for r in df.select(record_id(df, ["m"])).collect()]
    assert only[0] == only[1]


def test_collections(spark):
    df = spark.createDataFrame([([1, 2, 1], {"k": 5})], "l array<int>, m map<string,int>")
    r = df.select(last_index_of(F.col("l"), 1).alias("at"), last_index_of(F.col("l"), 9).alias("no"), find_in_map(F.col("m"), key="k").alias("v"), to_text(df).alias("t")).first()
    assert (r.at, r.no, r.v, r.t) == (2, -1, 5, '{"l":[1,2,1],"m":{"k":5}}')


def test_delta_round_trip_with_evolution(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "y", None), (3, "z", 1)], "id int, v string, w int")
    d = state.delta(a, b)
    assert [r.id for r in d.added.collect()] == [3] and [r.id for r in d.removed.collect()] == [1]


def test_mutations(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    e = spark.createDataFrame([(1, "A", 1, "upsert"), (1, "AA", 2, "upsert"), (2, "", 1, "delete"), (3, "C", 1, "upsert"), (3, None, 2, "discard"), (4, "d", 1, "insert"), (4, "e", 2, "insert"), (1, "no", 3, "insert"), (5, "", 1, "delete"), (2, "back", 0, "upsert")], "id int, v string, seq int, action string")
    assert sorted(map(tuple, state.mutate(s, e, ["id"]).collect())) == [(1, "AA"), (3, "c"), (4, "d")]


def test_scores_with_collections_and_nulls(spark):
    kind = "id int, s string, n struct<v: int>, l array<int>, m map<string,int>"
    a = spark.createDataFrame([(1, "a", (1,), [1, 1, 2], {"k": 1}), (2, None, None, [], {})], kind)
    b = spark.createDataFrame([(1, "b", (1,), [1, 2, 2], {"k": 2}), (2, "x", (5,), [], {})], kind)
    got = {(r.id, r.path): r.score for r in diff.field_scores(a, b, ["id"]).collect()}
    assert got == {(1, "s"): 2, (1, "l.element"): 2, (1, "m.value"): 2, (2, "s"): 2, (2, "n.v"): 1}


def test_pair_elements():
    pairs = diff.pair_elements([{"a": 1, "b": 2}, {"a": 9, "b": 9}], [{"a": 1, "b": 3}, {"a": 7, "b": 7}])
    assert pairs[0] == ({"a": 1, "b": 2}, {"a": 1, "b": 3}, 2) and len(pairs) == 3


def test_history_extends_and_searches(spark):
    s = [spark.createDataFrame(r, "id int, v string") for r in ([(1, "a")], [(1, "b"), (2, "c")], [(2, "c")])]
    log = history.log([(1, s[0]), (2, s[1])], ["id"])
    log = history.extend(log, s[1], s[2], 3, ["id"])
    assert sorted((r.version, r.change, r.n) for r in history.counts(log).collect()) == [(2, "added", 1), (2, "updated", 1), (3, "removed", 1)]
    assert sorted(map(tuple, history.as_of(s[2], log, 2, ["id"]).collect())) == [(1, "b"), (2, "c")]
    assert [r.id for r in history.search(history.key_index(log, s[2], ["id"]), ["id"], "2").collect()] == [2]
    assert history.extend(log, s[2], s[2], 4, ["id"], keep=1).select("version").distinct().count() == 1


def test_combine_and_remap(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    two = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    out = algebra.combine([Dataset({"T": one}), Dataset({"T": two})], {"T": ["id"]}).types["T"]
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (2, "b"), (3, "C")]
    with pytest.raises(ValueError):
        algebra.combine([Dataset({"T": one}), Dataset({"T": two})], {"X": ["id"]})
    parents = spark.createDataFrame([(9, (2, "B"))], "p int, c struct<id: int, v: string>")
    assert algebra.remap(parents, "c", [one, two], ["id"]).first().c.v == "b"


def test_graph(spark):
    s = Dataset({"P": spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "p int, c int"), "C": spark.createDataFrame([(1,), (2,)], "c int")}, {"P": ("p",), "C": ("c",)}, (Reference("P", "C", "c", "c"),))
    closure = s.children({"P": s.types["P"].filter("p in (1, 3)")})
    assert sorted(r.c for r in closure["C"].collect()) == [1, 2]
    assert [r.c for r in s.unreferenced(closure)["C"].collect()] == [2]
    assert sorted(r.p for r in s.referrers({"C": s.types["C"].filter("c = 1")})["P"].collect()) == [1, 2]
    shards = algebra.split(s, 2, {"P": F.pmod("p", F.lit(2))})
    assert [d.types["P"].count() for d in shards] == [1, 2]


def test_normalize(spark):
    schemas = parse("A @PrimaryKey(id) { long id; B b; L l; } B { long x; } L List<B>;")
    df = spark.createDataFrame([(1, (7,), [(7,), (8,)]), (2, (7,), [])], "id long, b struct<x: long>, l array<struct<x: long>>")
    types, edges = normalize(df, schemas, "A")
    assert types["B"].count() == 2 and edges.count() == 4


def test_type_filter():
    s = parse("A { int x; B b; } B { C c; int y; } C { int z; }")
    assert query.TypeFilter().exclude_all().include_recursive("B").resolve(s) == {"B": {"c", "y"}, "C": {"z"}}
    f = query.TypeFilter().exclude_recursive("B").include("B", "y")
    assert f.resolve(s) == {"A": {"x", "b"}, "B": {"y"}} and query.TypeFilter.parse(str(f)).resolve(s) == f.resolve(s)


def test_key_text():
    kinds = [T.IntegerType(), T.StringType()]
    assert query.parse_key(r"7:a\:b", kinds) == [7, "a:b"]
    with pytest.raises(ValueError):
        query.parse_key("x:y", kinds)
