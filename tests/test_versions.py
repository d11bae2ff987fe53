"""Evolved schemas, failed cycles, null keys, objects, defaults, and every query of the toolkit against its SQL."""

from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions import records as R
from lodestrata.operators import algebra, diff, state
from lodestrata.operators.dataset import Dataset, Reference
from lodestrata.operators.index import Find, HashIndex, UniqueKeyIndex
from lodestrata.operators.lifecycle import Consumer, Producer
from lodestrata.operators.objects import ObjectMapper, RecordWriter, empty, round_trip
from lodestrata.sources.json_records import chunks, discover, flat_records
from lodestrata.sources.store import Store


def of(spark, rows, schema):
    return Dataset({"T": spark.createDataFrame(rows, schema)}, {"T": ("k",)})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_columns_come_and_go(spark, tmp_path):
    """Over deltas forward and back, through a producer with its integrity check."""
    store = Store(spark, f"file://{tmp_path}")
    p = Producer(store, snapshot_every=100)
    first = p.run_cycle(lambda _: of(spark, [(1, "a"), (2, "b"), (None, "n")], "k int, v string"))
    second = p.run_cycle(lambda _: of(spark, [(1, "a", 7), (2, "b", None), (None, "n", 1)], "k int, v string, w int"))
    third = p.run_cycle(lambda _: of(spark, [(7, 1), (None, 2), (1, None)], "w int, k int"))
    c = Consumer(store)
    assert rows(c.refresh(first).types["T"]) == rows(p.store.snapshot(first).types["T"])
    assert rows(c.refresh(second).types["T"]) == [(1, "a", 7), (2, "b", None), (None, "n", 1)] and not store.manifest(second).snapshot
    assert c.refresh(third).types["T"].columns == ["w", "k"] and rows(c.state.types["T"]) == [(1, None), (7, 1), (None, 2)]
    assert rows(c.refresh(first).types["T"]) == [(1, "a"), (2, "b"), (None, "n")]
    assert p.current.tags["schema_changed"] == "true"


def test_types_come_and_go(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    p = Producer(store, snapshot_every=100)
    first = p.run_cycle(lambda _: Dataset({"A": a}))
    second = p.run_cycle(lambda _: Dataset({"A": a, "B": b}))
    third = p.run_cycle(lambda _: Dataset({"B": b}))
    c = Consumer(store)
    c.refresh(first)
    assert set(c.refresh(second).types) == {"A", "B"} and rows(c.state.types["B"]) == [(2,)]
    assert set(c.refresh(third).types) == {"B"} and set(c.refresh(first).types) == {"A"}


def test_a_failed_cycle_leaves_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")

    def veto(event, version, details):
        if event == "validated" and state_of["stop"]:
            raise RuntimeError("vetoed")

    state_of = {"stop": False}
    p = Producer(store, listeners=[veto])
    first = p.run_cycle(lambda _: of(spark, [(1, "a")], "k int, v string"))
    state_of["stop"] = True
    with pytest.raises(RuntimeError, match="vetoed"):
        p.run_cycle(lambda _: of(spark, [(2, "b")], "k int, v string"))
    assert store.versions() == [first] and store.announced() == first and p.current.version == first
    files = [f for f in tmp_path.rglob("*.parquet") if f"version={first}" not in str(f)]
    assert not files and rows(Consumer(store).refresh().types["T"]) == [(1, "a")]
    with pytest.raises(ZeroDivisionError):
        p.run_cycle(lambda _: 1 / 0)


def test_alike_records_are_one(spark, tmp_path):
    p = Producer(Store(spark, f"file://{tmp_path}"))
    p.run_cycle(lambda _: Dataset({"A": spark.createDataFrame([(1,), (1,)], "x int")}))
    assert p.run_cycle(lambda _: Dataset({"A": spark.createDataFrame([(1,)], "x int")})) is None


def test_compaction_survives_and_is_named(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    p = Producer(store)
    v = p.run_cycle(lambda _: of(spark, [(i, str(i)) for i in range(50)], "k int, v string"))
    before = rows(p.current.types["T"])
    assert p.run_compaction_cycle(least=1 << 30) == ["T"] and p.run_compaction_cycle(least=1 << 30) == []
    assert rows(store.snapshot(v).types["T"]) == before and store.manifest(v).moved["T"].startswith("compacted=")
    store.clean(keep=0)
    assert not list(tmp_path.rglob("*.parquet"))


def test_null_keys(spark):
    a = spark.createDataFrame([(None, 1, "x"), (1, None, "y"), (2, 2, "z")], "a int, b int, v string")
    b = spark.createDataFrame([("x", None, 1), ("Y", 1, None), ("w", None, None)], "v string, a int, b int")
    assert state.changes(a, a, ["a", "b"]).count() == 0
    got = {(r.a, r.b): r.change for r in state.changes(a, b, ["a", "b"]).collect()}
    assert got == {(1, None): "updated", (2, 2): "removed", (None, None): "added"}
    assert {(r.a, r.b): r.side for r in diff.match(a, b, ["a", "b"]).collect()} == {(None, 1): "matched", (1, None): "matched", (2, 2): "from_only", (None, None): "to_only"}
    events = spark.createDataFrame([(None, 1, "new", 1, "upsert"), (2, 2, None, 1, "delete"), (None, None, "i", 1, "insert"), (1, None, "no", 1, "insert")], "a int, b int, v string, seq int, action string")
    assert rows(state.mutate(a, events, ["a", "b"])) == sorted([(None, 1, "new"), (1, None, "y"), (None, None, "i")], key=repr)


def test_two_steps(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    one, two = state.two_steps(a, b, ["k"])
    for d in (one, two):
        assert not {r.k for r in d.added.collect()} & {r.k for r in d.removed.collect()}
    assert rows(state.apply(state.apply(a, one), two)) == rows(b)


def test_combine_moves_references(spark):
    refs = (Reference("A", "B", "b", "id"), Reference("B", "C", "c", "id"))

    def make(a, b, c):
        return Dataset({"A": spark.createDataFrame(a, "name string, b int"), "B": spark.createDataFrame(b, "id int, name string, c int"), "C": spark.createDataFrame(c, "id int, name string")}, {}, refs)

    one = make([("a1", 1)], [(1, "b1", 1)], [(1, "c1")])
    two = make([("a1", 10), ("a2", 11)], [(10, "b1", 100), (11, "b2", 100)], [(100, "c1")])
    got = algebra.combine([one, two], {"B": ["name", "c"], "C": ["name"]}).types
    # c1 is the first input's; so both b1 have one key; so both a1 are alike
    assert rows(got["C"]) == [(1, "c1")] and rows(got["B"]) == [(1, "b1", 1), (11, "b2", 1)] and rows(got["A"]) == [("a1", 1), ("a2", 11)]
    with pytest.raises(ValueError):
        algebra.combine([one, two], {"X": ["name"]})


@dataclass
class Tag:
    name: str


@dataclass
class Movie:
    __primary_key__ = ("id", "lead.name")
    id: int
    title: str | None
    lead: Tag | None
    tags: list[Tag] = field(default_factory=list)
    votes: dict[str, int] = field(default_factory=dict)


def test_objects_go_in_and_out(spark):
    m = ObjectMapper(spark)
    one = Movie(1, "x", Tag("t"), [Tag("a"), Tag("b")], {"u": 3})
    assert m.add(one) == (1, "t") and m.add(Movie(2, None, None)) == (2, None) and m.add(one) == (1, "t")
    d = m.dataset()
    assert d.types["Movie"].count() == 2 and d.keys["Movie"] == ("id", "lead.name")
    assert sorted(m.read(d.types["Movie"], Movie), key=lambda x: x.id) == [one, Movie(2, None, None)]
    assert m.find(d.types["Movie"], Movie, 1, "t") == one and m.find(d.types["Movie"], Movie, 1, "z") is None
    assert list(m.read(d.types["Movie"].drop("tags", "votes").filter("id = 2"), Movie)) == [Movie(2, None, None)]
    assert empty(spark, m.schemas, ["Movie"]).types["Movie"].schema == d.types["Movie"].schema


def test_written_records_and_round_trip(spark, tmp_path):
    w = RecordWriter(T.StructType().add("a", "integer").add("b", T.ArrayType(T.StringType())))
    df = w.set("a", 1).set("b", ["x"]).reset().set("b", []).reset().frame(spark)
    assert rows(df) == [(1, ["x"]), (None, [])]
    with pytest.raises(KeyError):
        w.set("c", 1)
    assert rows(round_trip(Dataset({"T": df}), f"file://{tmp_path}").types["T"]) == rows(df)


def test_nested_hash_index_without_explode(spark):
    """Paths into one collection meet in one element; independent collections multiply; maps and empty branches."""
    schema = "id int, xs array<struct<a: int, b: int, ys: array<int>>>, m map<string, int>"
    data = [(1, [(1, 2, [5]), (3, 4, [])], {"k": 1}), (2, [(1, 4, [6]), (3, 2, [5])], {"k": 2}), (3, [], {}), (4, None, None), (1, [(1, 2, [5]), (3, 4, [])], {"k": 1})]
    df = spark.createDataFrame(data, schema)
    ids = lambda paths, *values: sorted(r.id for r in HashIndex(df, "", paths).find(*values).collect())
    assert ids(["xs.element.a", "xs.element.b"], 1, 2) == [1] and ids(["xs.element.a", "xs.element.b"], 3, 2) == [2]
    assert ids(["xs.element.a", "xs.element.ys.element"], 1, 5) == [1] and ids(["xs.element.ys.element", "m.value"], 5, 2) == [2]
    assert ids(["m.key", "m.value"], "k", 1) == [1] and ids(["id"], 3) == [3] and ids(["xs.element.a"], 9) == []
    assert HashIndex(df, "", ["id"]).count(1) == 1 and [r.a for r in HashIndex(df, "xs.element", ["id"]).find(2).orderBy("a").collect()] == [1, 3]


def test_typed_find(spark):
    @dataclass
    class Query:
        a: int
        other: str = field(default="", metadata={"path": "n.s"})

    df = spark.createDataFrame([(1, ("x",)), (1, ("y",)), (2, ("x",))], "a int, n struct<s: string>")
    assert Find(df).using_bean(Query).matches(Query(1, "y")).count() == 1
    assert Find(df).using("a", "n.s").unique(2, None).count() == 1 and Find(df).using("a", "n.s").unique(None, None).count() == 0
    index = UniqueKeyIndex(df, ["a", "n.s"])
    assert index.display(1, "x", given=df.filter("n.s = 'y'")).first().n.s == "x" and index.display(1, "x", given=df.filter("a = 1 AND n.s = 'x'")).count() == 1


def test_json_pieces(spark):
    df = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ("[]",), ("nothing",)], "value string")
    assert sorted((r.position, r.value) for r in chunks(df).collect()) == [(0, '{"a":1}'), (1, '{"a":2}')]
    texts = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": 1.5, "c": [true]}',), ("{bad",), (None,)], "value string")
    assert {f.name: f.dataType.simpleString() for f in discover(texts)} == {"a": "double", "b": "string", "c": "array<boolean>"}
    with pytest.raises(ValueError, match="bad"):
        discover(texts, strict=True)
    got = flat_records(texts, discover(texts)).collect()
    assert [r.record.a for r in got[:2]] == [1.0, 1.5]


def test_indented_text(spark):
    df = spark.createDataFrame([(1, ("w",), [3, 1], {"k": (5, None)}), (2, None, None, None)], "id int, one struct<value: string>, s array<int>, m map<string, struct<a: int, b: int>>")
    got = [r.t for r in df.select(R.to_lines(df, sort=("s",)).alias("t")).collect()]
    assert got[0] == "\n  id: 1\n  one: w\n  s: \n    e: 1\n    e: 3\n  m: \n    k: k\n    v: \n      a: 5\n      b: null"
    assert got[1] == "\n  id: 2\n  one: null\n  s: null\n  m: null"
    assert df.select(R.to_lines(df, exclude=("m",), collapse=False).alias("t")).first().t.startswith("\n  id: 1\n  one: \n    value: w")


def test_values_compare(spark):
    df = spark.createDataFrame([(1, 2), (2, 2), (None, 1), (None, None), (3, None)], "a int, b int")
    assert [r.c for r in df.select(R.compared(F.col("a"), F.col("b")).alias("c")).collect()] == [-1, 0, -1, 0, 1]
