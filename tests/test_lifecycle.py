import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators import validate
from lodestrata.operators.dataset import Dataset, Reference
from lodestrata.operators.lifecycle import Consumer, Producer
from lodestrata.sources import json_records as J
from lodestrata.sources.store import Store, VersionError


def make(spark, rows, tags=None):
    return Dataset({"T": spark.createDataFrame(rows, "id int, v string")}, {"T": ("id",)}, (), 0, tags or {})


def rows(state):
    return sorted(map(tuple, state.types["T"].collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}")


def test_cycles_and_refresh(spark, store):
    p = Producer(store, [validate.duplicate_keys("T", ["id"])], snapshot_every=2)
    first = p.run_cycle(lambda _: make(spark, [(1, "a"), (2, "b")]))
    assert p.run_cycle(lambda b: make(spark, [(2, "b"), (1, "a")])) is None
    c = Consumer(store)
    assert rows(c.refresh()) == [(1, "a"), (2, "b")]
    second = p.run_cycle(lambda _: make(spark, [(2, "B"), (3, "c")]))
    assert first < second and not store.manifest(second).snapshot
    assert store.plan(first, second) == [("delta", second)]
    assert rows(c.refresh()) == [(2, "B"), (3, "c")]
    assert rows(c.refresh(first)) == [(1, "a"), (2, "b")]  # over the reverse delta
    assert rows(Consumer(store, pinned=first).refresh()) == [(1, "a"), (2, "b")]
    with pytest.raises(validate.ValidationError):
        p.run_cycle(lambda _: make(spark, [(2, "x"), (2, "y")]))
    assert store.announced() == second and rows(p.current) == [(2, "B"), (3, "c")]
    with pytest.raises(VersionError):
        store.step(store.snapshot(first), 1)


def test_incremental_removes_orphans(spark, store):
    s = Dataset({"T": spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id int, c int"), "C": spark.createDataFrame([(10,), (20,)], "c int")}, {"T": ("id",), "C": ("c",)}, (Reference("T", "C", "c", "c"),))
    p = Producer(store)
    p.run_cycle(lambda _: s)
    e = spark.createDataFrame([(1, None, 1, "delete"), (2, None, 1, "delete")], "id int, c int, seq int, action string")
    p.run_incremental("T", e, ["id"])
    assert [r.id for r in p.current.types["T"].collect()] == [3] and [r.c for r in p.current.types["C"].collect()] == [20]


def test_not_primary(spark, store):
    assert Producer(store, is_primary=lambda: False).run_cycle(lambda _: make(spark, [(1, "a")])) is None


def test_clean_compact_parts(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}", parts={"T": "side"})
    p = Producer(store)
    v = [p.run_cycle(lambda _, i=i: make(spark, [(i, "a")])) for i in range(3)]
    assert store.clean(keep=2) == v[:1] and rows(store.load(v[2])) == [(2, "a")]
    store.compact(v[2], 1)
    assert rows(store.load(v[2])) == [(2, "a")] and (tmp_path / "part=side").exists()
    assert store.footprint().filter("bytes > 0").count() > 0


def test_validators(spark):
    a, b = make(spark, [(i, "x") for i in range(10)]), make(spark, [(i, "x") for i in range(11)])
    assert validate.minimum_count("T", 12)(b, a).status == "FAILED"
    assert validate.count_variance("T", 10)(b, a).ok and not validate.count_variance("T", 9)(b, a).ok
    assert not validate.percent_change("T", added=10)(b, a).ok and validate.percent_change("T", added=10.1)(b, a).ok
    assert validate.percent_change("T", added=0)(b, None).status == "SKIPPED"
    assert validate.object_modification("T", F.col("after.v") == F.col("before.v"))(b, a).ok
    with pytest.raises(validate.ValidationError) as e:
        validate.run([lambda now, before: 1 / 0, validate.null_keys("T", ["id"])], b, a)
    assert [o.status for o in e.value.outcomes] == ["ERROR", "PASSED"]


def test_json(spark):
    texts = ['{"id": 1, "m": {"a": 1}, "x": "q", "l": [1, "b"], "o": {"p": 1}, "n": null}', '{"id": 2, "m": [{"key": "b", "value": 2}], "deep": {"y": "z"}}', "{}"]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    kind = T.StructType.fromDDL("id long, m map<string,int>, far string")
    got = J.ingest(df, kind, remap={"far": "deep.y"}, processors={"id": lambda c: c + 1}).collect()
    assert [(r.id, r.m, r.far) for r in got[:2]] == [(2, {"a": 1}, None), (3, {"b": 2}, "z")] and got[2].id is None
    p = J.passthrough(df, ["id", "m"]).first()
    assert p.single_values == {"x": "q"} and p.multi_values == {"l": ["1", "b"]}
    assert J.find_key(df, ["deep.y"]).collect()[1].deep_y == "z"
    found = J.discover(df.limit(1), maps=["m"])
    assert isinstance(found["m"].dataType, T.MapType) and isinstance(found["id"].dataType, T.LongType)


def test_streams(spark, tmp_path):
    from lodestrata.streaming.follow import apply_mutations, follow_announcements

    store = Store(spark, f"file://{tmp_path}/store")
    p = Producer(store)
    p.run_cycle(lambda _: make(spark, [(1, "a")]))
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.json").write_text(json.dumps({"id": 2, "v": "b", "seq": 1, "action": "upsert"}))
    q = apply_mutations(spark.readStream.schema("id int, v string, seq int, action string").json(str(events)), p, "T", ["id"], f"file://{tmp_path}/c1")
    q.processAllAvailable(), q.stop()
    assert rows(p.current) == [(1, "a"), (2, "b")]
    c = Consumer(store)
    q = follow_announcements(spark, c, f"file://{tmp_path}/c2")
    q.processAllAvailable(), q.stop()
    assert rows(c.state) == [(1, "a"), (2, "b")]
