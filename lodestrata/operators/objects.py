"""Dataclass objects in and out of datasets, records built field by field, and a cache of query results by version."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ..plans.schema import from_dataclass, spark_type
from .dataset import Dataset
from .index import UniqueKeyIndex


class ObjectMapper:
    """Objects of dataclasses as records: add() collects them, dataset() makes the states, read() gives objects back.

    Alike objects are one record. A mapper holds what was added until dataset(); for states that the driver can hold.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.schemas, self.classes = spark, {}, {}
        self.added: dict[str, dict[tuple, tuple]] = {}

    def register(self, cls: type) -> T.StructType:
        if cls.__name__ not in self.classes:
            self.schemas |= from_dataclass(cls)
            self.classes[cls.__name__] = cls
        return spark_type(self.schemas, cls.__name__)

    def add(self, value) -> tuple:
        """The record's primary key values (its whole content without a key)."""
        cls = type(value)
        kind = self.register(cls)
        record = _plain(value, kind)
        self.added.setdefault(cls.__name__, {})[_frozen(record)] = record
        return self.key(value)

    def key(self, value) -> tuple:
        """The primary key of an object; paths step through objects."""
        paths = self.schemas[type(value).__name__].key if type(value).__name__ in self.schemas else getattr(type(value), "__primary_key__", ())
        out = []
        for path in paths:
            at = value
            for name in path.split("."):
                at = None if at is None else getattr(at, name)
            out.append(at)
        return tuple(out) if paths else (value,)

    def dataset(self) -> Dataset:
        types = {t: self.spark.createDataFrame(list(rows.values()), spark_type(self.schemas, t)) for t, rows in self.added.items()}
        return Dataset(types, {t: self.schemas[t].key for t in types if self.schemas[t].key})

    def read(self, df: DataFrame, cls: type) -> Iterable:
        """Records as objects, one by one; fields that the class lacks are left out, those that the record lacks take the class's default."""
        self.register(cls)
        for row in df.toLocalIterator():
            yield _object(row, cls)

    def find(self, df: DataFrame, cls: type, *key):
        """The object of a key, or None."""
        self.register(cls)
        found = UniqueKeyIndex(df, self.schemas[cls.__name__].key).match(*key).first()
        return None if found is None else _object(found, cls)


def _plain(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_plain(getattr(value, f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        items = [_plain(x, kind.elementType) for x in value]
        return sorted(items, key=repr) if isinstance(value, (set, frozenset)) else items
    if isinstance(kind, T.MapType):
        return {_frozen(_plain(k, kind.keyType)): _plain(v, kind.valueType) for k, v in value.items()}
    return value


def _frozen(value):
    if isinstance(value, (list, tuple)):
        return tuple(map(_frozen, value))
    return tuple(sorted(((k, _frozen(v)) for k, v in value.items()), key=repr)) if isinstance(value, dict) else value


def _object(value, kind):
    if value is None:
        return None
    base, args = typing.get_origin(kind), [a for a in typing.get_args(kind) if a is not type(None)]
    if base in (list, set):
        return base(_object(x, args[0]) for x in value)
    if base is dict:
        return {_object(k, args[0]): _object(v, args[1]) for k, v in value.items()}
    if base is not None and len(args) == 1:
        return _object(value, args[0])
    if dataclasses.is_dataclass(kind):
        hints, names = typing.get_type_hints(kind), value.__fields__ if isinstance(value, Row) else ()
        return kind(**{f.name: _object(value[f.name], hints[f.name]) for f in dataclasses.fields(kind) if f.name in names})
    return value


class RecordWriter:
    """A record set field by field; reset() begins the next. Fields not set are null; one that the schema lacks raises."""

    def __init__(self, schema: T.StructType):
        self.schema, self.values, self.done = schema, {}, []

    def set(self, name: str, value) -> RecordWriter:
        if name not in self.schema.names:
            raise KeyError(name)
        self.values[name] = value
        return self

    def reset(self) -> RecordWriter:
        """Finish the record."""
        self.done.append(tuple(self.values.get(n) for n in self.schema.names))
        self.values = {}
        return self

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.done, self.schema)


class ByVersion:
    """A result of a state that is computed anew only when the version has changed."""

    def __init__(self, compute: Callable[[Dataset], object]):
        self.compute, self.version, self.value = compute, None, None

    def of(self, state: Dataset):
        if self.version != state.version:
            self.value, self.version = self.compute(state), state.version
        return self.value


class ColumnUsage:
    """Counts which columns of which types queries read: observe() looks at a query's plan, as pruned, before it runs."""

    def __init__(self, state: Dataset):
        self.spark = next(iter(state.types.values())).sparkSession
        self.of = {c: t for t, df in sorted(state.types.items()) for c in df.columns}
        self.counts: dict[tuple[str, str], int] = {}

    def observe(self, df: DataFrame) -> DataFrame:
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        for i in range(leaves.size()):
            output = leaves.apply(i).output()
            for j in range(output.size()):
                name = output.apply(j).name()
                if name in self.of:
                    self.counts[self.of[name], name] = self.counts.get((self.of[name], name), 0) + 1
        return df

    def report(self) -> DataFrame:
        """(type, field, reads), the most read first."""
        rows = sorted(((t, c, n) for (t, c), n in self.counts.items()), key=lambda r: (-r[2], r))
        return self.spark.createDataFrame(rows, "type string, field string, reads long")


def round_trip(state: Dataset, folder: str, names: Sequence[str] | None = None) -> Dataset:
    """Write types to a folder and read them back: what a reader of the state sees."""
    out = {}
    for t in names or state.types:
        state.types[t].write.mode("overwrite").parquet(f"{folder}/{t}")
        out[t] = state.types[t].sparkSession.read.parquet(f"{folder}/{t}")
    return Dataset(out, state.keys, state.references, state.version, state.tags)


def empty(spark: SparkSession, schemas, names: Sequence[str]) -> Dataset:
    """A state without records, from schemas: types, keys."""
    return Dataset({n: spark.createDataFrame([], spark_type(schemas, n)) for n in names}, {n: schemas[n].key for n in names if schemas[n].key})
