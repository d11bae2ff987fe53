"""Keyed access: unique keys, nested hash index, prefixes, integer sets. An index is a lazy plan over the current records."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, is_dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import canonical, comparable
from ..plans.paths import expand, tuples, type_of
from .dataset import Dataset


class UniqueKeyIndex:
    """Records by key; paths run through one-field structs by themselves. `only` indexes a part of the rows."""

    def __init__(self, df: DataFrame, keys: Sequence[str], only: Column | None = None):
        if not keys:
            raise ValueError("a key needs a field path")
        self.df, self.paths = df if only is None else df.filter(only), [expand(df.schema, k) for k in keys]

    def match(self, *key) -> DataFrame:
        """The record of a key, none for a wrong number of parts; any of several if the key isn't unique."""
        if len(key) != len(self.paths) or any(k is None for k in key):
            return self.df.limit(0)
        return self.df.filter(self._equal(key)).limit(1)

    def _equal(self, key) -> Column:
        out = F.lit(True)
        for p, v in zip(self.paths, key):
            out = out & (F.col(p) == F.lit(v))
        return out

    def match_all(self, probe: DataFrame, on: Sequence[str]) -> DataFrame:
        """Each probe row with its record (columns null for none). Spark picks the join by size."""
        condition = F.lit(True)
        left, right = probe.alias("probe"), self.df.alias("record")
        for p, c in zip(self.paths, on):
            condition = condition & (F.col(f"record.{p}") == F.col(f"probe.{c}"))
        return left.join(right, condition, "left").select("probe.*", "record.*")

    def duplicates(self) -> DataFrame:
        """Keys of several records, with their count."""
        names = [p.replace(".", "_") for p in self.paths]
        return self.df.groupBy(*[F.col(p).alias(n) for p, n in zip(self.paths, names)]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")

    def has_duplicates(self) -> bool:
        return not self.duplicates().limit(1).isEmpty()

    def key_of(self) -> DataFrame:
        return self.df.select(F.struct(*[F.col(p).alias(p.replace(".", "_")) for p in self.paths]).alias("key"), "*")

    def key_matches(self, *key) -> Column:
        """Whether a record of the index has the key: for use in a selection over its rows."""
        return F.coalesce(self._equal(key), F.lit(False)) if len(key) == len(self.paths) else F.lit(False)

    def display(self, *key, given: DataFrame | None = None) -> DataFrame:
        """The record to show for a key: the given one, if it has the key, else the index's."""
        found = self.match(*key)
        if given is None:
            return found
        return given.filter(self.key_matches(*key)).withColumn("__g", F.lit(0)).unionByName(found.withColumn("__g", F.lit(1))).orderBy("__g").limit(1).drop("__g")

    def key_hash(self, shards: int) -> Column:
        """A shard from 0 for a record's key; equal keys have equal shards, whatever the version."""
        return F.pmod(F.xxhash64(*[F.col(p) for p in self.paths]), F.lit(shards)).cast("int")


class HashIndex:
    """Match on any paths, select the record or something nested in it; results are distinct.

    A select path that ends in a scalar selects the record that holds it ("" and "a" the root alike).
    """

    def __init__(self, df: DataFrame, select: str, match: Sequence[str], distinct: bool = False):
        """distinct: the records are known to differ (they have a primary key), so that found roots needn't be told apart by their content."""
        kind = type_of(df.schema, select)
        while select and not isinstance(kind, T.StructType):
            select = select.rpartition(".")[0]
            kind = type_of(df.schema, select)
        for m in match:
            type_of(df.schema, m)
        self.df, self.select, self.match, self.kind, self.distinct = df, select, list(match), kind, distinct

    def find(self, *values) -> DataFrame:
        """Selected records whose match paths have the values; null is no query value.

        Values are known, so they are tested inside each record, with no explode, where no two paths need one element; what is selected is exploded alone.
        """
        if len(values) != len(self.match) or any(v is None for v in values):
            raise ValueError("one value that isn't null for each match path")
        if not self.select:
            fits = self._fits(F.struct(*[F.col(f"`{c}`") for c in self.df.columns]), self.df.schema, [(m.split("."), v) for m, v in zip(self.match, values)])
            rows = self.df.filter(fits)
            if self.distinct:
                return rows
            key = F.struct(*comparable(rows, rows.columns))
            return rows.withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
        rows = tuples(self.df, [*self.match, self.select])
        for i, v in enumerate(values):
            rows = rows.filter(F.col(f"p{i}") == F.lit(v))
        return self._selected(rows, [])

    @staticmethod
    def _fits(column: Column, kind: T.DataType, paths: list[tuple[list[str], object]]) -> Column:
        """Whether some combination of values along the paths has all of theirs: paths that go on into one collection have to meet in one element of it."""
        out, below = F.lit(True), {}
        for names, value in paths:
            if not names:
                out = out & F.coalesce(column == F.lit(value), F.lit(False))
            else:
                below.setdefault(names[0], []).append((names[1:], value))
        if isinstance(kind, T.ArrayType) and below:
            return out & F.coalesce(F.exists(column, lambda x: HashIndex._fits(x, kind.elementType, below["element"])), F.lit(False))
        if isinstance(kind, T.MapType) and below:
            return out & F.coalesce(F.exists(F.map_entries(column), lambda e: HashIndex._fits(e, T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]), [([n, *rest], v) for n, found in below.items() for rest, v in found])), F.lit(False))
        for name, found in below.items():
            out = out & HashIndex._fits(column.getField(name), kind[name].dataType, found)
        return out

    def count(self, *values) -> int:
        return self.find(*values).count()

    def contains(self, records: DataFrame, *values) -> DataFrame:
        """Those of the records, of the selected kind, that the values find."""
        found = self.find(*values)
        return records.alias("l").join(found.alias("r"), on_columns("l", "r", found.columns), "left_semi")

    def find_all(self, probe: DataFrame, on: Sequence[str]) -> DataFrame:
        """Each probe row's selected records: probe columns, then the record's. Only what is matched and selected goes through the join."""
        rows, condition = tuples(self.df, [*self.match, self.select]).drop("root"), F.lit(True)
        for i, c in enumerate(on):
            condition = condition & (F.col(f"p{i}") == F.col(f"`{c}`"))
        return self._selected(rows.join(probe, condition), probe.columns)

    def _selected(self, rows: DataFrame, carry: list[str]) -> DataFrame:
        last = f"p{len(self.match)}"
        rows = rows.filter(F.col(last).isNotNull())
        # Whole records are told apart by their content; maps in a form that compares.
        key = canonical(F.col(last), self.kind)
        return rows.select(*carry, F.col(last), key.alias("__key")).dropDuplicates([*carry, "__key"]).select(*carry, f"{last}.*")


def on_columns(left: str, right: str, names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{left}.`{n}`").eqNullSafe(F.col(f"{right}.`{n}`"))
    return out


@dataclass(frozen=True)
class Find:
    """A typed facade over the indexes: Find(df).using("a.b", "c").select("d").matches(1, 2); query beans are dataclasses whose fields name paths.

    unique() looks up one record by key; a null part of a key is dropped with its path, and a key of nulls finds nothing.
    """

    df: DataFrame
    paths: tuple[str, ...] = ()
    selected: str = ""

    def using(self, *paths: str) -> Find:
        return replace(self, paths=(*self.paths, *paths))

    def using_bean(self, bean: type) -> Find:
        """Paths from a dataclass: a field's metadata "path", or its name."""
        return self.using(*[f.metadata.get("path", f.name) for f in fields(bean)])

    def select(self, path: str) -> Find:
        return replace(self, selected=path)

    def matches(self, *values) -> DataFrame:
        """Records found; values one by one or as one query bean."""
        return HashIndex(self.df, self.selected, self.paths).find(*self._values(values))

    def unique(self, *values) -> DataFrame:
        known = [(p, v) for p, v in zip(self.paths, self._values(values), strict=True) if v is not None]
        return UniqueKeyIndex(self.df, [p for p, _ in known]).match(*[v for _, v in known]) if known else self.df.limit(0)

    @staticmethod
    def _values(values: tuple) -> tuple:
        return tuple(getattr(values[0], f.name) for f in fields(values[0])) if len(values) == 1 and is_dataclass(values[0]) else values


class CurrentIndex:
    """An index that follows a consumer: built anew when the consumer's version has changed, the same plan (cached, if asked) until then."""

    def __init__(self, state: Callable[[], Dataset | None], t: str, build: Callable[[DataFrame], object], cache: bool = False):
        self.state, self.t, self.build, self.cache = state, t, build, cache
        self.version: int | None = None
        self._index: object = None
        self._held: DataFrame | None = None

    def get(self):
        now = self.state()
        if now is None:
            raise LookupError("no version is loaded")
        if self.version != now.version:
            if self._held is not None:
                self._held.unpersist()
            df = now.types[self.t]
            self._held = df.persist() if self.cache else None
            self._index, self.version = self.build(df), now.version
        return self._index


class PrefixIndex:
    """Records by beginnings of the strings along a path; `keys` may cut a string into several keys."""

    def __init__(self, df: DataFrame, path: str, case_sensitive: bool = False, keys: Callable[[Column], Column] | None = None):
        self.df, self.case = df, case_sensitive
        rows = tuples(df, [path]).filter("p0 IS NOT NULL")
        rows = rows.select("root", (F.explode(keys(F.col("p0"))) if keys else F.col("p0")).alias("key"))
        self.rows = rows if case_sensitive else rows.withColumn("key", F.lower("key"))

    def _text(self, text: str) -> Column:
        return F.lit(text) if self.case else F.lower(F.lit(text))

    def _records(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__id", canonical(F.col("root"), self.df.schema)).dropDuplicates(["__id"]).select("root.*")

    def with_prefix(self, prefix: str) -> DataFrame:
        return self._records(self.rows.filter(F.col("key").startswith(self._text(prefix))))

    def longest_match(self, text: str) -> DataFrame:
        """Records of the longest key that the text begins with."""
        fit = self.rows.filter(self._text(text).startswith(F.col("key")))
        longest = fit.agg(F.max(F.length("key")).alias("longest"))
        return self._records(fit.join(F.broadcast(longest), F.length("key") == F.col("longest")).drop("longest"))

    def contains(self, key: str) -> bool:
        return not self.rows.filter(F.col("key") == self._text(key)).limit(1).isEmpty()


class IntSet:
    """The distinct integers along a path, over rows that pass a predicate."""

    def __init__(self, df: DataFrame, path: str, where: Column | None = None):
        self.values = tuples(df if where is None else df.filter(where), [path]).select(F.col("p0").alias("value")).filter("value IS NOT NULL").distinct()

    def cardinality(self) -> DataFrame:
        return self.values.agg(F.count(F.lit(1)).alias("cardinality"))

    def contains(self, value: int) -> bool:
        return not self.values.filter(F.col("value") == value).limit(1).isEmpty()

    def members(self, df: DataFrame, column: str) -> DataFrame:
        return df.join(self.values, df[column] == self.values["value"], "left_semi")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")
