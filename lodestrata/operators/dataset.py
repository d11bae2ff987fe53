"""A dataset state: record types as DataFrames, their keys, the references between them, and closures over those."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import RID, canonical, comparable, with_id
from ..plans.schema import TypeSchema


@dataclass(frozen=True)
class Reference:
    """Records of `parent` refer to those of `child` where parent_column = child_column."""

    parent: str
    child: str
    parent_column: str
    child_column: str


@dataclass(frozen=True)
class Dataset:
    """types: one DataFrame a record type; keys: primary key columns; references: a DAG of types."""

    types: Mapping[str, DataFrame]
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()
    version: int = 0
    tags: Mapping[str, str] = field(default_factory=dict)

    def order(self) -> list[str]:
        """Referenced types first."""
        graph = TopologicalSorter({t: {r.child for r in self.references if r.parent == t} for t in sorted(self.types)})
        return [t for t in graph.static_order() if t in self.types]

    def top_level(self) -> set[str]:
        return set(self.types) - {r.child for r in self.references}

    def get(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """A type's records; an absent type is empty, if its schema is given."""
        if name in self.types or schema is None:
            return self.types[name]
        return next(iter(self.types.values())).sparkSession.createDataFrame([], schema)

    def counts(self) -> DataFrame:
        """Records of each type."""
        parts = [df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(t).alias("type"), "records") for t, df in sorted(self.types.items())]
        return _union(parts)

    def checksum(self, columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """Per type a count and a sum over content, independent of order and layout; equal content gives equal rows. columns: only these types and columns of them."""
        parts = []
        for t, df in sorted(self.types.items()):
            if columns is not None and t not in columns:
                continue
            ids = with_id(df.select(*columns[t]) if columns is not None else df).select(RID)
            parts.append(ids.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.xxhash64(RID).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum")).select(F.lit(t).alias("type"), "records", "checksum"))
        return _union(parts)

    def common_columns(self, other: Dataset) -> dict[str, list[str]]:
        """Types of both states with their columns of one name and kind, in order of name: what a checksum of common schemas runs over."""
        out = {}
        for t in sorted(self.types.keys() & other.types.keys()):
            theirs = {f.name: f.dataType for f in other.types[t].schema}
            out[t] = sorted(f.name for f in self.types[t].schema if theirs.get(f.name) == f.dataType)
        return {t: c for t, c in out.items() if c}

    def field_statistics(self) -> DataFrame:
        """Per field: nulls, distinct values (exact), and the bytes of its text form (JSON for nested ones), largest and in total."""
        parts = []
        for t, df in sorted(self.types.items()):
            aggs, nested = [], (T.StructType, T.ArrayType, T.MapType)
            for f in df.schema:
                c = F.col(f"`{f.name}`")
                size = F.octet_length(F.to_json(F.struct(c)) if isinstance(f.dataType, nested) else c.cast("binary" if isinstance(f.dataType, T.BinaryType) else "string"))
                aggs += [F.count(F.when(c.isNull(), 1)).alias(f"{f.name}/n"), F.count_distinct(canonical(c, f.dataType)).alias(f"{f.name}/d"), F.max(size).alias(f"{f.name}/m"), F.sum(size).alias(f"{f.name}/s")]
            of = lambda c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("field"), F.col(f"`{c}/n`").alias("nulls"), F.col(f"`{c}/d`").alias("distinct_values"), F.col(f"`{c}/m`").cast("long").alias("max_bytes"), F.col(f"`{c}/s`").cast("long").alias("total_bytes"))  # noqa: E731, B023
            parts.append(df.agg(*aggs).select(F.explode(F.array(*map(of, df.columns))).alias("x")).select("x.*"))
        return _union(parts)

    def with_defaults(self, schemas: Mapping[str, T.StructType], defaults: Mapping[str, Mapping[str, object]] | None = None) -> Dataset:
        """The types and columns that a reader expects: an absent type is empty, an absent column has its default, null without one; others are left out."""
        out = {}
        for t, schema in schemas.items():
            df, given = self.get(t, schema), (defaults or {}).get(t, {})
            out[t] = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in schema])
        return Dataset(out, self.keys, self.references, self.version, self.tags)

    # Closures: selections are type -> DataFrame of records; a semi join per reference, so cost follows the schema's edges.

    def _names(self, t: str) -> list[str]:
        return self.types[t].columns

    def _merge(self, t: str, a: DataFrame | None, b: DataFrame) -> DataFrame:
        if a is None:
            return b
        out = a.unionByName(b)
        return out.withColumn("__c", F.struct(*comparable(out, self._names(t)))).dropDuplicates(["__c"]).drop("__c")

    def children(self, seeds: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Seeds and everything they reach, parents first."""
        out = dict(seeds)
        for t in reversed(self.order()):
            for r in self.references:
                if r.parent == t and t in out:
                    reached = self.types[r.child].join(out[t].select(F.col(r.parent_column).alias("__k")), F.col(r.child_column) == F.col("__k"), "left_semi")
                    out[r.child] = self._merge(r.child, out.get(r.child), reached)
        return out

    def referrers(self, seeds: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """Seeds and everything that refers to them, directly or over others; children first."""
        out = dict(seeds)
        for t in self.order():
            for r in self.references:
                if r.child == t and t in out:
                    refer = self.types[r.parent].join(out[t].select(F.col(r.child_column).alias("__k")), F.col(r.parent_column) == F.col("__k"), "left_semi")
                    out[r.parent] = self._merge(r.parent, out.get(r.parent), refer)
        return out

    def unreferenced(self, closure: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        """The closure without records that something outside it refers to, seeds included; a removal frees nothing below it either."""
        out = dict(closure)
        for t in reversed(self.order()):
            for r in self.references:
                if r.child != t or t not in out or r.parent not in self.types:
                    continue
                parents = self.types[r.parent]
                if r.parent in out:
                    names = self._names(r.parent)
                    inside = out[r.parent].select(F.struct(*comparable(out[r.parent], names)).alias("__c"))
                    parents = parents.withColumn("__c", F.struct(*comparable(parents, names))).join(inside, "__c", "left_anti")
                out[t] = out[t].join(parents.select(F.col(r.parent_column).alias("__k")), F.col(r.child_column) == F.col("__k"), "left_anti")
        return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def normalize(df: DataFrame, schemas: Mapping[str, TypeSchema], name: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Nested records as one table per object type with content ids, and edges (parent_type, parent, field, position, child_type, child).

    Each level is one explode of the level above; equal records collapse.
    """
    tables: dict[str, list[DataFrame]] = {}
    edges: list[DataFrame] = []

    def visit(rows: DataFrame, own: str) -> None:
        rows = with_id(rows)
        tables.setdefault(own, []).append(rows)
        for f, t in schemas[own].fields:
            s = schemas.get(t)
            if s is None:
                continue
            target, source = t, F.col(f"`{f}`")
            if s.kind == "object":
                part = rows.select(F.col(RID).alias("parent"), F.lit(0).alias("position"), source.alias("child")).filter("child IS NOT NULL")
            elif s.kind in ("list", "set"):
                target = s.element
                part = rows.select(F.col(RID).alias("parent"), F.posexplode(source).alias("position", "child"))
            else:
                target = s.element
                part = rows.select(F.col(RID).alias("parent"), F.posexplode(F.map_values(source)).alias("position", "child"))
            if target not in schemas:
                continue
            if not isinstance(part.schema["child"].dataType, T.StructType):
                part = part.withColumn("child", F.struct(F.col("child").alias("value")))
            part = part.filter("child IS NOT NULL")
            child = part.select("child.*")
            edges.append(with_id(part.select("parent", "position", "child.*"), child.columns).select(F.lit(own).alias("parent_type"), "parent", F.lit(f).alias("field"), "position", F.lit(target).alias("child_type"), F.col(RID).alias("child")))
            visit(child, target)

    visit(df, name)
    empty = df.sparkSession.createDataFrame([], "parent_type string, parent string, field string, position int, child_type string, child string")
    return {t: _union(p).dropDuplicates([RID]) for t, p in tables.items()}, _union(edges).distinct() if edges else empty
