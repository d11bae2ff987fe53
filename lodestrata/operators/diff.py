"""Scored differences of two states: by field, by record, by nested element."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import RID, canonical, comparable
from ..plans.paths import leaves, tuples
from .dataset import Dataset, _union
from .state import on_keys


def match(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side): matched, from_only or to_only; without keys every record is on one side only."""
    if not keys:
        return before.select(F.lit("from_only").alias("side")).unionAll(after.select(F.lit("to_only").alias("side")))
    a, b = before.select(*keys, F.lit(True).alias("__f")), after.select(*keys, F.lit(True).alias("__t"))
    side = F.when(F.col("__f").isNull(), "to_only").when(F.col("__t").isNull(), "from_only").otherwise("matched")
    both = a.alias("l").join(b.alias("r"), on_keys("l", "r", keys), "full_outer")
    return both.select(*[F.when(F.col("__f").isNull(), F.col(f"r.`{k}`")).otherwise(F.col(f"l.`{k}`")).alias(k) for k in keys], side.alias("side"))


def field_scores(before: DataFrame, after: DataFrame, keys: Sequence[str], shortcuts: Sequence[str] = ()) -> DataFrame:
    """(keys, path, score) of matched records that differ: per leaf path the size of the multiset difference of its values.

    A changed scalar scores 2, one unmatched value on each side. shortcuts: paths below which nothing is descended; there
    whole unequal sub-records count. One keyed join: pairs that are alike drop out in it, and of the others all values of both sides are listed
    within the row and exploded once. A null reference has no values below it, a null scalar is one.
    """
    common = [c for c in before.columns if c in after.columns]
    side = lambda df, name: df.select(*keys, F.struct(*comparable(df, common)).alias(f"__c{name}"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    pairs = side(before, "__f").join(side(after, "__t"), list(keys))
    if set(before.columns) == set(after.columns):
        pairs = pairs.filter(~F.col("__c__f").eqNullSafe(F.col("__c__t")))
    cells = []
    for df, name, sign in ((before, "__f", 1), (after, "__t", -1)):
        own = T.StructType([f for f in df.schema if f.name in common])
        for p in dict.fromkeys([*leaves(own), *shortcuts]):
            if p not in keys and not any(p != s and p.startswith(s + ".") for s in shortcuts):
                values = _values(F.col(name), df.schema, p.split("."))
                cells.append(F.transform(values, _cell(p, sign)))
        for c in df.columns:
            if c not in common:
                there = F.struct(F.lit(c).alias("path"), F.lit("").alias("value"), F.lit(sign).alias("s"))
                cells.append(F.when(F.col(name).getField(c).isNotNull(), F.array(there)).otherwise(F.array().cast("array<struct<path: string, value: string, s: int>>")))
    rows = pairs.select(*keys, F.explode(F.concat(*cells)).alias("c")).select(*keys, "c.path", "c.value", "c.s")
    found = rows.groupBy(*keys, "path", "value").agg(F.abs(F.sum("s")).alias("n")).filter("n > 0")
    return found.groupBy(*keys, "path").agg(F.sum("n").alias("score"))


def _cell(path: str, sign: int) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(path).alias("path"), v.alias("value"), F.lit(sign).alias("s"))


def _values(column: Column, kind: T.DataType, names: Sequence[str]) -> Column:
    """The values along a path as an array of texts."""
    if not names:
        return F.array(F.to_json(F.struct(canonical(column, kind).alias("v")), {"ignoreNullFields": "false"}))
    none = F.array().cast("array<string>")
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), _values(column.getField(names[0]), kind[names[0]].dataType, names[1:])).otherwise(none)
    if isinstance(kind, T.MapType):
        part = kind.keyType if names[0] == "key" else kind.valueType
        return F.coalesce(F.flatten(F.transform(F.map_entries(column), lambda e: _values(e[names[0]], part, names[1:]))), none)
    return F.coalesce(F.flatten(F.transform(column, lambda x: _values(x, kind.elementType, names[1:]))), none)


def field_totals(scores: DataFrame) -> DataFrame:
    """(path, score, records), the most different first."""
    return scores.groupBy("path").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("records")).orderBy(F.desc("score"), "path")


def pair_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.sum("score").alias("score"))


def summary(types: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]]) -> DataFrame:
    """Per type: matched, only in from, only in to, total score."""
    parts = []
    for name, (before, after, keys) in sorted(types.items()):
        sides = match(before, after, keys).groupBy().pivot("side", ["matched", "from_only", "to_only"]).agg(F.count(F.lit(1)))
        total = field_scores(before, after, keys).agg(F.coalesce(F.sum("score"), F.lit(0)).alias("score")) if keys else before.sparkSession.createDataFrame([(0,)], "score long")
        parts.append(sides.join(F.broadcast(total)).select(F.lit(name).alias("type"), *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("matched", "from_only", "to_only")], "score"))  # one row with one row
    return _union(parts)


def keyed_types(before: Dataset, after: Dataset, without_key: bool = False) -> dict[str, tuple[DataFrame, DataFrame, Sequence[str]]]:
    """What summary() takes, found by itself: every type of both states that has a primary key; a type of only one state is compared with none.

    without_key: types without one as well; a single scalar field is its own key, else nothing of the type is matched.
    """
    out = {}
    for t in sorted(before.types.keys() | after.types.keys()):
        a, b = before.types.get(t), after.types.get(t)
        a, b = (b.limit(0) if a is None else a), (a.limit(0) if b is None else b)
        keys = tuple(after.keys.get(t) or before.keys.get(t) or ())
        if keys or without_key:
            scalar = len(a.columns) == 1 and not isinstance(a.schema[0].dataType, (T.StructType, T.ArrayType, T.MapType))
            out[t] = (a, b, keys or (tuple(a.columns) if scalar else ()))
    return out


def overview(totals: DataFrame, by: str = "score", number: int = 0, size: int = 50) -> DataFrame:
    """A page of summary(), the types that differ most first; by: score, from_only, to_only or matched."""
    return totals.orderBy(F.desc(by), "type").offset(number * size).limit(size)


def element_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], element_key: Sequence[str], element: Sequence[str]) -> DataFrame:
    """Within matched records, elements at paths: counts of equal, modified (same element key, other values), from_only, to_only."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        t = tuples(df, [*element_key, *element])
        k, n = len(element_key), len(element)
        return t.select(*[F.col(f"root.`{x}`").alias(x) for x in keys], *[F.col(f"p{i}").alias(f"e{i}") for i in range(k)], F.struct(*[F.col(f"p{k + i}") for i in range(n)]).alias(side))

    both = before.select(*keys).join(after.select(*keys), list(keys)).distinct()
    a, b = (rows(df.join(both, list(keys), "left_semi"), side) for df, side in ((before, "f"), (after, "t")))
    on = [*keys, *[f"e{i}" for i in range(len(element_key))]]
    # Several alike elements pair one by one, in order of value.
    from pyspark.sql import Window

    a, b = (x.withColumn("__i", F.row_number().over(Window.partitionBy(*on).orderBy(s))) for x, s in ((a, "f"), (b, "t")))
    outcome = F.when(F.col("t").isNull(), "from_only").when(F.col("f").isNull(), "to_only").when(F.col("f").eqNullSafe(F.col("t")), "equal").otherwise("modified")
    return a.join(b, [*on, "__i"], "full_outer").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def equal_pairs(before: DataFrame, after: DataFrame, keys: Sequence[str], unordered: bool = False, common: bool = True) -> DataFrame:
    """One-to-one pairs of records alike in content whatever their keys: (from keys f_*, to keys t_*).

    Nested records are compared in their common fields; maps by entries. unordered: lists as bags, whatever their order, at any depth.
    """
    from pyspark.sql import Window

    names = [c for c in before.columns if c in after.columns and c not in keys]

    def shaped(df: DataFrame, other: DataFrame) -> DataFrame:
        parts = [_in_common(F.col(f"`{n}`"), df.schema[n].dataType, other.schema[n].dataType, unordered, common).alias(n) for n in names]
        return df.select(*keys, F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256).alias(RID))

    a, b = (shaped(df, other).withColumn("__i", F.row_number().over(Window.partitionBy(RID).orderBy(*keys))) for df, other in ((before, after), (after, before)))
    return a.select(RID, "__i", *[F.col(k).alias(f"f_{k}") for k in keys]).join(b.select(RID, "__i", *[F.col(k).alias(f"t_{k}") for k in keys]), [RID, "__i"]).drop(RID, "__i")


def _in_common(column: Column, kind: T.DataType, other: T.DataType, unordered: bool, common: bool) -> Column:
    if isinstance(kind, T.StructType) and isinstance(other, T.StructType):
        fields = [f for f in sorted(kind, key=lambda f: f.name) if not common or f.name in other.names]
        inner = [_in_common(column.getField(f.name), f.dataType, other[f.name].dataType if f.name in other.names else f.dataType, unordered, common).alias(f.name) for f in fields]
        return F.when(column.isNotNull(), F.struct(*inner)) if inner else F.lit(None)
    if isinstance(kind, T.ArrayType) and isinstance(other, T.ArrayType):
        out = F.transform(column, lambda x: _in_common(x, kind.elementType, other.elementType, unordered, common))
        return F.array_sort(out) if unordered else out
    return canonical(column, kind)


def pair_elements(before: list, after: list, most: int = 10_000, hint: Callable[[object], object] | None = None) -> list[tuple[object, object, int]]:
    """Elements of one record's two versions side by side: those of one hint key, then those with least difference first, then what is left alone (None).

    Difference: leaves not shared. Two elements pair only if they share a leaf. For the display of one pair of records, so bounded.
    """
    def flat(x, at="") -> Counter:
        if isinstance(x, dict):
            return sum((flat(v, f"{at}.{k}") for k, v in x.items()), Counter())
        if isinstance(x, (list, tuple)):
            return sum((flat(v, at) for v in x), Counter())
        return Counter([(at, repr(x))])

    if len(before) * len(after) > most * most:
        raise ValueError("too many elements to pair for display")
    a, b = [flat(x) for x in before], [flat(x) for x in after]
    scored = sorted(((sum(((x - y) + (y - x)).values()), i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x & y))
    left, right, out = set(range(len(a))), set(range(len(b))), []
    if hint:
        named: dict = {}
        for j, x in enumerate(after):
            named.setdefault(repr(hint(x)), []).append(j)
        scored = [(-1, i, named[repr(hint(x))].pop(0)) for i, x in enumerate(before) if named.get(repr(hint(x)))] + scored
    for score, i, j in scored:
        if i in left and j in right:
            left.discard(i), right.discard(j)
            out.append((before[i], after[j], score if score >= 0 else sum(((a[i] - b[j]) + (b[j] - a[i])).values())))
    return out + [(before[i], None, sum(a[i].values())) for i in sorted(left)] + [(None, after[j], sum(b[j].values())) for j in sorted(right)]
