"""Functions on records: content identity, equality, display, literals, collections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "__rid"
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def canonical(column: Column, kind: T.DataType, sets: bool = False) -> Column:
    """A value in a form that compares by content: maps as sorted entries; with sets, arrays sorted and distinct."""
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[canonical(column.getField(f.name), f.dataType, sets).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        out = F.transform(column, lambda x: canonical(x, kind.elementType, sets))
        return F.array_sort(F.array_distinct(out)) if sets else out
    if isinstance(kind, T.MapType):
        return F.array_sort(F.transform(F.map_entries(column), lambda e: F.struct(canonical(e["key"], kind.keyType, sets).alias("key"), canonical(e["value"], kind.valueType, sets).alias("value"))))
    return column


def record_id(df: DataFrame, columns: list[str] | None = None, sets: bool = False) -> Column:
    """Equal for equal content, whatever the version; names and order of columns count, nulls too."""
    names = columns or [c for c in df.columns if c != RID]
    parts = [canonical(F.col(f"`{n}`"), df.schema[n].dataType, sets).alias(n) for n in names]
    return F.sha2(F.to_json(F.struct(*parts), _TIME), 256)


def with_id(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df if RID in df.columns else df.withColumn(RID, record_id(df, columns))


def comparable(df: DataFrame, names: list[str]) -> list[Column]:
    """Columns for joins, distinct and grouping, where maps aren't allowed as such."""
    return [canonical(F.col(f"`{n}`"), df.schema[n].dataType).alias(n) for n in names]


def same(a: Column, b: Column) -> Column:
    """Value equality in which null equals null and NaN NaN."""
    return a.eqNullSafe(b)


def display_key(*columns: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])


def to_text(df: DataFrame, exclude: tuple[str, ...] = (), collapse: bool = False) -> Column:
    """A record as JSON: nulls are written, one-field structs collapse on request, maps with scalar keys become objects, other maps entry lists."""

    def shape(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            if collapse and len(kind) == 1:
                return shape(column.getField(kind[0].name), kind[0].dataType)
            return F.when(column.isNotNull(), F.struct(*[shape(column.getField(f.name), f.dataType).alias(f.name) for f in kind if f.name not in exclude]))
        if isinstance(kind, T.ArrayType):
            return F.transform(column, lambda x: shape(x, kind.elementType))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, (T.StructType, T.ArrayType)):
            return F.transform(F.map_entries(column), lambda e: F.struct(shape(e["key"], kind.keyType).alias("key"), shape(e["value"], kind.valueType).alias("value")))
        return column

    return F.to_json(F.struct(*[shape(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if f.name not in exclude]), _TIME)


def to_lines(df: DataFrame, exclude: tuple[str, ...] = (), collapse: bool = True, sort: tuple[str, ...] = ()) -> Column:
    """A record as indented text: `name: value` lines, list elements `e0:`, map entries `k:` and `v:`; null where there is none.

    collapse: a struct of one field is written as that field. exclude: fields (dotted paths) written as null. sort: lists (dotted paths) that are sets, in order.
    """

    def lines(column: Column, kind: T.DataType, depth: int, path: str) -> Column:
        line = lambda name: F.lit("\n" + "  " * (depth + 1) + name + ": ")
        if path in exclude:
            return F.lit("null")
        if isinstance(kind, T.StructType):
            if collapse and len(kind) == 1:
                return lines(column.getField(kind[0].name), kind[0].dataType, depth, path)
            fields = [F.concat(line(f.name), lines(column.getField(f.name), f.dataType, depth + 1, f"{path}.{f.name}".lstrip("."))) for f in kind]
            return F.when(column.isNull(), F.lit("null")).otherwise(F.concat(*fields))
        if isinstance(kind, T.ArrayType):
            own = F.array_sort(column) if path in sort else column
            name = lambda i: F.lit("e") if path in sort else F.concat(F.lit("e"), i.cast("string"))
            each = F.transform(own, lambda x, i: F.concat(F.lit("\n" + "  " * (depth + 1)), name(i), F.lit(": "), lines(x, kind.elementType, depth + 1, path + ".element")))
            return F.coalesce(F.array_join(each, ""), F.lit("null"))
        if isinstance(kind, T.MapType):
            each = F.transform(F.map_entries(column), lambda e: F.concat(line("k"), lines(e["key"], kind.keyType, depth + 1, path + ".key"), line("v"), lines(e["value"], kind.valueType, depth + 1, path + ".value")))
            return F.coalesce(F.array_join(each, ""), F.lit("null"))
        if isinstance(kind, T.BinaryType):
            column = F.hex(column)
        return F.coalesce(column.cast("string"), F.lit("null"))

    return lines(F.struct(*[F.col(f"`{c}`") for c in df.columns]), df.schema, 0, "")


def literal(text: str, kind: T.DataType):
    """A query text as a value of a field's type, or None if it isn't one. Any text but "true" is false for a boolean."""
    try:
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            if text != text.strip() or "_" in text:
                return None
            bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31}.get(type(kind), 63)
            return v if -(2**bits) <= (v := int(text)) < 2**bits else None
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return None if "_" in text else float(text)
    except ValueError:
        return None
    if isinstance(kind, T.BooleanType):
        return text.lower() == "true"
    return text if isinstance(kind, T.StringType) else None


def typed(text: str, kind: T.DataType) -> Column | None:
    value = literal(text, kind)
    return None if value is None else F.lit(value).cast(kind)


def find_in_set(array: Column, **keys) -> Column:
    """The element whose fields have the given values, or null."""
    def fits(x: Column) -> Column:
        out = F.lit(True)
        for k, v in keys.items():
            out = out & (x[k] == v)
        return out

    return F.try_element_at(F.filter(array, fits), F.lit(1)) if keys else F.lit(None)


def find_in_map(column: Column, part: str = "value", **keys) -> Column:
    """Entry, key or value of the map entry whose key's fields (or key itself: key=) have the given values, or null."""
    def fits(e: Column) -> Column:
        out = F.lit(True)
        for k, v in keys.items():
            out = out & ((e["key"] if k == "key" else e["key"][k]) == v)
        return out

    entry = F.try_element_at(F.filter(F.map_entries(column), fits), F.lit(1))
    return entry if part == "entry" else entry[part]


def index_of(array: Column, value) -> Column:
    """Position from 0 of the first equal element, -1 for none."""
    return (F.array_position(array, value) - 1).cast("int")


def element_at(array: Column, at: int) -> Column:
    """The element at a place from 0, or null."""
    return F.get(array, F.lit(at))


def same_lists(a: Column, b: Column) -> Column:
    """Alike element by element, in order; null is alike to null only."""
    return a.eqNullSafe(b)


def same_sets(a: Column, b: Column) -> Column:
    """The same elements, in whatever order and number."""
    return F.sort_array(F.array_distinct(a)).eqNullSafe(F.sort_array(F.array_distinct(b)))


def contains_all(array: Column, values: Column) -> Column:
    return F.size(F.array_except(values, array)) == 0


def map_contains(column: Column, key=None, value=None) -> Column:
    """Whether a map has the key, or some entry the value."""
    return F.map_contains_key(column, key) if key is not None else F.array_contains(F.map_values(column), value)


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as values of a field are ordered: nulls first."""
    less = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
    return F.when(a.eqNullSafe(b), 0).when(less, -1).otherwise(1)


def last_index_of(array: Column, value) -> Column:
    """Position from 0 of the last equal element, -1 for none."""
    at = F.array_position(F.reverse(array), value)
    return F.when(at == 0, F.lit(-1)).otherwise(F.size(array) - at).cast("int")


def version_time(version: Column) -> Column:
    """The time in a version number yyyyMMddHHmmss + counter of three digits; null where it is none."""
    return F.try_to_timestamp(F.substring(version.cast("string"), 1, 14), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")


class VersionMinter:
    """Ascending version numbers: time to the second and a counter."""

    def __init__(self) -> None:
        self.last = 0

    def mint(self, now: datetime | None = None) -> int:
        base = int((now or datetime.now()).strftime("%Y%m%d%H%M%S")) * 1000
        self.last = max(base, self.last + 1)
        return self.last
