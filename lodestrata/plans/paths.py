"""Dotted field paths over nested columns, compiled to columns and explodes.

`element` steps into arrays, `key` and `value` into maps. Paths with a common collection prefix share one explode; independent
collections multiply; a record with an empty branch gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PathError(ValueError):
    """A path that names no field (NOT_FOUND), ends before a scalar (NOT_FULL) or steps into one (NOT_TRAVERSABLE)."""


def step(kind: T.DataType, name: str, path: str) -> T.DataType:
    if isinstance(kind, T.StructType):
        if name not in kind.names:
            raise PathError(f"NOT_FOUND: {name} of {path}")
        return kind[name].dataType
    if isinstance(kind, T.ArrayType) and name == "element":
        return kind.elementType
    if isinstance(kind, T.MapType) and name in ("key", "value"):
        return kind.keyType if name == "key" else kind.valueType
    raise PathError(f"{'NOT_FOUND' if isinstance(kind, (T.ArrayType, T.MapType)) else 'NOT_TRAVERSABLE'}: {name} of {path}")


def type_of(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for name in path.split(".") if path else []:
        kind = step(kind, name, path)
    return kind


def expand(schema: T.StructType, path: str) -> str:
    """A key path carried through one-field structs to its scalar; a final `!` leaves it as it is. Collections aren't traversed."""
    if path.endswith("!"):
        type_of(schema, path[:-1])
        return path[:-1]
    kind, names = type_of(schema, path), path.split(".")
    if any(n in ("element", "key", "value") and not isinstance(type_of(schema, ".".join(names[:i])), T.StructType) for i, n in enumerate(names)):
        raise PathError(f"NOT_TRAVERSABLE: {path} steps into a collection")
    while isinstance(kind, T.StructType):
        if len(kind) != 1:
            raise PathError(f"NOT_EXPANDABLE: {path} has {len(kind)} fields")
        path, kind = f"{path}.{kind[0].name}", kind[0].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        raise PathError(f"NOT_FULL: {path} ends at a collection")
    return path


def tuples(df: DataFrame, paths: Sequence[str], root: str = "root") -> DataFrame:
    """One row per combination of values along the paths: column p0, p1, ... and the whole record as `root`."""
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(root))
    made: dict[tuple[str, ...], Column] = {(): F.col(root)}
    n = 0
    for path in paths:
        kind: T.DataType = df.schema
        names = tuple(path.split(".")) if path else ()
        for i, name in enumerate(names):
            at, before = names[: i + 1], names[:i]
            nxt = step(kind, name, path)
            if at not in made:
                if isinstance(kind, T.StructType):
                    made[at] = made[before].getField(name)
                elif isinstance(kind, T.ArrayType):
                    out = out.withColumn(f"x{n}", F.explode(made[before]))
                    made[at], n = F.col(f"x{n}"), n + 1
                else:
                    out = out.select("*", F.explode(made[before]).alias(f"x{n}k", f"x{n}v"))
                    made[before + ("key",)], made[before + ("value",)], n = F.col(f"x{n}k"), F.col(f"x{n}v"), n + 1
            kind = nxt
    return out.select(root, *[made[tuple(p.split(".")) if p else ()].alias(f"p{i}") for i, p in enumerate(paths)])


def values(df: DataFrame, path: str) -> DataFrame:
    """All values along a path, a row each; a null on the way gives none."""
    return tuples(df, [path]).select(F.col("p0").alias("value")).filter("value IS NOT NULL")


def leaves(kind: T.DataType, prefix: str = "") -> list[str]:
    """All paths that end at scalars."""
    if isinstance(kind, T.StructType):
        inner = [(f.name, f.dataType) for f in kind]
    elif isinstance(kind, T.ArrayType):
        inner = [("element", kind.elementType)]
    elif isinstance(kind, T.MapType):
        inner = [("key", kind.keyType), ("value", kind.valueType)]
    else:
        return [prefix]
    return [x for n, k in inner for x in leaves(k, f"{prefix}.{n}" if prefix else n)]
