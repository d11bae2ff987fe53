"""Record schemas: a small declaration language, its algebra, and the mapping to Spark types.

    Customer @PrimaryKey(id) { long id; string name; Nation nation; ListOfOrder orders; }
    ListOfOrder List<Order>;   Tags Set<Tag> @HashKey(name);   Names Map<Key, Value> @HashKey(id);

Any field type that isn't a primitive refers to another type.
"""

from __future__ import annotations

import dataclasses
import hashlib
import re
import typing
from collections.abc import Iterable, Mapping
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import types as T

PRIMITIVES: dict[str, T.DataType] = {"int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType()}
_BY_SPARK = {type(v): k for k, v in PRIMITIVES.items()} | {T.ShortType: "int", T.ByteType: "int", T.TimestampType: "long", T.TimestampNTZType: "long", T.DateType: "int"}


class SchemaError(ValueError):
    """A schema that doesn't parse, doesn't fit another, or refers to itself."""


@dataclasses.dataclass(frozen=True)
class TypeSchema:
    """kind: object, list, set or map. fields: name -> type (object); element/key/value types else."""

    name: str
    kind: str = "object"
    fields: tuple[tuple[str, str], ...] = ()
    key: tuple[str, ...] = ()
    element: str = ""
    key_type: str = ""

    @property
    def refers(self) -> set[str]:
        """Types this one refers to directly."""
        named = {t for _, t in self.fields} | {self.element, self.key_type}
        return {t for t in named if t and t not in PRIMITIVES}

    def __str__(self) -> str:
        keys = f"({', '.join(self.key)})"
        if self.kind == "object":
            head = f"{self.name} @PrimaryKey{keys}" if self.key else self.name
            return head + " {\n" + "".join(f"\t{t} {n};\n" for n, t in self.fields) + "}"
        inner = f"{self.key_type}, {self.element}" if self.kind == "map" else self.element
        return f"{self.name} {self.kind.title()}<{inner}>" + (f" @HashKey{keys}" if self.key else "") + ";"

    def without_keys(self) -> TypeSchema:
        return dataclasses.replace(self, key=())

    def only(self, names: Iterable[str]) -> TypeSchema:
        keep = set(names)
        return dataclasses.replace(self, fields=tuple(f for f in self.fields if f[0] in keep), key=self.key if all(k.split(".")[0] in keep for k in self.key) else ())

    def common(self, other: TypeSchema) -> TypeSchema:
        """Fields both have; a field of two types is an error; the key stays if equal."""
        theirs = dict(other.fields)
        for n, t in self.fields:
            if theirs.get(n, t) != t:
                raise SchemaError(f"{self.name}.{n} is {t} and {theirs[n]}")
        return dataclasses.replace(self, fields=tuple(f for f in self.fields if f[0] in theirs), key=self.key if self.key == other.key else ())

    def union(self, other: TypeSchema) -> TypeSchema:
        """All fields of this, then the other's new ones."""
        self.common(other)
        mine = dict(self.fields)
        return dataclasses.replace(self, fields=self.fields + tuple(f for f in other.fields if f[0] not in mine), key=self.key if self.key == other.key else ())


_TOKEN = re.compile(r"\s*(?:/\*.*?\*/|//[^\n]*|([A-Za-z_][\w.!]*|@\w+|[{}<>(),;]))", re.S)


def parse(text: str) -> dict[str, TypeSchema]:
    """All declarations of a text, by name."""
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected {text[at:at + 20]!r}")
        tokens += [m[1]] if m[1] else []
        at = m.end()
    tokens = tokens[::-1]

    def take(want: str | None = None) -> str:
        if not tokens or want and tokens[-1] != want:
            raise SchemaError(f"expected {want or 'more'}, got {tokens[-1] if tokens else 'the end'}")
        return tokens.pop()

    def key_list(mark: str) -> tuple[str, ...]:
        if not tokens or tokens[-1] != mark:
            return ()
        take(), take("(")
        out = [take()]
        while tokens and tokens[-1] == ",":
            take()
            out.append(take())
        take(")")
        return tuple(out)

    out: dict[str, TypeSchema] = {}
    while tokens:
        name = take()
        key = key_list("@PrimaryKey")
        kind = take()
        if kind == "{":
            fields = []
            while tokens and tokens[-1] != "}":
                kind_, field = take(), take()
                take(";")
                fields.append((field, kind_))
            take("}")
            out[name] = TypeSchema(name, "object", tuple(fields), key)
        elif kind in ("List", "Set", "Map"):
            take("<")
            first = take()
            second = (take(","), take())[1] if kind == "Map" else ""
            take(">")
            out[name] = TypeSchema(name, kind.lower(), (), key_list("@HashKey"), second or first, first if second else "")
            take(";")
        else:
            raise SchemaError(f"{name}: expected a body or a collection, got {kind}")
    return out


def dump(schemas: Mapping[str, TypeSchema]) -> str:
    return "\n\n".join(str(schemas[n]) for n in dependency_order(schemas))


def schema_hash(schemas: Mapping[str, TypeSchema]) -> str:
    """The same whatever order types were registered in."""
    return hashlib.sha256("\n".join(str(schemas[n]) for n in sorted(schemas)).encode()).hexdigest()


def dependency_order(schemas: Mapping[str, TypeSchema]) -> list[str]:
    """Referenced types first, alphabetical among equals."""
    graph = TopologicalSorter({n: s.refers & schemas.keys() for n, s in schemas.items()})
    try:
        graph.prepare()
    except CycleError as e:
        raise SchemaError(f"circular reference: {' -> '.join(e.args[1])}") from None
    out = []
    while graph.is_active():
        ready = sorted(graph.get_ready())
        out += ready
        graph.done(*ready)
    return out


def depends_on(schemas: Mapping[str, TypeSchema], name: str, on: str) -> bool:
    """Whether a type refers to another, directly or over others."""
    todo, seen = [name], set()
    while todo:
        for r in schemas[todo.pop()].refers & schemas.keys() - seen:
            if r == on:
                return True
            seen.add(r)
            todo.append(r)
    return False


def top_level(schemas: Mapping[str, TypeSchema]) -> set[str]:
    return set(schemas) - {r for s in schemas.values() for r in s.refers}


def complete(schemas: Mapping[str, TypeSchema]) -> dict[str, TypeSchema]:
    """Without types that refer, directly or not, to undeclared ones."""
    out = dict(schemas)
    while missing := [n for n, s in out.items() if s.refers - out.keys()]:
        for n in missing:
            del out[n]
    return out


def spark_type(schemas: Mapping[str, TypeSchema], name: str) -> T.DataType:
    """The nested Spark type of a record type; one-field string/number wrappers stay structs, their fields keep names."""
    if name in PRIMITIVES:
        return PRIMITIVES[name]
    s = schemas[name]
    if s.kind == "map":
        return T.MapType(spark_type(schemas, s.key_type), spark_type(schemas, s.element))
    if s.kind in ("list", "set"):
        return T.ArrayType(spark_type(schemas, s.element))
    return T.StructType([T.StructField(n, spark_type(schemas, t)) for n, t in s.fields])


def from_spark(name: str, struct: T.StructType, key: Iterable[str] = ()) -> dict[str, TypeSchema]:
    """Schemas of a nested Spark type: arrays become lists, structs objects named by their field."""
    out: dict[str, TypeSchema] = {}

    def visit(kind: T.DataType, hint: str) -> str:
        if isinstance(kind, T.StructType):
            own = hint[:1].upper() + hint[1:]
            out[own] = TypeSchema(own, "object", tuple((f.name, visit(f.dataType, f.name)) for f in kind))
            return own
        if isinstance(kind, T.ArrayType):
            e = visit(kind.elementType, hint)
            return out.setdefault(f"ListOf{e}", TypeSchema(f"ListOf{e}", "list", element=e)).name
        if isinstance(kind, T.MapType):
            k, v = visit(kind.keyType, hint + "Key"), visit(kind.valueType, hint + "Value")
            return out.setdefault(f"MapOf{k}To{v}", TypeSchema(f"MapOf{k}To{v}", "map", element=v, key_type=k)).name
        try:
            return _BY_SPARK[type(kind)]
        except KeyError:
            raise SchemaError(f"{hint}: no record type for {kind.simpleString()}") from None

    visit(struct, name)
    own = name[:1].upper() + name[1:]
    out[own] = dataclasses.replace(out[own], key=tuple(key))
    return out


_PYTHON = {int: "long", float: "double", str: "string", bool: "boolean", bytes: "bytes"}


def from_dataclass(cls: type) -> dict[str, TypeSchema]:
    """Schemas of a dataclass: list/set/dict fields become ListOfX, SetOfX, MapOfKToV; `__primary_key__` names the key.

    A set or map without a key of its own takes its element's key, or its only field.
    """
    out: dict[str, TypeSchema] = {}

    def default_key(name: str) -> tuple[str, ...]:
        s = out.get(name)
        return () if s is None or s.kind != "object" else s.key or ((s.fields[0][0],) if len(s.fields) == 1 else ())

    def visit(kind) -> str:
        if kind in _PYTHON:
            return _PYTHON[kind]
        base, args = typing.get_origin(kind), [a for a in typing.get_args(kind) if a is not type(None)]
        if base in (list, set):
            e = visit(args[0])
            name = f"{'List' if base is list else 'Set'}Of{e[:1].upper() + e[1:]}"
            out[name] = TypeSchema(name, "list" if base is list else "set", element=e, key=default_key(e) if base is set else ())
            return name
        if base is dict:
            k, v = map(visit, args)
            name = f"MapOf{k[:1].upper() + k[1:]}To{v[:1].upper() + v[1:]}"
            out[name] = TypeSchema(name, "map", element=v, key_type=k, key=default_key(k))
            return name
        if base is not None and len(args) == 1:  # Optional
            return visit(args[0])
        if not dataclasses.is_dataclass(kind):
            raise SchemaError(f"no record type for {kind}")
        if kind.__name__ not in out:
            hints = typing.get_type_hints(kind)
            out[kind.__name__] = TypeSchema(kind.__name__)
            fields = tuple((f.name, visit(hints[f.name])) for f in dataclasses.fields(kind) if not f.name.startswith("_"))
            out[kind.__name__] = TypeSchema(kind.__name__, "object", fields, tuple(getattr(kind, "__primary_key__", ())))
        return kind.__name__

    visit(cls)
    dependency_order(out)
    return out
