"""Field-match scans, conjunctions over types, paging, display keys, and column filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import literal, typed
from ..plans.schema import TypeSchema
from .dataset import Dataset, _union


def field_match(df: DataFrame, field: str, text: str) -> DataFrame:
    """Records whose field is the text, read as the field's type; one-field structs are looked through. Nothing fits: none."""
    if field not in df.columns:
        return df.limit(0)
    kind, column = df.schema[field].dataType, F.col(f"`{field}`")
    while isinstance(kind, T.StructType) and len(kind) == 1:
        column, kind = column.getField(kind[0].name), kind[0].dataType
    value = typed(text, kind)
    return df.limit(0) if value is None else df.filter(column == value)


def field_match_all(state: Dataset, field: str, text: str) -> dict[str, DataFrame]:
    """field_match over every type that has the field and can hold the text."""
    return {t: field_match(df, field, text) for t, df in state.types.items() if field in df.columns}


def match_counts(found: Mapping[str, DataFrame]) -> DataFrame:
    """Matches of each type that has any, most first."""
    parts = [df.agg(F.count(F.lit(1)).alias("matches")).select(F.lit(t).alias("type"), "matches") for t, df in sorted(found.items())]
    return _union(parts).filter("matches > 0").orderBy(F.desc("matches"), "type")


def query_and(state: Dataset, clauses: Sequence[tuple[str | None, str, str]]) -> dict[str, DataFrame]:
    """Records that satisfy all clauses (type or None, field, text), each spread to whatever refers to its matches."""
    out: dict[str, DataFrame] | None = None
    for t, f, text in clauses:
        found = field_match_all(state, f, text) if t is None else {t: field_match(state.types[t], f, text)}
        spread = state.referrers(found)
        if out is None:
            out = spread
        else:
            out = {n: out[n].join(spread[n].select(*_keys(state, n)).distinct(), _keys(state, n), "left_semi") for n in out.keys() & spread.keys()}
    return out or {}


def _keys(state: Dataset, t: str) -> list[str]:
    return list(state.keys.get(t) or state.types[t].columns)


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(number * size).limit(size)


def parse_key(text: str, kinds: Sequence[T.DataType], mark: str = ":") -> list:
    """A display key's parts as typed values; the mark is escaped by a backslash."""
    parts = [p.replace("\\" + mark, mark) for p in re.split(rf"(?<!\\){re.escape(mark)}", text)]
    if len(parts) != len(kinds) or any(isinstance(k, T.BinaryType) for k in kinds):
        raise ValueError(f"{text!r} isn't a key of {len(kinds)} parts")
    values = [literal(p, k) for p, k in zip(parts, kinds)]
    if any(v is None for v in values):
        raise ValueError(f"{text!r} doesn't fit the key's types")
    return values


class TypeFilter:
    """Ordered rules that include or exclude types and fields; a later rule overrides earlier ones on the same thing."""

    def __init__(self, include: bool = True):
        self.rules: list[tuple[bool, str | None, str | None, bool]] = [(include, None, None, False)]

    def include_all(self) -> TypeFilter:
        self.rules = [(True, None, None, False)]
        return self

    def exclude_all(self) -> TypeFilter:
        self.rules = [(False, None, None, False)]
        return self

    def _add(self, yes: bool, t: str, f: str | None, deep: bool) -> TypeFilter:
        self.rules.append((yes, t, f, deep))
        return self

    def include(self, t: str, f: str | None = None) -> TypeFilter:
        return self._add(True, t, f, False)

    def exclude(self, t: str, f: str | None = None) -> TypeFilter:
        return self._add(False, t, f, False)

    def include_recursive(self, t: str, f: str | None = None) -> TypeFilter:
        return self._add(True, t, f, True)

    def exclude_recursive(self, t: str, f: str | None = None) -> TypeFilter:
        return self._add(False, t, f, True)

    @staticmethod
    def parse(text: str) -> TypeFilter:
        """Lines `+Type`, `-Type.field`, `+Type*` (recursive), `+*` or `-*`."""
        out = TypeFilter()
        for line in filter(None, map(str.strip, text.splitlines())):
            yes, deep, name = line[0] == "+", line.endswith("*"), line[1:].rstrip("*")
            if not name:
                out.rules = [(yes, None, None, False)]
            else:
                t, _, f = name.partition(".")
                out._add(yes, t, f or None, deep)
        return out

    def __str__(self) -> str:
        return "\n".join(("+" if y else "-") + (t or "") + (f".{f}" if f else "") + ("*" if d or t is None else "") for y, t, f, d in self.rules)

    def resolve(self, schemas: Mapping[str, TypeSchema]) -> dict[str, set[str] | None]:
        """Included types, each with its included fields (None: collections)."""
        fields: dict[tuple[str, str | None], bool] = {}

        def below(t: str) -> set[str]:
            seen, todo = set(), [t]
            while todo:
                x = todo.pop()
                if x in schemas and x not in seen:
                    seen.add(x)
                    todo += schemas[x].refers
            return seen

        def mark(yes: bool, t: str) -> None:
            fields[t, None] = yes
            for f, _ in schemas[t].fields:
                fields[t, f] = yes

        for yes, t, f, deep in self.rules:
            if t is None:
                fields.clear()
                for x in schemas:
                    mark(yes, x)
            elif t not in schemas:
                continue
            elif f is None:
                for x in below(t) if deep else {t}:
                    mark(yes, x)
            else:
                fields[t, f] = yes
                target = dict(schemas[t].fields).get(f)
                for x in below(target) if deep and target in schemas else ():
                    mark(yes, x)
        out: dict[str, set[str] | None] = {}
        for t, s in schemas.items():
            kept = {f for f, _ in s.fields if fields.get((t, f))}
            if fields.get((t, None)) or kept:
                out[t] = kept if s.kind == "object" else None
        return out

    def apply(self, state: Dataset, schemas: Mapping[str, TypeSchema]) -> Dataset:
        """Excluded types and columns are never read: the plan selects what is left."""
        keep = self.resolve(schemas)
        return Dataset({t: df.select(*[c for c in df.columns if keep[t] is None or c in keep[t]]) for t, df in state.types.items() if t in keep}, state.keys, state.references, state.version, state.tags)
