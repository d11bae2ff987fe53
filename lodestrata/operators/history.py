"""A log of changes over versions: counts, point-in-time reads, key timelines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import display_key, literal
from .dataset import _union
from .state import changes, on_keys, without_keys


def log(states: Sequence[tuple[int, DataFrame]], keys: Sequence[str]) -> DataFrame:
    """(version, keys, change, before, after) of each step between states in order of version; steps may skip versions (snapshots)."""
    steps = sorted(states, key=lambda s: s[0])
    return _union([changes(a, b, keys).select(F.lit(v).cast("long").alias("version"), *keys, "change", "before", "after") for (_, a), (v, b) in zip(steps, steps[1:])])


def extend(history: DataFrame, before: DataFrame, after: DataFrame, version: int, keys: Sequence[str], keep: int | None = None) -> DataFrame:
    """The log with one more step; keep: only so many of the newest versions stay."""
    out = history.unionByName(changes(before, after, keys).select(F.lit(version).cast("long").alias("version"), *keys, "change", "before", "after"))
    if keep is None:
        return out
    newest = out.select("version").distinct().orderBy(F.desc("version")).limit(keep)
    return out.join(F.broadcast(newest), "version", "left_semi")  # `keep` rows at most


def extend_back(history: DataFrame, before: DataFrame, after: DataFrame, version: int, keys: Sequence[str]) -> DataFrame:
    """The log with an earlier step, known from a reverse delta: `after` is the state that the log begins with."""
    return extend(history, before, after, version, keys)


def counts(history: DataFrame) -> DataFrame:
    return history.groupBy("version", "change").agg(F.count(F.lit(1)).alias("n"))


def as_of(current: DataFrame, history: DataFrame, version: int, keys: Sequence[str]) -> DataFrame:
    """The state at a version: the newest state with every later change undone, one anti join for all of them."""
    later = history.filter(F.col("version") > version)
    first = later.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("version"))).filter("__n = 1")
    restored = first.filter("before IS NOT NULL").select("before.*").select(current.columns)
    return without_keys(current, first, keys).select(current.columns).unionByName(restored)


def timeline(history: DataFrame, keys: Sequence[str], *key) -> DataFrame:
    """All changes of one key, oldest first."""
    out = history
    for k, v in zip(keys, key, strict=True):
        out = out.filter(F.col(k) == F.lit(v))
    return out.orderBy("version")


def of_keys(history: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """What happened in each version to the records of any of the wanted keys: (version, change, keys, before, after)."""
    return history.alias("l").join(wanted.select(*keys).distinct().alias("r"), on_keys("l", "r", keys), "left_semi").select("version", "change", *keys, "before", "after")


def named(history: DataFrame, namer: Callable[[Column], Column]) -> DataFrame:
    """The log with a column `name`: the namer's name of each record, from what it is, or was before it went."""
    return history.withColumn("name", F.coalesce(namer(F.col("after")), namer(F.col("before"))))


def grouped(history: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Changes as a tree over key fields: counts for each level."""
    return history.rollup("version", *fields).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level")).filter(F.col("version").isNotNull())


def key_index(history: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key there has been, with its display text."""
    return history.select(*keys).union(current.select(*keys)).distinct().withColumn("display", display_key(*[F.col(k) for k in keys]))


def search(index: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Keys of which a field is the text, or with `a:b` all fields are; text that isn't of a field's type doesn't match it."""
    kinds = [index.schema[k].dataType for k in keys]
    parts = text.split(":")
    if len(parts) == len(keys) > 1:
        values = [literal(p, t) for p, t in zip(parts, kinds)]
        if any(v is None for v in values):
            return index.limit(0)
        out = index
        for k, v in zip(keys, values):
            out = out.filter(F.col(k) == F.lit(v))
        return out
    hit = F.lit(False)
    for k, t in zip(keys, kinds):
        if (v := literal(text, t)) is not None:
            hit = hit | F.coalesce(F.col(k) == F.lit(v), F.lit(False))
    return index.filter(hit)


def schema_changes(before: DataFrame, after: DataFrame) -> list[tuple[str, str]]:
    """(field, added | removed | changed) between two states of a type."""
    a, b = ({f.name: f.dataType for f in df.schema} for df in (before, after))
    return sorted([(n, "removed") for n in a.keys() - b.keys()] + [(n, "added") for n in b.keys() - a.keys()] + [(n, "changed") for n in a.keys() & b.keys() if a[n] != b[n]])
