"""What changed between two states of a type, and putting changes to use."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import RID, comparable, with_id


@dataclass(frozen=True)
class Delta:
    """Full rows on both sides: the reverse is the same with sides swapped."""

    added: DataFrame
    removed: DataFrame

    def reverse(self) -> Delta:
        return Delta(self.removed, self.added)

    def is_empty(self) -> bool:
        return self.added.limit(1).isEmpty() and self.removed.limit(1).isEmpty()


def dedup(df: DataFrame) -> DataFrame:
    """Records that are alike collapse."""
    return df.withColumn("__c", F.struct(*comparable(df, df.columns))).dropDuplicates(["__c"]).drop("__c")


def delta(before: DataFrame, after: DataFrame) -> Delta:
    """By content. Columns of only one side count as null on the other (schema evolution)."""
    names = _all_columns(before, after)
    a, b = _aligned(before, names, after), _aligned(after, names, before)
    if _comparable(a, b):
        return Delta(b.subtract(a), a.subtract(b))
    a, b = with_id(a, names), with_id(b, names)
    return Delta(b.join(a.select(RID), RID, "left_anti").dropDuplicates([RID]).select(names), a.join(b.select(RID), RID, "left_anti").dropDuplicates([RID]).select(names))


def _comparable(a: DataFrame, b: DataFrame) -> bool:
    """Whether rows can be joined on their columns as they are: of one kind on both sides, and without maps. Else they are compared by content id."""
    def maps(kind: T.DataType) -> bool:
        if isinstance(kind, T.StructType):
            return any(maps(f.dataType) for f in kind)
        return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and maps(kind.elementType)

    return all(f.dataType == g.dataType and not maps(f.dataType) for f, g in zip(a.schema, b.schema))


def _all_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [*a.columns, *(c for c in b.columns if c not in a.columns)]


def _aligned(df: DataFrame, names: list[str], other: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(other.schema[n].dataType).alias(n) for n in names])


def apply(state: DataFrame, change: Delta, columns: Sequence[str] | None = None) -> DataFrame:
    """The state after a change. Both are taken in the change's columns (one that the state lacks is null), as the change was made; columns: those that the result has."""
    names = _all_columns(change.removed, state)
    a, gone = _aligned(state, names, change.removed), _aligned(change.removed, names, state)
    if _comparable(a, gone):
        kept = without_keys(a, gone, names)
    else:
        kept = with_id(a, names).join(with_id(gone, names).select(RID), RID, "left_anti").drop(RID)
    out = kept.unionByName(change.added, allowMissingColumns=True)
    return out.select(*columns) if columns is not None else out


def on_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equality of keys in which null equals null: a key part may be null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return out


def without_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.alias("l").join(gone.select(*keys).alias("r"), on_keys("l", "r", keys), "left_anti")


def carry_over(state: DataFrame, removed: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Everything of before but rows with a removed or added key, and the added rows."""
    gone = removed.select(*keys).unionByName(added.select(*keys)).distinct()
    return without_keys(state, gone, keys).select(state.columns).unionByName(added)


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, before, after): added, removed or updated by key; records alike on both sides are left out.

    One full outer join by key, null parts included; rows are compared by content within it, by name: a column of only one side counts as null on the other.
    """
    names = _all_columns(before, after)
    side = lambda df, other: F.struct(*comparable(_aligned(df, names, other), names))
    a = _aligned(before, names, after).select(*[F.col(f"`{k}`") for k in keys], side(before, after).alias("__b"), F.struct(*before.columns).alias("before"))
    b = _aligned(after, names, before).select(*[F.col(f"`{k}`") for k in keys], side(after, before).alias("__a"), F.struct(*after.columns).alias("after"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("updated")
    rows = a.alias("l").join(b.alias("r"), on_keys("l", "r", keys), "full_outer").filter(~F.col("__b").eqNullSafe(F.col("__a")))
    return rows.select(*[F.when(F.col("__b").isNull(), F.col(f"r.`{k}`")).otherwise(F.col(f"l.`{k}`")).alias(k) for k in keys], change.alias("change"), "before", "after")


def two_steps(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> tuple[Delta, Delta]:
    """Two deltas that lead from one state to the other, neither of which removes and adds a record of one key: first what goes or gives way
    and what is new, then the new content of changed keys."""
    whole = delta(before, after)
    changed = whole.added.alias("l").join(whole.removed.select(*keys).distinct().alias("r"), on_keys("l", "r", keys), "left_semi")
    return Delta(without_keys(whole.added, whole.removed, keys), whole.removed), Delta(changed, whole.removed.limit(0))


def change_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def mutate(state: DataFrame, events: DataFrame, keys: Sequence[str], sequence: str = "seq", action: str = "action") -> DataFrame:
    """Incremental changes by key: upsert and delete (the last of a key wins), insert (only where neither the state nor an event before has the key), discard (forgets what was queued for the key).

    events: the state's columns, `sequence` and `action`. One shuffle of events, one join with the state.
    """
    order = Window.partitionBy(*keys).orderBy(sequence)
    # Since the last discard: of upserts and deletes the last counts, an insert counts only as the first.
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("__d", F.sum(F.when(F.col(action) == "discard", 1).otherwise(0)).over(so_far))
    e = e.withColumn("__last", F.max("__d").over(Window.partitionBy(*keys))).filter((F.col("__d") == F.col("__last")) & (F.col(action) != "discard"))
    e = e.withColumn("__n", F.row_number().over(order)).filter((F.col(action) != "insert") | (F.col("__n") == 1))
    e = e.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))).filter("__r = 1")
    e = e.select(*state.columns, F.col(action).alias("__a"))
    strong = e.filter("__a <> 'insert'").select(*keys)
    kept = without_keys(state, strong, keys).select(state.columns)
    inserted = without_keys(e.filter("__a = 'insert'"), state, keys)
    return kept.unionByName(e.filter("__a = 'upsert'").select(state.columns)).unionByName(inserted.select(state.columns))


def latest(events: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    return events.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))).filter("__r = 1").drop("__r")


def modified(before: DataFrame, after: DataFrame, keys: Sequence[str], allowed: Column) -> DataFrame:
    """Updated pairs for which a predicate on columns before.* and after.* fails."""
    return changes(before, after, keys).filter("change = 'updated'").filter(~F.coalesce(allowed, F.lit(False)))
