"""States combined, split, patched, copied and filtered."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.records import RID, comparable, with_id
from .dataset import Dataset, _union
from .query import field_match
from .state import dedup


def combine(inputs: Sequence[Dataset], keys: Mapping[str, Sequence[str]] | None = None, ignore: Sequence[str] = ()) -> Dataset:
    """The union of datasets; records alike collapse. keys: of records with one key the earliest input's wins (only with several inputs).

    References to a losing record go to the winner instead, type by type from the referenced ones on, so that records which become alike, or of one key, by that
    collapse in turn.
    """
    keys = {} if len(inputs) < 2 else dict(keys or {})
    if unknown := set(keys) - {t for d in inputs for t in d.types}:
        raise ValueError(f"no such type: {', '.join(sorted(unknown))}")
    references = tuple(dict.fromkeys(r for d in inputs for r in d.references))
    every = {t for d in inputs for t in d.types} - set(ignore)
    order = TopologicalSorter({t: {r.child for r in references if r.parent == t and r.child in every} for t in sorted(every)}).static_order()
    types: dict[str, DataFrame] = {}
    moved: dict[tuple[str, str], DataFrame] = {}  # type and referenced column: input, its value in a losing record, the winner's
    for t in order:
        parts = [d.types[t].withColumn("__i", F.lit(i)) for i, d in enumerate(inputs) if t in d.types]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        names = [c for c in out.columns if c != "__i"]
        for r in references:
            if r.parent == t and (m := moved.get((r.child, r.child_column))) is not None:
                at = F.col("__i") == F.col("__mi")
                out = out.join(m, at & (F.col(r.parent_column) == F.col("__old")), "left").withColumn(r.parent_column, F.coalesce("__new", r.parent_column)).select(*names, "__i")
        if t in keys:
            first = Window.partitionBy(*keys[t]).orderBy("__i", F.struct(*comparable(out, names)))
            out = out.withColumn("__n", F.row_number().over(first))
            for c in {r.child_column for r in references if r.child == t}:
                of = out.select("__i", F.col(c).alias("__old"), F.first(c).over(first).alias("__new")).filter("__old <> __new").dropDuplicates(["__i", "__old"])
                moved[t, c] = of.withColumnRenamed("__i", "__mi")
            types[t] = out.filter("__n = 1").drop("__n", "__i")
        else:
            types[t] = dedup(out.drop("__i"))
    return Dataset({t: types[t] for t in sorted(types)}, inputs[0].keys, references)


def remap(parents: DataFrame, column: str, children: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Parents (with __input and a nested child record) whose child becomes the earliest input's child of the same key."""
    all_ = _union([c.withColumn("__i", F.lit(i)) for i, c in enumerate(children)])
    winners = all_.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__i"))).filter("__n = 1")
    names = [c for c in all_.columns if c != "__i"]
    winners = winners.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.struct(*names).alias("__w"))
    condition = F.lit(True)
    for i, k in enumerate(key):
        condition = condition & F.col(f"{column}.{k}").eqNullSafe(F.col(f"__k{i}"))
    return parents.join(winners, condition, "left").withColumn(column, F.coalesce("__w", column)).select(parents.columns)


def copy(state: Dataset, accept: Mapping[str, Column]) -> Dataset:
    """Records that a predicate of their type accepts (all of types without one), and whatever those refer to."""
    seeds = {t: df.filter(accept[t]) if t in accept else df for t, df in state.types.items() if t in accept or t in state.top_level()}
    return Dataset(state.children(seeds), state.keys, state.references)


def include_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def exclude_keys(df: DataFrame, unwanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(unwanted.select(*keys), list(keys), "left_anti")


def exclude_with_referenced(state: Dataset, t: str, unwanted: DataFrame) -> Dataset:
    """Without records of given keys and everything only they refer to."""
    gone = state.unreferenced(state.children({t: include_keys(state.types[t], unwanted, state.keys[t])}))
    return _minus(state, gone)


def _minus(state: Dataset, gone: Mapping[str, DataFrame]) -> Dataset:
    out = {}
    for t, df in state.types.items():
        out[t] = df if t not in gone else with_id(df).join(with_id(gone[t]).select(RID), RID, "left_anti").drop(RID)
    return Dataset(out, state.keys, state.references)


def split(state: Dataset, shards: int, shard_of: Mapping[str, Column] | None = None, everywhere: Sequence[str] = ()) -> list[Dataset]:
    """Top-level records dealt to shards by a column expression (key hash by default; negative: to all), what they refer to along with them."""
    whole = split_all(state, shards, shard_of, everywhere)
    return [Dataset({t: df.filter(F.col("shard") == i).drop("shard") for t, df in whole.types.items()}, state.keys, state.references) for i in range(shards)]


def split_all(state: Dataset, shards: int, shard_of: Mapping[str, Column] | None = None, everywhere: Sequence[str] = ()) -> Dataset:
    """All shards in one pass: each type with a column `shard`, a record once for each shard that it is in; write with partitionBy("shard").

    The shards follow the references as a column: a join an edge, however many shards there are.
    """
    at: dict[str, DataFrame] = {}
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    for t in sorted(state.top_level()):
        df = state.types[t]
        own = (shard_of or {}).get(t)
        own = F.pmod(F.xxhash64(*state.keys.get(t, df.columns)), F.lit(shards)) if own is None else own
        own = every if t in everywhere else F.when(own < 0, every).otherwise(F.array(own.cast("int")))
        at[t] = df.withColumn("shard", F.explode(own)).filter((F.col("shard") >= 0) & (F.col("shard") < shards))
    for t in reversed(state.order()):
        for r in state.references:
            if r.parent == t and t in at and r.child in state.types:
                wanted = at[t].select(F.col(r.parent_column).alias("__k"), F.col("shard").alias("shard")).distinct()
                reached = state.types[r.child].join(wanted, F.col(r.child_column) == F.col("__k")).select(*state.types[r.child].columns, "shard")
                if r.child in at:
                    reached = dedup(at[r.child].unionByName(reached))
                at[r.child] = reached
    return Dataset(at, state.keys, state.references)


def split_by_place(df: DataFrame, shards: int) -> DataFrame:
    """Records dealt in turn, in order of their content: the same for the same state, whatever its layout; shards differ by a record at most.

    Places are numbered within ranges of the content id, which is evenly spread; each range adds what the ranges before it hold.
    """
    rows = with_id(df).withColumn("__p", F.conv(F.substring(RID, 1, 3), 16, 10).cast("int"))
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(RID)))
    before = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))  # 4,096 rows
    before = before.select("__p", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return rows.join(F.broadcast(before), "__p").withColumn("shard", F.pmod(F.col("__b") + F.col("__n") - 1, F.lit(shards)).cast("int")).select(*df.columns, "shard")


def include_records(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records that are among the wanted, by content."""
    return with_id(df).join(with_id(wanted, df.columns).select(RID), RID, "left_semi").drop(RID)


def exclude_records(df: DataFrame, unwanted: DataFrame) -> DataFrame:
    return with_id(df).join(with_id(unwanted, df.columns).select(RID), RID, "left_anti").drop(RID)


def copy_records(df: DataFrame, references: Mapping[str, DataFrame]) -> DataFrame:
    """Records with their references moved: column -> (old, new); a reference that isn't named stays."""
    names = df.columns
    for c, moved in references.items():
        m = moved.select(F.col(moved.columns[0]).alias("__old"), F.col(moved.columns[1]).alias("__new"))
        df = df.join(m, F.col(c) == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).select(*names)
    return df


def shard_column(df: DataFrame, shards: int, keys: Sequence[str]) -> DataFrame:
    """All shards in one pass: write with partitionBy("shard")."""
    return df.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards)).cast("int"))


def patch(base: Dataset, source: Dataset, t: str, where: Mapping[str, str], ignore: Sequence[str] = ()) -> Dataset:
    """Roots of a type that match (field -> text) are replaced by the source's matching roots; children that nothing else needs go and come with them."""
    def roots(d: Dataset) -> DataFrame:
        out = d.types[t]
        for f, text in where.items():
            out = field_match(out, f, text)
        return out

    gone = base.unreferenced(base.children({t: roots(base)}))
    fresh = source.children({t: roots(source)})
    kept = _minus(base, {k: v for k, v in gone.items() if k not in ignore})
    return combine([kept, Dataset({k: v for k, v in fresh.items() if k not in ignore}, base.keys, base.references)])


def write_outputs(df: DataFrame, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], folder: str) -> dict[str, DataFrame]:
    """Several filtered outputs of one read, each written under its name in folder and read from there."""
    df = df.persist()
    try:
        for n, f in outputs.items():
            f(df).write.mode("overwrite").parquet(f"{folder}/{n}")
    finally:
        df.unpersist()
    return {n: df.sparkSession.read.parquet(f"{folder}/{n}") for n in outputs}
