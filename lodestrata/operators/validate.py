"""Checks on a new state, each an outcome row: PASSED, FAILED, SKIPPED or ERROR."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dataset import Dataset
from .state import changes, modified


@dataclass(frozen=True)
class Outcome:
    name: str
    status: str
    message: str = ""
    details: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.status in ("PASSED", "SKIPPED")


Validator = Callable[[Dataset, Dataset | None], Outcome]


class ValidationError(RuntimeError):
    def __init__(self, outcomes: Sequence[Outcome]):
        self.outcomes = list(outcomes)
        super().__init__("; ".join(f"{o.name}: {o.status} {o.message}" for o in outcomes if not o.ok))


def _outcome(name: str, ok: bool, message: str, **details) -> Outcome:
    return Outcome(name, "PASSED" if ok else "FAILED", message, {k: str(v) for k, v in details.items()})


def duplicate_keys(t: str, keys: Sequence[str], most: int = 10) -> Validator:
    def check(now: Dataset, before: Dataset | None) -> Outcome:
        rows = now.types[t].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(most).collect()
        return _outcome(f"duplicate_keys({t})", not rows, f"{len(rows)} duplicate keys" if rows else "", keys=[tuple(r) for r in rows])

    return check


def new_duplicates(before: DataFrame, after: DataFrame, added: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that added rows duplicate, among themselves or with rows that stayed: only added keys are looked at."""
    fresh = added.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return after.join(fresh.select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def minimum_count(t: str, least: int) -> Validator:
    if not 0 <= least <= 2**29:
        raise ValueError("a minimum from 0 to 2^29")

    def check(now: Dataset, before: Dataset | None) -> Outcome:
        n = now.types[t].count()
        return _outcome(f"minimum_count({t})", n >= least, f"{n} records, at least {least}", count=n)

    return check


def null_keys(t: str, keys: Sequence[str]) -> Validator:
    """A null on the way to a key field counts as null."""
    def check(now: Dataset, before: Dataset | None) -> Outcome:
        n = null_key_rows(now.types[t], keys).count()
        return _outcome(f"null_keys({t})", not n, f"{n} records", count=n)

    return check


def null_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull()
    return df.filter(bad)


def object_modification(t: str, allowed: Column) -> Validator:
    """A predicate on before.* and after.* for updated records."""
    def check(now: Dataset, before: Dataset | None) -> Outcome:
        name = f"object_modification({t})"
        if before is None:
            return Outcome(name, "SKIPPED", "no previous state")
        bad = modified(before.types[t], now.types[t], now.keys[t], allowed).limit(1).collect()
        return _outcome(name, not bad, str(bad[0].asDict(True)) if bad else "")

    return check


def change_percentages(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(before, added, removed, updated) counts and percentages of the previous count."""
    n = before.agg(F.count(F.lit(1)).alias("before"))
    c = changes(before, after, keys).agg(*[F.count(F.when(F.col("change") == x, 1)).alias(x) for x in ("added", "removed", "updated")])
    out = n.join(F.broadcast(c))  # a row each
    return out.select("*", *[(100.0 * F.col(x) / F.col("before")).alias(f"{x}_percent") for x in ("added", "removed", "updated")])


def percent_change(t: str, added: float = -1, removed: float = -1, updated: float = -1) -> Validator:
    """Each percentage has to be below its threshold; a negative one is off."""
    def check(now: Dataset, before: Dataset | None) -> Outcome:
        name = f"percent_change({t})"
        if before is None or before.types[t].limit(1).isEmpty():
            return Outcome(name, "SKIPPED", "no previous records")
        r = change_percentages(before.types[t], now.types[t], now.keys[t]).first()
        over = [x for x, most in (("added", added), ("removed", removed), ("updated", updated)) if most >= 0 and not r[f"{x}_percent"] < most]
        return _outcome(name, not over, ", ".join(f"{x} {r[f'{x}_percent']:.2f} %" for x in over))

    return check


def count_variance(t: str, most: float) -> Validator:
    """The count changes by `most` percent at most; skipped without previous records."""
    def check(now: Dataset, before: Dataset | None) -> Outcome:
        name, was = f"count_variance({t})", 0 if before is None else before.types[t].count()
        if not was:
            return Outcome(name, "SKIPPED", "no previous records")
        n = now.types[t].count()
        return _outcome(name, 100 * abs(n - was) / was <= most, f"{was} to {n}")

    return check


def run(validators: Sequence[Validator], now: Dataset, before: Dataset | None, skip: bool = False) -> list[Outcome]:
    """All of them, whatever the others say; an exception is an ERROR; any that isn't ok fails the whole."""
    out = []
    for v in () if skip else validators:
        try:
            out.append(v(now, before))
        except Exception as e:  # a validator is user code
            out.append(Outcome(getattr(v, "__qualname__", repr(v)), "ERROR", repr(e)))
    if not all(o.ok for o in out):
        raise ValidationError(out)
    return out
