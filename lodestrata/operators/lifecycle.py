"""Producing versions in cycles and following them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Sequence
from concurrent.futures import Future
from dataclasses import dataclass, field
from hashlib import sha256
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.records import RID, VersionMinter, with_id
from ..plans.schema import dump, from_spark
from ..sources.store import Store, VersionError
from . import validate
from .dataset import Dataset
from .state import Delta, dedup, delta, mutate


@dataclass
class Producer:
    """One cycle: mint a version, populate, write it aside, check, validate, make it visible, announce; a step that fails leaves nothing of it behind.

    listeners: called (event, version, details) at each step; one that raises before "published" vetoes the cycle.
    """

    store: Store
    validators: Sequence[validate.Validator] = ()
    snapshot_every: int = 1
    listeners: list[Callable[[str, int, dict], None]] = field(default_factory=list)
    is_primary: Callable[[], bool] = lambda: True
    check_integrity: bool = True
    minter: VersionMinter = field(default_factory=VersionMinter)
    current: Dataset | None = None
    cycles: int = 0
    metrics: list[dict] = field(default_factory=list)

    def restore(self, version: int) -> Dataset:
        self.current = self.store.load(version)
        return self.current

    def _tell(self, event: str, version: int, **details) -> None:
        for f in self.listeners:
            f(event, version, details)

    def run_cycle(self, populate: Callable[[Dataset | None], Dataset]) -> int | None:
        """The new version; None if this isn't the primary producer or nothing changed."""
        if not self.is_primary():
            return None
        began, version, before = time.time(), self.minter.mint(), self.current
        self._tell("cycle_start", version)
        try:
            state = populate(before)
            # Records alike are one; those of a type with a key differ anyhow.
            state = Dataset({t: df if state.keys.get(t) else dedup(df) for t, df in state.types.items()}, state.keys, state.references, tags=state.tags)
            schema = {t: df.schema.json() for t, df in state.types.items()}
            schema_hash = sha256("\n".join(f"{t} {s}" for t, s in sorted(schema.items())).encode()).hexdigest()
            evolved = before is not None and before.tags.get("schema_hash") != schema_hash
            tags = {**state.tags, "schema_hash": schema_hash, "schema_changed": str(evolved).lower(), "chain": str(self.cycles)}
            snapshot = before is None or self.cycles % self.snapshot_every == 0
            m = self.store.publish(Dataset(state.types, state.keys, state.references, version, tags), version, before, snapshot, stage=True)
            # From here on the state is what was written, not the plan that made it.
            state = self.store.written(version)
            changed = before is None or bool(m.changed) or evolved or before.types.keys() != state.types.keys()
            self._tell("populated", version, changed=changed)
            if not changed:
                self.store.discard(version)
                self._tell("no_change", version)
                return None
            self._tell("staged", version, snapshot=snapshot)
            if self.check_integrity and before is not None:
                self._integrity(before, state, version)
            outcomes = validate.run(self.validators, state, before)
            self._tell("validated", version, outcomes=outcomes)
            self.store.commit(version)
            self._tell("published", version, snapshot=snapshot)
            self.store.announce(version)
            self._tell("announced", version)
        except Exception as e:
            self.store.discard(version)
            self._tell("cycle_failed", version, error=e)
            self.metrics.append({"version": version, "ok": False, "seconds": time.time() - began})
            raise
        self.current = self.store.load(version)
        self.cycles += 1
        self.metrics.append({"version": version, "ok": True, "seconds": time.time() - began, "changed": sorted(m.changed)})
        return version

    def run_compaction_cycle(self, least: int = 32 << 20, files: int = 1) -> list[str]:
        """Rewrite those types of the current version's snapshot that lie in too many small files; content and version stay. The types rewritten."""
        if not self.is_primary() or self.current is None or not self.store.manifest(self.current.version).snapshot:
            return []
        found = sorted(self.store.needs_compaction(self.current.version, least, files))
        if found:
            self.store.compact(self.current.version, files, found)
            self._tell("compacted", self.current.version, types=found)
            self.current = self.store.load(self.current.version)
        return found

    def _integrity(self, before: Dataset, state: Dataset, version: int) -> None:
        forward = self.store.step(before, version)
        back = self.store.step_back(forward)
        for got, want, what in ((forward, state, "delta"), (back, before, "reverse delta")):
            if got.types.keys() != want.types.keys():
                raise VersionError(f"{what} of {version} doesn't give the state's types")
            got = Dataset({t: df.select(*want.types[t].columns) for t, df in got.types.items()})
            a, b = (sorted(map(tuple, d.checksum().collect())) for d in (got, want))
            if a != b:
                raise VersionError(f"{what} of {version} doesn't give the state: {a} and {b}")

    def run_incremental(self, t: str, events: DataFrame, keys: Sequence[str], sequence: str = "seq", action: str = "action") -> int | None:
        """A cycle that applies keyed mutations to one type; children that nothing refers to any more go."""
        def populate(before: Dataset | None) -> Dataset:
            if before is None:
                raise VersionError("restore or populate a state first")
            after = mutate(before.types[t], events, keys, sequence, action)
            gone = with_id(before.types[t]).join(with_id(after, before.types[t].columns).select(RID), RID, "left_anti").drop(RID)
            orphans = before.unreferenced({k: v for k, v in before.children({t: gone}).items() if k != t} | {t: gone})
            types = dict(before.types)
            for k, df in orphans.items():
                types[k] = with_id(types[k]).join(with_id(df).select(RID), RID, "left_anti").drop(RID) if k != t else after
            return Dataset(types, before.keys, before.references)

        return self.run_cycle(populate)


@dataclass
class Consumer:
    """Follows announced versions (or a pinned one) by deltas where it can."""

    store: Store
    types: Sequence[str] | None = None
    listeners: list[Callable[[str, int], None]] = field(default_factory=list)
    pinned: int | None = None
    max_deltas: int = 32
    allow_snapshot: bool = True
    failed: set[int] = field(default_factory=set)
    state: Dataset | None = None
    metrics: list[dict] = field(default_factory=list)
    lock: threading.RLock = field(default_factory=threading.RLock, repr=False)

    def refresh_later(self, delay: float = 0.0, version: int | None = None) -> Future:
        """refresh() in a thread of its own after so many seconds; refreshes wait for one another."""
        out: Future = Future()

        def run() -> None:
            try:
                out.set_result(self.refresh(version))
            except Exception as e:  # handed to who waits
                out.set_exception(e)

        timer = threading.Timer(delay, run)
        timer.daemon = True
        timer.start()
        return out

    def refresh(self, version: int | None = None) -> Dataset | None:
        with self.lock:
            return self._refresh(version)

    def _refresh(self, version: int | None = None) -> Dataset | None:
        """To a version, the pinned one, or the announced one; a version that failed once isn't tried again by itself."""
        goal = version if version is not None else self.pinned if self.pinned is not None else self.store.announced()
        if goal is None or self.state is not None and self.state.version == goal or version is None and goal in self.failed:
            return self.state
        began = time.time()
        try:
            steps = self.store.plan(self.state.version if self.state else None, goal, self.max_deltas, self.allow_snapshot or self.state is None)
            state = self.store.load(goal, self.state, self.types, max_deltas=self.max_deltas, allow_snapshot=self.allow_snapshot or self.state is None)
        except Exception:
            self.failed.add(goal)
            raise
        self.state = state
        self.metrics.append({"version": state.version, "steps": len(steps), "seconds": time.time() - began})
        for f in self.listeners:
            f("snapshot" if steps and steps[0][0] == "snapshot" else "delta", state.version)
        return state


class Versions(Protocol):
    """What a producer needs of a store; any class with these methods will do."""

    def publish(self, state: Dataset, version: int, before: Dataset | None = None, snapshot: bool = True, stage: bool = False): ...
    def written(self, version: int) -> Dataset: ...
    def commit(self, version: int) -> None: ...
    def discard(self, version: int) -> None: ...
    def announce(self, version: int) -> None: ...
    def load(self, version: int, current: Dataset | None = None, types: Sequence[str] | None = None, **options) -> Dataset: ...


class Announcements(Protocol):
    """What tells a consumer the version to go to."""

    def announced(self) -> int | None: ...


@dataclass
class Handle:
    """A type of a consumer's state by name: always of the version that the consumer has by then. A type that isn't there is empty, if its schema is given; disabled: it raises."""

    consumer: Consumer
    type: str
    schema: StructType | None = None
    enabled: bool = True

    def get(self) -> DataFrame:
        if not self.enabled or self.consumer.state is None:
            raise LookupError(f"{self.type} can't be read")
        return self.consumer.state.get(self.type, self.schema)


def schema_text(state: Dataset) -> str:
    """The declarations of a state's types."""
    out = {}
    for t, df in state.types.items():
        out |= from_spark(t, df.schema, state.keys.get(t, ()))
    return dump(out)


def change_of(before: Dataset, after: Dataset, t: str) -> Delta:
    return delta(before.types[t], after.types[t])


def type_overview(state: Dataset, stored: DataFrame | None = None, by: str = "records") -> DataFrame:
    """Types with their records, fields and key, most first; with a store's footprint the files and bytes of the state's version too."""
    known = state.counts().join(F.broadcast(next(iter(state.types.values())).sparkSession.createDataFrame([(t, len(df.columns), ",".join(state.keys.get(t, ()))) for t, df in state.types.items()], "type string, fields int, key string")), "type")
    if stored is not None:
        sizes = stored.filter((F.col("kind") == "snapshot") & (F.col("version") == state.version)).select("type", "files", "bytes")
        known = known.join(F.broadcast(sizes), "type", "left")
    return known.orderBy(F.desc(by), "type")
