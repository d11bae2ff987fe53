"""A versioned store: snapshots and deltas as Parquet, a manifest per version, and an announcement.

    <root>/type=T/kind=snapshot|added|removed/version=V/    <root>/manifest/V.json    <root>/announced.json

Deltas carry full rows on both sides, so the reverse delta is the same files with roles swapped.  Data is written first, the manifest makes
a version visible (a staged one is read by its own store only), the announcement points to it last. Small files go through Spark's Hadoop filesystem, so any store Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dataset import Dataset, Reference
from ..operators.state import Delta, apply, delta


@dataclass
class Manifest:
    version: int
    base: int | None
    snapshot: bool
    types: list[str]
    changed: list[str]
    keys: dict[str, list[str]] = field(default_factory=dict)
    references: list[dict] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    parts: dict[str, str] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)
    #: Types whose snapshot lies elsewhere than under its version: type -> folder name.
    moved: dict[str, str] = field(default_factory=dict)


class VersionError(LookupError):
    """No such version, no way to it, or a delta that starts elsewhere."""


class Store:
    def __init__(self, spark: SparkSession, root: str, codec: str = "zstd", parts: Mapping[str, str] | None = None):
        """parts: type -> named side folder, read only on demand."""
        self.spark, self.root, self.codec, self.parts = spark, root.rstrip("/"), codec, dict(parts or {})
        #: Written versions that aren't visible yet: only this store reads them.
        self._staged: dict[int, Manifest] = {}

    # Small files.

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p, jvm

    def _put(self, name: str, value: dict) -> None:
        """Whole or not at all: written aside, then renamed over what is there in one step."""
        fs, aside, jvm = self._fs(f"{self.root}/.{name.replace('/', '-')}.{uuid.uuid4().hex}.tmp")
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, how)

    def _get(self, name: str) -> dict | None:
        fs, p, jvm = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        fs, p, _ = self._fs(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def manifest(self, version: int) -> Manifest:
        if version in self._staged:
            return self._staged[version]
        got = self._get(f"manifest/{version}.json")
        if got is None:
            raise VersionError(f"no version {version}")
        return Manifest(**got)

    def _folder(self, t: str, kind: str, version: int, part: str | None = None) -> str:
        part = self.parts.get(t) if part is None else part
        return f"{self.root}{f'/part={part}' if part else ''}/type={t}/kind={kind}/version={version}"

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("compression", self.codec).parquet(path)

    # Publishing.

    def publish(self, state: Dataset, version: int, before: Dataset | None = None, snapshot: bool = True, stage: bool = False) -> Manifest:
        """Write a version; with the state before it a delta of the types that changed as well. Types without a change write none.

        The state is computed once, as it is written; deltas are made from what was written. stage: nobody else sees the version until commit().
        """
        m = Manifest(version, before.version if before is not None else None, True, sorted(state.types), [], {k: list(v) for k, v in state.keys.items()}, [asdict(r) for r in state.references], dict(state.tags), dict(self.parts), {t: df.columns for t, df in state.types.items()})
        for t, df in state.types.items():
            self._write(df, self._folder(t, "snapshot", version))
        self._staged[version] = m
        if before is not None:
            written = self.snapshot(version)
            for t in sorted(written.types.keys() | before.types.keys()):
                d = self._delta(before, written, t)
                for kind, df in (("added", d.added), ("removed", d.removed)):
                    self._write(df, self._folder(t, kind, version))
                if not self.delta(version, t).is_empty():
                    m.changed.append(t)
                else:
                    self._drop(t, "added", version), self._drop(t, "removed", version)
            m.snapshot = snapshot
        if not stage:
            self.commit(version)
        return m

    def written(self, version: int) -> Dataset:
        """The state of a staged version, whether or not its snapshot will stay."""
        return self._snapshot(self._staged[version])

    def commit(self, version: int) -> None:
        """Make a staged version visible; a snapshot that isn't to stay goes."""
        m = self._staged[version]
        self._put(f"manifest/{version}.json", asdict(m))
        del self._staged[version]
        if not m.snapshot:
            for t in m.types:
                self._drop(t, "snapshot", version)

    def discard(self, version: int) -> None:
        """Take a staged version back, files and all."""
        m = self._staged.pop(version, None)
        for t in {*m.types, *self._types()} if m else ():
            for kind in ("snapshot", "added", "removed"):
                self._drop(t, kind, version)

    def _types(self) -> set[str]:
        return {t for v in self.versions() for t in self.manifest(v).types}

    def _drop(self, t: str, kind: str, version: int) -> None:
        fs, p, _ = self._fs(self._folder(t, kind, version))
        fs.delete(p, True)

    @staticmethod
    def _delta(before: Dataset, state: Dataset, t: str) -> Delta:
        old, new = before.types.get(t), state.types.get(t)
        return delta(new.limit(0) if old is None else old, old.limit(0) if new is None else new)

    def announce(self, version: int) -> None:
        self.manifest(version)
        self._put("announced.json", {"version": version})

    def announced(self) -> int | None:
        got = self._get("announced.json")
        return got and got["version"]

    # Reading.

    def snapshot(self, version: int, types: Sequence[str] | None = None, columns: Mapping[str, Sequence[str]] | None = None) -> Dataset:
        """A version that has a snapshot; only the types and columns asked for are read."""
        m = self.manifest(version)
        if not m.snapshot:
            raise VersionError(f"version {version} has no snapshot")
        return self._snapshot(m, types, columns)

    def _snapshot(self, m: Manifest, types: Sequence[str] | None = None, columns: Mapping[str, Sequence[str]] | None = None) -> Dataset:
        out = {}
        for t in m.types if types is None else [t for t in m.types if t in types]:
            df = self.spark.read.parquet(self._snapshot_folder(m, t))
            out[t] = df.select(*columns[t]) if columns and t in columns else df
        return self._dataset(out, m)

    def _snapshot_folder(self, m: Manifest, t: str) -> str:
        own = self._folder(t, "snapshot", m.version, m.parts.get(t, ""))
        return f"{own.rpartition('/')[0]}/{m.moved[t]}" if t in m.moved else own

    @staticmethod
    def _dataset(types: dict[str, DataFrame], m: Manifest) -> Dataset:
        return Dataset(types, {k: tuple(v) for k, v in m.keys.items()}, tuple(Reference(**r) for r in m.references), m.version, m.tags)

    def delta(self, version: int, t: str) -> Delta:
        part = self.manifest(version).parts.get(t, "")
        return Delta(*(self.spark.read.parquet(self._folder(t, k, version, part)) for k in ("added", "removed")))

    def step(self, state: Dataset, version: int) -> Dataset:
        """The state one version on: it has to be the one the delta starts from. Types that aren't loaded stay so; new ones come, lost ones go, columns are the version's."""
        m = self.manifest(version)
        if m.base != state.version:
            raise VersionError(f"the delta to {version} starts from {m.base}, the state is {state.version}")
        return self._moved(state, m, self.manifest(m.base), version, False)

    def step_back(self, state: Dataset) -> Dataset:
        m = self.manifest(state.version)
        if m.base is None:
            raise VersionError(f"version {state.version} has no delta")
        return self._moved(state, self.manifest(m.base), m, state.version, True)

    def _moved(self, state: Dataset, to: Manifest, from_: Manifest, version: int, back: bool) -> Dataset:
        types, loaded_all = dict(state.types), set(state.types) >= set(from_.types)
        for t in self.manifest(version).changed:
            if t not in types and not (loaded_all and t in to.types and t not in from_.types):
                continue
            d = self.delta(version, t)
            d = d.reverse() if back else d
            types[t] = apply(types.get(t, d.added.limit(0)), d, to.columns.get(t))
        for t in set(types) & set(to.types):
            if to.columns.get(t) and types[t].columns != to.columns[t]:  # a type that only lost or gained empty columns
                names = to.columns[t]
                d = self.delta(version, t) if t in self.manifest(version).changed else None
                types[t] = types[t].select(*[c if c in types[t].columns else F.lit(None).cast(d.added.schema[c].dataType if d else "string").alias(c) for c in names])
        return self._dataset({t: df for t, df in types.items() if t in to.types}, to)

    def plan(self, current: int | None, desired: int, max_deltas: int = 32, allow_snapshot: bool = True) -> list[tuple[str, int]]:
        """Steps (snapshot | delta | reverse, version) towards the newest version <= desired.

        Deltas from where one is, forward or back, up to max_deltas; else the nearest snapshot not above and deltas from there.
        """
        all_ = {v: self.manifest(v) for v in self.versions()}
        goal = max((v for v in all_ if v <= desired), default=None)
        if goal is None:
            raise VersionError(f"nothing at or before {desired}")
        next_ = {m.base: v for v, m in all_.items() if m.base is not None}

        def forward(v: int) -> list[tuple[str, int]] | None:
            out = []
            while v != goal:
                v = next_.get(v)
                if v is None or v > goal:
                    return None
                out.append(("delta", v))
            return out

        if current is not None and current in all_:
            steps: list[tuple[str, int]] | None = forward(current) if current <= goal else []
            v = current
            while steps is not None and v > goal:
                steps.append(("reverse", v))
                v = all_[v].base if all_[v].base is not None else goal - 1
            if v < goal and current > goal:
                steps = None
            if steps is not None and (len(steps) <= max_deltas or not allow_snapshot):
                return steps
        if current is not None and not allow_snapshot:
            raise VersionError("no chain of deltas, and snapshots aren't allowed")
        for s in sorted((v for v, m in all_.items() if m.snapshot and v <= goal), reverse=True):
            if (steps := forward(s)) is not None:
                return [("snapshot", s), *steps]
        raise VersionError(f"no way to {goal}")

    def load(self, version: int, current: Dataset | None = None, types: Sequence[str] | None = None, **options) -> Dataset:
        state = current
        for kind, v in self.plan(current.version if current else None, version, **options):
            state = self.snapshot(v, types) if kind == "snapshot" else self.step(state, v) if kind == "delta" else self.step_back(state)
        return state

    def clean(self, keep: int = 5) -> list[int]:
        """Drop snapshots but the newest `keep`; deltas stay, so every version from the oldest kept on can be read."""
        have = [v for v in self.versions() if self.manifest(v).snapshot]
        gone = have[:-keep] if keep else have
        for v in gone:
            m = self.manifest(v)
            m.snapshot = False
            self._put(f"manifest/{v}.json", asdict(m))
            for t in m.types:
                fs, p, _ = self._fs(self._snapshot_folder(m, t))
                fs.delete(p, True)
        return gone

    def compact(self, version: int, files: int, only: Sequence[str] | None = None) -> None:
        """Rewrite a version's snapshot in so many files a type; content is the same. The manifest names the new folders, then the old ones go."""
        m, state = self.manifest(version), self.snapshot(version, only)
        old = []
        for t, df in state.types.items():
            old.append(self._snapshot_folder(m, t))
            name = f"compacted={version}-{uuid.uuid4().hex}"
            self._write(df.repartition(files), f"{old[-1].rpartition('/')[0]}/{name}")
            m.moved[t] = name
        self._put(f"manifest/{version}.json", asdict(m))
        for folder in old:
            fs, p, _ = self._fs(folder)
            fs.delete(p, True)

    def needs_compaction(self, version: int, least: int, most_files: int = 1) -> dict[str, int]:
        """Types of a version's snapshot with over `most_files` files of under `least` bytes on average: how many files they have."""
        m, out = self.manifest(version), {}
        for t in m.types if m.snapshot else ():
            files, size = self._size(self._snapshot_folder(m, t))
            if files > most_files and size < least * files:
                out[t] = files
        return out

    def _size(self, folder: str) -> tuple[int, int]:
        """Data files of a folder, and their bytes."""
        fs, p, _ = self._fs(folder)
        files = [s for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._"] if fs.exists(p) else []
        return len(files), sum(s.getLen() for s in files)

    def footprint(self) -> DataFrame:
        """(type, kind, version, files, bytes) of what is stored."""
        rows = []
        for v in self.versions():
            m = self.manifest(v)
            for t, kind in [(t, "snapshot") for t in m.types if m.snapshot] + [(t, k) for t in m.changed for k in ("added", "removed")]:
                rows.append((t, kind, v, *self._size(self._snapshot_folder(m, t) if kind == "snapshot" else self._folder(t, kind, v, m.parts.get(t, "")))))
        return self.spark.createDataFrame(rows, "type string, kind string, version long, files long, bytes long")
