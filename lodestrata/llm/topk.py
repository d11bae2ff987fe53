"""Exact inner-product top-k by ball-tree branch and bound (operator 5)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, partitions

#: Vectors of one tree, queries of one block, vectors of a leaf, vectors that give the first bounds.
TREE, BLOCK, LEAF, SEED = 8192, 2048, 128, 1024
#: Centres and radii of trees broadcast at once: so many bytes; more go in turns.
SUMMARY_BYTES = 32 << 20
_LONG = 2**63 - 1


def exact(x: float, scale: int) -> int:
    """floor(scale * x) of a finite double, whatever its size."""
    return math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale


def _quantized(scale: int):
    """(id, dim, wide, v): v holds int32 of floor(scale * x) while sums of products stay exact in doubles (below 2^52); a wide vector's holds its doubles."""

    def run(batches):
        for batch in batches:
            column = batch.column("v")
            some = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False) & ~batch.column("id").is_null().to_numpy(zero_copy_only=False))
            part = column.take(pa.array(some))
            sizes = part.value_lengths().to_numpy()
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            with np.errstate(invalid="ignore", over="ignore"):
                q = np.floor(flat * scale)
                narrow = np.abs(q) <= np.floor(np.sqrt(2.0**52 / np.maximum(np.repeat(sizes, sizes), 1)))
            fails = lambda good: np.diff(np.concatenate([[0], np.cumsum(~good)])[offsets]) > 0
            keep, wide = np.flatnonzero(~fails(np.isfinite(flat))), fails(narrow)
            small = np.where(narrow, q, 0).astype(np.int32)
            vectors = [(flat if wide[i] else small)[offsets[i] : offsets[i + 1]].tobytes() for i in keep]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(some[keep])), pa.array(sizes[keep].astype(np.int32)), pa.array(wide[keep]), pa.array(vectors, pa.binary())], ["id", "dim", "wide", "v"])

    return run


def _matrix(data: bytes, dim: int, wide: bool) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.int32).reshape(-1, dim).astype(np.float64) if dim else np.zeros((0, 0))


class Ball:
    """A ball tree over the rows of v: centre and radius of each node; leaves hold rows."""

    def __init__(self, v: np.ndarray, rows: np.ndarray):
        own = v[rows]
        self.centre = own.mean(0)
        away = np.sqrt(((own - self.centre) ** 2).sum(1))
        self.radius = float(away.max()) * (1 + 1e-9) + 1e-6
        self.rows, self.halves = rows, ()
        if len(rows) > LEAF and self.radius > 1e-3:
            far = own[away.argmax()]
            other = own[((own - far) ** 2).sum(1).argmax()]
            side = own @ (other - far)
            half = len(rows) // 2
            order = np.argpartition(side, half)
            self.halves = (Ball(v, rows[order[:half]]), Ball(v, rows[order[half:]]))

    def bound(self, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return upper_bounds(q, norms, self.centre[None, :], np.array([self.radius]))[:, 0]


def upper_bounds(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The inner product that a query can reach in a ball at most, for each query and ball; with a margin for rounding."""
    reach = radii + 1e-9 * (np.sqrt((centres * centres).sum(1)) + radii)
    return q @ centres.T + norms[:, None] * reach[None, :] + 1e-3


def search(tree: Ball, ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of a tree for each query, ties to the smaller id; bound: a score that k candidates are known to reach.

    Each query goes to the half of the higher bound first, so that its k-th score rules the other one out more often.
    """
    best = np.full((len(q), k), -np.inf)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    norms = np.sqrt((q * q).sum(1))

    def visit(node: Ball, at: np.ndarray, own: np.ndarray) -> None:
        still = own >= np.maximum(best[at, -1], bound[at])
        at = at[still]
        if not len(at):
            return
        if node.halves:
            one, two = (h.bound(q[at], norms[at]) for h in node.halves)
            first = one >= two
            visit(node.halves[0], at[first], one[first])
            visit(node.halves[1], at, two)
            visit(node.halves[0], at[~first], one[~first])
            return
        scores = q[at] @ v[node.rows].T
        scores[qids[at][:, None] == ids[node.rows][None, :]] = -np.inf
        some = np.flatnonzero(scores.max(1) >= np.maximum(best[at, -1], bound[at]))
        if len(some):
            at, scores = at[some], scores[some]
            both = np.hstack([best[at], scores])
            names = np.hstack([who[at], np.broadcast_to(ids[node.rows], scores.shape)])
            order = np.lexsort((names, -both), axis=1)[:, :k]
            best[at], who[at] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    visit(tree, np.arange(len(q)), tree.bound(q, norms))
    return best, who


def search_wide(ids: np.ndarray, v: list[list[int]], qids: np.ndarray, q: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best candidates of each query where doubles can't hold the scores: they only tell which few are scored in whole numbers."""
    top = max((abs(x) for rows in (v, q) for r in rows for x in r), default=0)
    if top < 2**500:
        a, b = np.array(q, float), np.array(v, float)
        about, off = a @ b.T, (np.abs(a) @ np.abs(b).T) * (b.shape[1] + 8) * 2.0**-51
    out = []
    for i, own in enumerate(q):
        there = np.flatnonzero(ids != qids[i])
        if top < 2**500 and len(there) > k:
            least = np.partition((about - off)[i, there], len(there) - k)[len(there) - k]
            there = there[(about + off)[i, there] >= least]
        scored = sorted((-sum(x * y for x, y in zip(own, v[j])), int(ids[j])) for j in there.tolist())
        out += [(i, name, -s) for s, name in scored[:k]]
    return out


_PACK = "pack long, dim int, wide boolean, ids binary, data binary, extra binary"


def _packs(size: int, finish):
    """Rows of one dimension and width at a time packed by `size`; finish(dim, wide, ids, vectors) gives the column `extra`."""

    def run(batches):
        from pyspark import TaskContext

        part, count, held = TaskContext.get().partitionId(), 0, {}

        def packed(key, rows):
            nonlocal count
            ids, data = np.array([r[0] for r in rows], np.int64), b"".join(r[1] for r in rows)
            count += 1
            values = [part << 32 | count, *key, ids.tobytes(), data, finish(*key, ids, _matrix(data, *key))]
            kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["pack", "dim", "wide", "ids", "data", "extra"])

        for batch in batches:
            for i, dim, wide, v in zip(*(batch.column(c).to_pylist() for c in ("id", "dim", "wide", "v"))):
                rows = held.setdefault((dim, wide), [])
                rows.append((i, v))
                if len(rows) == size:
                    yield packed((dim, wide), held.pop((dim, wide)))
        for key, rows in held.items():
            yield packed(key, rows)

    return run


def _summary(dim: int, wide: bool, ids: np.ndarray, v: np.ndarray) -> bytes:
    """A tree's centre and radius."""
    if wide or not dim:
        return b""
    centre = v.mean(0)
    return np.append(centre, np.sqrt(((v - centre) ** 2).sum(1).max()) * (1 + 1e-9) + 1e-6).tobytes()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """The k candidates with the highest integer inner product for each query, itself left out, ties to the smaller id.

    Components become floor(scale * x).  Vectors that are null, have no id, or hold a null or non-finite component take no part; a query meets
    candidates of its own dimension only; an empty vector scores 0 with another.  Rows of one id are candidates each, yet none of them for a query of
    that id. An empty side gives no rows; other columns are ignored. A score beyond a long is ranked as what it is and returned as the nearest long.

    Candidates lie in trees of TREE vectors, near ones together (dealt by their nearest of 64 sampled pivots, then by range, so that no pivot is hot);
    queries come in blocks of BLOCK. Trees' centres and radii are sent to the blocks: each query goes to the tree of its highest bound first; the k-th
    score it reaches there (at least what SEED sampled vectors give) is what all other trees' bounds have to reach for it to be sent to them. A task
    shares what its trees have reached so far. Vectors so large that sums of products may pass 2^52 lie in packs of their own and are scored in whole numbers.

    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    n = partitions(spark)
    of = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(_quantized(scale), "id long, dim int, wide boolean, v binary")
    base = of(vectors)
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample = base.filter("NOT wide AND dim > 0").orderBy(F.xxhash64("id"), "id").limit(SEED).collect()
    for d in {r.dim for r in sample}:
        seeds[d] = np.array([r.id for r in sample if r.dim == d]), np.array([np.frombuffer(r.v, np.int32) for r in sample if r.dim == d], float)

    def near(batches):
        for batch in batches:
            dims, wide, vs, out = batch.column("dim").to_pylist(), batch.column("wide").to_pylist(), batch.column("v").to_pylist(), np.zeros(batch.num_rows, np.int32)
            for d in set(dims) & seeds.keys():
                rows = [i for i, x in enumerate(dims) if x == d and not wide[i]]
                pivots = seeds[d][1][:64]
                out[rows] = ((pivots**2).sum(1) - 2 * _matrix(b"".join(vs[i] for i in rows), d, False) @ pivots.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], ["id", "dim", "wide", "v", "pivot"])

    def seeded(dim: int, wide: bool, ids: np.ndarray, v: np.ndarray) -> bytes:
        """The k-th score that the sampled vectors give each query."""
        bound = np.full(len(ids), -np.inf)
        if not wide and dim in seeds and len(seeds[dim][0]) > k:
            scores = v @ seeds[dim][1].T
            scores[ids[:, None] == seeds[dim][0][None, :]] = -np.inf
            bound = np.partition(scores, -k, axis=1)[:, -k]
        return bound.tobytes()

    dealt = lambda df: df.mapInArrow(near, "id long, dim int, wide boolean, v binary, pivot int").repartitionByRange(n, "dim", "wide", "pivot", "id")
    trees = checkpoint(dealt(base).mapInArrow(_packs(TREE, _summary), _PACK))
    blocks = checkpoint(dealt(of(queries)).mapInArrow(_packs(BLOCK, seeded), _PACK))
    width = trees.agg(F.max(F.octet_length("extra"))).first()[0] or 0
    turns = -(-trees.count() * (width + 32) // SUMMARY_BYTES)
    names = trees.select("pack", "dim", "wide", "extra")
    in_turn = lambda t: names if turns <= 1 else names.filter(F.pmod(F.xxhash64("pack"), F.lit(turns)) == t)
    routed = "pack long, block long, dim int, wide boolean, at binary, ids binary, data binary, bound binary"

    def send(first: bool, turn: int):
        """Blocks' queries to trees: each to the one of its highest bound (of this turn's trees), or to all others that its own bound doesn't rule out."""
        summaries = spark.sparkContext.broadcast([(r.pack, r.dim, r.wide, r.extra) for r in in_turn(turn).collect()])

        def run(batches):
            tables = {}
            for pack, dim, wide, extra in sorted(summaries.value, key=lambda x: x[0]):
                tables.setdefault((dim, wide), []).append((pack, extra))
            for batch in batches:
                for block, dim, wide, ids, data, bound in zip(*(batch.column(c).to_pylist() for c in ("pack", "dim", "wide", "ids", "data", "extra"))):
                    q, size = _matrix(data, dim, wide), len(data) // max(1, len(ids) // 8)
                    for other in (False, True):
                        some = tables.get((dim, other), [])
                        if wide or other or not dim:  # nothing to tell them apart by
                            goes = np.full((len(ids) // 8, len(some)), not first)
                        else:
                            table = np.array([np.frombuffer(x, np.float64) for _, x in some]).reshape(-1, dim + 1)
                            reach = upper_bounds(q, np.sqrt((q * q).sum(1)), table[:, :-1], table[:, -1])
                            goes = np.zeros(reach.shape, bool)
                            if len(some):
                                goes[np.arange(len(q)), reach.argmax(1)] = True
                            goes = goes if first else ~goes & (reach >= np.frombuffer(bound, np.float64)[:, None])
                        for j in np.flatnonzero(goes.any(0)).tolist():
                            at = np.flatnonzero(goes[:, j])
                            cut = lambda x, w: np.frombuffer(x, np.uint8).reshape(-1, w)[at].tobytes() if w else b""  # noqa: E731, B023
                            values = [some[j][0], block, dim, wide, at.astype(np.int32).tobytes(), cut(ids, 8), cut(data, size), cut(bound, 8)]
                            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]
                            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["pack", "block", "dim", "wide", "at", "ids", "data", "bound"])

        return run

    def searched(batches) -> Iterator[pa.RecordBatch]:
        tree, reached = None, {}
        for batch in batches:
            for block, dim, wide, at, ids, data, bound in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "wide", "at", "ids", "data", "bound"))):
                if block < 0:
                    names, v, big, raw, tree = np.frombuffer(ids, np.int64), _matrix(data, dim, wide), wide, data, None
                    continue
                qids, rows = np.frombuffer(ids, np.int64), np.frombuffer(at, np.int32)
                if wide or big or not dim:
                    whole = lambda x, w: [[exact(c, scale) for c in r] if w else [int(c) for c in r] for r in _matrix(x, dim, w)] if dim else None  # noqa: E731, B023
                    found = search_wide(names, whole(raw, big) or [[]] * len(names), qids, whole(data, wide) or [[]] * len(qids), k)
                    of_query, vec, scores = (list(x) for x in zip(*found)) if found else ([], [], [])
                    over = [None if -_LONG - 1 <= s <= _LONG else s.bit_length() * (1 if s > 0 else -1) for s in scores]
                    exactly = [None if o is None else (s if s >= 0 else s + (1 << s.bit_length())).to_bytes(s.bit_length() // 8 + 1, "big") for s, o in zip(scores, over)]
                    scores = [max(-_LONG - 1, min(_LONG, s)) for s in scores]
                else:
                    q = _matrix(data, dim, False)
                    tree = tree or Ball(v, np.arange(len(v)))
                    known = np.maximum(np.frombuffer(bound), reached[block][rows] if block in reached else -np.inf)
                    best, who = search(tree, names, v, qids, q, known, k)
                    if len(reached) > 256:  # only bounds are forgotten
                        reached.pop(next(iter(reached)))
                    held = reached.setdefault(block, np.full(BLOCK, -np.inf))
                    held[rows] = np.maximum(known, best[:, -1])
                    of_query, column = np.nonzero(np.isfinite(best))
                    vec, scores = who[of_query, column], best[of_query, column].astype(np.int64)
                    over = exactly = [None] * len(vec)
                arrays = [pa.array(np.full(len(vec), block), pa.int64()), pa.array(rows[of_query] if len(vec) else [], pa.int32()), pa.array(qids[of_query] if len(vec) else [], pa.int64()), pa.array(vec, pa.int64()), pa.array(scores, pa.int64()), pa.array(over, pa.int32()), pa.array(exactly, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "at", "query_id", "vec_id", "score", "over", "exactly"])

    def wave(first: bool, blocks: DataFrame) -> DataFrame:
        shape = routed.split(", ")
        rows = trees.select("pack", F.lit(-1).cast("long").alias("block"), "dim", "wide", F.lit(b"").alias("at"), "ids", "data", F.lit(b"").alias("bound"))
        for t in range(max(1, turns)):
            rows = rows.unionByName(blocks.mapInArrow(send(first, t), ", ".join(shape)))
        found = rows.repartition(n, "pack").sortWithinPartitions("pack", "block")
        return checkpoint(found.mapInArrow(searched, "block long, at int, query_id long, vec_id long, score long, over int, exactly binary"))

    one = wave(True, blocks)
    # What each query has reached: its k-th score, if it has k.
    kth = one.filter("over IS NULL").groupBy("block", "at").agg(F.get(F.sort_array(F.collect_list("score"), False), F.lit(k - 1)).alias("kth")).filter("kth IS NOT NULL")
    kth = kth.groupBy(F.col("block").alias("pack")).agg(F.collect_list(F.struct("at", "kth")).alias("reached"))

    def raised(batches):
        for batch in batches:
            new = []
            for bound, reached in zip(batch.column("extra").to_pylist(), batch.column("reached").to_pylist()):
                own = np.frombuffer(bound, np.float64).copy()
                for x in reached or ():
                    own[x["at"]] = max(own[x["at"]], x["kth"])
                new.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.select(["pack", "dim", "wide", "ids", "data"]).columns, pa.array(new, pa.binary())], ["pack", "dim", "wide", "ids", "data", "extra"])

    found = one.unionByName(wave(False, blocks.join(kth, "pack", "left").mapInArrow(raised, _PACK)))
    # Scores beyond a long: by sign and length, then by digits.
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("over", F.lit(0))), F.desc("exactly"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
