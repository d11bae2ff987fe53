"""SimHash near-duplicates through sharded BK-trees (operator 3)."""

from __future__ import annotations

import pickle
import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import mix
from .common import NULL_ID, as_bytes, binary_matrix, binary_rows, checkpoint, doc_key, partitions, small, whole_groups

#: Members of a tree node up to which it is a leaf, compared in one go; members of a shard up to which it is one tree; bytes of trees broadcast at once.
LEAF, HOT, BROADCAST_BYTES = 8, 4096, 32 << 20


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text, A-Z lower-cased; all words where there are fewer than `size`, nothing for none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - size + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64, n)


def majority(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """The fingerprint as bytes: a bit is 1 if set in over half the hashes; each further 64 bits come from remixed hashes."""
    out = []
    for lane in range(lanes):
        total = np.zeros(64, np.int64)
        for s in range(0, len(hashes), 100_000):
            part = hashes[s : s + 100_000]
            part = part if not lane else mix(part + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64))
            total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(total * 2 > len(hashes)))
    return np.concatenate(out)


def set_hash(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of sorted distinct shingle hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted arrays of distinct values; of two empty ones 1."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, sketch: int = 0, text: str = "text", doc_id: str = "doc_id", distinct: bool = False) -> DataFrame:
    """(id, k, fp, keys, same): the fingerprint of each row (of its distinct shingles, if asked), its `sketch` least shingle hashes and a hash of its shingle set."""

    def run(batches):
        for batch in small(batches):
            fps, keys, same = [], [], []
            for x in as_bytes(batch.column("text_")):
                h = shingle_hashes(x, shingle)
                own = np.unique(h) if sketch or distinct else h
                fps.append(majority(own if distinct else h, lanes))
                keys.append(own[:sketch].view(np.int64).tolist())
                same.append(set_hash(own) if distinct else 0)
            fp = binary_rows(np.array(fps, np.uint8).reshape(len(fps), lanes * 8))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), fp, pa.array(keys, pa.list_(pa.int64())), pa.array(same, pa.int64())], ["id", "k", "fp", "keys", "same"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), doc_key(doc_id).alias("k"), F.col(text).alias("text_"))
    return rows.mapInArrow(run, f"id {kind}, k long, fp binary, keys array<long>, same long")


class Forest:
    """Which of n things are connected: each points to a lesser one of its own tree, roots to themselves."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        at = self.up[of]
        while not np.array_equal(above := self.up[at], at):
            at = above
        self.up[of] = at
        return at

    def root(self, i: int) -> int:
        while (j := int(self.up[i])) != i:
            self.up[i] = self.up[j]
            i = j
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def unite(self, hits: np.ndarray, rows: np.ndarray, columns: np.ndarray, check: Similar | None = None) -> None:
        """Each row's hits fall together; hits within what is already one component cost nothing. check: confirms a link, if it isn't implied; pairs have to come both ways."""
        n, own, mine = len(self.up), self.roots(columns), self.roots(rows)
        low, high = np.where(hits, own, n).min(1), np.where(hits, own, -1).max(1)
        for i in np.flatnonzero((high >= 0) & ((low != high) | (low != mine))).tolist():
            row, found = int(rows[i]), columns[hits[i]]
            if check:
                found = found[found < row]
                found = check.maybe(row, found[self.roots(found) != self.root(row)])
            for c in found.tolist():
                if check is None or self.root(c) != self.root(row) and check.sure(c, row):
                    self.join(c, row)


class Similar:
    """Which sets of sorted hashes, end to end in an array (that may be a file), have a Jaccard similarity of so much."""

    SLOTS, AT_ONCE = 1 << 22, 1 << 22

    def __init__(self, hashes: np.ndarray, ends: list[int], similarity: float):
        self.hashes, self.ends, self.least = hashes, np.array(ends), similarity
        self.sizes = np.diff(self.ends)
        self.mark = np.zeros(self.SLOTS, bool)

    def _slots(self, a: int, b: int) -> np.ndarray:
        return (self.hashes[a:b] & np.uint64(self.SLOTS - 1)).astype(np.int64)

    def maybe(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others that could be as similar: by size, then by slots of their hashes, which are alike more often than the hashes, never less."""
        few, many = np.minimum(self.sizes[others], self.sizes[i]), np.maximum(self.sizes[others], self.sizes[i])
        others = others[few >= self.least * many]
        if len(others) < 8:
            return others
        own = self._slots(self.ends[i], self.ends[i + 1])
        self.mark[own] = True
        common = np.zeros(len(others), np.int64)
        first = 0
        while first < len(others):  # so many at once that what is read of them stays small
            last = first + max(1, int(np.searchsorted(np.cumsum(self.sizes[others[first:]]), self.AT_ONCE, "right")))
            part = others[first:last]
            if part[-1] - part[0] == len(part) - 1:  # neighbours: one range
                slots, size = self._slots(self.ends[part[0]], self.ends[part[-1] + 1]), self.sizes[part]
            else:
                slots, size = np.concatenate([self._slots(self.ends[c], self.ends[c + 1]) for c in part.tolist()]), self.sizes[part]
            sums = np.concatenate([[0], np.cumsum(self.mark[slots])])
            edge = np.concatenate([[0], np.cumsum(size)])
            common[first:last] = sums[edge[1:]] - sums[edge[:-1]]
            first = last
        self.mark[own] = False
        both = self.sizes[others] + self.sizes[i]
        return others[common >= self.least * (both - np.minimum(common, both - 1))]

    def sure(self, i: int, j: int) -> bool:
        few, many = sorted((self.sizes[i], self.sizes[j]))
        return few >= self.least * many and jaccard(self.hashes[self.ends[i] : self.ends[i + 1]], self.hashes[self.ends[j] : self.ends[j + 1]]) >= self.least


class BKTree:
    """Fingerprints (rows of uint64 lanes) below one another by integer distance: a node's children are keyed by how far their members are from it.

    Members are kept in tree order, so that a subtree is a range; a subtree of up to LEAF members is a leaf and isn't divided.
    """

    def __init__(self, fps: np.ndarray):
        self.order = np.arange(len(fps))
        #: node: start and end of its subtree, children as (distance, node); a leaf has none.
        self.nodes: list[tuple[int, int, list[tuple[int, int]]]] = []
        todo = [(0, len(fps), None, 0)]
        while todo:
            start, stop, parent, edge = todo.pop()
            if parent is not None:
                self.nodes[parent][2].append((edge, len(self.nodes)))
            self.nodes.append((start, stop, []))
            if stop - start <= LEAF:
                continue
            below = self.order[start + 1 : stop]
            away = np.bitwise_count(fps[below] ^ fps[self.order[start]]).sum(1, dtype=np.int16)
            by = np.argsort(away, kind="stable")
            self.order[start + 1 : stop] = below[by]
            edges, first = np.unique(away[by], return_index=True)
            for e, i, j in zip(edges.tolist(), first.tolist(), [*first[1:].tolist(), len(by)]):
                todo.append((start + 1 + i, start + 1 + j, len(self.nodes) - 1, e))
        self.fps = fps[self.order]

    def visit(self, queries: np.ndarray, radius: int):
        """(members, queries, hits): members' and queries' indexes, and which are within the radius. Of the queries that reach a node only those whose
        distance to it is within the radius of an edge follow that edge."""
        step = max(1, 20_000 // self.fps.shape[1])  # so that a leaf's distances stay within the cache
        todo = [(0, np.arange(len(queries)))] if len(self.fps) else []
        while todo:
            node, at = todo.pop()
            start, stop, children = self.nodes[node]
            members = self.order[start : start + 1 if children else stop]
            for s in range(0, len(at), step):
                part = at[s : s + step]
                away = np.bitwise_count(self.fps[start : start + len(members)][:, None, :] ^ queries[part][None, :, :]).sum(2, dtype=np.int16)
                yield members, part, away <= radius
                for edge, child in children:
                    follow = part[np.abs(away[0] - edge) <= radius]
                    if len(follow):
                        todo.append((child, follow))


def tree_links(fps: np.ndarray, radius: int, check: Similar | None = None) -> np.ndarray:
    """For each fingerprint the first member of its component under distance <= radius, by a BK-tree that all search together.

    With `check`, only links that it confirms count; it isn't asked about what is already one component.
    """
    forest = Forest(len(fps))
    for members, queries, hits in BKTree(fps).visit(fps, radius):
        forest.unite(hits, members, queries, check)
    return forest.roots(np.arange(len(fps)))


def block_keys(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """Shard keys of 64-bit fingerprints: any two of radius + 2 bit blocks. Within the radius at least two blocks are alike, so
    whatever links shares a shard; the keys are exact, 64 / (radius + 2) * 2 bits each."""
    blocks = radius + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    width = max(b - a for a, b in zip(edges, edges[1:]))
    return [(np.uint64(c) << np.uint64(2 * width)) | (part[i] << np.uint64(width)) | part[j] for c, (i, j) in enumerate(combinations(range(blocks), 2))]


def links(nodes: DataFrame, radius: int, lanes: int = 1) -> DataFrame:
    """Links (a, b) that connect whatever is within the radius and shares a shard; nodes: (rep, fp, keys), one per distinct fingerprint.

    Shards are keyed by `keys`, or with none by block_keys, which misses no link of 64-bit fingerprints. A shard of up to HOT members is one
    tree in one task, which yields a link per member at most. A hot shard is dealt into trees of up to HOT members, which are broadcast,
    BROADCAST_BYTES at a time (checked), to all tasks that hold its members; a task yields as many links as a batch and a tree have members, never their pairs.
    """

    def shard(batches):
        for batch in batches:
            fp = binary_matrix(batch.column("fp"), 8 * lanes)
            rep = batch.column("rep").to_numpy()
            listed = batch.column("keys").to_pylist()
            if any(listed):
                counts = np.fromiter(map(len, listed), np.int64, len(listed))
                row, key = np.repeat(np.arange(len(rep)), counts), np.fromiter((k for x in listed for k in x), np.int64, counts.sum())
            elif lanes == 1:
                keys = block_keys(fp.view(">u8").astype(np.uint64).ravel(), radius)
                row, key = np.tile(np.arange(len(rep)), len(keys)), np.concatenate(keys).view(np.int64)
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep[row]), binary_rows(fp[row])], ["key", "rep", "fp"])

    def lanes_of(column) -> np.ndarray:
        return binary_matrix(column, 8 * lanes).view(">u8").astype(np.uint64).reshape(-1, lanes)

    def grouped(batches, names: list[str]):
        held: list = []
        for table, goes_on in whole_groups(batches, names[0]):
            held.append(table)
            if goes_on:
                continue
            table, held = (pa.concat_tables(held).combine_chunks() if len(held) > 1 else table), []
            labels = [table.column(c).to_numpy() for c in names]
            step = np.zeros(table.num_rows - 1, bool)
            for x in labels:
                step |= x[1:] != x[:-1]
            edge = np.concatenate([[0], np.flatnonzero(step) + 1, [table.num_rows]])
            rep, fps = table.column("rep").to_numpy(), lanes_of(table.column("fp"))
            yield labels, rep, fps, edge

    def search(batches):
        for _, rep, fps, edge in grouped(batches, ["key"]):
            a, b = [], []
            for i in np.flatnonzero(np.diff(edge) > 1):
                own = slice(edge[i], edge[i + 1])
                label = tree_links(fps[own], radius)
                linked = np.flatnonzero(label != np.arange(len(label)))
                a.append(rep[own][linked])
                b.append(rep[own][label[linked]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def plant(batches):
        for (key, piece), rep, fps, edge in grouped(batches, ["key", "piece"]):
            for s, e in zip(edge, edge[1:]):
                tree = pickle.dumps((BKTree(fps[s:e]), rep[s:e]))
                yield pa.RecordBatch.from_arrays([pa.array([key[s]]), pa.array([piece[s]], pa.int32()), pa.array([tree], pa.binary()), pa.array([len(tree)], pa.int64())], ["key", "piece", "tree", "size"])

    def search_broadcast(trees):
        def run(batches):
            by_key: dict[int, list] = {}
            for key, piece, data in trees.value:
                by_key.setdefault(key, []).append((piece, *pickle.loads(data)))
            for batch in small(batches, HOT):
                keys, pieces, rep, fps = batch.column("key").to_numpy(), batch.column("piece").to_numpy(), batch.column("rep").to_numpy(), lanes_of(batch.column("fp"))
                for key in np.unique(keys).tolist():
                    for piece, tree, own in by_key.get(key, ()):
                        at = np.flatnonzero((keys == key) & (pieces >= piece))  # each pair of trees once
                        forest = Forest(len(own) + len(at))
                        for members, queries, hits in tree.visit(fps[at], radius):
                            forest.unite(hits, members, queries + len(own))
                        names, root = np.concatenate([own, rep[at]]), forest.roots(np.arange(len(own) + len(at)))
                        linked = np.flatnonzero(names != names[root])
                        yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[root[linked]])], ["a", "b"])

        return run

    spark = nodes.sparkSession
    n = partitions(spark)
    rows = nodes.mapInArrow(shard, "key long, rep long, fp binary")
    apart = lambda df: df.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(search, "a long, b long")
    hot = checkpoint(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT))
    if hot.isEmpty():
        return apart(rows)
    few = F.broadcast(hot) if hot.count() * 64 <= BROADCAST_BYTES else hot
    piece = F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / HOT)).cast("int")
    split = checkpoint(rows.join(few, "key").select("key", piece.alias("piece"), "rep", "fp"))
    trees = checkpoint(split.repartition(n, "key", "piece").sortWithinPartitions("key", "piece", "rep").mapInArrow(plant, "key long, piece int, tree binary, size long"))
    turns = -(-trees.agg(F.sum("size")).first()[0] // BROADCAST_BYTES)
    out = apart(rows.join(few, "key", "left_anti"))
    for i in range(turns):
        own = trees.filter(F.pmod(F.xxhash64("key", "piece"), F.lit(turns)) == i)
        sent = spark.sparkContext.broadcast([(r.key, r.piece, r.tree) for r in own.select("key", "piece", "tree").collect()])
        out = out.unionByName(checkpoint(split.mapInArrow(search_broadcast(sent), "a long, b long").distinct()))
        sent.unpersist()
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b), by alternating large-star and small-star steps.

    Each round halves paths at least; it is checkpointed, so lineage stays short and a lost executor costs a round at most.
    """
    def signature(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    last = signature(edges)
    while last[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        edges = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        small = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges = checkpoint(small.filter("a <> b").distinct())
        now = signature(edges)
        if now == last:
            break
        last = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def confirmed(candidates: DataFrame, shingle: int, radius: int, lanes: int, similarity: float) -> DataFrame:
    """(same, group) of candidates (component, same, text): components of the links within the radius whose shingle sets are as similar.

    A component's rows are in one task, their shingle hashes in a file of its own, so that a large one isn't held in memory.
    """

    def run(batches):
        with tempfile.TemporaryFile() as file:
            at, names, fps, ends = None, {}, [], [0]

            def groups() -> pa.RecordBatch:
                file.flush()
                hashes = np.memmap(file, np.uint64, "r", shape=(ends[-1],)) if ends[-1] else np.zeros(0, np.uint64)
                label = tree_links(np.array(fps, np.uint8).view(">u8").astype(np.uint64), radius, Similar(hashes, ends, similarity))
                own = np.fromiter(names, np.int64, len(names))
                return pa.RecordBatch.from_arrays([pa.array(own), pa.array(own[label])], ["same", "group"])

            for batch in small(batches):
                for component, same, text in zip(batch.column("component").to_pylist(), batch.column("same").to_pylist(), as_bytes(batch.column("text_"))):
                    if component != at:
                        if names:
                            yield groups()
                        file.seek(0)
                        file.truncate()
                        at, names, fps, ends = component, {}, [], [0]
                    h = np.unique(shingle_hashes(text, shingle))
                    if same in names or set_hash(h) != same:  # rows of one id with other texts
                        continue
                    names[same] = None
                    fps.append(majority(h, lanes))
                    ends.append(ends[-1] + len(h))
                    file.write(h.tobytes())
            if names:
                yield groups()

    n = partitions(candidates.sparkSession)
    return candidates.repartition(n, "component").sortWithinPartitions("component", "same").mapInArrow(run, "same long, group long")


def similar_documents(docs: DataFrame, shingle: int = 5, radius: int = 256, lanes: int = 16, sketch: int = 6, similarity: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of `similarity` at least, directly or over others.

    Documents that share one of their `sketch` least shingle hashes and have fingerprints (of the distinct shingles) up to `radius` bits
    apart are candidates; within what they connect, each pair within the radius is a link only if its shingle sets are so similar. The radius has
    to be wide: at 0.8, 1,024 bits differ in 155 on average, but four shingles of five in 192. Input and result are as of near_duplicates().
    """
    rows = checkpoint(fingerprints(docs, shingle, lanes, sketch, text, doc_id, distinct=True))
    nodes = rows.groupBy("same").agg(F.min("k").alias("k"), F.min_by("fp", "k").alias("fp"), F.min_by("keys", "k").alias("keys"))
    near = components(links(nodes.withColumnRenamed("same", "rep"), radius, lanes)).select(F.col("node").alias("same"), "component")
    near = near.union(near.select("component", "component").distinct())
    texts = docs.select(doc_key(doc_id).alias("k"), F.col(text).alias("text_"))
    found = checkpoint(confirmed(near.join(nodes.select("same", "k"), "same").join(texts, "k").select("component", "same", "text_"), shingle, radius, lanes, similarity))
    group = nodes.select("same", "k").join(found, "same", "left").select("same", "k", F.coalesce("group", "same").alias("group"))
    least = group.groupBy("group").agg(F.min("k").alias("c"))
    out = rows.select("id", "fp", "same").join(group.join(least, "group").select("same", "c"), "same")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, lanes: int = 1, sketch: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Group documents whose SimHash fingerprints differ in `radius` bits at most, directly or over others.

    lanes: 64-bit words of a fingerprint. sketch 0 (64 bits only): every link is found. sketch s: documents are compared where
    they share one of their s least shingle hashes, for radii too wide for shard keys by blocks.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased; fewer than `shingle` count as one shingle; no words (or null): fingerprint 0, linked
    like any other. Rows of one id keep a row each; a null id counts as the smallest and is returned as null. An empty
    table gives none; other columns are ignored.

    Returns doc_id, fingerprint (hex), component_id (the least id reachable).
    """
    rows = checkpoint(fingerprints(docs, shingle, lanes, sketch, text, doc_id))
    nodes = rows.groupBy("fp").agg(F.min("k").alias("rep"), F.min_by("keys", "k").alias("keys"))
    found = components(links(nodes, radius, lanes))
    reps = nodes.select("fp", "rep").join(found, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("c"))
    out = rows.select("id", "fp").join(reps, "fp", "left")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.when(F.col("c") != NULL_ID, F.col("c")).alias("component_id"))
