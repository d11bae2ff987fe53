"""Token windows that also start earlier in the corpus: what suffix-array (bytes) and substring (words) dedup share.

Plan, two passes over the texts; texts are exchanged by document only:

1. anchors of all documents, with a digest of their context (the tokens of all windows that may own the anchor) -> one exchange by anchor, an initial
   bucket each: what repeats an earlier context whole is covered; the first of each context goes on if its bucket has others; the rest is unique;
2. those meet their documents again (exchange of texts by document, read twice by exchange reuse), which send the tokens around
   each first -> one exchange by bucket, sorted by document and place: the operator compares contents and yields covered ranges;
3. ranges meet their documents, which drop the tokens.

So copies, however many, cost an anchor row each and no context; what a batch repeats within itself doesn't meet in a bucket. A bucket of over HOT different
contexts (a very common line in ever new surroundings) isn't gathered: its windows are dealt one by one, by their content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import anchors as A
from .common import as_bytes, doc_key, partitions, small

#: Different contexts of a bucket up to which one task compares them.
HOT = 4096
_LOW = 0xFFFFFFFF
#: What the second exchange carries. Context null: `before` tokens from pos on are known to be covered. before = WINDOW: one window of a hot bucket, of
#: whose digest h has 64 bits and the context the rest. Else a context, with as many tokens before the anchor at pos.
WINDOW = -1
CONTEXTS = "h long, k long, tag long, pos int, before int, context binary"
RANGES = "k long, tag long, start long, end long"

Covers = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass(frozen=True)
class Tokens:
    """Texts as tokens: bytes end to end, edges of the tokens in them, and where each text's tokens begin (one more at the end)."""

    data: bytes
    starts: np.ndarray | None
    ends: np.ndarray | None
    offsets: np.ndarray

    def cut(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ranges as byte ranges."""
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])


@dataclass(frozen=True)
class Unit:
    """How texts become tokens."""

    window: int
    gram: int
    words: bool
    #: True: only another document with a smaller id counts as earlier; False: an earlier start in the same one as well.
    other_document: bool

    @property
    def left(self) -> int:
        return self.window - self.gram

    def tokens(self, texts: list[bytes]) -> Tokens:
        if self.words:  # one space between words, so that equal words are equal bytes
            return Tokens(*A.word_edges([b" ".join(t.split()) for t in texts]))
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        return Tokens(b"".join(texts), None, None, offsets)

    def anchors(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            return A.word_anchors(A.hash_words(t.data, t.starts, t.ends), t.offsets, self.window, self.gram)
        return A.byte_anchors(np.frombuffer(t.data, np.uint8), t.offsets, self.window, self.gram)

    def around(self, t: Tokens, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context of an anchor: from the first to behind the last token of its document's windows that may own it."""
        return np.maximum(at - self.left, t.offsets[doc]), np.minimum(at + self.window, t.offsets[doc + 1])


def keyed(docs: DataFrame, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """Rows under (k, tag): the document id, null as the smallest, and a 64-bit hash that tells rows of one id apart; alike rows have one result."""
    tag = F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))
    return docs.select(doc_key(doc_id).alias("k"), tag.alias("tag"), F.col(text).alias("text_"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)])


def packed(batches):
    """Texts compressed, each by itself: they are what the exchange by document mostly moves."""
    compress = zstandard.ZstdCompressor(level=3).compress
    for batch in small(batches):
        i = batch.schema.get_field_index("text_")
        column = batch.column(i)
        texts = [None if null else compress(t) for t, null in zip(as_bytes(column), column.is_null().to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()) if j == i else c for j, c in enumerate(batch.columns)], batch.schema.names)


def unpacked(column: pa.Array) -> list[bytes]:
    """The inverse of packed(); null becomes empty."""
    decompress = zstandard.ZstdDecompressor().decompress
    return [decompress(x) if x else b"" for x in column.to_pylist()]


def _anchors_of(unit: Unit) -> Covers:
    def run(batches):
        for batch in small(batches):
            t = unit.tokens(as_bytes(batch.column("text_")))
            at, h = unit.anchors(t)
            doc = np.searchsorted(t.offsets, at, "right") - 1
            start, end = unit.around(t, at, doc)
            d = A.digests(t.data, *t.cut(start, end))
            # Contexts are alike only if the anchor stands at the same place in them.
            c1 = (d[:, 0].astype(np.uint64) | d[:, 1].astype(np.uint64) << np.uint64(32)) ^ A.mix((at - start).astype(np.uint64) + np.uint64(1)) | np.uint64(1)
            k, tag = (batch.column(c).to_numpy()[doc] for c in ("k", "tag"))
            pos = at - t.offsets[doc]
            # What repeats a context within this batch is covered already: under a bucket of its own, so that no bucket grows with its copies.
            order = np.lexsort((pos, k, d[:, 2], c1, h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (c1[order][1:] != c1[order][:-1]) | (d[order, 2][1:] != d[order, 2][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
            later = k[order] != k[first]
            later = order[later if unit.other_document else later | (pos[order] != pos[first])]
            c1[later] = 0
            h[later] = A.mix(A.mix(k[later].view(np.uint64) ^ A.mix(tag[later].view(np.uint64))) ^ pos[later].view(np.uint64))
            low = tag.view(np.uint64) & np.uint64(_LOW)
            c2, loc = d[:, 2].astype(np.uint64) << np.uint64(32) | tag.view(np.uint64) >> np.uint64(32), pos.astype(np.uint64) << np.uint64(32) | low
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (h, c1, c2)), pa.array(k), pa.array(loc.view(np.int64))], ["h", "c1", "c2", "k", "loc"])

    return run


def _contexts_of(unit: Unit) -> Covers:
    def rows(h, k, tag, pos, before, contexts) -> pa.RecordBatch:
        if isinstance(contexts, bytes):  # four bytes each
            contexts = pa.Array.from_buffers(pa.binary(), len(h), [None, pa.py_buffer(np.arange(0, 4 * len(h) + 1, 4, dtype=np.int32)), pa.py_buffer(contexts)])
        arrays = [pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(tag, pa.int64()), pa.array(pos, pa.int32()), pa.array(before, pa.int32()), pa.array(contexts, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["h", "k", "tag", "pos", "before", "context"])

    def windows(t: Tokens, start, end, k, tag) -> Iterator[pa.RecordBatch]:
        """Contexts of hot buckets window by window, each under a bucket that its content names; what this batch repeats is known to be covered."""
        n = np.maximum(end - start - unit.window + 1, 0)
        every = np.unique(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n))
        for s in range(0, len(every), 200_000):
            a = every[s : s + 200_000]
            d = A.digests(t.data, *t.cut(a, a + unit.window))
            h = d[:, 0].astype(np.uint64) | d[:, 1].astype(np.uint64) << np.uint64(32)
            doc = np.searchsorted(t.offsets, a, "right") - 1
            who, names, pos = k[doc], tag[doc], a - t.offsets[doc]
            order = np.lexsort((pos, who, d[:, 2], h))
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (d[order, 2][1:] != d[order, 2][:-1])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            other = who[order] != who[first]
            known = np.zeros(len(order), bool)
            known[order] = other if unit.other_document else other | (pos[order] != pos[first])
            own = np.flatnonzero(~known)
            yield rows(h[own].view(np.int64), who[own], names[own], pos[own], np.full(len(own), WINDOW), d[own, 2].tobytes())
            own = np.flatnonzero(known)
            if len(own):  # runs of them in a document
                begins = np.flatnonzero(np.concatenate([[True], (np.diff(a[own]) > 1) | (np.diff(doc[own]) > 0)]))
                i, j = own[begins], own[np.append(begins[1:], len(own)) - 1]
                yield rows(A.mix(h[i] ^ A.mix(names[i].view(np.uint64))).view(np.int64), who[i], names[i], pos[i], a[j] - a[i] + unit.window, [None] * len(i))

    def run(batches):
        for batch in small(batches):
            found = batch.column("found").combine_chunks() if isinstance(batch.column("found"), pa.ChunkedArray) else batch.column("found")
            counts = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(counts)
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            t = unit.tokens(unpacked(part.column("text_")))
            flat = part.column("found").flatten()
            doc = np.repeat(np.arange(len(some)), counts[some])
            go_on = flat.field("h").is_valid()
            flat, doc = flat.filter(go_on), doc[go_on.to_numpy(zero_copy_only=False)]
            h, pos = flat.field("h").to_numpy(), flat.field("pos").to_numpy().astype(np.int64)
            hot = pos < 0
            pos = np.where(hot, -1 - pos, pos)
            k, tag, base = part.column("k").to_numpy()[doc], part.column("tag").to_numpy()[doc], t.offsets[doc]
            at, view = pos + base, memoryview(t.data)
            start, end = unit.around(t, at, doc)
            lo, hi = t.cut(start, end)
            for s in range(0, len(at), 10_000):
                own = np.flatnonzero(~hot[s : s + 10_000]) + s
                if len(own):
                    yield rows(h[own], k[own], tag[own], pos[own], (at - start)[own], [bytes(view[i:j]) for i, j in zip(lo[own].tolist(), hi[own].tolist())])
            if hot.any():
                yield from windows(t, start[hot], end[hot], part.column("k").to_numpy(), part.column("tag").to_numpy())

    return run


def _covers_of(unit: Unit, covers: Covers) -> Covers:
    """CONTEXTS to RANGES: known ranges as they are, windows of hot buckets by digest, all others by the operator's `covers`."""

    def run(batches):
        out: list[pa.RecordBatch] = []
        bucket, held = None, {}  # of the bucket that the next batch may go on with: digest's rest -> first document and place

        def told(k, tag, start, end) -> None:
            if len(k):
                out.append(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, tag, start, end)], ["k", "tag", "start", "end"]))

        def rest():
            nonlocal bucket, held
            for batch in batches:
                context = batch.column("context")
                known = context.is_null().to_numpy(zero_copy_only=False)
                h, k, tag, pos, before = (batch.column(c).to_numpy() for c in ("h", "k", "tag", "pos", "before"))
                pos = pos.astype(np.int64)
                told(k[known], tag[known], pos[known], pos[known] + before[known])
                own = np.flatnonzero(~known & (before == WINDOW))
                if len(own):
                    digest = np.frombuffer(b"".join(context.take(pa.array(own)).to_pylist()), np.uint32)
                    order = np.lexsort((digest, h[own]))  # stable: in order of k and pos
                    i, x = own[order], digest[order]
                    new = np.concatenate([[True], (h[i][1:] != h[i][:-1]) | (x[1:] != x[:-1])])
                    first = i[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
                    who, at = k[first], pos[first]
                    for j in np.flatnonzero(h[i] == bucket) if bucket is not None else ():
                        who[j], at[j] = held.get(int(x[j]), (who[j], at[j]))
                    hit = (k[i] != who) if unit.other_document else (k[i] != who) | (pos[i] != at)
                    told(k[i][hit], tag[i][hit], pos[i][hit], pos[i][hit] + unit.window)
                    if bucket != h[own[-1]]:
                        bucket, held = h[own[-1]], {}
                    for j in np.flatnonzero(h[i] == bucket):
                        held.setdefault(int(x[j]), (who[j], at[j]))
                left = np.flatnonzero(~known & (before != WINDOW))
                if len(left):
                    yield batch.take(pa.array(left))

        for found in covers(rest()):
            yield from out
            out.clear()
            yield found
        yield from out

    return run


def merged(unit: Unit, n: int, found: list | None, ranges: list | None) -> list[tuple[int, int]]:
    """The covered ranges of a document of n tokens, united: whole contexts of `found`, and `ranges`."""
    whole = [(max(0, x["pos"] - unit.left), min(n, x["pos"] + unit.window)) for x in found or () if x["h"] is None]
    out: list[list[int]] = []
    for a, b in sorted([*whole, *((x["start"], x["end"]) for x in ranges or ())]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def covered_documents(docs: DataFrame, unit: Unit, covers: Covers, text: str, doc_id: str, keep: list[str]) -> DataFrame:
    """Rows of docs as (k, tag, text_, c0_..., found, ranges): text_ packed, and what merged() takes, null for none.

    covers: from contexts (rows CONTEXTS) of whole buckets, each in order of k and pos, to RANGES.
    """
    n = partitions(docs.sparkSession)
    rows = keyed(docs, text, doc_id, keep)
    at = rows.select("k", "tag", "text_").mapInArrow(_anchors_of(unit), "h long, c1 long, c2 long, k long, loc long").repartition(n, "h")
    at = at.withColumn("d", F.shiftright("c2", 32)).withColumn("pos", F.shiftright("loc", 32).cast("int"))
    bucket, same = Window.partitionBy("h"), Window.partitionBy("h", "c1", "d").orderBy("k", "pos")
    # Rank, not row number: a repeated row ties with its twin and takes nothing from it.
    repeats = (F.col("c1") == 0) | ((F.col("k") > F.first("k").over(same)) if unit.other_document else (F.rank().over(same) > 1))
    at = at.withColumn("nth", F.row_number().over(same)).withColumn("repeats", repeats)
    at = at.withColumn("contexts", F.count(F.when(F.col("nth") == 1, 1)).over(bucket)).filter("repeats OR contexts > 1")
    element = F.struct(F.when(~F.col("repeats"), F.col("h")).alias("h"), F.when(F.col("repeats") | (F.col("contexts") <= HOT), F.col("pos")).otherwise(-1 - F.col("pos")).alias("pos"))
    tag = F.shiftleft("c2", 32).bitwiseOR(F.col("loc").bitwiseAND(_LOW))
    lists = at.groupBy("k", tag.alias("tag")).agg(F.collect_set(element).alias("found"))
    kinds = StructType([StructField("text_", BinaryType()) if f.name == "text_" else f for f in rows.schema])
    spread = rows.mapInArrow(packed, kinds).repartition(n, "k", "tag")
    both = spread.join(lists.hint("shuffle_hash"), ["k", "tag"], "left")
    # Both uses take the same columns, else their exchanges of texts would differ and be written twice.
    around = both.mapInArrow(_contexts_of(unit), CONTEXTS)
    ranges = around.repartition(n, "h").sortWithinPartitions("h", "k", "pos").mapInArrow(_covers_of(unit, covers), RANGES)
    ranges = ranges.groupBy("k", "tag").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    return both.join(ranges.hint("shuffle_hash"), ["k", "tag"], "left")
