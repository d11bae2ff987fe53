"""Exact byte-substring dedup by bucket-pointer refinement of suffixes (operator 1)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small, whole_groups
from .spans import Covers, Unit, covered_documents, merged, unpacked

#: Bytes of an initial bucket's key, and of contexts refined together: few enough for the cache.
GRAM, TOGETHER = 5, 1 << 18


def bucket_pointers(text: np.ndarray, depth: int) -> np.ndarray:
    """For each position of text (uint8) the pointer of its bucket: the place, in suffix order, of the first suffix that has the same `depth` bytes.

    Suffixes start in buckets of their first GRAM bytes. Every bucket of several is then sorted on the bucket pointers of the suffixes so many bytes
    further on as its own are alike in, and its members get the pointers of the smaller buckets, which the next round reads: so depth doubles, and a suffix
    alone in its bucket is done. The last offset is shorter, to end at `depth`. Beyond the end zeros are read.
    """
    n, q = len(text), min(GRAM, depth)
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    gram = np.zeros(n, np.int64)
    for j in range(q):
        gram = gram << 8 | padded[j : j + n]
    active, old = _ordered(gram, 8 * q), np.zeros(n, np.int64)
    pointer = np.zeros(n + depth, np.int64)  # behind the text: one bucket of empty suffixes before all others
    key, alike, bits = gram[active], q, (n + 1).bit_length()
    while True:
        new_old = np.concatenate([[True], old[1:] != old[:-1]])
        new = new_old | np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(active))
        begin = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(new_old, place, 0))
        pointer[active] = old + begin + (alike == q)  # places from 1 on
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        if alike == depth or not len(active):
            return pointer[:n]
        offset = min(alike, depth - alike)
        key, old = pointer[active + offset], pointer[active]
        order = _ordered(old << bits | key, 2 * bits)
        active, key, old = active[order], key[order], old[order]
        alike += offset


def _ordered(key: np.ndarray, bits: int) -> np.ndarray:
    """Places in order of a key of so many bits: sorted along with it where both fit a word, which is several times faster."""
    own = len(key).bit_length()
    if bits + own > 63:
        return np.argsort(key)
    return np.sort(key << own | np.arange(len(key))) & ((1 << own) - 1)


def covered(text: np.ndarray, ends: np.ndarray, who: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts end to end in text (each ends at `ends`; its document's order number, and where it begins there): from where to where, in the
    context, windows lie that also start earlier, in a document of a smaller number or in the same before; 0, 0 for none."""
    starts = np.concatenate([[0], ends[:-1]])
    n = np.maximum(ends - starts - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    if not len(row):
        return np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    bucket = bucket_pointers(text, window)[starts[row] + inside]
    order = _ordered(bucket, (len(text) + 1).bit_length())
    start = (who[row] << 40 | at[row] + inside)[order]  # texts are below 2^31 bytes
    new = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    hit = order[start > np.repeat(np.minimum.reduceat(start, new), np.diff(np.append(new, len(order))))]
    lo, hi = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
    np.minimum.at(lo, row[hit], inside[hit])
    np.maximum.at(hi, row[hit], inside[hit] + window)
    return np.where(hi > 0, lo, 0), hi


def refined_buckets(window: int) -> Covers:
    """CONTEXTS to RANGES (spans.py): contexts of whole buckets become one text, whose suffixes are refined to `window` bytes.

    A bucket longer than a step is carried on as its different contexts, of which there are HOT at most.
    """

    def run(batches):
        carry: dict[bytes, tuple[int, int]] = {}  # context: document, start
        bucket = None
        for table, goes_on in whole_groups(batches, "h", 8192):
            h, k, tag, pos, before = (table.column(c).to_numpy() for c in ("h", "k", "tag", "pos", "before"))
            pos = pos.astype(np.int64)
            contexts = table.column("context").to_pylist()
            held = carry if len(h) and bucket == h[0] else {}
            carry, bucket = {}, None
            done = 0
            while done < len(h):
                # whole buckets of about TOGETHER bytes
                size, end = 0, done
                while end < len(h) and (size < TOGETHER or h[end] == h[end - 1]):
                    size += len(contexts[end])
                    end += 1
                own = slice(done, end)
                old = list(held) if not done else []
                texts = [*old, *contexts[own]]
                names = np.concatenate([np.array([held[x][0] for x in old], np.int64), k[own]])
                begin = np.concatenate([np.array([held[x][1] for x in old], np.int64), pos[own] - before[own]])
                a, b = covered(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(x) for x in texts]), np.unique(names, return_inverse=True)[1], begin, window)
                a, b, begin = a[len(old) :], b[len(old) :], begin[len(old) :]
                hit = np.flatnonzero(b)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k[own][hit], tag[own][hit], begin[hit] + a[hit], begin[hit] + b[hit])], ["k", "tag", "start", "end"])
                done = end
            if goes_on and len(h):
                carry, bucket = held, h[0]
                for x, i, s in zip(contexts, k.tolist(), (pos - before).tolist()):
                    carry.setdefault(x, (i, s))

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Drop every byte inside a string of `length` bytes that also starts earlier in the corpus.

    Earlier: in a document with a smaller id, or in the same one at a smaller offset.  Texts are UTF-8 bytes, null is empty;
    strings never cross documents and are judged on the input.  A null id counts as the smallest; rows of one id are one document, so
    a repeated row takes nothing from its twin (ids are numbers; -2^63 shares null's place).  An empty table gives none, other columns are ignored, whatever their names.

    The 100-byte suffixes that can repeat meet in buckets of a common 24-gram (spans.py); there bucket_pointers() refines them to their whole
    length, so bytes decide. A whole context that repeats is told by 96 bits of BLAKE2b.

    Returns a row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and
    kept (binary: what is left may cut a character), spans (array of start, end).
    """

    def cut(batches):
        for batch in small(batches):
            texts = unpacked(batch.column("text_"))
            out = []
            for text, found, ranges in zip(texts, batch.column("found").to_pylist(), batch.column("ranges").to_pylist()):
                spans = merged(unit, len(text), found, ranges)
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                left = b"".join([*kept, text[last:]]) if spans else text
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left, [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("c0_"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    unit = Unit(length, min(24, max(1, length // 2)), words=False, other_document=False)
    kind = docs.schema[doc_id].dataType.simpleString()
    return covered_documents(docs, unit, refined_buckets(length), text, doc_id, [doc_id]).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")


#: Bytes as pairs of hex digits; a window is 200 of them.
SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS win FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 - 98)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM x) WHERE n > 1),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM r GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS ends, string_agg(substr(h, 2 * last + 1, 2 * (a - last - 1)), '' ORDER BY a) AS head FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(ends, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
