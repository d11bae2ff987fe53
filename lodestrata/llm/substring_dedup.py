"""Word-substring dedup by relative Lempel-Ziv factors (operator 6)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .common import small
from .spans import Covers, Unit, covered_documents, merged, unpacked


class ReferenceBlock:
    """The segments of earlier documents that one bucket holds, indexed by a trie of their suffixes of `least` words or more."""

    def __init__(self, least: int):
        self.least, self.root, self.seen = least, {}, set()

    def add(self, segment: bytes) -> None:
        if segment in self.seen:
            return
        self.seen.add(segment)
        words = segment.split()
        for s in range(len(words) - self.least + 1):
            node = self.root
            for w in words[s:]:
                node = node.setdefault(w, {})

    def longest(self, words: list[bytes], at: int) -> int:
        """How many words from a place on are a factor: the longest beginning that the block has."""
        node, n = self.root, at
        while n < len(words) and (node := node.get(words[n])) is not None:
            n += 1
        return n - at

    def covered(self, segment: bytes) -> tuple[int, int]:
        """Where factors of `least` words or more lie: from, to; 0, 0 for none.

        The segment is parsed greedily: the longest factor from each place, then on behind it; a word that begins none is a literal. A window that the
        block has as a whole may lie across the end of a factor, so the places before each end are tried as well.
        """
        words = segment.split()
        lo, hi, at = len(words), 0, 0
        while at < len(words):
            n = self.longest(words, at)
            end = at + max(n, 1)
            for s in range(max(at, end - self.least + 1), min(end, len(words) - self.least + 1)):
                if s > at and (m := self.longest(words, s)) >= self.least:
                    lo, hi = min(lo, s), max(hi, s + m)
            if n >= self.least:
                lo, hi = min(lo, at), max(hi, end)
            at = end
        return (lo, hi) if hi else (0, 0)


def parsed_buckets(least: int) -> Covers:
    """CONTEXTS to RANGES (spans.py): each document's segments are parsed against the bucket's reference block, then added to it.

    A block grows with the bucket's different contexts, of which there are HOT at most.
    """

    def run(batches):
        block, bucket, document, waiting = ReferenceBlock(least), None, None, []
        for batch in small(batches):
            out = []
            for h, k, tag, pos, before, segment in zip(*(batch.column(c).to_pylist() for c in ("h", "k", "tag", "pos", "before", "context"))):
                if h != bucket:
                    block, bucket, document, waiting = ReferenceBlock(least), h, k, []
                elif k != document:  # rows of one document take nothing from each other
                    for x in waiting:
                        block.add(x)
                    document, waiting = k, []
                a, b = block.covered(segment)
                if b:
                    out.append((k, tag, pos - before + a, pos - before + b))
                waiting.append(segment)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], ["k", "tag", "start", "end"])

    return run


def substring_dedup(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop every word inside a run of `window` words that also starts in a document with a smaller id.

    Reference blocks are dealt by content: the segments of all documents that share an anchor (spans.py) meet in one block, in order of id, and each
    is parsed into its longest factors against those of the documents before, which the block has indexed; factors of `window` words or more, checked at
    their ends, become spans. A segment holds every window that may own the anchor, so no window is lost. A whole segment that repeats is told
    by 96 bits of BLAKE2b. Spans that touch unite.

    Words are [^\\x20\\x09-\\x0D]+, unchanged; null has none.  A null id counts as the smallest; rows of one id are one document and take
    nothing from each other (ids are numbers; -2^63 shares null's place).  An empty table gives none; other columns are ignored, whatever their names.

    Returns a row for each input row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space; the
    text itself where none went), spans (array of start, end in words), and the columns of `carry` as they are.
    """

    def cut(batches):
        for batch in small(batches):
            out = []
            for text, null, found, ranges in zip(unpacked(batch.column("text_")), batch.column("text_").is_null().to_pylist(), batch.column("found").to_pylist(), batch.column("ranges").to_pylist()):
                words = text.split()
                spans = merged(unit, len(words), found, ranges)
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), None if null else (left if spans else text).decode(), [{"start": a, "end": b} for a, b in spans]))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column("c0_"), *[pa.array(c, t) for c, t in zip(columns, kinds)], *[batch.column(f"c{i + 1}_") for i in range(len(carry))]], [*own.names, *carry])

    unit = Unit(window, min(5, max(1, window // 2)), words=True, other_document=True)
    own = StructType([StructField("doc_id", docs.schema[doc_id].dataType), *StructType.fromDDL("n_words long, n_removed long, kept_sha256 string, kept string, spans array<struct<start: long, end: long>>")])
    return covered_documents(docs, unit, parsed_buckets(window), text, doc_id, [doc_id, *carry]).mapInArrow(cut, StructType([*own, *[docs.schema[c] for c in carry]]))
