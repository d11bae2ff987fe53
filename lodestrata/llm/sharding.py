"""Contiguous, byte-balanced shards by global prefix sums (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, partitions


def shard_by_bytes(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Cut all rows, in order of id, into contiguous shards of nearly equal bytes (UTF-8 bytes of the text plus 1 a row).

    A shard is decided by the bytes before a row: floor(shards * before / total), so each ends within one row of its target.  Rows
    are dealt by ranges of the id; each partition's totals give it its offset (one row a partition reaches the driver, no more), and
    rows then number themselves within their partition, in two streams over it and no further exchange.  Ties of the id go by checksum and size, null ids come first, null texts
    have no bytes, an empty table gives none, other columns are ignored.

    Returns doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard), grown_shard (null: the law fixes no
    shard count growth).
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # Sorted by range: which rows share a partition must not change between the totals and their use, hence the checkpoint.
    rows = checkpoint(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    totals = sorted((r.part, r.size, r.n) for r in rows.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, {}
    for part, size, _ in totals:
        offsets[part], before = before, before + size
    # A row is in the last shard whose first byte isn't behind the row's: whole numbers of any size here, so nothing overflows.
    edges = [-(-s * before // shards) for s in range(shards)]

    def numbered(slots: dict[tuple[int, int], int] | None):
        """Rows with their shard, and their slot from where the partition's slots begin; without those the first pass: rows of each shard."""

        def run(batches):
            at, seen, bounds = None, {}, np.array(edges, np.int64)
            for batch in batches:
                size, part = batch.column("size").to_numpy(), batch.column("part").to_numpy()
                for p in np.unique(part).tolist():  # one: a partition's rows stay together
                    own = np.flatnonzero(part == p)
                    at = offsets[p] if at is None else at
                    ends = at + np.cumsum(size[own])
                    shard = (np.searchsorted(bounds, ends - size[own], "right") - 1).astype(np.int32)
                    at, slot = int(ends[-1]), np.zeros(len(own), np.int64)
                    for s in np.unique(shard).tolist():
                        mine = shard == s
                        first = seen.get((p, s), 0)
                        seen[p, s] = first + int(mine.sum())
                        if slots is not None:
                            slot[mine] = slots[p, s] + first + np.arange(mine.sum())
                    if slots is not None:
                        yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "size", "text_crc32"]).take(pa.array(own)).columns, pa.array(shard), pa.array(slot)], ["doc_id", "size", "text_crc32", "shard", "slot"])
            if slots is None and seen:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["part", "shard", "n"])

        return run

    # A shard's rows in a partition are contiguous: its slots go on from its rows in the partitions before. At most partitions + shards rows come here.
    slots, last, held = {}, None, 0
    for shard, part, n in sorted((r.shard, r.part, r.n) for r in rows.mapInArrow(numbered(None), "part int, shard int, n long").collect()):
        held = held if shard == last else 0
        slots[part, shard] = held
        last, held = shard, held + n
    kind = docs.schema[doc_id].dataType.simpleString()
    out = rows.mapInArrow(numbered(slots), f"doc_id {kind}, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no CRC-32: its reflected polynomial, four bits at a time, low half of each byte first.
SQL = r"""
WITH crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(range(4), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS v FROM (SELECT unnest(range(16)) AS n))),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda x: strpos('0123456789ABCDEF', x) - 1) AS x FROM documents),
k AS (SELECT doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(list_reduce(range(len(x)), lambda c, i: xor(c >> 4, t[(xor(c, x[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]) & 15) + 1]), 4294967295), 4294967295) END AS text_crc32 FROM d, crc),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER () AS total FROM k),
s AS (SELECT *, (before * 16 // total)::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
