"""Shared pieces of the corpus operators: Arrow helpers, keys, checkpoint folder."""

from __future__ import annotations

import ctypes
import os
import posixpath
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id in keys and comparisons: sorts before every id.
NULL_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster has none that its machines share, so raises."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/lodestrata-checkpoints-{os.getuid()}"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared folder."""
    return posixpath.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def drop_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage through the reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def doc_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column), F.lit(NULL_ID))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """Texts of an Arrow column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary()).to_pylist()]


def small(batches, rows: int = 1000):
    """The batches cut to so many rows, so that what is derived from their texts stays small; at the end freed memory goes back to the system."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and what they keep adds to the next stage's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def binary_rows(matrix: np.ndarray) -> pa.Array:
    """Rows of a uint8 matrix as a binary column."""
    n, width = matrix.shape
    offsets = np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def binary_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The inverse of binary_rows: equally long values as a uint8 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), width)


def whole_groups(batches, key: str, least: int = 50_000):
    """Sorted batches dealt anew as (table, group goes on): a table ends with its last group complete unless that group alone has over `least` rows.

    A group that is longer than that comes in several tables, all but the last flagged, so a reader can carry what it needs of it instead of holding it.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut), False
            rest = table.slice(cut)
        else:
            yield table, True
            rest = None
        held = rest.to_batches() if rest is not None else []
        rows = rest.num_rows if rest is not None else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False
