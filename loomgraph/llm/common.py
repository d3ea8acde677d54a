"""Reading, Arrow batching and shared intermediate tables for the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import shared_dir, table, written

__all__ = ["SLICE_BYTES", "buffers", "drop_shuffles", "free_name", "id_and_text", "release", "shared_dir", "sliced", "small_batches", "table", "written"]

#: Bytes of text that one task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of each finished query; steps that follow each other need less disk."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold a few MB: long texts then need no more memory than short ones."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))
    return df


def free_name(base: str, columns: list[str]) -> str:
    """A column name that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that a text operator needs; a null text counts as empty."""
    return small_batches(docs).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column as one uint8 array, and the n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give freed memory back to the machine: workers are kept for later stages, their idle memory should not be."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def sliced(batch: pa.RecordBatch, column: int, max_bytes: int = SLICE_BYTES):
    """Consecutive slices of a batch whose texts have about max_bytes together (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()
