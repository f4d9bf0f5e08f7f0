"""Shared plumbing of the training-data operators: reading and batching; written intermediate
tables are the library's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialise, shared_dir

__all__ = ["bytes_of", "estimated_tokens", "frugal", "held_out", "materialise", "shared_dir", "slices", "spans", "table", "texts_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table below ``sf_dir``, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves 0 modulo 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def estimated_tokens(text: str) -> Column:
    """Tokens of a text by its length, without an encoder: half its characters, and each further
    byte of a character beyond the first. A byte-level encoding has at most one token a byte, so
    the real number is at most twice this, whatever the script. Null: 0."""
    chars, size = F.length(text), F.octet_length(text)
    return F.coalesce(F.ceil(chars / 2) + size - chars, F.lit(0)).cast("long")


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str | None]:
    """The column's strings; bytes that aren't UTF-8 become U+FFFD instead of an error."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        return [None if x is None else x.decode("utf-8", "replace") for x in raw]


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """The column's strings as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of a batch, which bound what one step of Python holds."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def spans(batch: pa.RecordBatch, column: int, rows: int = 8192, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Runs of a batch of at most ``rows`` rows, and of one row or ``size`` bytes of a column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(run: Run) -> Run:
    """The same, giving the memory that it freed back to the system when it ends: workers stay for
    the next stage, which finds it taken otherwise."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return wrapped
