"""Arrow batches of texts, cut so that a worker holds a bounded amount of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once; a longer text is a batch of its own.
CHUNK_BYTES = 4 << 20


def tidy() -> None:
    """Give memory that this worker no longer uses back to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def ending(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a task's batches, with :func:`tidy` when the task is over."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def as_list(values: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``limit`` bytes in ``column``, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def only(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """The named columns alone, so that nothing else in ``docs`` can clash."""
    return docs.select(*(F.col(c).alias(k) if isinstance(c, str) else c.alias(k) for k, c in columns.items()))
