"""Materialised tables and Arrow helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import discard, materialise, read_table as table, shared_folder, shared_path, sweep

__all__ = ["CHUNK_BYTES", "chunks", "discard", "fresh", "give_back", "lean", "materialise", "release_shuffles", "shared_folder", "shared_path", "spread", "sweep", "table", "utf8"]

#: Bytes of text that a Python worker turns into words at a time.
CHUNK_BYTES = 2 << 20


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files that no plan refers to any more.

    The cleaner only learns of them when the driver collects garbage.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start, done = 0, 0
        while start < n:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which lives on beside the executor's heap, gives freed memory back to the system."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def spread(ends: np.ndarray, total: int) -> np.ndarray:
    """For items laid end to end: the number of the item that each position belongs to."""
    marks = np.zeros(total + 1, np.int64)
    np.add.at(marks, ends, 1)
    return np.cumsum(marks)[:total]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def utf8(name: str):
    """A text column as its UTF-8 bytes, null as empty: Python workers get no decoded strings."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary")
