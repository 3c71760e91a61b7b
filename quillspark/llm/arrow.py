"""Small helpers for functions that take and give Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from quillspark.llm import byte_bpe

BATCH_BYTES = 4 << 20


def slices(texts: list, limit: int = 300_000) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters, so that work on one run needs bounded memory."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def longs(column: pa.Array) -> np.ndarray:
    """A column of longs without nulls as an array."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables with the rows of one key each, from batches in which equal keys follow one another."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [longs(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(int(c[0]) for c in columns)
        change[0] = last is not None and first != last
        at = 0
        for start in np.flatnonzero(change).tolist():
            if start > at:
                held.append(batch.slice(at, start - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], start
        held.append(batch.slice(at))
        last = tuple(int(c[-1]) for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold about ``BATCH_BYTES`` at most, however long the texts in their rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Give back to the system what earlier work has left free in this process."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if give_back:
        give_back(0)


def release(memos: bool = True) -> None:
    """``trim`` after garbage is collected; ``memos``: also what the tokenizers of an earlier stage have kept."""
    if memos:
        byte_bpe.encoder.cache_clear()
    gc.collect()
    trim()


def lean(work: Callable, memos: bool = True) -> Callable:
    """``work`` for ``mapInArrow``, in a Python worker that Spark uses again: it starts with what earlier stages have left given back,
    and does not stay large beside stages that need no Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(memos)
        yield from work(batches)
        trim()

    return run
