"""Arrow helpers used by every operator here, and the session folders of the library."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dissona.sources.scratch import discard, scratch, shared_dir, stored, table

__all__ = ["KEPT", "cuts", "discard", "portions", "scratch", "shared_dir", "slices", "stored", "table", "tidy", "utf8"]


#: Tables that a worker keeps from task to task, by their users' name.
KEPT: dict[str, dict] = {}


#: Bytes of a batch that a kernel is given at a time; a longer single row is given alone.
PORTION_BYTES = 4 << 20


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, in parts of at most PORTION_BYTES; nothing is copied."""
    if batch.num_rows < 2 or batch.nbytes <= PORTION_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from portions(batch.slice(0, half))
    yield from portions(batch.slice(half))


def release() -> None:
    """Give memory that is free back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = 0
    for batch in batches:
        for part in portions(batch):
            yield part
            seen += part.nbytes
            if seen >= PORTION_BYTES // 2:
                release()
                seen = 0


def tidy(run: Callable, uses: str = "") -> Callable:
    """A mapInArrow function for workers that live on: tables that other operators have kept go when its task begins
    (not those of `uses`), batches come in portions, so that what is made of them stays small, and memory that is free
    goes back to the system after each of them and at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, kept in KEPT.items():
            if name != uses:
                kept.clear()
        try:
            yield from run(_fed(batches))
        finally:
            release()

    return task


#: Bytes of text that the vectorised kernels hold at a time; a longer single text is held alone.
SLICE_BYTES = 1 << 20


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, offsets - lo


def cuts(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes and at most 20,000 rows; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, i + 20_000, n)
        yield i, j
        i = j


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same with their texts: (first, end, bytes, offsets from 0). Each text stays whole."""
    for i, j in cuts(offsets, most):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
