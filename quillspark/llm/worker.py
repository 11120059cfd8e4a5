"""What a Python worker keeps from task to task, and how it reads batches in little memory."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

_resident: dict = {}


def resident(name: tuple, make: Callable):
    """The object of this name, made if need be; a worker keeps one at a time, so operators don't add up their caches."""
    if name not in _resident:
        _resident.clear()
        give_back()
        _resident[name] = make()
    return _resident[name]


def give_back() -> None:
    """Return memory that is free in this process to the system; an executor's budget counts what idle workers hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def frugal(run: Callable) -> Callable:
    """run, a function for mapInArrow, followed by give_back()."""

    def task(rows):
        try:
            yield from run(rows)
        finally:
            give_back()

    return task


def text_slices(batch: pa.RecordBatch, column: int | str = 1, most_bytes: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have at most so many bytes together, or one row."""
    texts = batch.column(column)
    if not len(texts):
        return
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        limit = (ends[start - 1] if start else 0) + most_bytes
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of the values of sizes bytes that follow one another in data."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def digests(data: np.ndarray, sizes: np.ndarray) -> list[str]:
    """SHA-256, lowercase hexadecimal, of the values of sizes bytes that follow one another in data."""
    view, ends = memoryview(np.ascontiguousarray(data)).cast("B"), np.cumsum(sizes)
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
