"""Memory that Python workers give back, since they and the JVM of an executor live from one stage to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim; None where the C library has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives what Arrow and the C library hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back when a task's batches end."""

    def then(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return then


def in_slices(batches: Iterator[pa.RecordBatch], column: str, at_once: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about so many bytes of a text column, or one longer row; memory is given back after each."""
    for batch in batches:
        at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + at_once, "right")) - 1)
            yield batch.slice(begin, end - begin)
            release()
            begin = end
