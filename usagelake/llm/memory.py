"""Python workers hold little: batches come in small parts, and what has been freed goes back to the system at once.

A worker outlives its tasks, and its allocators keep what they have freed; beside a JVM that uses its whole heap that is too much.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
#: Rows of a part, and after how many parts memory is given back.
ROWS, PARTS = 500, 16


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)
            n += 1
            if n % PARTS == 0:
                _release()


def tidy(run: Run, whole: bool = False) -> Run:
    """run over parts of the batches, or whole ones where they hold what should be put together. No result may depend on where a
    batch ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches if whole else _parts(batches))
        finally:
            _release()

    return tidied
