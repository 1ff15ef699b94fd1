"""Python workers that give memory back: they live on between tasks, beside the executor's JVM."""

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

_state = {"set": False}


def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library
        return None


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with large arrays in mappings of their own, freed when they go, and unused pools returned at the end of the task."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc is not None and not _state["set"]:
            libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
            _state["set"] = True
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return task
