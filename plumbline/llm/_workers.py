"""What runs around functions on executors. This module travels with them whole, so it holds nothing of a session."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Returns this process's free memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Arrays of this size are mapped one by one, so that they leave with their last use; by itself, malloc raises its limit to 32 MB as it goes.
_MAPPED_BYTES = 4 << 20


def map_large() -> None:
    """Keeps this process's large arrays out of the heap, where a small one behind them holds them fast."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").mallopt(-3, _MAPPED_BYTES)  # M_MMAP_THRESHOLD


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, giving the memory that a worker has free back to the system when its task ends: idle workers stay with their executor."""

    def through(batches: Iterator) -> Iterator:
        map_large()
        try:
            yield from run(batches)
        finally:
            give_back()

    return through
