"""Memory of Python workers, which live on and serve the next stage after this one."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa


def release() -> None:
    """Gives memory that is free within this process back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library keeps its own counsel
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, with memory released before the first and after the last."""

    def wrapped(batches: Iterator) -> Iterator:
        release()
        yield from run(batches)
        release()

    return wrapped
