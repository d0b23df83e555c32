"""One operator's caches at a time in a worker: Spark reuses workers, and memory is shared by their tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: list = [None, None]


def claim(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Say whose task runs now; what another operator's tasks have cached is dropped."""
    if _held[0] != owner:
        before, _held[:] = _held[1], [owner, clear]
        if before:
            before()
            gc.collect()
        settle()


def settle() -> None:
    """Give memory that this worker has freed back to the system; other workers and the JVM share the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library keeps its own ways
