"""Keeps Python workers small: they serve one task after another, and what one leaves behind adds to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

#: Owner -> what empties its table.
_TABLES: dict[str, Callable[[], None]] = {}
# Fixed values of the C library: its parameters for trimming and for blocks that go back to the system at once.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD = -1, -3


def keeps(owner: str, empty: Callable[[], None]) -> None:
    """Registers a table that a worker holds over tasks of one operator."""
    _TABLES[owner] = empty


@cache
def _allocator():
    """The C library with blocks from 256 KB on returned when freed; None where it has no such settings."""
    held = ctypes.CDLL(None)
    if not hasattr(held, "mallopt") or not hasattr(held, "malloc_trim"):
        return None
    held.mallopt(_M_MMAP_THRESHOLD, 1 << 18)
    held.mallopt(_M_TRIM_THRESHOLD, 1 << 20)
    return held


def _trim() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if (held := _allocator()) is not None:
        held.malloc_trim(0)


def lean(owner: str, task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task, run in a worker that holds no other operator's table and gives free memory back at the end."""

    def run(stream: Iterator) -> Iterator:
        for other, empty in _TABLES.items():
            if other != owner:
                empty()
        _trim()
        try:
            yield from task(stream)
        finally:
            _trim()

    return run
