"""Memory of Python workers between tasks.

Spark keeps a worker for later tasks, and what the worker freed stays with it: Arrow and the C library hold
large blocks for reuse. A job of many stages then finds several workers that each hold the most they ever needed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import pyarrow as pa


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def tidy(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``work`` over the batches of a task, after which freed memory goes back."""

    @wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
