"""One large object a Python worker: what an earlier operator cached there goes when another asks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_held: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], object]):
    """The object of that key, made if the worker holds another or none."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Forget what is held and give freed memory back to the system."""
    _held.clear()
    trim()


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
