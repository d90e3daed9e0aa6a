"""What a Python worker keeps from one task to the next. Workers are reused by all stages, so one stage's memory must not stay for those after it."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Callable
from typing import Any

_held: dict[tuple, Any] = {}


def hold(key: tuple, make: Callable[[], Any]) -> Any:
    """The value of ``key``, made where the worker does not have it. It holds one at a time."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Give back what is held, to the system too where its allocator can. Operators that hold nothing call it when a task begins."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    library = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None
    if trim:
        trim(0)
