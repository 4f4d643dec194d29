"""What a Python worker keeps between tasks: one heavy helper (an encoder, a shingler) at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The helper of that key; what the worker held for another operator is given back first."""
    if key not in _held:
        release()
        _held[key] = make()
        gc.freeze()  # its tables live on and hold no cycles: the collector need not walk them
    return _held[key]


def release() -> None:
    """Gives back what is held, to the operating system too where the C library can do that."""
    if _held:
        _held.clear()
        gc.unfreeze()
        gc.collect()
        trim()


def trim() -> None:
    """Gives free memory back to the operating system: else an idle worker keeps its peak while later steps run."""
    pa.default_memory_pool().release_unused()
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)
