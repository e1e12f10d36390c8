"""State that a Python worker keeps between its tasks (functions of this package are shipped by value, so module globals don't last)."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system (the C library keeps it else); call it when a batch is done."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def kept(key, make):
    """``make()`` on the first call with this key in this worker process, the same object afterwards.

    One object is kept at a time: a worker that goes on to another operator gives the memory back.
    """
    held = sys.modules.setdefault("_postlens_worker", types.ModuleType("_postlens_worker")).__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        trim()
        held[key] = make()
    return held[key]


def drop() -> None:
    """Give up what this worker keeps."""
    module = sys.modules.get("_postlens_worker")
    if module is not None:
        module.__dict__.get("held", {}).clear()
    trim()
