"""Python workers of the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give back memory that a task has freed: a worker waits for its next task, and
    what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def resting(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The function with the collector of cycles at rest while it runs. What these
    operators hold refers to nothing that refers back, so it goes by reference
    counts, and the collector would only go over all of it again and again. After it
    the worker gives its free memory back."""

    @functools.wraps(run)
    def quiet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from run(batches)
        finally:
            gc.enable()
            release()

    return quiet
