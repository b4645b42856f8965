"""What Python workers give back between tasks: they live on, and go from one operator's tasks to another's."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.lru_cache
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6") if sys.platform == "linux" else None
    except OSError:
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, between dropping a tokenizer's memory of other tasks (unless it tokenizes) and returning freed memory to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("sparkassay.llm.tokens")
        if tokens is not None and not tokenizes:
            tokens.WordPieces.forget()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return tidied
