"""Vectorised word scanning of Arrow text columns.

Every separator here is ASCII, so UTF-8 bytes can be cut without decoding.  A slice of documents is
scanned at a time; memory follows SLICE_BYTES or the longest single document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)


@dataclass
class Words:
    """The words of documents first..first+n-1 of a batch."""

    first: int
    n: int
    buf: np.ndarray  # lower-cased bytes
    start: np.ndarray  # byte offsets of each word
    end: np.ndarray
    doc: np.ndarray  # offsets into start, n + 1 of them

    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same wherever the word stands.

        Each run of eight bytes is mixed with its place in the word; the sum is mixed with the word's length.
        """
        if not len(self.start):
            return np.empty(0, U64)
        size = self.end - self.start
        runs = (size + 7) // 8
        first = np.cumsum(runs) - runs
        place = np.arange(int(runs.sum())) - np.repeat(first, runs)
        at = np.repeat(self.start, runs) + 8 * place
        padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.buf) + 1,), np.dtype("<u8"), padded, 0, (1,))
        held = np.minimum(np.repeat(self.end, runs) - at, 8)
        mixed = mix((eight[at] & _FIRST[held]) ^ mix((place + 1).astype(U64) * _BASE))
        return mix(np.add.reduceat(mixed, first) + size.astype(U64) * _BASE)

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1, joined by one space."""
        return b" ".join(self.buf[a:b].tobytes() for a, b in zip(self.start[i:j], self.end[i:j]))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def rows(batches: Iterator[pa.RecordBatch], n: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of at most n rows: what Python makes of texts is several times their size."""
    for batch in batches:
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about limit bytes each; always at least one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def scan(column: pa.Array | pa.ChunkedArray, kind: np.ndarray) -> Iterator[Words]:
    """The words of each slice of a text column, in order; kind tells the bytes that belong to words."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        buf, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        inside = kind[buf]
        before, after = np.empty_like(inside), np.empty_like(inside)
        if len(buf):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[at[:-1][at[:-1] < len(buf)]] = False  # words end with their document
            after[at[1:][at[1:] > 0] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        yield Words(i, j - i, buf, start, end, np.searchsorted(start, at))
