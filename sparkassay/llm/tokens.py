"""Token ids of whole texts by a public word-piece tokenizer file.

White space never joins two pieces, so a text's ids are the ids of its space-free chunks in order.
Chunks and their pieces are remembered as Arrow arrays, as the tokenizer itself remembers words; each slice of texts
looks up its distinct chunks only.  A text with a special token, or with characters outside Latin blocks (where
normalising can change it), goes to the tokenizer as it is.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from sparkassay.llm.words import NOT_SPACE, slices, utf8

#: The tokenizer's own pattern (a fixed value of its file), and the line ends that part chunks here.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Bytes of text looked up at once.
_SLICE = 8 << 20
_loaded: dict[str, WordPieces] = {}


def _odd(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a character above U+024F, `<|` or an information separator."""
    after = np.append(data[1:], np.uint8(0)) if len(data) else data
    bad = (data >= 0xCA) | ((data == 0xC9) & (after > 0x8F)) | ((data >= 0x1C) & (data <= 0x1F)) | ((data == ord("<")) & (after == ord("|")))
    at = np.flatnonzero(bad)
    return np.searchsorted(at, offsets[1:]) > np.searchsorted(at, offsets[:-1])


def _chunks(low: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The space-free chunks of lower-cased Latin texts, and offsets of each text's into them."""
    data, offsets = utf8(low)
    inside = NOT_SPACE[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]  # next line and no-break space
    inside[two] = inside[two + 1] = False
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # chunks end with their text
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.append(0, np.cumsum(end - start))
    held = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return held, np.searchsorted(start, offsets)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] and what follows, size[0] of them; then those of start[1], ..."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Held:
    """Names with their ids, in the order in which they were met; forgotten together beyond a limit."""

    def __init__(self, limit: int, first: str | None = None) -> None:
        self.limit, self.first = limit, first
        self.clear()

    def clear(self) -> None:
        self.names = pa.array([] if self.first is None else [self.first], pa.large_string())
        self.ends, self.ids = np.zeros(1 + len(self.names), np.int64), np.empty(0, "<u4")

    def find(self, names: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each name, number of its ids); learn gives numbers of ids, and ids, of distinct new names."""
        each = names.dictionary_encode()
        distinct = each.dictionary
        at = pc.index_in(distinct, self.names).fill_null(-1).to_numpy().astype(np.int64)
        if len(self.names) + np.count_nonzero(at < 0) > self.limit:
            self.clear()
            at = pc.index_in(distinct, self.names).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            mine = distinct.take(pa.array(new))
            sizes, ids = learn(mine)
            at[new] = len(self.names) + np.arange(len(new))
            self.names = pa.concat_arrays([self.names, mine])
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
            self.ids = np.append(self.ids, ids)
        at = at[each.indices.to_numpy()]
        return at, self.ends[at + 1] - self.ends[at]


class WordPieces:
    """A tokenizer with its memory, one for each Python worker: at most some 100 MB."""

    CHUNKS, PIECES = 600_000, 1_000_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)  # for pieces that are normalised and cut already
        cut = pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence(list(cut))
        (self.end,) = self.bare.encode("\n", add_special_tokens=False).ids  # a line end is one id, and in no other piece
        self.chunks, self.pieces = _Held(self.CHUNKS), _Held(self.PIECES, "\n")

    @classmethod
    def shared(cls, path: str) -> WordPieces:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    @staticmethod
    def forget() -> None:
        """Drop all tokenizers of this worker."""
        _loaded.clear()

    def _of_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names = pieces.to_pylist()
        lines = ["\n".join([*names[at : at + 500], ""]) for at in range(0, len(names), 500)]
        ids = np.concatenate([np.array(e.ids, "<u4") for at in range(0, len(lines), 20) for e in self.bare.encode_batch_fast(lines[at : at + 20], add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.end)
        return np.diff(ends, prepend=-1) - 1, ids[ids != self.end]

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._of_some(chunks.slice(at, 200_000)) for at in range(0, len(chunks), 200_000)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _of_some(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat = pa.array(_PIECE.findall("\n".join(chunks.to_pylist())), pa.large_string())
        at, sizes = self.pieces.find(flat, self._of_pieces)
        ends = np.append(0, np.cumsum(sizes))
        cuts = np.r_[0, ends[np.flatnonzero(at == 0)], ends[-1]]  # the line end is the first name and has no ids
        return np.diff(cuts), self.pieces.ids[_spread(self.pieces.ends[at], sizes)]

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        data, offsets = utf8(column)
        for i, j in slices(offsets, _SLICE):
            texts = column.slice(i, j - i).to_pylist()
            odd = _odd(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]).tolist()
            chunks, of = _chunks(pa.array(["" if o or t is None else t.lower() for t, o in zip(texts, odd)], pa.large_string()))
            at, sizes = self.chunks.find(chunks, self._of_chunks)
            ids = memoryview(self.chunks.ids[_spread(self.chunks.ends[at], sizes)].tobytes())
            ends = (4 * np.append(0, np.cumsum(sizes))[of]).tolist()
            for t, o, a, z in zip(texts, odd, ends, ends[1:]):
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else bytes(ids[a:z])
