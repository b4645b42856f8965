"""XXH64 of many short byte ranges at once, and 64-bit SimHash fingerprints from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from sparkassay.llm.words import NOT_SPACE, U64, Words, scan

#: The constants of XXH64 (fixed values of its specification).
P1, P2, P3, P4, P5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Ranges longer than this are hashed one by one.
LONG = 160
SEED, SHINGLE = 42, 4


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U64(n)) | (x >> U64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def _xxh64_of_length(buf: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of buf[a:a+n] for each a; buf has 8 spare bytes at its end."""
    w64 = np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf, 0, (1,))
    w32 = np.ndarray((len(buf) - 7,), np.dtype("<u4"), buf, 0, (1,))
    s, done = U64(seed), 0
    if n >= 32:
        acc = [np.full(len(at), x, U64) for x in (s + P1 + P2, s + P2, s, s - P1)]
        while n - done >= 32:
            acc = [_round(v, w64[at + (done + 8 * i)]) for i, v in enumerate(acc)]
            done += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for v in acc:
            h = (h ^ _round(np.zeros_like(v), v)) * P1 + P4
    else:
        h = np.full(len(at), s + P5, U64)
    h = h + U64(n)
    while n - done >= 8:
        h = _rotl(h ^ _round(np.zeros_like(h), w64[at + done]), 27) * P1 + P4
        done += 8
    if n - done >= 4:
        h = _rotl(h ^ (w32[at + done].astype(U64) * P1), 23) * P2 + P3
        done += 4
    while done < n:
        h = _rotl(h ^ (buf[at + done].astype(U64) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> U64(33))) * P2
    h = (h ^ (h >> U64(29))) * P3
    return h ^ (h >> U64(32))


def xxh64(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each buf[start:end]."""
    size, out = end - start, np.empty(len(start), U64)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint16), kind="stable")
    cuts = np.flatnonzero(np.diff(np.minimum(size, LONG + 1)[order])) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts) if len(order) else ():
            n = int(size[group[0]])
            if n > LONG:
                for i in group:
                    out[i] = xxhash.xxh64_intdigest(buf[start[i] : end[i]].tobytes(), seed)
            else:
                out[group] = _xxh64_of_length(padded, start[group], n, seed)
    return out


def shingle_hashes(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each document): XXH64 of each run of size words joined by one space."""
    # words packed with single spaces between them
    n = words.end - words.start
    to = np.cumsum(n + 1) - (n + 1)
    packed = np.full(int((n + 1).sum()), 0x20, np.uint8)
    source = np.arange(int(n.sum())) + np.repeat(words.start - (np.cumsum(n) - n), n)
    packed[np.arange(int(n.sum())) + np.repeat(to - (np.cumsum(n) - n), n)] = words.buf[source]
    per = words.counts()
    k = np.where(per == 0, 0, np.maximum(1, per - size + 1))
    first = np.arange(int(k.sum())) + np.repeat(words.doc[:-1] - (np.cumsum(k) - k), k)
    last = np.minimum(first + size - 1, np.repeat(words.doc[1:] - 1, k))
    return xxh64(packed, to[first], to[last] + n[last]), k


def majority(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """For each document, the bits set in over half of its hashes; zero for none."""
    out = np.zeros(len(per), U64)
    full = np.flatnonzero(per)
    if not len(full):
        return out
    per = per[full]
    first = np.cumsum(per) - per
    # runs of at most 255 hashes, so that eight 8-bit counters fit a word
    runs = -(-per // 255)
    at = np.repeat(first, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs))
    by_doc = np.cumsum(runs) - runs
    bits = np.zeros(len(full), U64)
    for j in range(8):
        lanes = np.add.reduceat((hashes >> U64(j)) & U64(0x0101010101010101), at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), by_doc, axis=0)
        for lane in range(8):
            bits |= (2 * counts[:, lane] > per).astype(U64) << U64(8 * lane + j)
    out[full] = bits
    return out


def simhash(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text."""
    return np.concatenate([np.empty(0, U64), *(majority(*shingle_hashes(w, size)) for w in scan(column, NOT_SPACE))])
