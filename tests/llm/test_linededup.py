"""Operator 3 against a plain rewrite of its contract, over both ways of probing."""

from __future__ import annotations

import hashlib
import random
import string
from collections import defaultdict

import numpy as np
import pytest

from sparkassay.llm import linededup
from tests.llm.common import documents

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for i, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            holders[line.strip(BLANK).translate(FOLD)].add((-1 << 63 if d is None else d, i))
    out = []
    for d, t in rows:
        lines, kept = (t or "").split("\n"), []
        for line in lines:
            key = line.strip(BLANK).translate(FOLD)
            held = holders[key]
            if len(key) < min_chars or len(held) < min_docs or max(held)[0] == (-1 << 63 if d is None else d):
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def rows_of(seed, n=200):
    rng = random.Random(seed)
    shared = [f"Shared line number {i} é" + "x" * rng.randint(0, 30) for i in range(25)]
    out = []
    for i in range(n):
        lines = [rng.choice([rng.choice(shared), rng.choice(shared).upper().replace("É", "é"), f"\t {rng.choice(shared)} \x0c", f"own line {i} {rng.random()}", "", "short", "É" * 19, "\xa0" + shared[0]]) for _ in range(rng.randint(0, 12))]
        out.append((rng.randint(0, 150), "\n".join(lines)))
    return [*out, out[0], out[0], (None, shared[0]), (None, None), (7, ""), (9, "x" * 100_000), (10, "x" * 100_000)]


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_against_brute_force(spark, monkeypatch, index_bytes):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 5)
    monkeypatch.setattr(linededup, "SHARD_PROBES", 200)
    rows = rows_of(1)
    got = linededup.report(documents(spark, rows).repartition(3), min_chars=20, min_docs=3, index_bytes=index_bytes).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, 20, 3), key=key)


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_empty_table_and_columns(spark, index_bytes):
    empty = linededup.dedup(documents(spark, []), index_bytes=index_bytes)
    assert empty.count() == 0 and "n_words" in empty.columns


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    made = linededup.PerfectHash.of(keys)
    again = linededup.PerfectHash.load(*made.dump())
    assert sorted(again.index(keys).tolist()) == list(range(len(keys)))


def test_hashes_that_coincide_are_told_apart():
    """(a, b) pairs whose folded numbers are one: another seed, the same result."""
    import numpy as np
    import pyarrow as pa

    a, b = np.array([1, 3, 5, 9], np.uint64), np.array([0, 1, 2, 7], np.uint64)
    assert len(np.unique(linededup._fold(a, b, 0))) < 4
    table = pa.table({"a": a.view(np.int64), "b": b.view(np.int64), "n": [9, 9, 9, 2], "keeper": [100, 101, 102, 103]})
    shard = linededup.Shard(linededup._build((pa.scalar(0),), table).to_pylist()[0])
    assert shard.seed > 0 and shard.drops(a, b, np.array([1, 101, 1, 1]), 5).tolist() == [True, False, True, False]
