"""Operator 7 against all pairs on small inputs."""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pytest
import xxhash

from sparkassay.llm import simhash
from tests.llm.common import documents, near_copies

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, threshold=4):
    fps = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))]


@pytest.mark.parametrize(("blocks", "tile"), [(3, 4096), (3, 6), (2, 4096), (4, 4096)])
def test_against_all_pairs(spark, monkeypatch, blocks, tile):
    rows = near_copies(random.Random(5), 250)
    rows += [(None, "alone here"), (None, rows[0][1]), (9000, None), (9001, ""), (9002, " \n"), rows[3], (9003, "é " * 3), (9004, "word " * 5000)]
    nodes = simhash.links
    monkeypatch.setattr(simhash, "links", lambda n, t, b: nodes(n, t, b, tile))
    got = simhash.report(documents(spark, rows).repartition(3), blocks=blocks).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_covering(blocks):
    """A value's home is within 1 of it, and every value within the threshold of it is replicated there."""
    rng = np.random.default_rng(blocks)
    for _, width in simhash.parts(blocks):
        x = rng.integers(0, 1 << width, 200).astype(np.uint64)
        own = simhash.home(x, width)
        assert (np.bitwise_count(x ^ own) <= 1).all()
        for flips in range(4 // blocks + 1):
            y = x.copy()
            for _ in range(flips):
                y ^= np.uint64(1) << rng.integers(0, width, len(y)).astype(np.uint64)
            which, anchor = simhash.anchors(y, width, 1 + 4 // blocks)
            held = set(zip(which.tolist(), anchor.tolist()))
            assert all((i, a) in held for i, a in enumerate(own.tolist()))
