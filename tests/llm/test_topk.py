"""Operator 9 against exact integer arithmetic."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest

from sparkassay.llm import topk


def brute(rows, k, every):
    good = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for (i, v), (_, raw) in zip(good, [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]):
        if i % every == 0 and (i not in first or raw < first[i][1]):
            first[i] = (v, raw)
    out = []
    for q, (v, _) in first.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good if c != q and len(w) == len(v))
        out += [(q, r, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [True, False])
def test_against_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SMALLEST", 40), ("BLOCK", 96), ("SHARD", 4000), ("TILE_QUERIES", 2), ("TILE_ROWS", 16), ("FAN_IN", 2)):
            monkeypatch.setattr(topk, name, value)
    rng = random.Random(7)
    vector = lambda n=4: [rng.choice([rng.uniform(-1, 1), 0.5, -0.25]) for _ in range(n)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(300, 420)]  # ties
    rows += [(500, None), (501, [0.1, None, 0.2, 0.3]), (502, [float("nan")] * 4), (600, [float("inf")] * 4), (None, vector()), (700, vector(3)), (701, vector(3)), (800, []), rows[10], rows[10], rows[100], (900, [1e9, 1e9, 0.0, 1.0]), (901, [1e306, -1e306, 0.3, 0.0]), (910, [0.0, 1e307, -0.7, 0.0])]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int").repartition(3)
    got = topk.report(frame, k=5, every=10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)


def test_few_rows_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.report(spark.createDataFrame([], schema)).count() == 0
    assert topk.report(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in topk.report(spark.createDataFrame([(0, [1.0]), (1, [-0.0001])], schema)).collect()] == [(0, 1, 1, -1024)]
