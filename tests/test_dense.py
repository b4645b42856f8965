"""Exact nearest vectors against all products."""

from __future__ import annotations

import numpy as np
import pytest

from sparkassay.operators import dense


def plain(v, ids, q, own, k):
    score = dense.rounded(v @ q, 6)
    return sorted((-s, i) for s, i in zip(score.tolist(), ids) if i != own)[:k]


@pytest.mark.parametrize("options", [{}, {"pivots": 12, "block": 20, "turn": 7}, {"pivots": 3}])
def test_against_all_products(spark, options):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(15, 8)) * 4
    v = centres[rng.integers(0, 15, 500)] + rng.normal(size=(500, 8)) * 0.2
    v[400:] = v[17]  # many copies of one
    v[30] = 0
    ids = list(range(1000, 1500))
    asked = [(i, 1000 + i * 7, (v[i * 7] * (1 if i % 2 else -1)).tolist()) for i in range(30)] + [(99, None, [0.0] * 8)]
    frame = spark.createDataFrame(list(zip(ids, v.tolist())), "vec_id bigint, v array<double>").repartition(3)
    got = dense.search(frame, spark.createDataFrame(asked, "question_id bigint, own bigint, q array<double>"), 4, **options).collect()
    want = [(n, r, i, -s) for n, own, q in asked for r, (s, i) in enumerate(plain(v, ids, np.array(q), own, 4), 1)]
    assert sorted((r.question_id, r.rank, r.vec_id, r.score) for r in got) == sorted((n, r, i, pytest.approx(s, abs=2e-6)) for n, r, i, s in want)


def test_clusters_are_skipped(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 5
    v = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.1
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, v array<double>")
    asked = spark.createDataFrame([(i, i, v[i].tolist()) for i in range(50)], "question_id bigint, own bigint, q array<double>")
    rows = dense.found(frame, asked, 5, pivots=200).collect()
    assert sum({r.scored for r in rows}) < 0.25 * 4000 * 50


def test_no_vectors_and_no_questions(spark):
    v, q = spark.createDataFrame([], "vec_id bigint, v array<double>"), spark.createDataFrame([(1, 2, [0.5])], "question_id bigint, own bigint, q array<double>")
    assert dense.search(v, q, 3).count() == 0
    assert dense.search(spark.createDataFrame([(1, [0.5]), (2, [1.0])], "vec_id bigint, v array<double>"), q.limit(0), 3).count() == 0
    assert [tuple(r) for r in dense.search(spark.createDataFrame([(1, [0.5]), (2, [1.0])], "vec_id bigint, v array<double>"), q, 3).collect()] == [(1, 1, 1, 0.25)]
