"""Operator 12 against plain water filling, all subset sums of small sources, and its own promises."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkassay.llm import mixing

COLUMNS = "doc_id bigint, text string, source string, size string, target int, `a``b` int, taken string, Source2 string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], COLUMNS)


def words(t):
    return len(re.findall("[^\x20\x09-\x0d]+", t or ""))


def plain_targets(rows, share=1.5):
    size = Counter()
    for _, t, s in rows:
        size[s] += words(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(size.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        out |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    return size, out


def sums(lengths):
    able = {0}
    for n in lengths:
        able |= {a + n for a in able}
    return able


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.choice(["a"] * 9 + ["B", "é", "\U0001f600", None, "c"])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 7, 7, 7, rng.randint(1, 60)])) if i % 17 else None, s))
    return rows


def checked(rows, got):
    size, target = plain_targets(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, words(t)) for d, t, _ in rows)
    of = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = of[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s], rel=1e-12)
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size if r.size else r.taken == 0
        taken[s] += r.taken
    return size, target, taken


@pytest.mark.parametrize("options", [{}, {"window": 40, "per_range": 5}])
def test_targets_and_subset_sums(spark, options):
    rows = made(250)
    got = mixing.mix(frame(spark, rows).repartition(4), **options).collect()
    size, target, taken = checked(rows, got)
    for s, t in target.items():
        rest = t - int(t / size[s]) * size[s] if size[s] else 0.0
        able = sums([words(x) for _, x, y in rows if y == s])
        nearest = min(abs(a - rest) for a in able)
        assert abs(taken[s] - t) <= (nearest + 1e-6 if not options else 60)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(2), **options).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    other = mixing.mix(frame(spark, rows), seed=7, **options).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))


def test_one_length_shared_by_most_and_repeated_rows(spark):
    rows = [(i, "same words here", "a") for i in range(400)] + [(900, "same words here", "a")] * 300 + [(None, "x y", "a")] * 5 + [(901, "w " * 500, "b")]
    got = mixing.mix(frame(spark, rows), per_range=20).collect()
    assert len(got) == len(rows)
    _, target, taken = checked(rows, got)
    assert abs(taken["a"] - target["a"]) <= 1.5


def test_fit_is_exact_where_it_can_be():
    rng = random.Random(5)
    for _ in range(300):
        length = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 6))))
        count = np.array([rng.randint(1, 4) for _ in length])
        goal = rng.randint(0, 2 * int((length * count).sum()) + 6) / 2
        got = mixing.fit(length, count, goal)
        able = sums([n for n, c in zip(length.tolist(), count.tolist()) for _ in range(c)])
        want = min(able, key=lambda a: (abs(a - goal), a))
        assert (got <= count).all() and (got * length).sum() == want
    for window in (64, 1000):
        length, count = np.arange(1, 300), np.full(299, 50)
        for goal in (10_000, 123_457, 2_000_001):
            got = mixing.fit(length, count, goal, window)
            assert (got <= count).all() and abs(int((got * length).sum()) - goal) <= (0 if window == 1000 else 300)
    far = np.array([10**7, 3 * 10**7])
    assert (mixing.fit(far, np.array([5, 5]), 6 * 10**7) * far).sum() == 6 * 10**7
    assert mixing.reach(np.array([7]), np.array([9]), 10).tolist() == [1]


def test_empty_and_columns_of_other_case(spark):
    assert mixing.report(frame(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, "no", "a b c", "s", "t")], "DOC_ID int, TEXT string, text string, source string, SOURCE string")
    assert [tuple(r) for r in mixing.report(odd).collect()] == [(1, 3, 3, 4.5, 3)]  # a budget of 1.5 documents: of two as near, the smaller
