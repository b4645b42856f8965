"""Operator 8: the weights by hand, exact selection, and held-out accuracy."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from sparkassay.llm import resample
from sparkassay.llm.words import NOT_SPACE, scan


def make(seed=0, n=400):
    rng = random.Random(seed)
    good, bad = [f"good{i}" for i in range(40)], [f"junk{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(n):
        fine = rng.random() < 0.7
        docs.append((i, " ".join(rng.choice(good if fine or rng.random() < 0.2 else bad) for _ in range(rng.randint(3, 40)))))
        if rng.random() < 0.6:
            labels.append((i, int(fine)))
    return docs, labels


def frames(spark, docs, labels):
    return (spark.createDataFrame([(*d, 1, True) for d in docs], "doc_id bigint, text string, log_ratio int, selected boolean").repartition(3), spark.createDataFrame([(*x, "c") for x in labels], "doc_id bigint, quality int, text string"))


def test_held_out_accuracy_and_size(spark):
    docs, labels = make()
    got = resample.report(*frames(spark, docs, labels)).collect()
    ratio = {r.doc_id: r.log_ratio for r in got if r.held_out}
    good = [ratio[d] for d, q in labels if d in ratio and q]
    bad = [ratio[d] for d, q in labels if d in ratio and not q]
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)
    assert len(got) == len(docs) and sum(r.selected for r in got) == 320
    assert min(r.gumbel_key for r in got if r.selected) >= max(r.gumbel_key for r in got if not r.selected) - 2e-9


def test_log_ratio_by_hand(spark):
    import numpy as np

    docs, labels = [(1, "a b"), (2, "b"), (3, None)], [(1, 1)]
    d, l = frames(spark, docs, labels)
    table = resample.train(d, l)
    # all: a, b, b, ab; target: a, b, ab; every other bin has the ratio of a
    size = 1 << resample.BITS
    values = sorted(set(np.round(table, 12)))
    want = [np.log(2 / (3 + size)) - np.log(n / (4 + size)) for n in (3, 2)]
    assert np.allclose(values, want)


@pytest.mark.parametrize("cells", [2, 7, 4096])
def test_kth_largest(spark, cells):
    rng = random.Random(cells)
    values = [rng.choice([rng.randint(-10**12, 10**12), 5, 6, -3]) for _ in range(200)]
    frame = spark.createDataFrame([(v,) for v in values], "rank_key bigint")
    for k in (1, 2, 77, 200):
        assert resample.kth_largest(frame, k, cells) == sorted(values, reverse=True)[k - 1]


def test_selection_against_plain_gumbel_topk(spark):
    """Every row's log ratio, key and selection, by dictionaries over the same bins and the same noise."""
    docs, labels = make(3, 150)
    docs += [(None, "good1 junk2"), (700, None), docs[5]]
    bins = lambda t: [int(b) for w in scan(pa.array([t]), NOT_SPACE) for b in resample.bins(w)[0]]
    raw, target = Counter(), Counter()
    good = {d for d, q in labels if q and zlib.crc32(str(d).encode()) % 4 != 2}
    for d, t in docs:
        raw.update(bins(t))
        if d in good:
            target.update(bins(t))
    size = 1 << resample.BITS
    chance = lambda c, b: math.log((c[b] + 1) / (sum(c.values()) + size))
    ratio = [sum(chance(target, b) - chance(raw, b) for b in bins(t)) for _, t in docs]
    noise = {(r.doc_id, r.text): -math.log(-math.log(((r.h % ((1 << 53) - 1)) + 1) / 2**53)) for r in spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", f"xxhash64(doc_id, text, {resample.SEED}) as h").collect()}
    keys = [x + noise[d] for d, x in zip(docs, ratio)]
    last = sorted(keys, reverse=True)[math.ceil(resample.SHARE * len(docs)) - 1]
    got = resample.report(*frames(spark, docs, labels)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((d, x, k, k >= last - 1e-9) for (d, _), x, k in zip(docs, ratio, keys)), key=order)
    assert len(got) == len(want)
    for g, w in zip(sorted(((r.doc_id, r.log_ratio, r.gumbel_key, r.selected) for r in got), key=order), want):
        assert g[0] == w[0] and g[1:3] == pytest.approx(w[1:3], abs=1e-8) and g[3] == w[3]


def test_odd_rows(spark):
    docs, labels = make(1, 50)
    docs += [(None, "good1"), (900, None), (901, ""), docs[3], docs[3], (902, "good2 " * 30_000)]
    got = resample.report(*frames(spark, docs, [*labels, (None, 1), (4, None)])).collect()
    assert len(got) == len(docs) and {r.log_ratio for r in got if r.doc_id in (900, 901)} == {0.0}
    assert len({(r.gumbel_key, r.selected) for r in got if r.doc_id == docs[3][0]}) == 1
    assert {r.log_ratio for r in resample.report(*frames(spark, docs[:5], [])).collect()} == {0.0}
    assert resample.report(*frames(spark, [], [])).count() == 0
