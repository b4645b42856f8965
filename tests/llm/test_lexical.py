"""Operator 13 against plain scoring of every item and document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sparkassay.llm import lexical

DOCS = "doc_id bigint, text string, score string, `a``b` int, rank int, Item_Id string"
FOLD = {c: c + 32 for c in range(65, 91)}
terms = lambda t: re.findall(lexical.TERM, (t or "").translate(FOLD))


def brute(docs, items, k):
    read = [(d, Counter(terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in read)
    words = sum(sum(c.values()) for _, c in read)
    df = Counter(t for _, c in read for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for d, c in read:
            m = 100 - 75 + (75 * sum(c.values()) * n) // words if words else 0
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in want.items() if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made(seed=4):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)] + ["Straße", "ÄÖ", "x_y", "naïve", "日本語", "a" * 40, "a" * 39 + "b"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(base) for _ in range(n))
    passage = text(15)
    docs = [(i, text(rng.randint(1, 60)) + (passage if rng.random() < 0.3 else "")) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "..., !"), (None, passage), (None, docs[3][1]), docs[3], docs[3], (203, "W1 " * 50_000)]
    items = [(i, text(rng.randint(0, 25)) + (" " + passage if i % 2 else "")) for i in range(25)]
    items += [(50, None), (51, ""), (52, "unheard of"), (None, "w1 w2"), (53, "w1"), (53, "w1 w2"), (54, items[1][1]), (55, items[1][1] + " w3")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"turn": 90, "block": 40, "k": 3}])
def test_against_brute_force(spark, monkeypatch, options):
    monkeypatch.setattr(lexical, "CELLS", 4000 if options else lexical.CELLS)
    docs, items = made()
    d = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in docs], DOCS).repartition(3)
    i = spark.createDataFrame([(*r, 1.0) for r in items], "item_id bigint, text string, score double")
    got = lexical.search(d, i, **options)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("k", 10))


def test_empty_tables(spark):
    docs, items = made()
    d, i = spark.createDataFrame([(*r, "s", 1, 2, "x") for r in docs], DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    assert lexical.search(d.limit(0), i).count() == lexical.search(d, i.limit(0)).count() == 0


def test_sums_are_shared():
    rng = random.Random(1)
    for _ in range(20):
        common = rng.sample(range(100), 20)
        items = [sorted({*rng.sample(common, 12), *rng.sample(range(100), 5)}) for _ in range(12)]
        sums, roots = lexical.share(items, 100)
        value = [1 << x for x in range(100)]
        for a, b in sums:
            value.append(value[a] + value[b])
        assert [value[r] for r in roots] == [sum(1 << x for x in held) for held in items]
        assert len(sums) < sum(len(x) - 1 for x in items) * 0.85
    same = [[1, 2, 3, 4]] * 5
    assert len(lexical.share(same, 5)[0]) == 3


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    hashes = lexical.Words.hashes
    monkeypatch.setattr(lexical.Words, "hashes", lambda self: hashes(self) & lexical.U64(1))
    names = [f"term{i}" for i in range(20)] + ["longer-than-eight-bytes-1", "longer-than-eight-bytes-2"]
    known = lexical.Vocabulary.of([n for n in names if n != "term7"])
    import pyarrow as pa

    (w,) = lexical.scan(pa.array([" ".join(n.replace("-", "x") for n in names)]), lexical.ALNUM)
    back = {v: k for k, v in known.ids.items()}
    assert [back.get(int(x)) for x in known.find(w)] == [n if n != "term7" and "-" not in n else None for n in names]
    assert np.unique(known.hashes).size == 2
