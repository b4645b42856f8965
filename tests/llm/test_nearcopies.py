"""Near copies against all pairs of shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparkassay.llm import nearcopies
from sparkassay.llm.words import NOT_SPACE, scan
from tests.llm.common import documents, near_copies
from tests.llm.test_simhash import FOLD


def shingles(text, size=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(rows, size=5, similarity=0.8):
    """A root for each row: rows are joined by similar sets."""
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                group[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def kept(rows, **options):
    """The rows that stay, by brute force."""
    roots, first = groups(rows, **options), {}
    for (d, _), r in zip(rows, roots):
        if d is not None:
            first[r] = min(d, first.get(r, d))
    return [(d, t) for (d, t), r in zip(rows, roots) if d is None or d == first[r]]


def edited(rng, n, size, changes):
    """Texts of `size` words; each later one is an earlier one with some words changed."""
    word = lambda: f"w{rng.randint(0, 5000)}"
    out = []
    for i in range(n):
        text = rng.choice(out)[1].split(" ") if out and rng.random() < 0.7 else [word() for _ in range(size)]
        for _ in range(rng.choice(changes)):
            text[rng.randrange(len(text))] = word()
        out.append((i, " ".join(text)))
    return out


order = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")


@pytest.mark.parametrize("tile", [4096, 8])
def test_against_all_pairs(spark, tile, monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rng = random.Random(tile)
    rows = edited(rng, 150, 200, [1, 2, 3, 4, 5, 8]) + [(1000 + d, t) for d, t in near_copies(rng, 100)]
    rows += [(None, rows[5][1]), (None, None), (3000, None), (3001, ""), (3002, " \n"), rows[7], (3003, "one two three"), (3004, "One TWO three"), (3005, "word " * 5000), (3006, "word " * 6000), (rows[9][0], "quite other words of the same number here")]
    got = [(r.doc_id, r.text) for r in nearcopies.keep_one(documents(spark, rows).repartition(3)).collect()]
    want = kept(rows)
    assert sorted(got, key=order) == sorted(want, key=order) and len(want) < len(rows) - 40


def test_planted_near_copies_at_each_similarity(spark):
    """Copies of 400-word texts with words changed at even distances: similarities of 0.8 to 0.95, and below."""
    rng = random.Random(3)
    rows, above, below = [], [], []
    for i in range(120):
        text = [f"w{rng.randint(0, 20_000)}" for _ in range(400)]
        for j, changes in enumerate((0, 2, 4, 6, 8, 9, 12, 14)):
            copy = list(text)
            for c in range(changes):
                copy[c * 390 // max(1, changes) + 3] = f"x{i}-{j}-{c}"
            a, b = shingles(" ".join(text)), shingles(" ".join(copy))
            likeness = len(a & b) / len(a | b)
            (above if likeness >= 0.8 else below).append(i * 10 + j)
            rows.append((i * 10 + j, " ".join(copy)))
    got = {r.doc_id for r in nearcopies.keep_one(documents(spark, rows)).collect()}
    first = {i * 10 for i in range(120)}
    assert len(above) == 120 * 6 and first <= got
    assert sum(d in got for d in above) - 120 <= 0.005 * (len(above) - 120)  # near copies that stay
    assert set(below) <= got  # texts that only resemble each other do


def test_a_pair_that_is_no_link_hides_none(spark):
    """A chain whose neighbours are links but for one: candidates of one anchor that fail are replaced by those that hold."""
    rng = random.Random(8)
    rows = []
    for g in range(30):
        text = [f"w{g}-{i}" for i in range(100)]
        for j in range(12):
            rows.append((g * 100 + j, " ".join(text)))
            for _ in range(rng.choice([2, 3, 4])):
                text[rng.randrange(100)] = f"n{rng.randint(0, 10**6)}"
    got = [(r.doc_id, r.text) for r in nearcopies.keep_one(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(kept(rows))


@pytest.mark.parametrize(("large", "pairs"), [(256, 1 << 18), (4, 40), (1000, 7)])
def test_anchors_of_any_size(monkeypatch, large, pairs):
    """Forests connect what all near pairs connect; without a forest, all near pairs of different labels come."""
    monkeypatch.setattr(nearcopies, "LARGE", large)
    monkeypatch.setattr(nearcopies, "PAIRS", pairs)
    rng = np.random.default_rng(large)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    rows = []
    for anchor in range(6):
        made = []
        for _ in range(rng.integers(1, 90)):
            if made and rng.random() < 0.8:
                a, b = made[rng.integers(len(made))]
                made.append((flip(a, rng.integers(1, 16)), flip(b, rng.integers(1, 16))))
            else:
                made.append(tuple(rng.integers(0, 1 << 63, 2).astype(np.uint64)))
        rows += [(anchor, 0, 0, 2, 1000 * anchor + i, int(rng.integers(0, 40)) if anchor % 2 else 1000 * anchor + i, a, b) for i, (a, b) in enumerate(made)]
    names = ["anchor", "i", "j", "side", "node", "label", "f0", "f1"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array([int(np.uint64(r[k]).view(np.int64)) if k > 5 else r[k] for r in rows], t) for k, t in enumerate(kinds)]
    batch = pa.RecordBatch.from_arrays(columns, names=names)
    near = {(x[4], y[4]) for x in rows for y in rows if x[4] < y[4] and x[0] == y[0] and x[5] != y[5] and int(x[6] ^ y[6]).bit_count() + int(x[7] ^ y[7]).bit_count() <= nearcopies.MOST}
    found = lambda forest: [p for b in nearcopies._compare(nearcopies.MOST, forest)(iter([batch.slice(0, 100), batch.slice(100)])) for p in zip(b["u"].to_pylist(), b["v"].to_pylist())]
    assert sorted(found(False)) == sorted(near) and near
    plain = {(u, v) for u, v in near if (u // 1000) % 2 == 0}  # where each row has its own label
    tree = {(u, v) for u, v in found(True) if (u // 1000) % 2 == 0}
    assert tree <= plain and joined(tree) == joined(plain)


@pytest.mark.parametrize("texts", [1000, 10**6, 10**8, 10**10])
def test_parts_grow_with_the_table(texts):
    """Rows an anchor stay few, and near copies still share one: of fingerprints that differ in each bit with probability 0.1515."""
    shape = nearcopies.Shape.of(texts)
    assert texts / 2**shape.width <= nearcopies.ROWS and shape.parts * shape.width <= 64 * shape.words
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, (2000, shape.words)).astype(np.uint64)
    flips = np.packbits((rng.random((2000, 64 * shape.words)) < 0.1515).astype(np.uint8), axis=1).view(np.uint64)
    same = (nearcopies.part_values(a, shape) == nearcopies.part_values(a ^ flips, shape)).any(1)
    assert same.mean() >= 0.993  # 0.9975 but for chance
    assert (np.bitwise_count(flips).sum(1) <= shape.most).mean() > 0.999


def test_rows_of_an_anchor_stay_flat(spark, monkeypatch):
    """Ten times more texts, parts that grow: an anchor of the largest holds no more."""
    monkeypatch.setattr(nearcopies, "PART", 6)
    rng = np.random.default_rng(2)
    most = []
    for n in (2000, 20_000):
        shape = nearcopies.Shape.of(n, rows=32)
        values = nearcopies.part_values(rng.integers(0, 1 << 63, (n, shape.words)).astype(np.uint64), shape)
        most.append(max(np.unique(values[:, i], return_counts=True)[1].max() for i in range(10)))
    assert most[1] <= 1.5 * most[0] and nearcopies.Shape.of(20_000, rows=32).width > nearcopies.Shape.of(2000, rows=32).width


def test_wider_parts_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(nearcopies.Shape.of.__func__, "__defaults__", (0.8, 1 / 4096))  # 19 bits for these few
    rng = random.Random(12)
    rows = edited(rng, 120, 150, [1, 2, 3, 6])
    got = [(r.doc_id, r.text) for r in nearcopies.keep_one(documents(spark, rows).repartition(3)).collect()]
    assert sorted(got) == sorted(kept(rows)) and len(got) < 110


def joined(pairs):
    group = {}
    for u, v in pairs:
        a, b = group.setdefault(u, {u}), group.setdefault(v, {v})
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    return {frozenset(x) for x in group.values()}


def test_empty_table_and_columns(spark):
    empty = nearcopies.keep_one(documents(spark, []))
    assert empty.count() == 0 and empty.columns == documents(spark, []).columns


def test_sets_and_forest():
    texts = ["a b c d e f", "a b", "", None, "x " * 20, "A b C d e f a b c d e"]
    got = [(w.n, *nearcopies.shingle_sets(w, 5)) for w in scan(pa.array(texts), NOT_SPACE)]
    assert [n for x in got for n in x[2].tolist()] == [len(shingles(t)) for t in texts]
    rng = np.random.default_rng(1)
    u, v, d = rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 5, 200)
    keep = u != v
    u, v, d = u[keep], v[keep], d[keep]
    taken = nearcopies.spanning(u, v, d)
    assert len(taken) == 29 and len(set(taken.tolist())) == 29
    weight, group = 0, list(range(30))
    for i in np.argsort(d, kind="stable"):  # Kruskal
        if group[u[i]] != group[v[i]]:
            weight += d[i]
            a, b = group[u[i]], group[v[i]]
            group = [a if x == b else x for x in group]
    assert d[taken].sum() == weight
