"""Operator 11 against a plain tree, with small blocks so that rounds and replicas are many."""

from __future__ import annotations

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sparkassay.llm import merkle

H = lambda s: sha256(s.encode()).hexdigest()
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, root int, part string, g int"


def one(row):
    d, t, x, s, n = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, s, x, n, t)))


def plain(leaves, f):
    """(root, proof of each leaf as levels of (siblings before, siblings after))."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, p in enumerate(proofs):
            a = at[i] - at[i] % f
            p.append((level[a : at[i]], level[at[i] + 1 : a + f]))
            at[i] //= f
        level = [H("".join(level[i : i + f])) for i in range(0, len(level), f)]
    return level[0], proofs


def brute(rows, f=2):
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        by[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, one(r)))
        trees[x] = plain([one(r) for r in by[x]], f)
    root, tops = plain([trees[x][0] for x in langs], f)
    out = []
    for x, top in zip(langs, tops):
        for r, proof in zip(by[x], trees[x][1]):
            path, bad = proof + top, r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                bad = (*r[:4], r[4] + 1)
            now = one(bad)
            for a, b in path:
                now = H("".join(a) + now + "".join(b))
            out.append((r[0], one(r), trees[x][0], root, H("".join("".join(a + b) for a, b in path)), now, now == root))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "p", 2) for r in [(d, t, x, s, n) for d, t, x, s, n in rows]], COLUMNS)


def made(n, seed=1):
    rng = random.Random(seed)
    langs = ["en"] * 12 + ["de", "fr", None, "é", "", "Z", "\U0001f600"]
    rows = [(i * 3, rng.choice(["text", "ü" * 5, "", None]) if i % 5 else f"t{i}", rng.choice(langs), rng.choice(["s", None]), rng.choice([None, 4, i])) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "x", "en", "s", 1), rows[0], rows[0], (rows[1][0], "other", rows[1][2], "s", 1), (10**6, "long " * 100_000, "en", "s", 500_000)]


@pytest.mark.parametrize(("fanout", "inner", "outer"), [(2, 10, 4), (2, 1, 1), (2, 2, 2), (3, 1, 1), (2, 1, 2)])
def test_against_a_plain_tree(spark, fanout, inner, outer):
    rows = made(200)
    got = merkle.report(frame(spark, rows).repartition(5), fanout=fanout, inner=inner, outer=outer)
    want = brute(rows, fanout)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert 0 < sum(not r[-1] for r in want) < 100


def test_siblings_prove_a_row(spark):
    rows = made(50)
    docs = frame(spark, rows)
    got = merkle.proofs(merkle.leaves(docs), inner=2, outer=1).collect()
    for r in got:
        it = iter(r.siblings)
        assert merkle.fold(merkle.fold(r.leaf, it, r.pos, r.n), it, r.top_pos, r.top_n) == r.root and next(it, None) is None
    assert len({r.root for r in got}) == 1


def test_replicas_stay_few(spark):
    leaves = spark.range(1025).select(F.lit("").alias("g"), F.col("id").alias("pos"), F.lit(1025).cast("bigint").alias("n"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("leaf"))
    state = merkle.exchange(leaves, inner=2, outer=2)
    assert state.count() == 257 and state.select("digest").distinct().count() == 1


def test_empty_one_row_and_names_of_other_case(spark):
    assert merkle.report(frame(spark, [])).count() == 0
    row = (7, "t", "en", "s", 1)
    got = merkle.report(frame(spark, [row])).collect()
    assert tuple(got[0])[:5] == (7, one(row), one(row), one(row), H(""))
    odd = spark.createDataFrame([(8, "u", *row)], "DOC_ID int, TEXT string, doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert merkle.report(odd).collect()[0].leaf == one(row)
