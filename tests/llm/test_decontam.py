"""Operator 10 against a plain scan of all windows."""

from __future__ import annotations

import hashlib
import random
import re
import string

import pytest

from sparkassay.llm import decontam
from tests.llm.common import documents

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(rows, items, window=13):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w and item is not None else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        names = ",".join(sorted(map(str, found)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize(("small", "bits"), [(100_000, (16, 28)), (3, (6, 6))])
def test_against_brute_force(spark, monkeypatch, small, bits):
    monkeypatch.setattr(decontam, "SKETCH", bits)
    monkeypatch.setattr(decontam, "_CHUNK", 8 if bits[0] == 6 else 1 << 13)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "中文", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 12, 13, 14, 30]))) for i in range(60)]
    items += [(61, items[3][1]), items[4], (62, None), (63, "..."), (None, text(20))]
    rows = []
    for i in range(150):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", text(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", ", ", "\n-- "]).join(parts).upper().replace("É", "é") if i % 3 else " ".join(parts)))
    rows += [rows[0], (None, items[0][1]), (500, None), (501, ""), (502, "w1 " * 20_000)]
    got = decontam.report(documents(spark, rows).repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), small=small).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, items), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[1:4] for r in decontam.report(documents(spark, [(1, "a b")]), none).collect()] == [(2, 0, 0)]
    some = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontam.report(documents(spark, []), some).count() == 0


def test_a_window_of_very_many_items(spark):
    """Boilerplate that all items share: rows that are sent stay small, all ids come back."""
    words = "terms of use apply to all that is said in this small note here"
    items = spark.createDataFrame([(i, words + f" item{i}") for i in range(3000)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x " + words + " y"), (2, "nothing"), (3, None), (4, "")], "doc_id bigint, text string")
    for small in (200_000, 0):
        got = {r.doc_id: r for r in decontam.report(docs, items, small=small).collect()}
        assert got[1].n_items == 3000 and got[1].contaminated and got[1].n_hit == 14
        assert [got[d].n_hit for d in (2, 3, 4)] == [0, 0, 0]
