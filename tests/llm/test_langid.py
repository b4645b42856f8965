"""Operator 4: held-out accuracy, mixtures and odd cases."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkassay.llm import langid

STEMS = {"aa": ["the", "and", "tion", "whe", "ould", "ing"], "bb": ["ungen", "sch", "keit", "über", "nicht", "ein"], "cc": ["ción", "que", "los", "ando", "ñas", "el"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def rows(seed=0, n=300):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(list(STEMS)), rng.randint(4, 60)), lang) for i in range(n)]


SCHEMA = "doc_id bigint, text string, lang string, score string, mixture int"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)


def test_held_out_accuracy(spark):
    data = rows()
    got = {r.doc_id: r for r in langid.report(frame(spark, data)).collect()}
    assert len(got) == len(data)
    held = [(d, lang) for d, _, lang in data if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d].held_out for d, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark):
    data = [*rows(), (None, "the tion and", "aa"), (1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... !", "cc"), (1003, "the and tion " * 20_000, None), (1003, "the and tion " * 20_000, None), (1004, "q", "aa")]
    got = langid.report(frame(spark, data)).collect()
    found = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == len(data)
    assert all(found[d] == ("und", 0.0) for d in (1000, 1001, 1002))
    assert found[1003][0] == "aa" and found[None][0] == "aa" and found[1004][0] in STEMS


def test_mixture_sets(spark):
    rng = random.Random(4)
    data = [(1, text(rng, "aa", 60), None), (2, text(rng, "aa", 70) + " " + text(rng, "bb", 30), None), (3, text(rng, "aa", 40) + " " + text(rng, "bb", 30) + " " + text(rng, "cc", 30), None)]
    found = {r.doc_id: r.mixture for r in langid.identify(frame(spark, data), frame(spark, rows())).collect()}
    assert set(found[1]) == {"aa"} and found[1]["aa"] == 1
    assert set(found[2]) == {"aa", "bb"} and 0.5 < found[2]["aa"] < 0.9
    assert set(found[3]) == {"aa", "bb", "cc"}


def plain_em(p, rounds=20_000):
    """Proportions and log likelihood of one document's n-gram probabilities (a list of lists), by plain loops."""
    share = [1 / len(p[0])] * len(p[0])
    for _ in range(rounds):
        new = [0.0] * len(share)
        for row in p:
            whole = sum(s * x for s, x in zip(share, row))
            for k, x in enumerate(row):
                new[k] += share[k] * x / whole / len(p)
        moved, share = max(abs(a - b) for a, b in zip(new, share)), new
        if moved < 1e-9:
            break
    return share, sum(math.log(sum(s * x for s, x in zip(share, row))) for row in p)


def test_inference_against_plain_loops():
    """Counting, estimation and the choice of the set, from texts to labels."""
    rng = random.Random(6)
    known = [(t, lang) for _, t, lang in rows(1, 60)]
    counts = {}
    bins_of = lambda t: [int(b) for _, bins, _ in langid.grams(pa.array([t])) for b in bins]
    for t, lang in known:
        counts.setdefault(lang, Counter()).update(bins_of(t))
    names = sorted(counts)
    chance = lambda lang, b: (counts[lang][b] + langid.SMOOTHING) / (sum(counts[lang].values()) + langid.SMOOTHING * langid.BINS)
    made = langid.Model(names, np.array([[counts[x][b] for b in range(langid.BINS)] for x in names], float))
    texts = [text(rng, "aa", 5), text(rng, "bb", 30), *(text(rng, "aa", a) + " " + text(rng, "bb", b) + " " + text(rng, "cc", c) for a, b, c in [(8, 8, 0), (20, 3, 0), (9, 8, 7), (12, 6, 3), (1, 1, 1)])]
    for t in texts:
        b = bins_of(t)
        p = [[chance(x, y) for x in names] for y in b]
        cost = langid.PENALTY * math.log(max(2, len(b)))
        alone = [sum(math.log(row[k]) for row in p) for k in range(len(names))]
        want, reached = {alone.index(max(alone)): 1.0}, max(alone)
        share, full = plain_em(p)
        if full - reached > cost:
            order = sorted(range(len(names)), key=lambda k: -share[k])
            for n in range(2, len(names) + 1):
                part, found = plain_em([[row[k] for k in order[:n]] for row in p])
                if found - reached <= cost:
                    break
                want, reached = dict(zip(order, part)), found
        (best, score, chosen), = made.infer(np.array(b), np.array([len(b)]), langid.PENALTY)
        assert best == min(want, key=lambda k: (-want[k], k)) and chosen == pytest.approx(want, abs=0.02) and 0 <= score <= 1


def test_many_languages_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(langid, "VALUES", 1 << 16)
    rng = random.Random(9)
    stems = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for i in range(300)}
    made = lambda lang, n: " ".join(rng.choice(stems[lang]) for _ in range(n))
    learn = [(10_000 + i, made(lang, 60), lang) for i, lang in enumerate(stems)]
    ask = [(1, made("l007", 40), None), (2, made("l123", 200_000), None), (3, made("l001", 60_000) + " " + made("l299", 50_000), None)]
    found = {r.doc_id: r for r in langid.identify(frame(spark, ask), frame(spark, learn)).collect()}
    assert [found[d].lang_pred for d in (1, 2, 3)] == ["l007", "l123", "l001"] and found[3].mixture["l299"] == pytest.approx(0.4545, abs=0.03)


def test_letters_are_of_category_l(spark):
    data = [*rows(), (2000, "½ ² 3 Ⅷ", None), (2001, "_ \u0301", None), (2002, "é", None), (2003, "ªʰ", None)]
    found = {r.doc_id: r.lang_pred for r in langid.report(frame(spark, data)).collect()}
    assert found[2000] == found[2001] == "und" and found[2002] in STEMS and found[2003] in STEMS


def test_nothing_to_learn(spark):
    got = langid.report(frame(spark, [(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
    assert langid.report(frame(spark, [])).count() == 0
