"""Operator 5: base phrases against a plain search, matching statistics against all runs, and template labels."""

from __future__ import annotations

import random
import re
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkassay.llm import licences
from tests.llm.common import documents

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    found = [(i, label) for phrase, label in licences.BASE for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_base_against_plain_search(spark):
    rng = random.Random(1)
    phrases = [p for p, _ in licences.BASE] + [t for t, _ in licences.TEMPLATES[:8]]
    filler = ["under", "the", "mit", "license", "cc", "by", "nc", "apache", "version", "2", "été", "中", "word"]
    rows = []
    for i in range(300):
        parts = [rng.choice(phrases) if rng.random() < 0.3 else " ".join(rng.choice(filler) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        rows.append((i, rng.choice([" ", ", ", "-", "\n"]).join(parts).upper().replace("ÉTÉ", "été")))
    rows += [(900, None), (901, ""), (None, "cc by nc"), (902, "cc-by-nc " * 3), (903, "x " * 50_000 + "Under the MIT License"), (903, "cc by nc"), (904, "cc by nc" * 2)]
    got = licences.report(documents(spark, rows).repartition(3)).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r[:5]) + (r[5],)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted([(d, *base(t)) for d, t in rows], key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


def test_template_spans(spark):
    gpl = dict((x, t) for t, x in licences.TEMPLATES)["gpl-2"]
    words = gpl.split()
    broken = " ".join(words[:20] + ["or", "so"] + words[21:])
    rows = [(1, "Intro here. " + broken.upper() + " the end"), (2, " ".join(words[:12])), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "the terms of this work and the software")]
    got = {r.doc_id: r for r in licences.scan_licences(documents(spark, rows)).collect()}
    assert "gpl-2" in got[1].labels.split(",") and 0.9 < got[1].score < 1
    assert any(s.label == "gpl-2" and s.first == 2 and s.last == len(words) + 2 for s in got[1].spans)
    assert got[2].labels == "" and got[4].labels == "" and got[3].labels == "gpl-3" and got[3].score == 1


def test_empty_table(spark):
    assert licences.report(documents(spark, [])).count() == 0


WORDS = st.lists(st.sampled_from("abcd"), min_size=1, max_size=9)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, min_size=1, max_size=4), st.lists(st.sampled_from("abcde"), max_size=25))
def test_matching_statistics(templates, text):
    made = licences.Automaton(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, (state, length) in enumerate(made.stream([made.vocabulary.get(w, -1) for w in text])):
        longest = max((n for n in range(i + 2) if not n or tuple(text[i + 1 - n : i + 1]) in runs), default=0)
        assert length == longest
        if length:
            match = text[i + 1 - length : i + 1]
            assert made.ends[state] == {(t, e - 1) for t, x in enumerate(templates) for e in range(length, len(x) + 1) if x[e - length : e] == match}
            assert [t for t in made.whole[state] if len(templates[t]) <= length] == [t for t, x in enumerate(templates) if text[: i + 1][-len(x) :] == x]


def plain_labels(text, templates):
    """Labels by all common runs of a text and its templates, and all chains of them, by plain search."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    known = {x for t, _ in templates for x in t.split()}
    longest = []  # the longest run of any template that ends at each word
    for i in range(len(w)):
        n = 0
        while n <= i and all(x in known for x in w[i - n : i + 1]) and any(w[i - n : i + 1] == t.split()[j : j + n + 1] for t, _ in templates for j in range(len(t.split()))):
            n += 1
        longest.append(n)
    out = set()
    for t, label in templates:
        t = t.split()
        runs = []
        for i in range(len(w)):
            if longest[i] < licences.MIN_MATCH or i + 1 < len(w) and longest[i + 1] > longest[i]:
                continue
            for place in range(len(t)):
                n = 0
                while n <= min(i, place) and w[i - n] == t[place - n]:
                    n += 1
                if n >= licences.MIN_MATCH:
                    runs.append((i - n + 1, i, place - n + 1, place))

        def best(k, runs=runs):
            a, b, x, y = runs[k]
            before = [best(j) for j, (_, b2, _, y2) in enumerate(runs) if j != k and 0 <= a - 1 - b2 <= licences.MAX_GAP and 0 <= x - 1 - y2 <= licences.MAX_GAP]
            return b - a + 1 + max(before, default=0)

        if any(best(k) / len(t) >= licences.COVERAGE for k in range(len(runs))):
            out.add(label)
    return out


def test_labels_against_plain_search(spark):
    """Templates from a table; texts with parts of them, words added, lost and exchanged."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    templates = [(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([6, 15, 30]))), f"l{i % 7}") for i in range(9)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 6))]
        for t, _ in rng.sample(templates, rng.choice([1, 1, 2])):
            words += [x for x in t.split() if rng.random() > 0.06]
            for _ in range(rng.choice([0, 1, 3])):
                words.insert(rng.randint(0, len(words)), rng.choice([*vocabulary, "other", "new"]))
        rows.append((i, rng.choice([" ", ", ", "-"]).join(words)))
    table = spark.createDataFrame([*((t.upper(), x, 1) for t, x in templates), (None, "x", 1), ("...", "y", 1), ("w1 w2", None, 1)], "text string, label string, n int")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licences.scan_licences(documents(spark, rows), licences.scanner_of(table, [])).collect()}
    want = {i: plain_labels(t, templates) for i, t in rows}
    assert got == want and sum(map(bool, want.values())) > 40 and not all(want.values())


def test_too_many_template_words(spark, monkeypatch):
    monkeypatch.setattr(licences, "MOST_WORDS", 3)
    with pytest.raises(ValueError, match="4 words"):
        licences.scanner_of(spark.createDataFrame([("a b", "x"), ("c d", "y")], "text string, label string"))
