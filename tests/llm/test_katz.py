"""Operator 6 against a plain dictionary model, and the sum of its probabilities."""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import pytest

from sparkassay.llm import katz
from tests.llm.common import documents

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
END, START = ("end",), ("start",)


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD)), END]


class Plain:
    """Katz backoff, written down directly."""

    def __init__(self, rows):
        self.word, self.pair, self.context = Counter(), Counter(), Counter()
        for d, t in rows:
            if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
                before = START
                for w in tokens(t):
                    self.word[w] += 1
                    self.pair[before, w] += 1
                    self.context[before] += 1
                    before = w
        self.n = sum(self.word.values())
        counts = lambda c: [sum(v == i for v in c.values()) for i in range(1, katz.TRUSTED + 2)]
        self.dw, self.dp = katz.discounts(counts(self.word)), katz.discounts(counts(self.pair))
        self.after = defaultdict(list)
        for h, w in self.pair:
            self.after[h].append(w)
        self.unknown = 1 - sum(self.kept(c, self.dw) for c in self.word.values()) / self.n if self.n else 1.0

    @staticmethod
    def kept(c, d):
        return c * d[c] if c <= katz.TRUSTED else c - katz.LEAST

    def p1(self, w):
        return self.kept(self.word[w], self.dw) / self.n if w in self.word else self.unknown

    def p(self, h, w):
        if (h, w) in self.pair:
            return self.kept(self.pair[h, w], self.dp) / self.context[h]
        if h not in self.after:
            return self.p1(w)
        left = 1 - sum(self.kept(self.pair[h, x], self.dp) for x in self.after[h]) / self.context[h]
        return left / (1 - sum(self.p1(x) for x in self.after[h])) * self.p1(w)

    def row(self, d, t):
        w = tokens(t)
        base = sum(math.log10((self.word[x] + 1) / (self.n + 1 * (len(self.word) + 1))) for x in w)
        score = sum(math.log10(self.p(h, x)) for h, x in zip([START, *w], w))
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        return (d, held, len(w), sum(x in self.word for x in w), self.n), (base, score)


def rows_of(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    out = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", "É", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*out, (None, "w1 W2"), (5000, None), (5001, ""), out[3], out[3], (5002, "w1 " * 30_000), (5003, "never\tseen  words")]


@pytest.mark.parametrize(("n", "block", "partition"), [(300, 500, 700), (300, 10**6, 10**6), (4, 50, 50)])
def test_against_plain_model(spark, monkeypatch, n, block, partition):
    monkeypatch.setattr(katz, "PARTITION", partition)
    monkeypatch.setattr(katz, "BLOCK", block)
    rows = rows_of(n, n)
    plain = Plain(rows)
    key = lambda r: tuple((x is not None, x or 0) for x in r[0])
    want = sorted((plain.row(d, t) for d, t in rows), key=key)
    got = sorted((((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), (r.base_score, r.score)) for r in katz.report(documents(spark, rows).repartition(3)).collect()), key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    for (_, g), (_, w) in zip(got, want):
        assert g == pytest.approx(w, rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain(rows_of(9, 200))
    for h in [START, "w1", "w2", "never", *list(plain.after)[:40]]:
        assert sum(plain.p(h, w) for w in plain.word) + plain.p(h, "some unknown word") == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    got = katz.report(documents(spark, [(held, "a b")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(True, 3, 0, 0, 0.0, 0.0)]
    assert katz.report(documents(spark, [])).count() == 0


def test_words_of_repeating_patterns(spark):
    """Two words of 2,048 letters whose polynomial hashes modulo 2^64 are equal (Thue and Morse) stay two words."""
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    learned = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(learned, one), (held, two)]
    got = {r.doc_id: r for r in katz.report(documents(spark, rows)).collect()}
    assert (got[held].n_tokens, got[held].n_known, got[learned].n_known) == (2, 1, 2)
    assert got[held].base_score == pytest.approx(Plain(rows).row(held, two)[1][0])


def test_discounts():
    d = katz.discounts([100, 40, 22, 14, 10, 7])
    assert d[0] == 1 and all(0 < x < 1 for x in d[1:])
    assert all(0 < x < 1 for x in katz.discounts([5, 9, 1, 0, 0, 0])[1:]) and all(0 < x < 1 for x in katz.discounts([0] * 6)[1:])


#: Numbers of words and pairs seen 1..6 times in the training documents of sf0.1, whose copies make d(4) of plain Turing 1.228 and 1.093.
UNEVEN = [[207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580]]


@pytest.mark.parametrize("n", UNEVEN)
def test_good_turing_is_in_force_with_copies(n):
    d = katz.discounts(n)
    x, y = [math.log(r) for r in range(1, 7)], [math.log(v) for v in n]
    b = (6 * sum(p * q for p, q in zip(x, y)) - sum(x) * sum(y)) / (6 * sum(p * p for p in x) - sum(x) ** 2)
    smooth = [math.exp(b * math.log(r)) for r in range(1, 7)]
    cut = 6 * smooth[5] / smooth[0]
    assert list(d[1:]) == pytest.approx([((r + 1) * smooth[r] / (r * smooth[r - 1]) - cut) / (1 - cut) for r in range(1, 6)])
    assert all(0 < x < 1 for x in d[1:]) and list(d[1:]) == sorted(d[1:])


def test_scores_with_copies(spark):
    """A corpus whose fivefold copies break plain Turing: scores follow the smoothed factors, not a constant loss."""
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(30)) for _ in range(120)]
    rows = list(enumerate(texts + [t for t in texts[:8] for _ in range(4)]))
    plain = Plain(rows)
    n = [sum(v == i for v in plain.pair.values()) for i in range(1, 7)]
    assert any((r + 1) * n[r] > r * n[r - 1] for r in range(1, 6))  # plain Turing gives no discount here
    one = n[0] / (n[0] + 2 * n[1])
    assert plain.dp[1] != pytest.approx(1 - one) and all(0 < x < 1 for x in plain.dp[1:])
    got = {r.doc_id: r.score for r in katz.report(documents(spark, rows)).collect()}
    assert got == pytest.approx({d: plain.row(d, t)[1][1] for d, t in rows}, rel=1e-9)
