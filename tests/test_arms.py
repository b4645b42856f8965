"""Phrases, hard negatives and pooled measures against plain Python."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sparkassay.operators import metrics, phrases, retrieval


@pytest.mark.parametrize("turn", [1_000_000, 8])
def test_phrases_wherever_they_stand(spark, turn):
    rng = random.Random(6)
    words = ["a", "b", "c", "가", "d e"]
    known = [list(p) for p in {tuple(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(25)}] + [[], ["unheard"]]
    docs = [(i, [rng.choice([*words, "x", ""]) for _ in range(rng.randint(0, 30))]) for i in range(120)] + [(900, None), (None, ["a", "b"])]
    frame = spark.createDataFrame([("|".join(p), p) for p in known], "phrase string, tokens array<string>")
    got = phrases.found(spark.createDataFrame(docs, "doc_id bigint, tokens array<string>").repartition(3), frame, turn).collect()
    want = {d: Counter("|".join(p) for p in known for i in range(len(t or [])) if p and (t or [])[i : i + len(p)] == p) for d, t in docs}
    assert {r.doc_id: Counter(r.found) for r in got} == want and len(got) == len(docs)


def test_negatives_do_not_hold_the_evidence(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    evidence = [(q, [rng.choice(words) for _ in range(rng.choice([0, 2, 5, 12, 30]))]) for q in range(20)]
    docs = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _, q in rng.sample(evidence, 4):
            t = t + q[: rng.choice([0, len(q) // 3, len(q) // 2, len(q)])]
        docs.append((i, t))
    hits = [(q, r, d) for q, _ in evidence for r, d in enumerate(rng.sample(range(60), 12), 1)]
    runs = lambda t: {tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} if t else set()
    text = dict(docs)
    holds = lambda q, d: bool(runs(dict(evidence)[q])) and len(runs(dict(evidence)[q]) & runs(text[d])) >= max(1, 0.5 * len(runs(dict(evidence)[q])))
    want, place = [], Counter()
    for q, r, d in hits:
        if not holds(q, d) and place[q] < 4:
            place[q] += 1
            want.append((q, place[q], d, r))
    assert sum(holds(q, d) for q, _, d in hits) > 5
    e, f = (spark.createDataFrame(x, s) for x, s in ((evidence, "question_id bigint, tokens array<string>"), (docs, "doc_id bigint, tokens array<string>")))
    got = retrieval.hard_negatives(spark.createDataFrame(hits, "question_id bigint, rank bigint, doc_id bigint"), e, f, 4).collect()
    assert sorted((r.question_id, r.rank, r.doc_id, r.rank_before) for r in got) == sorted(want)


def test_pools_judged_in_part(spark):
    rows = [("R", "a", "k", t, s, v) for t, s, v in [("1", "x", "Y"), ("1", "x", "N"), ("2", "x", "N"), ("2", "y", "N"), ("3", "x", None), ("3", "y", "U"), ("4", "y", "U"), ("4", "x", "N"), ("5", "z", None)]]
    (r,) = metrics.pooled(spark.createDataFrame(rows, "measure string, arm string, kind string, target string, stratum string, value string")).collect()
    # of stratum x a quarter of the judged are Y, of y none, of z nothing is known
    assert tuple(r) == ("R", "a", "k", 5, 1, 1, 1, 2, 0.2, 0.8, round((1 + 0.25) / 5, 6))


def test_strata_that_are_unsure_throughout(spark):
    rows = [("R", "a", "k", t, s, v) for t, s, v in [("1", "x", "U"), ("2", "x", None), ("3", "y", "Y"), ("4", "y", None), ("5", "z", "U")]]
    (r,) = metrics.pooled(spark.createDataFrame(rows, "measure string, arm string, kind string, target string, stratum string, value string")).collect()
    # of x and z nothing is known, of y all judged are Y
    assert tuple(r) == ("R", "a", "k", 5, 1, 0, 2, 2, 0.2, 1.0, 0.4)
