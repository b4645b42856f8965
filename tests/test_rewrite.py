"""Variants: goldens, a plain model on random scripts, and the term map's rules."""

from __future__ import annotations

import copy
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkassay.functions import rewrite, terms
from sparkassay.operators import termmap



@pytest.fixture(scope="module")
def shipped(spark):
    return termmap.load(spark, terms.PAYLOAD, allow_unapproved=True)


def run(spark, texts, *cols):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *cols).orderBy("i").collect()
    return [r[1] for r in rows]


def model(text, mapping):
    """Left to right, longest term first, at boundaries of its own script."""
    hangul = lambda c: "가" <= c <= "힣"
    word = lambda c: c.isascii() and c.isalnum()
    ordered = sorted(mapping, key=len, reverse=True)
    particles = sorted(rewrite.PARTICLES, key=len, reverse=True)
    out, i, hits = "", 0, 0
    while i < len(text):
        for term in [t for t in ordered if any(map(hangul, t))] + [t for t in ordered if not any(map(hangul, t))]:
            if text[i : i + len(term)].lower() != term:
                continue
            korean, end = any(map(hangul, term)), i + len(term)
            if korean and not (i and hangul(text[i - 1])):
                tail = next((p for p in [*particles, ""] if text.startswith(p, end) and not (end + len(p) < len(text) and hangul(text[end + len(p)]))), None)
            elif not korean and not (i and word(text[i - 1])) and not (end < len(text) and word(text[end])):
                tail = ""
            else:
                tail = None
            if tail is not None:
                out, i, hits = out + mapping[term] + tail, end + len(tail), hits + 1
                break
        else:
            out, i = out + text[i], i + 1
    fused = lambda t: bool(re.search("[가-힣][A-Za-z]", t)) or any(r not in rewrite.PARTICLES for r in re.findall("[A-Za-z0-9]([가-힣]+)", t))
    return out if hits and out != text and not (fused(out) and not fused(text)) else None


def test_goldens(spark, shipped):
    got = run(spark, ["내성 굴림 규칙"], F.expr("1").alias("x")) and run(spark, [" 내성 굴림 규칙 "], rewrite.variants(F.col("t"), shipped).alias("v"))[0]
    assert [(v.transform_id, v.text) for v in got] == [("spacing.join_all", "내성굴림규칙"), ("spacing.pad", "내성  굴림  규칙"), ("mixed.ko_to_en", "saving throw 규칙"), ("abbreviation.apply", "내성 규칙"), ("compound.ko_to_en_join", "savingthrow규칙")]
    assert run(spark, ["", "x"], F.size(rewrite.variants(F.col("t"), shipped)).alias("n")) == [0, 0]


@pytest.mark.parametrize("name", ["ko_to_en", "en_to_ko", "to_abbreviation"])
def test_replacement_against_model(spark, shipped, name):
    rng = random.Random(name)
    mapping = getattr(shipped, name)
    parts = [*mapping, *rewrite.PARTICLES[:12], " ", " ", "망상", "x", "3", "Roll", ".", "AC"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(1500)]
    texts = [t.upper() if rng.random() < 0.2 else t for t in texts]
    assert run(spark, texts, rewrite.replace_terms(F.col("t"), mapping).alias("x")) == [model(t, mapping) for t in texts]


def test_rows_inherit_and_expand(spark, shipped):
    rows = spark.createDataFrame([("q1", "natural", "긴 휴식 규칙", 7), ("q2", "paraphrase", " kept as it is", 8), ("q3", None, "x", 9)], "question_id string, query_kind string, query string, more int")
    got = rewrite.expand(rows, shipped).collect()
    ids = {r.question_id: r for r in got}
    assert ids["q2"].query == " kept as it is" and ids["q1::mixed.ko_to_en"].query == "long rest 규칙" and ids["q1::mixed.ko_to_en"].more == 7
    assert ids["q1"].transform_id == "natural.source" and ids["q3"].query_kind == "natural" and len(got) == len(ids)


def broken(**change):
    payload = copy.deepcopy(terms.PAYLOAD) | {"status": "approved"}
    entry = payload["entries"][0]
    for k, v in change.items():
        if k in payload:
            payload[k] = v
        else:
            entry[k] = v
    return payload


@pytest.mark.parametrize("change", [{"status": "draft"}, {"entries": []}, {"entries": "x"}, {"entries": [1]}, {"ko": " "}, {"en": None}, {"en": "내성 굴림"}, {"ko_aliases": "x"}, {"ko_aliases": ["능력치"]}, {"abbreviation": " "}])
def test_map_errors(spark, change):
    with pytest.raises(termmap.TermMapError):
        termmap.load(spark, broken(**change))


def test_map_content(spark):
    made = termmap.load(spark, broken())
    assert made.en_to_ko["saving throw"] == "내성 굴림" and made.ko_to_en["내성굴림"] == "saving throw" and "피해" not in made.ko_to_en
    assert made.to_abbreviation["armour class"] == "AC" and "ac" not in made.to_abbreviation
    assert "피해" in termmap.load(spark, broken(), include_generic_risk=True).ko_to_en
    with pytest.raises(termmap.TermMapError):
        termmap.load(spark, {k: v for k, v in broken().items() if k != "domain"})


def test_overlap(spark):
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "term string")
    r = rewrite.glossary_overlap(frame(["A", "b", "c", "b"]), frame([" a", "C", ""])).first()
    assert tuple(r) == (3, 2, 0.6667, False, "a,c")
