"""Text functions against plain Python on mixed scripts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sparkassay.functions import text as T

ALPHABET = list("aZbQ9 3._/-\n\t\u000b\u001c\u0085 　") + ["가", "힣", "é", "😀", "&", "<"]


def samples(n=400):
    rng = random.Random(11)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def column(spark, texts, *cols):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *cols).orderBy("i").collect()
    return [tuple(r)[1:] for r in rows]


def model_tokens(text):
    """A hand-written scanner of the token rules."""
    out, i = [], 0
    spaced = ""
    for j, ch in enumerate(text):
        if j and "A" <= ch <= "Z" and (text[j - 1].isascii() and (text[j - 1].islower() or text[j - 1].isdigit())):
            spaced += " "
        spaced += ch
    latin = lambda c: c.isascii() and c.isalpha()
    while i < len(spaced):
        j = i
        if "가" <= spaced[i] <= "힣":
            while j < len(spaced) and "가" <= spaced[j] <= "힣":
                j += 1
        elif latin(spaced[i]):
            while j < len(spaced) and latin(spaced[j]):
                j += 1
            while j + 1 < len(spaced) and spaced[j] in "._/-" and spaced[j + 1].isascii() and spaced[j + 1].isalnum():
                j += 1
                while j < len(spaced) and spaced[j].isascii() and spaced[j].isalnum():
                    j += 1
        elif spaced[i].isdecimal():
            while j < len(spaced) and spaced[j].isdecimal():
                j += 1
            if j + 1 < len(spaced) and spaced[j] == "." and spaced[j + 1].isdecimal():
                j += 1
                while j < len(spaced) and spaced[j].isdecimal():
                    j += 1
        else:
            i += 1
            continue
        out.append(spaced[i:j].lower())
        i = j
    return out


def test_tokens(spark):
    texts = [*samples(), "BG3", "bg3Game", "foo-bar2", "3.5.1", "DX11과", "été"]
    got = column(spark, texts, T.tokens("t").alias("x"))
    assert [g[0] for g in got] == [model_tokens(t) for t in texts]


def test_white_space(spark):
    texts = samples()
    got = column(spark, texts, T.excerpt("t", 9).alias("a"), T.joined_key("t").alias("b"), T.collapse_ends("t").alias("c"))
    for text, (short, key, ends) in zip(texts, got):
        assert short == " ".join(text.split())[:9].rstrip() and key == "".join(text.split()).lower() and ends == text.strip()


def test_escape_and_ids(spark):
    ((a, b),) = column(spark, ["<a & b>"], T.escape("t").alias("a"), T.content_id(F.lit(1), F.lit(2), F.lit("x")).alias("b"))
    assert (a, b) == ("&lt;a &amp; b&gt;", "doc:1:chunk:2:sha256:x")


def test_urls_and_times(spark):
    urls = ["https://User@A.Example:8/x", "HTTP://[::1]/", "http://localhost:1", "ftp://x", "nothing", "https:///x", "http://127.0.0.1.evil/"]
    got = column(spark, urls, T.host("t").alias("h"), T.is_https("t").alias("s"), T.is_loopback("t").alias("l"))
    assert got == [("a.example", True, False), ("::1", False, True), ("localhost", False, True), ("x", False, False), ("", False, False), ("", False, False), ("127.0.0.1.evil", False, False)]
    times = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+09:00", "2024-01-01T00:00:00", "2024-13-01T00:00:00Z", "x"]
    assert [x for (x,) in column(spark, times, T.has_zone("t").alias("z"))] == [True, True, False, False, False]


def model_focused(text, terms, limit):
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\s*==+\s*", " ".join(text.split())) if p.strip()]
    used, taken = 0, []
    for i in sorted(range(len(parts)), key=lambda i: (-sum(t in parts[i].lower() for t in terms), i)):
        if used >= limit * 0.8:
            break
        if used + len(parts[i]) <= limit:
            taken.append(i)
            used += len(parts[i]) + 5
    return " […] ".join(parts[i] for i in sorted(taken))[:limit].rstrip()


def test_focused(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "d", "9", "== See ==", "end."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + rng.choice([".", "!", ""]) for _ in range(80)]
    terms = ["alpha", "gamma", "9"]
    got = column(spark, texts, T.focused("t", F.array(*map(F.lit, terms)), 100).alias("x"))
    assert [g[0] for g in got] == [model_focused(t, terms, 100) for t in texts]
    assert column(spark, ["Alpha a 9 alpha BB 12"], T.query_terms("t").alias("x")) == [(["alpha", "9", "bb", "12"],)]


def test_casefold_of_every_character(spark):
    import unicodedata

    known = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    # a lower-case form that only a later edition of Unicode has is not one that Python knows
    later = {c for c in known if c.lower() == c == c.casefold() and c.upper() == c}
    texts = [c + "a" + c for c in known if c not in later] + ["Straße", "STRASSE", "ΟΔΟΣ", "ﬃ x ŉ", "", None]
    got = column(spark, texts, T.casefold("t").alias("x"))
    assert [g[0] for g in got] == [t if t is None else t.casefold() for t in texts]


def test_every_fold_is_found_by_a_class_that_is_fast_to_test(spark):
    """Each character that folding changes, between others; ranges beyond Latin-1 are behind one test."""
    odd = sorted(T.folds())
    texts = ["".join(f"a{c}é" for c in odd[i : i + 7]) for i in range(0, len(odd), 7)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.casefold("t").alias("k"))
    assert [r.k for r in df.collect()] == [r.t.casefold() for r in df.collect()]
    assert "&&[" in str(T.casefold("t"))
