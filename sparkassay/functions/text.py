"""Text columns: tokens, normalised keys, digests, excerpts, escapes.  Built-in expressions only."""

from __future__ import annotations

import functools
import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four information separators.
WS = r"[\s\x1c-\x1f\u0085\p{Z}]"
#: A Hangul run, a Latin word with . _ / - joins, or a number with one decimal part.
TOKEN = r"[가-힣]+|[A-Za-z]+(?:[._/-][A-Za-z0-9]+)*|\p{Nd}+(?:\.\p{Nd}+)?"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


@functools.lru_cache
def folds() -> dict[str, str]:
    """Lower-case characters that full case folding still changes, and what they become: one character or more."""
    return {c: f for c in map(chr, range(0x80, sys.maxunicode + 1)) if c.lower() == c and (f := c.casefold()) != c}


def casefold(text: str | Column) -> Column:
    """Full case folding, which may lengthen a text: ß and SS are alike, as are all three sigmas."""
    low, table = F.lower(_col(text)), folds()
    codes = sorted(map(ord, table))
    firsts = [c for c in codes if c - 1 not in codes]
    ranges = [f"{chr(a)}-{chr(z)}" for a, z in zip(firsts, (c for c in codes if c + 1 not in codes))]
    latin, others = ("".join(r for r in ranges if (r < "\u0100") == low_) for low_ in (True, False))
    odd = rf"[{latin}[\x{{100}}-\x{{10ffff}}&&[{others}]]]"  # the many ranges are gone through only for what lies beyond Latin-1
    names = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    new = F.transform(F.regexp_extract_all(low, F.lit(odd), F.lit(0)), lambda c: F.try_element_at(names, c))
    folded = F.array_join(F.zip_with(F.split(low, odd, -1), new, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")
    return F.when(low.rlike(odd), folded).otherwise(low)


def tokens(text: str | Column) -> Column:
    """Lower-cased tokens, with camel case taken apart."""
    apart = F.regexp_replace(_col(text), r"(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.transform(F.regexp_extract_all(apart, F.lit(TOKEN), F.lit(0)), F.lower)


def collapse(text: str | Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(_col(text), f"{WS}+", " "))


def bounded(text: str | Column, limit: int = 1800) -> Column:
    return F.substring(collapse(text), 1, limit)


def excerpt(text: str | Column, limit: int = 360) -> Column:
    return F.rtrim(bounded(text, limit))


def joined_key(text: str | Column) -> Column:
    """Without any white space, case folded."""
    return casefold(F.regexp_replace(_col(text), f"{WS}+", ""))


def collapsed_digest(text: str | Column) -> Column:
    return F.sha2(casefold(collapse(text)), 256)


def sha256(text: str | Column) -> Column:
    return F.sha2(_col(text).cast("binary"), 256)


def is_sha256(x: str | Column) -> Column:
    return F.coalesce(_col(x).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def content_id(document: Column, chunk: Column, digest: Column) -> Column:
    return F.concat(F.lit("doc:"), document.cast("string"), F.lit(":chunk:"), chunk.cast("string"), F.lit(":sha256:"), digest)


def escape(x: str | Column) -> Column:
    """The three characters that HTML text needs escaped."""
    x = _col(x).cast("string")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def tail(text: str | Column, n: int = 1000) -> Column:
    return F.right(_col(text), F.lit(n))


def canary(fingerprint: str | Column) -> Column:
    return F.concat(F.lit("REFERENCE_CANARY_"), F.substring(_col(fingerprint), 1, 24))


def host(url: str | Column) -> Column:
    """Lower-cased host without user, port or IPv6 brackets; empty if there is none."""
    raw = F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1)
    return F.lower(F.regexp_replace(raw, r"[\[\]]", ""))


def is_https(url: str | Column) -> Column:
    return F.coalesce(_col(url).rlike("^(?i)https://[^/?#]+"), F.lit(False))


def is_loopback(url: str | Column) -> Column:
    return F.coalesce(_col(url).rlike("^(?i)http://"), F.lit(False)) & host(url).isin("127.0.0.1", "localhost", "::1")


def has_zone(time: str | Column) -> Column:
    """An ISO-8601 time that names its zone."""
    t = _col(time)
    return F.coalesce(t.rlike(r"(Z|[+-]\d\d:?\d\d(:?\d\d)?)\z") & F.try_to_timestamp(t).isNotNull(), F.lit(False))


def sentences(text: str | Column) -> Column:
    """Parts of a collapsed text at sentence ends and section marks, without blank ones."""
    return F.filter(F.split(collapse(text), r"(?<=[.!?])\s+|\s*==+\s*", -1), lambda x: F.trim(x) != "")


def query_terms(question: str | Column) -> Column:
    """Distinct Latin words and digits of a question: longer than one character, or a digit."""
    words = F.transform(F.regexp_extract_all(_col(question), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$")))


def focused(text: str | Column, terms: Column, limit: int = 3000) -> Column:
    """The parts of a text that hold most terms, in their own order, within a budget of characters.

    Parts are taken by matched terms, then by place; one that does not fit is passed over, and taking
    ends once four fifths of the budget are used.
    """
    parts = sentences(text)
    ranked = F.array_sort(F.transform(parts, lambda p, i: F.struct((-F.size(F.filter(terms, lambda t: F.contains(F.lower(p), t)))).alias("score"), i.alias("place"), p.alias("part"))))
    start = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<struct<place:int,part:string>>)").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        size = F.length(x["part"])
        fits = (acc["used"] * 5 < F.lit(limit * 4)) & (acc["used"] + size <= limit)
        more = F.struct((acc["used"] + size + 5).alias("used"), F.concat(acc["taken"], F.array(F.struct(x["place"].alias("place"), x["part"].alias("part")))).alias("taken"))
        return F.when(fits, more).otherwise(acc)

    taken = F.aggregate(ranked, start, step, lambda acc: F.array_sort(acc["taken"]))
    return F.rtrim(F.substring(F.array_join(F.transform(taken, lambda x: x["part"]), " […] "), 1, limit))


def collapse_ends(text: str | Column) -> Column:
    """Without white space at the ends; inside, text stays as it is."""
    return F.regexp_replace(_col(text), rf"\A{WS}+|{WS}+\z", "")


def request_key(api: str | Column, parameters: dict[str, Column]) -> Column:
    """The cache key of a request: the digest of its address with parameters in the order of their names."""
    pairs = [F.concat(F.lit(f"{k}="), F.url_encode(parameters[k].cast("string"))) for k in sorted(parameters)]
    return sha256(F.concat(_col(api), F.lit("?"), F.concat_ws("&", *pairs)))
