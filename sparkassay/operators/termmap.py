"""Term maps as tables: an entry is a row of JSON, what is wrong with it a rule, the lookups an aggregate of surfaces.

A surface is a name that a text may have: an entry's own Korean name (place 0) or an alias.  All comparison is by full case folding.
Generic words stay out unless asked for, before their aliases and abbreviations are looked at.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.functions.rewrite import TermMap
from sparkassay.operators.contracts import Json


class TermMapError(ValueError):
    """A term map that cannot be used."""


def entries(rows: DataFrame, include_generic_risk: bool = False) -> DataFrame:
    """(pos, ko, en, aliases, abbreviation, risk, violation) of rows (pos, entry as JSON text); risk: left out as a generic word."""
    j = Json(rows, "entry", ["ko", "en", "ko_aliases", "abbreviation", "generic_risk"])
    clean = lambda k: T.collapse_ends(F.coalesce(j.text(k), F.lit("")))
    named = lambda k: (j.kind(k) == "STRING") & (clean(k) != "")
    risk = F.lit(not include_generic_risk) & (j.kind("generic_risk") == "BOOLEAN") & (j.text("generic_risk") == "true")
    aliases = F.transform(F.try_variant_get("__value", "$.ko_aliases", "array<variant>"), lambda v: T.collapse_ends(F.try_variant_get(v, "$", "string")))
    short = F.when(j.kind("abbreviation") != "VOID", clean("abbreviation"))
    rules = [
        ("not_an_object", j.keys.isNull()),
        ("ko", ~named("ko")),
        ("en", ~named("en")),
        ("maps_to_itself", T.casefold(clean("ko")) == T.casefold(clean("en"))),
        ("aliases", ~risk & j.has("ko_aliases") & ~j.kind("ko_aliases").startswith("ARRAY")),
        ("abbreviation", ~risk & (short == "")),
    ]
    j.df = j.df.withColumns({"ko": clean("ko"), "en": clean("en"), "aliases": F.coalesce(aliases, F.array().cast("array<string>")), "abbreviation": short, "risk": risk})
    return j.judged(rules).select("pos", "ko", "en", "aliases", "abbreviation", "risk", "violation")


def surfaces(judged: DataFrame) -> DataFrame:
    """(pos, place, surface, key, en, abbreviation) of the entries that count."""
    sound = judged.filter("violation is null and not risk")
    named = sound.select("pos", "en", "abbreviation", F.posexplode(F.concat(F.array("ko"), "aliases")).alias("place", "surface"))
    return named.filter("surface <> ''").withColumn("key", T.casefold("surface"))


def repeated(judged: DataFrame) -> DataFrame:
    """(key, uses) of the surfaces that stand more than once."""
    return surfaces(judged).groupBy("key").agg(F.count("*").alias("uses")).filter("uses > 1")


def lookups(judged: DataFrame) -> DataFrame:
    """(direction, key, value): what each surface is replaced by.  The first of two names stays, of two abbreviations the last."""
    s = surfaces(judged)
    own, en = F.col("place") == 0, T.casefold("en")
    short = lambda key: F.when(key != T.casefold("abbreviation"), key)
    names = ("direction", "key", "value", "first", "then")
    turn = lambda *parts: F.struct(*(p.cast("bigint" if n in names[3:] else "string").alias(n) for n, p in zip(names, parts)))
    pos, place, key = (F.col(c) for c in ("pos", "place", "key"))
    turns = F.array(
        turn(F.lit("ko_to_en"), key, F.col("en"), pos, place),
        turn(F.lit("en_to_ko"), F.when(own, en), F.col("surface"), pos, place),
        turn(F.lit("to_abbreviation"), short(key), F.col("abbreviation"), -pos, place),
        turn(F.lit("to_abbreviation"), F.when(own, short(en)), F.col("abbreviation"), -pos, place),
    )
    each = s.select(F.explode(turns).alias("t")).select("t.*").filter("key is not null and value is not null")
    return each.groupBy("direction", "key").agg(F.min_by("value", F.struct("first", "then")).alias("value"))


def load(spark: SparkSession, payload: dict, allow_unapproved: bool = False, include_generic_risk: bool = False) -> TermMap:
    """A term map given by hand, checked, as what the rewriting takes; its first fault is an error."""
    whole = Json(spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "raw string"), "raw", ["version", "domain", "status", "entries"])
    rules = [(f"{k} is missing", ~whole.has(k)) for k in ("version", "domain", "status", "entries")]
    rules += [("there are no entries", ~whole.kind("entries").startswith("ARRAY") | whole.text("entries").isin("[]", "")), ("the status is not approved", F.lit(not allow_unapproved) & (whole.text("status") != "approved"))]
    rows = whole.df.select(F.posexplode_outer(F.try_variant_get("__value", "$.entries", "array<variant>")).alias("pos", "e")).select("pos", F.to_json("e").alias("entry"))
    fault = whole.judged(rules).first().violation
    judged = entries(rows, include_generic_risk)
    if fault is None:
        wrong = judged.filter("violation is not null").orderBy("pos").first()
        again = repeated(judged).orderBy("key").first() if wrong is None else None
        fault = f"entry {wrong.pos}: {wrong.violation}" if wrong else f"'{again.key}' stands {again.uses} times" if again else None
    if fault is not None:
        raise TermMapError(fault)
    made: dict[str, dict[str, str]] = {"ko_to_en": {}, "en_to_ko": {}, "to_abbreviation": {}}
    for r in lookups(judged).collect():  # as many as were given by hand
        made[r.direction][r.key] = r.value
    return TermMap(str(payload["version"]), str(payload["status"]), **made)
