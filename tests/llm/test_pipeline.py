"""The pipeline's stages against brute-force versions of each, one after the other."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from sparkassay.llm.registry import tokenizer_path
from tests.llm import test_decontam, test_linededup, test_nearcopies, test_packing

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def tables(spark, path):
    rng = random.Random(8)
    stems = {"en": ["the", "and", "tion", "whe", "ould"], "de": ["ungen", "sch", "keit", "über", "nicht"]}
    sentence = lambda lang, n: " ".join("".join(rng.choice(stems[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    shared = [sentence("en", 12) for _ in range(6)]
    items = [(i, sentence("en", rng.choice([5, 14, 25]))) for i in range(12)]
    rows = []
    for i in range(160):
        lang = rng.choice(["en", "de"])
        lines = [sentence(lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if rng.random() < 0.2:
            lines.insert(0, rng.choice(items)[1])
        text = "\n".join(lines)
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1] or ""
            text = text + " one more" if rng.random() < 0.5 else text
        rows.append((i, text, lang if rng.random() < 0.9 else None))
    rows += [(900, None, "en"), (901, "", "en"), (902, "123 456 ...", "en"), (903, "the and " * 3000, "en")]
    spark.createDataFrame([(d, t, x, f"s{d % 3}", len(t or "")) for d, t, x in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return [(d, t) for d, t, _ in rows], items


def lines_kept(rows):
    """Texts after removal of shared lines; the digests are checked on the way."""
    holders = {}
    key = lambda line: line.strip(test_linededup.BLANK).translate(test_linededup.FOLD)
    for d, t in rows:
        for line in set(map(key, t.split("\n"))):
            holders.setdefault(line, []).append(d)
    gone = lambda d, line: len(key(line)) >= 40 and len(holders[key(line)]) >= 5 and max(holders[key(line)]) != d
    return [(d, "\n".join(x for x in t.split("\n") if not gone(d, x))) for d, t in rows]


def test_stages_and_rows(spark, tmp_path):
    rows, items = tables(spark, str(tmp_path))
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]
    rows = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    rows = lines_kept(rows)
    before, rows = len(rows), test_nearcopies.kept(rows)
    one = {d for d, _ in rows}
    assert len(rows) < before
    bad = {r[0] for r in test_decontam.brute(rows, items) if r[-1]}
    rows = [(d, t) for d, t in rows if d not in bad]
    assert bad and len(one) < 160
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(test_packing.expected(rows, 2048))


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert tokenizer_path()


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, digest string, `a``b` int, score string, `c0` int, __hits int, contaminated string, `x.y` int, Lang_Pred string, lost int, kept_text string"


def odd(spark, rows):
    return spark.createDataFrame([(d, t, x, "s", len(t or ""), 1, "d", 2, "s", 3, 4, "c", 5, "l", 6, "k") for d, t, x in rows], ODD)


def test_odd_columns_and_rows(spark, tmp_path):
    """Names that clash, null ids and texts, repeated rows and a very long text, through every stage."""
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["the", "and", "tion", "whe", "ould", "ing"]) + str(rng.randint(0, 99)) for _ in range(n))
    rows = [(i, text(30), "en") for i in range(40)]
    rows += [(None, text(30), "en"), (None, None, None), rows[3], rows[3], (50, "the " * 200_000, "en"), (51, None, "en"), (52, "", None), (53, rows[4][1], "en")]
    path = str(tmp_path)
    odd(spark, rows).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, rows[9][1]), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == odd(spark, []).columns
        assert {tuple(r)[5:] for r in docs.collect()} == {(1, "d", 2, "s", 3, 4, "c", 5, "l", 6, "k")}
    left = [r.doc_id for r in docs.collect()]
    assert sorted(left, key=lambda d: -1 if d is None else d) == [None, *sorted([*range(9), *range(10, 40), 3, 3, 50])]
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(left)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    odd(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_names_that_differ_in_case_only(spark, tmp_path):
    """Exact names come first; others, whatever their case, are columns like any other."""
    from sparkassay.llm import decontam, langid, licences, linededup, packing

    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "and", "tion", "whe", "ould", "ing"]) + str(rng.randint(0, 99)) for _ in range(20))
    rows = [("no", i, text(), "xx", "en", None) for i in range(30)]
    docs = spark.createDataFrame(rows, "TEXT string, doc_id bigint, text string, Doc_Id string, lang string, LANG string")
    items = spark.createDataFrame([(1, "other", rows[3][2])], "item_id bigint, TEXT string, text string")
    assert {r[0] for r in linededup.report(docs).collect()} == set(range(30))
    assert {r.lang_pred for r in langid.report(docs).collect()} == {"en"}
    assert licences.report(docs).count() == packing.pack(docs, tokenizer_path()).count() == 30
    assert {r.doc_id for r in decontam.report(docs, items).collect() if r.contaminated} == {3}
    assert linededup.dedup(docs).columns[:6] == docs.columns
    held = docs
    spark.createDataFrame([(1, rows[3][2])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = stage(spark, held, str(tmp_path))
        assert held.columns == docs.columns
    assert held.toDF("a", "b", "c", "d", "e", "f").select("b").distinct().count() == 29
