"""Registered queries on made tables that the given ones do not cover."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from sparkassay.plans import arms, corpus
from tests.test_queries import TABLES, duck, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize(("size", "keys"), [(256, 10_000), (2, 0)])
def test_sources_of_any_question(spark, tmp_path, monkeypatch, size, keys):
    """Questions of one word, without spaces, that start or end inside a word, empty and null ones."""
    monkeypatch.setattr(corpus, "HEADS", size)
    monkeypatch.setattr(corpus, "KEYS", keys)
    pad = " lorem ipsum dolor sit amet" * 6
    texts = ["Romance", "二十一世纪的问题没有空格" * 8, "supercalifragilistic" * 5, "three word item", "one two three four five six seven", "tail of a word and head of an", "", None, "nowhere at all", "two words"]
    docs = [(i, f"before {t} after {i}{pad}", "en" if i % 2 else "de", "s") for i, t in enumerate(texts[:6] * 2)] + [(90, "unRomanced" + pad, "en", "s"), (91, None, "en", "s"), (92, "cocktail of a word and head of another" + pad, "en", "s"), (93, "xtwo wordsx" + pad, "de", "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = plain(con.execute(entry.oracle_sql()["source_hit_at_k"]).df())
    assert plain(entry.queries()["source_hit_at_k"](spark, str(tmp_path)).toPandas()) == want


def test_peaks_gather_nothing(spark):
    assert "collect_list" not in entry.queries()["peaks"](spark, TABLES)._jdf.queryExecution().toString()


def test_pooled_arms_share_one_lexical_search(spark, monkeypatch):
    asked = []
    hits = corpus.hits
    monkeypatch.setattr(corpus, "hits", lambda *a: asked.append(a[2:]) or hits(*a))
    arms._cards(spark, TABLES)
    assert asked == [(20,)]


def test_pooled_measures_of_few_cards(spark, tmp_path):
    """One question, whose strata hold a card each: some have an unsure one and nothing else."""
    texts = ["one two three four five six seven eight", "one two three four and more of it", "seven eight or six five", "two three in a row", "nothing alike", "four five six seven eight nine ten"]
    pad = " lorem ipsum dolor sit amet" * 6
    spark.createDataFrame([(i, t + pad, "en", "s") for i, t in enumerate(texts * 4)], "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, texts[0])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i % 5), 1.0, float(i)]) for i in range(12)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = plain(con.execute(entry.oracle_sql()["pooled_measures"]).df())
    assert plain(entry.queries()["pooled_measures"](spark, str(tmp_path)).toPandas()) == want
