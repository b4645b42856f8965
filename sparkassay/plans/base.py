"""The tables in the roles that the operators need, for Spark and for DuckDB."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- expressions of DuckDB --------------------------------------------------------------------

#: Unicode white space for RE2.
WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def sql_tokens(x: str) -> str:
    return rf"[lower(t) for t in regexp_extract_all(regexp_replace({x}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[\x{{AC00}}-\x{{D7A3}}]+|[A-Za-z]+(?:[._/-][A-Za-z0-9]+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)?')]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


#: Full case folding as a table of its own: characters that become one other, and those that become several.
_FOLD = {c: f for c in map(chr, range(sys.maxunicode + 1)) if (f := c.casefold()) != c}
_ONE = {c: f for c, f in _FOLD.items() if len(f) == 1}
_SEVERAL = {c: f for c, f in _FOLD.items() if len(f) > 1}


def sql_casefold(x: str) -> str:
    out = f"translate({x}, '{''.join(_ONE)}', '{''.join(_ONE.values())}')"
    for c, f in _SEVERAL.items():
        out = f"replace({out}, '{c}', '{f}')"
    return out


def sql_key(x: str) -> str:
    return sql_casefold(f"regexp_replace({x}, '{WS}+', '', 'g')")


def sql_host(x: str) -> str:
    return rf"lower(regexp_replace(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)', 1), '[\[\]]', '', 'g'))"


# -- roles -----------------------------------------------------------------------------------------
# Expressions that both engines read alike; {sha} is the digest function.

URL = "concat('https://', source, '.example/', cast(doc_id as {text}))"
EVENT_VALUE = "case when value < 5 then 'N' when value < 10 then 'U' else 'Y' end"
EVENT_ACTION = "case when event_type = 'error' then 'undo' else 'label' end"
KIND = "case turn % 4 when 0 then 'natural' when 1 then 'mixed' when 2 then 'spacing_abbreviation' else 'paraphrase' end"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: title := source, body := text."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id as chunk_id", "doc_id as document_id", "0 as chunk_number", "source as title", "text as body", f"{URL.format(text='string')} as source_url", "sha2(text, 256) as content_hash")


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the chunks' documents."""
    return table(spark, sf_dir, "labels").selectExpr("doc_id as document_id", "'2024-01-01T00:00:00Z' as retrieved_at", "case when toxic = 1 then '2024-02-02T00:00:00Z' end as modified_at", "case when quality = 1 then 'CC-BY' else 'unknown' end as license_url")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, title, body, source_url) of documents of 120 characters or more."""
    return table(spark, sf_dir, "documents").filter("length(text) >= 120").selectExpr("doc_id", "concat(source, ' ', text) as text", "source as title", "text as body", f"{URL.format(text='string')} as source_url")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as questions."""
    return table(spark, sf_dir, "benchmark").selectExpr("item_id as question_id", "text as query", "text")


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as fixtures: a conversation is a cluster, a turn a question."""
    return table(spark, sf_dir, "conversations").selectExpr("concat('q', cast(conv_id as string), '-', cast(turn as string)) as question_id", "concat('f', cast(conv_id as string)) as fact_cluster_id", "conv_id * 1000 + turn as pos", "text as query", f"{KIND} as query_kind", "conv_id", "turn", "role")


SQL_CORPUS = f"select doc_id, concat(source, ' ', text) as text, source as title, text as body, {URL.format(text='varchar')} as source_url from documents where length(text) >= 120"
SQL_FIXTURES = f"select concat('q', cast(conv_id as varchar), '-', cast(turn as varchar)) as question_id, concat('f', cast(conv_id as varchar)) as fact_cluster_id, conv_id * 1000 + turn as pos, text as query, {KIND} as query_kind, conv_id, turn, role from conversations"
SQL_EVENTS = f"select event_id as seq, cast(user_id as varchar) as question_id, 'query_natural' as target_type, cast(user_id as varchar) as target_id, {EVENT_ACTION} as action, {EVENT_VALUE} as value from events"


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as review events: an error undoes, anything else labels."""
    return table(spark, sf_dir, "events").selectExpr("event_id as seq", "cast(user_id as string) as question_id", "'query_natural' as target_type", "cast(user_id as string) as target_id", f"{EVENT_ACTION} as action", f"{EVENT_VALUE} as value")


#: BM25 over the corpus: hits(question_id, rank, doc_id, score).
SQL_HITS = f"""
    corpus as ({SQL_CORPUS}),
    read as (select doc_id, {sql_tokens("text")} as tokens from corpus),
    stats as (select count(*) as n, avg(len(tokens)) as avgdl from read),
    postings as (select doc_id, term, count(*) as tf, any_value(dl) as dl from (select doc_id, len(tokens) as dl, unnest(tokens) as term from read) group by doc_id, term),
    dfs as (select term, count(*) as df from postings group by term),
    asked as (select question_id, term, count(*) as mult from (select item_id as question_id, unnest({sql_tokens("text")}) as term from benchmark) group by question_id, term),
    scored as (
        select a.question_id, p.doc_id, round(sum(a.mult * ln(1 + (s.n - d.df + 0.5::double) / (d.df + 0.5::double)) * 2.5::double * p.tf / (p.tf + 1.5::double * (1 - 0.75::double + 0.75::double * p.dl / greatest(1.0::double, s.avgdl)))), 8) as score
        from asked a join dfs d on a.term = d.term join postings p on p.term = a.term cross join stats s group by a.question_id, p.doc_id
    ),
    hits as (select question_id, rank, doc_id, score from (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from scored where score <> 0) where rank <= 5)
"""
