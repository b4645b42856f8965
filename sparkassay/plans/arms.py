"""Arms beside the lexical one, their pool, and measures from judgments of a part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators import blockmax, metrics, phrases, retrieval
from sparkassay.plans import base as b
from sparkassay.plans import corpus as c
from sparkassay.plans.base import query, table
from sparkassay.sources.shared import written

#: Phrases of a glossary and of an index of entities: runs of so many tokens of the questions, at every so many tokens.
GLOSSARY, ENTITIES = (2, 4), (3, 5)


def _sql_phrases(size: int, step: int) -> str:
    """BM25 over phrases as terms: ranked(question_id, rank, doc_id, score)."""
    runs = lambda table_, key: f"select {key}, array_to_string(t[i : i + {size - 1}], ' ') as term, i from (select {key}, t, unnest(range(1, len(t) - {size - 2})) as i from {table_})"
    return f"""
    corpus as (select doc_id, {b.sql_tokens("text")} as t from documents),
    questions as (select item_id as question_id, {b.sql_tokens("text")} as t from benchmark),
    phrases as (select distinct term from ({runs("questions", "question_id")}) where (i - 1) % {step} = 0),
    places as (select doc_id, term from ({runs("corpus", "doc_id")}) semi join phrases using (term)),
    lengths as (select doc_id, count(*) as dl from places group by doc_id),
    stats as (select (select count(*) from corpus) as n, (select count(*) from places) / (select count(*) from corpus)::double as avgdl),
    postings as (select doc_id, term, count(*) as tf from places group by all),
    dfs as (select term, count(*) as df from postings group by term),
    asked as (select question_id, term, count(*) as mult from ({runs("questions", "question_id")}) semi join phrases using (term) group by all),
    scored as (select question_id, doc_id, round(sum(mult * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * 2.5::double * tf / (tf + 1.5::double * (0.25::double + 0.75::double * dl / greatest(1.0::double, avgdl)))), 8) as score
        from asked join dfs using (term) join postings using (term) join lengths using (doc_id), stats group by all),
    ranked as (select question_id, rank, doc_id, score from (select *, row_number() over (partition by question_id order by score desc, doc_id) as rank from scored) where rank <= 5)"""


def _phrase_hits(spark: SparkSession, sf_dir: str, size: int, step: int) -> DataFrame:
    """Documents ranked by the phrases that they share with a question, each weighed by its rarity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("tokens"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), T.tokens("text").alias("tokens"))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("tokens") - size + 1)), lambda i: ((i - 1) % step == 0) & (i + size - 1 <= F.size("tokens")))
    known = written(asked.select(F.explode(F.transform(starts, lambda i: F.slice("tokens", i, F.lit(size)))).alias("tokens")).distinct().withColumn("phrase", F.array_join("tokens", " ")))
    mine = phrases.found(asked, known).select(F.col("doc_id").alias("question_id"), F.explode("found").alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("mult"))
    return blockmax.search(phrases.found(docs, known).select("doc_id", F.col("found").alias("tokens")), written(mine), 5)


@query(f"with {_sql_phrases(*GLOSSARY)} select * from ranked")
def glossary_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_hits(spark, sf_dir, *GLOSSARY)


@query(f"with {_sql_phrases(*ENTITIES)} select * from ranked")
def entity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_hits(spark, sf_dir, *ENTITIES)


#: Hits of a question among which its negatives are looked for.
NEAR = 20

_NEGATIVES = f"""{b.SQL_HITS.replace("rank <= 5", "rank <= 20")},
    item_tokens as (select item_id as question_id, {b.sql_tokens("text")} as t from benchmark),
    item_runs as (select distinct question_id, array_to_string(t[i : i + 4], ' ') as run from (select question_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) as i from item_tokens where len(t) > 0)),
    doc_tokens as (select doc_id, {b.sql_tokens("text")} as t from documents where doc_id in (select doc_id from hits)),
    doc_runs as (select distinct doc_id, array_to_string(t[i : i + 4], ' ') as run from (select doc_id, t, unnest(range(1, greatest(1, len(t) - 4) + 1)) as i from doc_tokens where len(t) > 0)),
    sizes as (select question_id, count(*) as n from item_runs group by question_id),
    holds as (select h.question_id, h.doc_id from hits h join item_runs i using (question_id) join doc_runs d on d.doc_id = h.doc_id and d.run = i.run join sizes s on s.question_id = h.question_id
        group by h.question_id, h.doc_id, s.n having count(*) >= greatest(1, ceil(s.n * 0.5))),
    negatives as (select question_id, place as rank, doc_id, rank as rank_before, sha256(concat_ws('|', 'evidence_absent', question_id, doc_id, rank)) as inspection_receipt
        from (select *, row_number() over (partition by question_id order by rank) as place from hits anti join holds using (question_id, doc_id)) where place <= 5)"""


@query(f"with {_NEGATIVES} select * from negatives")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hits of each question that hold less than half of its runs of five tokens."""
    return _negatives(spark, sf_dir, written(c.hits(spark, sf_dir, NEAR)))


def _negatives(spark: SparkSession, sf_dir: str, hits: DataFrame) -> DataFrame:
    evidence = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), T.tokens("text").alias("tokens"))
    # only texts that are hits are cut into tokens
    docs = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", T.tokens("text").alias("tokens"))
    return retrieval.hard_negatives(hits, evidence, docs)


_ARMS = ("lexical", "dense", "glossary", "hard_negative")


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, arm, rank, content_id) of four arms."""
    content = lambda x: F.concat(F.lit("doc:"), F.col(x).cast("string")).alias("content_id")
    near = written(c.hits(spark, sf_dir, NEAR))  # one search: its first five are the lexical arm
    arms = (near.filter("rank <= 5").withColumnRenamed("doc_id", "x"), c.dense_hits(spark, sf_dir).withColumnRenamed("vec_id", "x"), glossary_hits(spark, sf_dir).withColumnRenamed("doc_id", "x"), _negatives(spark, sf_dir, near).withColumnRenamed("doc_id", "x"))
    out = None
    for name, hits in zip(_ARMS, arms):
        rows = hits.select("question_id", F.lit(name).alias("arm"), "rank", content("x"))
        out = rows if out is None else out.unionByName(rows)
    return out


_KIND = b.KIND.replace("turn", "question_id")
#: Judged or not, and how, by a digest of what is judged.
_VALUE = "case when {d} < '66' then null when {d} < '9a' then 'Y' when {d} < 'e6' then 'N' else 'U' end"
_SQL_GLOSSARY = _sql_phrases(*GLOSSARY).replace("corpus", "texts").replace("read", "read_").replace("questions as", "asking as").replace("from questions", "from asking").replace("stats", "gstats").replace("postings", "gpostings").replace("dfs", "gdfs").replace("asked", "gasked").replace("scored", "gscored")
_SQL_POOLED = f"""
    lexical as (select question_id, rank, doc_id from hits where rank <= 5),
    cards as (
        select question_id, 'lexical' as arm, rank, concat('doc:', doc_id) as content_id from lexical union all select question_id, 'dense', rank, concat('doc:', vec_id) from dense
        union all select question_id, 'glossary', rank, concat('doc:', doc_id) from ranked union all select question_id, 'hard_negative', rank, concat('doc:', doc_id) from negatives
    ), judged as (
        select 'R@5' as measure, arm, {_KIND} as kind, cast(question_id as varchar) as target, concat(arm, '-', rank) as stratum, sha256(concat_ws('|', 'R', question_id, content_id)) as d from cards
        union all select 'C', 'pool', {_KIND}, cast(question_id as varchar), 'pool', sha256(concat_ws('|', 'R', question_id, content_id)) from (select distinct question_id, content_id from cards)
        union all select m, 'answer', {_KIND}, cast(question_id as varchar), {_KIND}, sha256(concat_ws('|', m, question_id, '')) from (select item_id as question_id, unnest(['A', 'G', 'X']) as m from benchmark)
    ), valued as (select *, {_VALUE.format(d="d")} as value from judged),
    rates as (select measure, stratum, coalesce(count(*) filter (value = 'Y') / nullif(count(*) filter (value in ('Y', 'N')), 0)::double, 0.0::double) as p from valued group by all),
    targets as (select measure, arm, kind, target, count(*) filter (value = 'Y') > 0 as yes, count(*) filter (value is null) > 0 as open_, count(*) filter (value = 'U') > 0 as unsure,
        exp(coalesce(sum(ln(greatest(1 - p, 1e-12::double))) filter (value is null or value = 'U'), 0)) as none_ from valued join rates using (measure, stratum) group by all),
    states as (select *, case when yes then 'yes' when open_ then 'unjudged' when unsure then 'unsure' else 'no' end as state, case when yes then 1.0::double when open_ or unsure then 1 - none_ else 0.0::double end as chance from targets)"""


@query(f"""
with {_NEGATIVES}, {c._DENSE_HITS}, {_SQL_GLOSSARY}, {_SQL_POOLED}
select measure, arm, kind, count(*) as targets, count(*) filter (state = 'yes') as yes, count(*) filter (state = 'no') as no, count(*) filter (state = 'unsure') as unsure, count(*) filter (state = 'unjudged') as unjudged,
    round(avg((state = 'yes')::int::double), 6) as lower, round(avg((state <> 'no')::int::double), 6) as upper, round(avg(chance), 6) as estimate from states group by all
""")
def pooled_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R@5 of each arm, C of their pool, and A, G and X of answers, by kind of question, from judgments of a part of the cards."""
    cards = written(_cards(spark, sf_dir))
    digest = lambda m, content: T.sha256(F.concat_ws("|", m, F.col("question_id").cast("string"), content))
    target = F.col("question_id").cast("string").alias("target")
    row = lambda df, m, arm, stratum, content: df.select(m.alias("measure"), arm.alias("arm"), F.expr(_KIND).alias("kind"), target, stratum.alias("stratum"), digest(F.when(m.isin("R@5", "C"), "R").otherwise(m), content).alias("d"))
    found = row(cards, F.lit("R@5"), F.col("arm"), F.concat_ws("-", "arm", F.col("rank").cast("string")), F.col("content_id"))
    pool = row(cards.select("question_id", "content_id").distinct(), F.lit("C"), F.lit("pool"), F.lit("pool"), F.col("content_id"))
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.explode(F.array(*map(F.lit, "AGX"))).alias("m"))
    rest = row(answers, F.col("m"), F.lit("answer"), F.expr(_KIND), F.lit(""))
    return metrics.pooled(found.unionByName(pool).unionByName(rest).withColumn("value", F.expr(_VALUE.format(d="d"))).drop("d"))
