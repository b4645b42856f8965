"""Soak measures, variants, references, reports, streams, files."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkassay.functions import rewrite, terms
from sparkassay.functions import text as T
from sparkassay.operators import metrics, reference, report, retrieval, runlog, termmap
from sparkassay.plans import base as b
from sparkassay.plans import corpus as c
from sparkassay.plans.base import query, table
from sparkassay.sources import jsonl, shared
from sparkassay.streaming import logs

# -- soak ----------------------------------------------------------------------------------------------


@query("""
with s as (select event_type, list_sort(list(value)) as v, count(*) as n from events group by event_type)
select event_type, n, v[cast(floor((n - 1) * 0.5::double) as bigint) + 1] as p50, v[cast(floor((n - 1) * 0.95::double) as bigint) + 1] as p95, v[n] as max from s
""")
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "max": 1.0})


@query("select l_returnflag, count(*) as n, (list_sort(list(l_extendedprice)))[cast(floor((count(*) - 1) * 0.95::double) as bigint) + 1] as p95 from lineitem group by l_returnflag")
def nearest_rank_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", {"p95": 0.95})


_DAY = "cast(day(ts) as bigint)"
_PHASE = "case when iteration % 2 = 1 then 'fixed_seed_reproducibility' else 'varied_seed_robustness' end"


@query(f"select {_DAY} as iteration, max(case when event_type <> 'view' then value end) as gpu_peak, max(case when event_type = 'none' then value end) as memory_peak from events group by {_DAY}")
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is null where a sampler failed; peaks skip nulls."""
    gpu, memory = F.when(F.col("event_type") != "view", F.col("value")), F.when(F.col("event_type") == "none", F.col("value"))
    return table(spark, sf_dir, "events").groupBy(F.expr(_DAY).alias("iteration")).agg(F.max(gpu).alias("gpu_peak"), F.max(memory).alias("memory_peak"))


@query(f"select phase, count(*) as n from (select {_PHASE} as phase from (select distinct {_DAY} as iteration from events)) group by phase")
def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.expr(_DAY).alias("iteration")).distinct()
    return days.groupBy(metrics.phase(F.col("iteration")).alias("phase")).agg(F.count("*").alias("n"))


@query("""
with u as (select user_id, sum(value) * 20 as total, count(distinct case when day(ts) % 2 = 1 then day(ts) end) as fixed, count(distinct case when day(ts) % 2 = 0 then day(ts) end) as varied from events group by user_id)
select user_id, total >= 14400 as duration_gate_passed, fixed >= 2 and varied >= 1 as phase_gate_passed, total >= 14400 and fixed >= 2 and varied >= 1 as formal_gate_passed,
    case when total >= 14400 and fixed >= 2 and varied >= 1 then 'completed' else concat_ws(',', case when total < 14400 then 'duration_below_14400' end, case when not (fixed >= 2 and varied >= 1) then 'phase_coverage_insufficient' end) end as exit_reason from u
""")
def soak_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of a user as a soak run, a day as an iteration."""
    day = F.day("ts")
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum("value") * 20).alias("total"), F.count_distinct(F.when(day % 2 == 1, day)).alias("fixed"), F.count_distinct(F.when(day % 2 == 0, day)).alias("varied"))
    return runs.select("user_id", metrics.soak_gate(F.col("total"), F.col("fixed"), F.col("varied")).alias("g")).select("user_id", "g.*")


@query("""
with u as (select user_id, cast(floor((epoch(ts) - epoch((select min(ts) from events))) / 14400) as bigint) as run, sum(value) * 20 as total, count(distinct case when hour(ts) % 2 = 1 then hour(ts) end) as fixed, count(distinct case when hour(ts) % 2 = 0 then hour(ts) end) as varied from events group by all)
select case when total >= 14400 and fixed >= 2 and varied >= 1 then 'completed' else concat_ws(',', case when total < 14400 then 'duration_below_14400' end, case when not (fixed >= 2 and varied >= 1) then 'phase_coverage_insufficient' end) end as exit_reason, count(*) as runs, round(sum(total), 2) as seconds from u group by exit_reason
""")
def soak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in spans of four hours as soak runs: how many end for which reason.  Every event counts once."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.min("ts").alias("start"))
    run = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))) / 14_400_000_000)
    hour = F.hour("ts")
    runs = e.crossJoin(F.broadcast(start)).groupBy("user_id", run.alias("run")).agg((F.sum("value") * 20).alias("total"), F.count_distinct(F.when(hour % 2 == 1, hour)).alias("fixed"), F.count_distinct(F.when(hour % 2 == 0, hour)).alias("varied"))  # start is one row
    reason = metrics.soak_gate(F.col("total"), F.col("fixed"), F.col("varied"))["exit_reason"]
    return runs.groupBy(reason.alias("exit_reason")).agg(F.count("*").alias("runs"), F.round(F.sum("total"), 2).alias("seconds"))


_SIGNED = f"(select cast(user_id % 20 as varchar) as question_id, {_DAY} as iteration, sha256(string_agg(distinct event_type, ',' order by event_type)) as retrieval, sha256(concat('{{\"n\":', count(*) // 4, '}}')) as answer from events group by user_id % 20, {_DAY})"
_COMPARED = f"(select s.question_id, s.iteration, {_PHASE.replace('iteration', 's.iteration')} as phase, s.answer, s.retrieval = z.retrieval as same_retrieval, s.answer = z.answer as same_answer from {_SIGNED} s join {_SIGNED} z on s.question_id = z.question_id and z.iteration = 1 where s.iteration > 1)"


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day as an iteration, a group of users as a question."""
    rows = table(spark, sf_dir, "events").groupBy(F.expr("cast(user_id % 20 as string)").alias("question_id"), F.expr(_DAY).alias("iteration"))
    out = rows.agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"), F.expr("count(*) div 4").alias("n"))
    return out.select("question_id", "iteration", T.sha256("types").alias("retrieval"), jsonl.object_hash({"n": F.col("n")}).alias("answer"))


@query(f"select * from {_SIGNED}")
def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(spark, sf_dir)


@query(f"select phase, count(*) as comparisons, round(avg(same_retrieval::int), 8) as retrieval_rate, round(avg(same_answer::int), 8) as answer_rate from {_COMPARED} group by phase")
def match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.match_rates(metrics.matches(_signed(spark, sf_dir)))


@query(f"select cast(coalesce(sum(n), 0) as bigint) as unique_signatures from (select count(distinct answer) as n from {_COMPARED} where phase = 'varied_seed_robustness' group by question_id)")
def unique_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_answers(metrics.matches(_signed(spark, sf_dir)))


# -- specified, not implemented by the reference ------------------------------------------------------


@query("""
with s as (select lang, count(*) as n, sum(toxic) as hits from documents join labels using (doc_id) group by lang), p as (select *, hits / n::double as p from s)
select lang, n, cast(hits as bigint) as hits, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as low,
    round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) as high from p
""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    out = s.withColumn("w", metrics.wilson(F.col("hits"), F.col("n")))
    return out.select("lang", "n", "hits", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def _poisson(u: str) -> str:
    """A Poisson(1) draw from a uniform one, by the places where its distribution steps."""
    upto, p, steps = 0.0, math.exp(-1), []
    for k in range(12):
        upto += p
        steps.append(f"({u} >= {upto!r}::double)::int")
        p /= k + 1
    return " + ".join(steps)


@query(f"""
with g as (select source, cast(sum(toxic) as bigint) as hits, count(*) as n from documents join labels using (doc_id) group by source),
d as (select *, ('0x' || substring(sha256(concat('7|', sha256(concat_ws('|', hits, n, source)), '|', i)), 1, 13))::bigint / {1 << 52}::double as u from g, (select unnest(range(200)) as i)),
r as (select i, sum(w * hits) / sum(w * n)::double as rate from (select *, {_poisson("u")} as w from d) group by i having sum(w * n) > 0),
o as (select list_sort(list(round(rate, 8))) as v, count(*) as m from r)
select (select count(*) from g) as clusters, round((select sum(hits) / sum(n)::double from g), 8) as rate, v[cast(floor((m - 1) * 0.025::double) as bigint) + 1] as low, v[cast(floor((m - 1) * 0.975::double) as bigint) + 1] as high from o
""")
def cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of a rate over clusters, here sources (specified only)."""
    g = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    return metrics.bootstrap(g, "hits", "n")


@query("""
with s as (select source, avg(quality) as success, avg(toxic) as toxic, avg((n_chars < 900)::int::double) as unsure, count(*) filter (doc_id % 389 = 7) as external, count(*) / 20.0::double as coverage from documents join labels using (doc_id) group by source)
select source, concat_ws(',', case when coverage < 0.5 then 'coverage_below_50' end, case when success < 0.7 then 'success_below_70' end, case when toxic > 0.05 then 'unsupported_above_5' end, case when unsure > 0.3 then 'unsure_above_30' end, case when external > 0 then 'external_requests' end) as reasons from s
""")
def stage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("s"), F.avg("toxic").alias("t"), F.avg((F.col("n_chars") < 900).cast("double")).alias("u"), F.count_if(F.col("doc_id") % 389 == 7).alias("x"), (F.count("*") / 20.0).alias("c"))
    return s.select("source", metrics.stage_gates(F.col("c"), F.col("s"), F.col("t"), F.col("u"), F.col("x")).alias("reasons"))


@query("""
select lang, doc_id, place from (select lang, doc_id, row_number() over (partition by lang order by sha256(concat('7:', doc_id)), doc_id) as place from documents) where place <= 20
""")
def transform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of twenty in each stratum."""
    return metrics.stratified(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", "doc_id", 7)


@query(f"""
with e as (select user_id, event_id, {b.EVENT_VALUE} as v, value from events), l as (select *, lag(v) over (partition by user_id order by event_id) as before from e)
select user_id, count(*) as decisions, round(avg((v = 'U')::int), 8) as u_rate, round(avg((v = before)::int), 8) as repeat_agreement, (list_sort(list(value)))[cast(floor((count(*) - 1) * 0.5::double) as bigint) + 1] as median_time from l group by user_id
""")
def review_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of U, agreement with the decision before, median time (specified only)."""
    e = table(spark, sf_dir, "events").withColumn("v", F.expr(b.EVENT_VALUE))
    again = e.withColumn("before", F.lag("v").over(Window.partitionBy("user_id").orderBy("event_id")))
    share = lambda c: F.round(F.avg(c.cast("double")), 8)
    rates = again.groupBy("user_id").agg(F.count("*").alias("decisions"), share(F.col("v") == "U").alias("u_rate"), share(F.col("v") == F.col("before")).alias("repeat_agreement"))
    return rates.join(metrics.nearest_rank(e, "user_id", "value", {"median_time": 0.5}).drop("n"), "user_id")


# -- variants ------------------------------------------------------------------------------------------

#: English function words of the corpus as a term map, so that its rewriting can be stated in SQL.
LATIN = rewrite.TermMap("t1", "approved", en_to_ko={"the": "그것", "of": "소유", "and": "그리고", "in": "안"}, to_abbreviation={"that": "TT", "with": "w/"})


def _sql_words(x: str, words: dict[str, str]) -> str:
    """Whole words replaced, by cutting a text into runs of letters and digits and the rest."""
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in words.items())
    return f"array_to_string([case lower(p) {whens} else p end for p in regexp_extract_all({x}, '[A-Za-z0-9]+|[^A-Za-z0-9]+')], '')"


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{b.WS}+|{b.WS}+$', '', 'g')"


_SOURCE = f"(select item_id, {_sql_strip('text')} as s from benchmark)"
_MADE = f"""(select item_id, s, 1 as i, 'spacing.join_all' as transform_id, regexp_replace(s, '{b.WS}+', '', 'g') as t from {_SOURCE}
    union all select item_id, s, 2, 'spacing.pad', replace(s, ' ', '  ') from {_SOURCE}
    union all select item_id, s, 4, 'mixed.en_to_ko', {_sql_words("s", LATIN.en_to_ko)} from {_SOURCE}
    union all select item_id, s, 5, 'abbreviation.apply', {_sql_words("s", LATIN.to_abbreviation)} from {_SOURCE})"""
_FRESH = f"(select item_id, i, transform_id, t from (select *, row_number() over (partition by item_id, t order by i) as n from {_MADE} where t <> s) where n = 1)"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.questions(spark, sf_dir).withColumns({"question_id": F.col("question_id").cast("string"), "query_kind": F.lit("natural")}).select("question_id", "query", "query_kind")


@query(f"select item_id, transform_id, t as text from {_FRESH} where i <= 2")
def variants_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.questions(spark, sf_dir).select(F.col("question_id").alias("item_id"), F.explode(rewrite.variants(F.col("query"), LATIN)).alias("v"))
    return v.filter("v.kind = 'spacing'").select("item_id", "v.transform_id", "v.text")


@query(f"select item_id, transform_id, t as text from {_FRESH} where i > 2")
def variants_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.questions(spark, sf_dir).select(F.col("question_id").alias("item_id"), F.explode(rewrite.variants(F.col("query"), LATIN)).alias("v"))
    return v.filter("v.kind <> 'spacing'").select("item_id", "v.transform_id", "v.text")


# Korean terms with a particle before a text of the table; what becomes of them can be stated.
_HANGUL = "case item_id % 4 when 0 then '내성 굴림을' when 1 then '주문슬롯' when 2 then '공격 굴림에서' else '방어도망' end"
_MIXED = "case item_id % 4 when 0 then 'saving throw을' when 1 then 'spell slot' when 2 then 'attack roll에서' end"
_REST = f"regexp_replace(text, '{b.WS}+$', '')"


@query(f"select item_id, 'mixed.ko_to_en' as transform_id, concat({_MIXED}, ' ', {_REST}) as text from benchmark where item_id % 4 <> 3 union all select item_id, 'compound.ko_to_en_join', regexp_replace(concat({_MIXED}, ' ', {_REST}), '{b.WS}+', '', 'g') from benchmark where item_id % 4 <> 3")
def variants_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term inside a longer word is left alone; a particle is kept; a joined mix may not fuse scripts anew before it is made."""
    shipped = termmap.load(spark, terms.PAYLOAD, allow_unapproved=True)
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.expr(_HANGUL), F.lit(" "), F.regexp_replace("text", f"{T.WS}+$", "")).alias("q"))
    v = q.select("item_id", F.explode(rewrite.variants(F.col("q"), shipped)).alias("v"))
    return v.filter("v.transform_id in ('mixed.ko_to_en', 'compound.ko_to_en_join')").select("item_id", "v.transform_id", "v.text")


_FUSED = "case item_id % 5 when 0 then 'AC를' when 1 then 'AC방어' when 2 then '방어AC' when 3 then '3까지' else '내성 AC' end"


@query(f"""
with q as (select item_id, concat({_FUSED}, ' ', text) as q from benchmark),
runs as (select item_id, unnest(regexp_extract_all(q, '[A-Za-z0-9][가-힣]+')) as run from q)
select item_id, regexp_matches(q, '[가-힣][A-Za-z]') or exists (select 1 from runs r where r.item_id = q.item_id and substring(run, 2) not in ({', '.join(f"'{x}'" for x in rewrite.PARTICLES)})) as fused from q
""")
def script_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.expr(_FUSED), F.lit(" "), F.col("text")).alias("q"))
    return q.select("item_id", rewrite.fuses(F.col("q")).alias("fused"))


@query(f"""
select cast(item_id as varchar) as question_id, cast(item_id as varchar) as derived_from, 'natural.source' as transform_id, s as query from {_SOURCE}
union all select concat(item_id, '::', transform_id), cast(item_id as varchar), transform_id, t from {_FRESH}
""")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.variant_rows(_questions(spark, sf_dir), LATIN).select("question_id", "derived_from", "transform_id", "query")


def _mixed_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).withColumn("query_kind", F.expr("case when cast(question_id as bigint) % 3 = 0 then 'paraphrase' else 'natural' end"))


_EXPANDED = f"""(select cast(item_id as varchar) as question_id, 'natural' as query_kind, s as query from {_SOURCE} where item_id % 3 <> 0
    union all select concat(item_id, '::', transform_id), split_part(transform_id, '.', 1), t from {_FRESH} where item_id % 3 <> 0
    union all select cast(item_id as varchar), 'paraphrase', text from benchmark where item_id % 3 = 0)"""


@query(f"select * from {_EXPANDED}")
def expand_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.expand(_mixed_fixture(spark, sf_dir), LATIN).select("question_id", "query_kind", "query")


@query(f"select (select count(*) from benchmark) as natural_queries, count(*) as derived_queries, round_even(count(*) / (select count(*) from benchmark)::double, 3) as multiplier, true as scoreable from {_EXPANDED}")
def expansion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mixed_fixture(spark, sf_dir)
    n = rows.agg(F.count("*").alias("natural_queries"))
    m = rewrite.expand(rows, LATIN).agg(F.count("*").alias("derived_queries"))
    ratio = F.when(F.col("natural_queries") > 0, F.bround(F.col("derived_queries") / F.col("natural_queries"), 3)).otherwise(0.0)
    return n.crossJoin(m).select("natural_queries", "derived_queries", ratio.alias("multiplier"), F.lit(LATIN.status == "approved").alias("scoreable"))  # one row each


@query(f"select transform_id, count(*) as fired, round(count(*) / (select count(*) from benchmark), 8) as rate from {_FRESH} group by transform_id")
def variant_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    v = b.questions(spark, sf_dir).select(F.explode(rewrite.variants(F.col("query"), LATIN)).alias("v")).groupBy("v.transform_id").agg(F.count("*").alias("fired"))
    return v.crossJoin(F.broadcast(n)).select("transform_id", "fired", F.round(F.col("fired") / F.col("n"), 8).alias("rate"))  # one row


_TERMS = {**LATIN.en_to_ko, **LATIN.to_abbreviation}


@query(f"""
with t as (select item_id, unnest([lower(w) for w in regexp_extract_all(text, '[A-Za-z0-9]+')]) as term from benchmark)
select term, count(distinct item_id) as rows, count(*) as places from t where term in ({', '.join(map(repr, _TERMS))}) group by term
""")
def term_firing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many questions each entry of the term map stands, and at how many places."""
    return rewrite.term_counts(b.questions(spark, sf_dir), "query", _TERMS)


_REVIEWED = "case when sha256(concat(item_id, transform_id)) < '02' then 'N' when sha256(concat(item_id, transform_id)) < '28' then 'U' else 'Y' end"


@query(f"""
with s as (select transform_id, {_REVIEWED} as value from (select *, row_number() over (partition by transform_id order by sha256(concat('7:', item_id)), item_id) as place from {_FRESH}) where place <= 20)
select transform_id, count(*) as reviewed, count(*) filter (value = 'N') as n, count(*) filter (value = 'U') as u, count(*) filter (value = 'N') > 0 or count(*) filter (value = 'U') > 2 as rejected from s group by transform_id
""")
def transform_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty variants of each transform reviewed (by a digest here); one N or more than two U reject it (specified only)."""
    v = b.questions(spark, sf_dir).select(F.col("question_id").alias("item_id"), F.explode(rewrite.variants(F.col("query"), LATIN)).alias("v")).select("item_id", "v.transform_id")
    digest = T.sha256(F.concat(F.col("item_id").cast("string"), "transform_id"))
    value = F.when(digest < "02", "N").when(digest < "28", "U").otherwise("Y")
    return metrics.transform_verdict(metrics.stratified(v, "transform_id", "item_id", 7).withColumn("value", value), "transform_id", "value")


_VOCABULARY = f"select distinct unnest({b.sql_tokens('text')}) as term from benchmark"
_GLOSSARY = f"select distinct unnest({b.sql_tokens('text')}) as term from documents where lang = 'de'"


@query(f"""
with e as ({_VOCABULARY}), k as ({_GLOSSARY}), s as (select term from e intersect select term from k)
select (select count(*) from e) as evaluation_terms, (select count(*) from s) as shared_terms, round_even((select count(*) from s) / (select count(*) from e)::double, 4) as overlap_ratio,
    (select count(*) from s) = (select count(*) from e) as trivially_solvable, (select string_agg(term, ',' order by term) from (select term from s order by term limit 10)) as shared_sample
""")
def glossary_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens("text")).alias("term"))
    known = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.explode(T.tokens("text")).alias("term"))
    return rewrite.glossary_overlap(mine, known)


_REPLACED = " union all ".join(f"select v.item_id, v.transform_id, lower(p) as term from (select item_id, transform_id, unnest(regexp_extract_all(s, '[A-Za-z0-9]+')) as p from (select f.*, q.s from {_FRESH} f join {_SOURCE} q using (item_id) where transform_id = '{t}')) v where lower(p) in ({', '.join(map(repr, m))})" for t, m in (("mixed.en_to_ko", LATIN.en_to_ko), ("abbreviation.apply", LATIN.to_abbreviation)))


@query(f"""
with r as ({_REPLACED}), k as ({_GLOSSARY})
select transform_id, term, count(distinct item_id) as variants, count(*) as places, term in (select term from k) as in_glossary from r group by transform_id, term
""")
def effective_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each term was really replaced, by transform, and whether the retriever's glossary knows it (specified only)."""
    known = table(spark, sf_dir, "documents").filter("lang = 'de'").select(F.explode(T.tokens("text")).alias("term"))
    return rewrite.effective_overlap(b.questions(spark, sf_dir), LATIN, known)


@query(f"""
with r as ({_REPLACED}), k as ({_GLOSSARY})
select transform_id, count(*) as places, count(*) filter (term in (select term from k)) as known_places, round(count(*) filter (term in (select term from k)) / count(*)::double, 8) as overlap from r group by transform_id
""")
def firing_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glossary's share of the replaced places of each transform: a known term weighs as often as it fires."""
    each = effective_overlap(spark, sf_dir)
    known = F.sum(F.when(F.col("in_glossary"), F.col("places")).otherwise(0))
    return each.groupBy("transform_id").agg(F.sum("places").alias("places"), known.alias("known_places"), F.round(known / F.sum("places"), 8).alias("overlap"))


#: A benchmark item as a term-map entry: its first word, all others as aliases; many entries break a rule or two.
_EN = "case when item_id % 11 = 3 then ' ' when item_id % 11 = 5 then concat(' ', first_, ' ') else concat('e', cast(item_id as {text})) end"
_SHORT = "case item_id % 5 when 1 then '' when 2 then ' X ' when 3 then first_ end"
_ENTRIES = f"""words as (select item_id, string_split(text, ' ') as w, string_split(text, ' ')[1] as first_ from benchmark),
made as (select item_id as pos, case when item_id % 13 = 4 then null else first_ end as ko, {_EN.format(text="varchar")} as en, w[2:] as aliases, item_id % 17 = 6 as odd, {_SHORT} as short, item_id % 6 = 0 as risk from words),
judged as (select *, case when trim(coalesce(ko, '')) = '' then 'ko' when trim(en) = '' then 'en'
    when {b.sql_casefold("trim(ko)")} = {b.sql_casefold("trim(en)")} then 'maps_to_itself' when risk then null when odd then 'aliases' when trim(short) = '' then 'abbreviation' end as violation from made),
sound as (select * from judged where violation is null and not risk),
surfaces as (select pos, place, trim(surface) as surface, {b.sql_casefold("trim(surface)")} as key, trim(en) as en, trim(short) as short
    from (select *, unnest(list_prepend(ko, aliases)) as surface, unnest(range(len(aliases) + 1)) as place from sound) where trim(surface) <> '')"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", " ", -1)).withColumn("first_", F.get("w", F.lit(0)))
    made = words.selectExpr("item_id as pos", "case when item_id % 13 = 4 then null else first_ end as ko", f"{_EN.format(text='string')} as en", "item_id % 6 = 0 as generic_risk", f"{_SHORT} as abbreviation", "item_id % 17 = 6 as odd", "w")
    # aliases are a list, or a text that is none
    plain = F.to_json(F.struct("ko", "en", "generic_risk", "abbreviation"))
    listed = F.when(F.col("odd"), F.lit('"x"')).otherwise(F.to_json(F.slice("w", 2, F.size("w"))))
    return made.select("pos", F.concat(F.lit('{"ko_aliases":'), listed, F.lit(","), F.substring(plain, 2, 1 << 30)).alias("entry"))


@query(f"with {_ENTRIES} select pos, violation from judged where violation is not null")
def term_map_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rule each unusable entry of a term map breaks first."""
    return termmap.entries(_entries(spark, sf_dir)).filter("violation is not null").select("pos", "violation")


@query(f"""
with {_ENTRIES}
select 'ko_to_en' as direction, key, arg_min(en, (pos, place)) as value from surfaces group by key
union all select 'en_to_ko', {b.sql_casefold("en")}, arg_min(surface, pos) from surfaces where place = 0 group by 2
union all select 'to_abbreviation', key, arg_max(short, pos) from
    (select key, pos, short from surfaces union all select {b.sql_casefold("en")}, pos, short from surfaces where place = 0) where short is not null and key <> {b.sql_casefold("short")} group by key
""")
def term_map_compile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termmap.lookups(termmap.entries(_entries(spark, sf_dir)))


@query(f"with {_ENTRIES} select key, count(*) as uses from surfaces group by key having count(*) > 1")
def term_map_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces that stand more than once."""
    return termmap.repeated(termmap.entries(_entries(spark, sf_dir)))


# -- references ------------------------------------------------------------------------------------------

_BUNDLE_DOMAINS = ["a.example", "b.example"]
# Fields of a document's reference, by expressions that both engines read alike; many rows break several rules at once.
_REFERENCE = {
    "cluster": "concat(case when doc_id % 11 = 10 then 'x' else 'f' end, cast(doc_id as {text}))",
    "title": "case when doc_id % 9 <> 1 then 'title' end",
    "url": "case when doc_id % 7 = 2 then 'https://c.example/' else 'https://A.example/p' end",
    "at": "case when doc_id % 8 = 5 then '2024-13-01T00:00:00Z' else '2024-01-01T00:00:00Z' end",
    "evidence": "case when doc_id % 6 = 4 then concat('  ', text, ' ') else concat('ref ', text) end",
    "digest": "case when doc_id % 13 = 3 then 'zz' when doc_id % 10 = 9 then {sha} else {sha_ref} end",
    "evidence_digest": "case when doc_id % 12 = 7 then '0' else {sha_evidence} end",
    "license": "case when doc_id % 14 = 6 then '' else 'CC-BY' end",
    "independence": "case when doc_id % 15 = 7 then 'unknown' when doc_id % 2 = 0 then 'same_source_new_revision' else 'different_domain' end",
    "private": "doc_id % 16 = 12",
    "parts": "case when doc_id % 17 = 8 then 0 else 1 end",
}
_EVIDENCE_TEXT = _REFERENCE["evidence"]
_SQL_REFERENCE = {k: v.format(text="varchar", sha="sha256(text)", sha_ref="sha256(concat('ref ', text))", sha_evidence=f"sha256({_EVIDENCE_TEXT})") for k, v in _REFERENCE.items()}
_JUDGED = f"""r as (select doc_id, source, text, {', '.join(f'{v} as {k}_' for k, v in _SQL_REFERENCE.items())} from documents where length(text) > 0),
judged as (select *, case when title_ is null then 'missing'
    when cluster_ <> concat('f', doc_id) then 'unknown_or_duplicated_cluster'
    when {b.sql_host("url_")} not in ('a.example', 'b.example') then 'domain'
    when not regexp_full_match(digest_, '[0-9a-f]{{64}}') then 'content_digest'
    when evidence_digest_ <> sha256(evidence_) then 'evidence_digest'
    when at_ like '2024-13%' then 'retrieved_at'
    when private_ or license_ = '' then 'not_public'
    when independence_ not in ('different_domain', 'same_source_new_revision') then 'source_independence'
    when parts_ = 0 then 'predicates'
    when digest_ = sha256(text) then 'identical_bytes'
    when {b.sql_casefold(b.sql_collapse("evidence_"))} = {b.sql_casefold(b.sql_collapse("text"))} then 'identical_text' end as violation from r)"""


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as fixtures, and a reference for each."""
    d = table(spark, sf_dir, "documents").filter("length(text) > 0")
    fixtures = d.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fact_cluster_id"), F.col("doc_id").alias("pos"), T.sha256("text").alias("content_digest"), F.col("text").alias("evidence_excerpt"), F.lit("old").alias("license_basis"), F.col("source").alias("reference_answer"), F.lit("Y").alias("reference_review"))
    f = {k: F.expr(v.format(text="string", sha="sha2(text, 256)", sha_ref="sha2(concat('ref ', text), 256)", sha_evidence=f"sha2({_EVIDENCE_TEXT}, 256)")) for k, v in _REFERENCE.items()}
    part = F.struct(F.lit("p").alias("predicate_id"), F.lit("t").alias("text"), F.lit("mandatory").alias("importance"))
    rows = d.select(
        f["cluster"].alias("fact_cluster_id"), F.lit("answer").alias("reference_answer"), f["url"].alias("source_url"), f["title"].alias("source_title"), f["at"].alias("retrieved_at"), F.lit("r1").alias("source_revision"), f["digest"].alias("content_digest"),
        f["evidence"].alias("evidence_excerpt"), f["evidence_digest"].alias("evidence_digest"), f["license"].alias("license_basis"), f["independence"].alias("source_independence"), f["private"].alias("private_input_used"), F.slice(F.array(part), 1, f["parts"]).alias("predicates"),
    )
    return rows, fixtures


@query(f"with {_JUDGED} select cluster_ as fact_cluster_id, violation from judged")
def reference_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fixtures = _bundle(spark, sf_dir)
    return reference.violations(rows, fixtures, _BUNDLE_DOMAINS).select("fact_cluster_id", "violation")


@query(f"""
with {_JUDGED}, f as (select *, violation is null as sound from judged)
select concat('f', doc_id) as fact_cluster_id, case when sound then 'answer' else source end as reference_answer, case when sound then 'CC-BY' else 'old' end as license_basis,
    case when sound then case independence_ when 'different_domain' then 'independent_web_verified' else 'same_source_web_refreshed' end end as reference_provenance,
    case when sound then 'old' end as original_fixture_license_basis, sound as review_required_after_reference_join
from f
""")
def reference_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fixtures = _bundle(spark, sf_dir)
    sound = reference.violations(rows, fixtures, _BUNDLE_DOMAINS).filter(F.col("violation").isNull())
    out = reference.enrich(fixtures, sound, "0" * 64)
    return out.select("fact_cluster_id", "reference_answer", "license_basis", "reference_provenance", "original_fixture_license_basis", F.coalesce("review_required_after_reference_join", F.lit(False)).alias("review_required_after_reference_join"))


# -- reports -----------------------------------------------------------------------------------------------


@query(f"""
with {b.SQL_HITS}, r as (select question_id, count(*) as b from hits group by question_id), both_ as (select i.item_id, r.question_id, r.b from benchmark i full outer join r on i.item_id = r.question_id)
select count(*) filter (question_id is null) as only_left, count(*) filter (item_id is null) as only_right, count(*) filter (b > 1) as repeated,
    count(*) filter (question_id is null) = 0 and count(*) filter (item_id is null) = 0 and count(*) filter (b > 1) = 0 as equal from both_
""")
def id_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.set_equality(b.questions(spark, sf_dir), c.hits(spark, sf_dir), "question_id")


_REVIEW = "case item_id % 4 when 0 then 'Y' when 1 then 'N' when 2 then 'Y' else 'pending' end"
_PROVENANCE = "case when item_id % 8 = 0 then 'independent_web_verified' when item_id % 8 = 2 then 'same_source_web_refreshed' end"
_LABEL = f"case when {_REVIEW} <> 'Y' then 'GENERATED REFERENCE CANDIDATE (not independently approved)' when {_PROVENANCE} = 'independent_web_verified' and item_id % 16 = 0 then 'INDEPENDENT INTERNET REFERENCE ANSWER' when {_PROVENANCE} = 'same_source_web_refreshed' then 'REFRESHED SAME-SOURCE INTERNET REFERENCE ANSWER' else 'APPROVED SYNTHETIC SELF-RETRIEVAL REFERENCE' end"


def _report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as fixtures with labels of their cluster and question."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question_id"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("fact_cluster_id"), "text", F.expr(_PROVENANCE).alias("provenance"))
    refs = q.filter("item_id % 4 <> 3").selectExpr("'reference_supported' as target_type", "fact_cluster_id as target_id", "case item_id % 4 when 1 then 'N' else 'Y' end as value", "item_id + 1000000 as pos")
    early = q.filter("item_id % 4 <> 3").selectExpr("'reference_supported' as target_type", "fact_cluster_id as target_id", "'U' as value", "item_id as pos")
    natural = q.filter("item_id % 5 = 0").selectExpr("'query_natural' as target_type", "question_id as target_id", "'Y' as value", "item_id as pos")
    out = report.with_labels(q, refs.unionByName(early).unionByName(natural))
    return out.withColumn("reference_label", report.reference_label(F.col("review"), F.col("provenance"), F.col("item_id") % 16 == 0))


@query(f"select concat('q', item_id) as question_id, {_REVIEW} as review, {_LABEL} as reference_label from benchmark")
def reference_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_rows(spark, sf_dir).select("question_id", "review", "reference_label")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.gathered(retrieval.evidence(c.hits(spark, sf_dir), b.corpus(spark, sf_dir))).withColumnRenamed("question_id", "item_id")
    rows = _report_rows(spark, sf_dir).join(found, "item_id", "left")
    rows = rows.withColumns({
        "query_kind": F.lit("natural"), "query": F.col("text"), "reference_answer": F.col("text"), "source_title": F.lit("T & <b>"), "source_url": F.lit("https://a.example/"), "status": F.lit("answered"), "answer": T.collapse("text"),
        "citations": F.transform(F.slice(F.col("retrieval"), 1, 1), lambda h: h["content_id"]), "predicates": F.when(F.col("item_id") % 2 == 0, F.array(F.lit("p > q"), F.lit("r"))), "license_basis": F.when(F.col("item_id") % 3 != 0, F.lit("CC-BY")),
        "retrieved_at": F.lit("2024-01-01T00:00:00Z"), "source_revision": F.concat(F.lit("r<"), F.col("item_id").cast("string")), "content_digest": T.sha256("text"), "elapsed_ms": F.when(F.col("item_id") % 5 != 0, F.col("item_id") * 7), "error": F.when(F.col("item_id") % 7 == 0, "timed out & lost"), "usage": F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("{'total_tokens': "), F.col("item_id").cast("string"), F.lit("}"))),
    })
    return rows.select("item_id", "question_id", report.case(rows).alias("markdown"))


def _sql_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_CASES = f"""
evidence as (select h.question_id, h.rank, concat('doc:', c.doc_id, ':chunk:0:sha256:', sha256(c.body)) as content_id, h.score, c.title, rtrim(substring({b.sql_collapse('c.body')}, 1, 360)) as excerpt from hits h join corpus c on h.doc_id = c.doc_id),
lines as (select question_id, string_agg(concat('  ', rank, '. `', content_id, '` (lexical, score=', score, ') — ', {_sql_escape("title")}, ': ', {_sql_escape("excerpt")}), chr(10) order by rank) as hits, min_by(content_id, rank) as first from evidence group by question_id),
cases as (select item_id, concat('q', item_id) as question_id, concat_ws(chr(10), concat('## q', item_id, ' · natural'), '', concat('- fact cluster: `f', item_id, '`'), concat('- QUERY: ', {_sql_escape("text")}), '- RESULT:', coalesce(l.hits, '  검색 결과 없음'),
    rtrim(concat('- LOCAL ANSWER: [answered] ', {_sql_escape(b.sql_collapse("text"))})), concat('- LOCAL CITATIONS: ', coalesce(concat('`', l.first, '`'), '없음')), concat('- ', {_LABEL}, ': ', {_sql_escape("text")}),
    concat('- REFERENCE PREDICATES: ', case when item_id % 2 = 0 then 'p &gt; q; r' else '없음' end), concat('- REFERENCE REVIEW: ', {_REVIEW}), concat('- REFERENCE: [T &amp; &lt;b&gt;](https://a.example/) · retrieved 2024-01-01T00:00:00Z · revision r&lt;', item_id, ' · digest `', sha256(text), '`'), case when item_id % 3 <> 0 then '- SOURCE LICENSE: CC-BY' else '- SOURCE LICENSE: 확인 필요' end,
    concat('- RUN: elapsed_ms=', case when item_id % 5 <> 0 then cast(item_id * 7 as varchar) else '' end, ' · error=', case when item_id % 7 = 0 then 'timed out &amp; lost' else '' end, ' · usage=', case when item_id % 2 = 0 then concat('{{''total_tokens'': ', item_id, '}}') else '{{}}' end),
    concat('- LABELS: reference=', {_REVIEW}, ', query_natural=', case when item_id % 5 = 0 then 'Y' else 'pending' end), '') as markdown from benchmark left join lines l on item_id = l.question_id)
"""


@query(f"with {b.SQL_HITS}, {_CASES} select question_id, markdown from cases")
def report_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("question_id", "markdown")


_HEAD = "'" + "\n".join(report.PAGE_HEAD).replace("{mode}", "smoke").replace("{n}", "', count(*), '") + "'"
_PAGES = f"""{_CASES}, n as (select *, row_number() over (order by item_id) as number, count(*) over () as total from cases),
p as (select *, (number - 1) // 12 as page, printf('cases-%04d-%04d.md', (number - 1) // 12 * 12 + 1, least((number - 1) // 12 * 12 + 12, total)) as filename from n),
pages as (select page, filename, count(*) as cases, sha256(concat({_HEAD}, chr(10), string_agg(markdown, chr(10) order by number))) as sha256 from p group by page, filename)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = shared.written(_cases(spark, sf_dir))
    return report.pages(runlog.paged(runlog.numbered(cases, "item_id"), 12), "smoke")


@query(f"with {b.SQL_HITS}, {_PAGES} select page, filename, cases, sha256 from pages")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page", "filename", "cases", "sha256")


_INDEX = " union all ".join(f"select {i} as place, '{x.replace('{mode}', 'smoke').replace('{no_claim}', '예')}' as line" for i, x in enumerate(report.INDEX_HEAD)).replace("{n}", "' || (select count(*) from benchmark) || '")


@query(f"with {b.SQL_HITS}, {_PAGES} select cast(place as bigint) as place, line from ({_INDEX} union all select page + {len(report.INDEX_HEAD)}, concat('- [', filename, '](', filename, ') — ', cases, '건 · SHA-256 `', sha256, '`') from pages)")
def report_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.index(_pages(spark, sf_dir), "smoke")


@query(f"with {b.SQL_HITS}, {_PAGES} select filename, sha256 from pages")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as files, and the digests of the bytes that are there."""
    path = shared.folder(spark)
    report.write_report(shared.written(_pages(spark, sf_dir)), path, "smoke")
    files = jsonl.file_hashes(spark, f"{path}/pages/*/*.txt")
    return files.select(F.url_decode(F.regexp_extract("path", "filename=([^/]+)/", 1)).alias("filename"), "sha256")


@query(f"""
select case when bool_or({_PROVENANCE} is distinct from 'independent_web_verified' or item_id % 16 <> 0) then 'independent_reference_required' end as violation from benchmark
""")
def full_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report_rows(spark, sf_dir)
    labels = rows.selectExpr("'query_natural' as target_type", "question_id as target_id", "natural as value", "cast(null as string) as decision_source", "item_id as pos")
    return report.full_gate(rows.withColumnRenamed("provenance", "reference_provenance"), rows.filter("item_id % 16 = 0"), labels)


#: Five runs of a question each in turn: sound, of another provenance, not reviewed with Y, decided by models, with a cluster unknown.
_RUN = "item_id % 5"
_FROM = f"case when {_RUN} = 1 and item_id % 4 = 0 then 'generated' else 'independent_web_verified' end"
_NATURAL = f"case when {_RUN} = 2 and item_id % 3 = 0 then 'U' else 'Y' end"
_SOURCE_OF = f"case when {_RUN} = 3 and item_id % 2 = 0 then 'local_model_consensus' when item_id % 7 = 0 then null else 'human' end"


@query(f"""
with r as (select {_RUN} as run, {_FROM} as provenance, {_NATURAL} as natural_, coalesce({_SOURCE_OF}, 'human') as decided, not ({_RUN} = 4 and item_id % 10 = 4) as known from benchmark)
select run, case when bool_or(provenance <> 'independent_web_verified' or not known) then 'independent_reference_required' when bool_or(natural_ <> 'Y') then 'y_review_required' when bool_or(decided <> 'human') then 'human_review_required' end as violation from r group by run
""")
def full_gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a full report for several runs, of which each meets another rule or none; earlier decisions do not count."""
    rows = table(spark, sf_dir, "benchmark").selectExpr(f"{_RUN} as run", "item_id", "concat('q', item_id) as question_id", "concat('f', item_id) as fact_cluster_id", f"{_FROM} as reference_provenance", f"{_NATURAL} as natural_", f"{_SOURCE_OF} as decided")
    natural = rows.selectExpr("'query_natural' as target_type", "question_id as target_id", "natural_ as value", "decided as decision_source", "item_id + 1000000 as pos")
    reference = rows.selectExpr("'reference_supported'", "fact_cluster_id", "'Y'", "'human'", "item_id")
    before = rows.selectExpr("'query_natural'", "question_id", "'N'", "'deterministic'", "item_id")
    return report.full_gate(rows.drop("natural_", "decided"), rows.filter("not (run = 4 and item_id % 10 = 4)"), natural.union(reference).union(before), "run")


# -- files and streams ---------------------------------------------------------------------------------------


@query("select event_id, event_type, user_id, sha256(concat('{\"event_id\":', event_id, ',\"event_type\":\"', event_type, '\",\"user_id\":', user_id, '}')) as digest from events")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical lines written, read back and hashed."""
    path = shared.folder(spark)
    jsonl.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), path)
    lines = jsonl.read_jsonl(spark, path).filter("valid")
    return lines.select(F.from_json("raw", "event_id bigint, event_type string, user_id bigint").alias("r"), T.sha256("raw").alias("digest")).select("r.*", "digest")


_NESTED = "struct(event_id, value, struct(cast(event_id as string) as at, array(struct(user_id as id, event_type as kind), null) as z, array(value, cast(null as double)) as list, 'ü\"' as a) as more, cast(null as string) as none)"


@query("""
with e as (select event_id, user_id, event_type, value, cast(value as varchar) as v from events)
select event_id, sha256(concat('{"event_id":', event_id, ',"more":{"a":"ü\\"","at":"', event_id, '","list":[', v, ',null],"z":[{"id":', user_id, ',"kind":"', event_type, '"},null]},"none":null,"value":', v, '}')) as digest from e
""")
def canonical_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of rows with structs, lists, decimals and nulls in canonical form."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_NESTED).alias("row"))
    raw = F.to_json("row", {"ignoreNullFields": "false"})
    return e.select("event_id", T.sha256(jsonl.canonical_json(raw)).alias("digest"))


#: Journals in parts of so many events, each a file: some lines blank, some no JSON, some no object.
_PART = "event_id div 5000"
_LINE = "case when event_id % 1009 = 3 then '{{bad' when event_id % 1013 = 4 then '[1]' when event_id % 97 = 5 then '' else concat('{{\"event_id\":', cast(event_id as {text}), '}}') end"


@query(f"""
with lines as (select event_type, event_id // 5000 as part, row_number() over (partition by event_type, event_id // 5000 order by event_id) as line, {_LINE.format(text="varchar")} as value from events)
select event_type, part, line, case when value = '{{bad' then 'invalid JSON' else 'object required' end as error from lines where value in ('{{bad', '[1]')
""")
def journal_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journals written with bad lines; file and number of each."""
    path = shared.folder(spark)
    e = table(spark, sf_dir, "events").selectExpr("event_type", f"{_PART} as part", "event_id", f"{_LINE.format(text='string')} as value")
    e.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "event_id").select("event_type", "part", "value").write.partitionBy("event_type", "part").text(path)
    found = jsonl.bad_lines(spark, f"{path}/*/*")
    return found.select(F.url_decode(F.regexp_extract("path", "event_type=([^/]+)/", 1)).alias("event_type"), F.regexp_extract("path", "part=([^/]+)/", 1).cast("bigint").alias("part"), "line", "error")


@query("""
with parts as (select event_type, event_id // 5000 as part, count(*) as n, sha256(concat(string_agg(concat('{"event_id":', event_id, ',"user_id":', user_id, '}'), chr(10) order by event_id), chr(10))) as d from events group by all)
select event_type, cast(sum(n) as bigint) as rows, count(*) as parts, sha256(string_agg(d, chr(10) order by part)) as parts_sha256, true as sound from parts group by event_type
""")
def manifest_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types written as journals in parts, with a manifest of the rows and digest of each part; the files are then checked against it.

    A journal's digest is that of its parts' digests in their order, so no file or value grows with it.
    """
    path = shared.folder(spark)
    e = table(spark, sf_dir, "events").select("event_type", F.expr(_PART).alias("part"), "event_id", jsonl.canonical({"event_id": F.col("event_id"), "user_id": F.col("user_id")}).alias("value"))
    # one file a part, in the order of its events
    e.repartition("event_type", "part").sortWithinPartitions("event_type", "part", "event_id").select("event_type", "part", "value").write.partitionBy("event_type", "part").text(f"{path}/journals")
    named = (F.url_decode(F.regexp_extract("path", "event_type=([^/]+)/", 1)).alias("event_type"), F.regexp_extract("path", "part=([^/]+)/", 1).cast("bigint").alias("part"))
    files = lambda: jsonl.file_hashes(spark, f"{path}/journals/*/*/*.txt").select(*named, "sha256")
    rows = spark.read.text(f"{path}/journals/*/*").select(F.col("_metadata.file_path").alias("path")).select(*named).groupBy("event_type", "part").agg(F.count("*").alias("rows"))
    jsonl.write_jsonl(files().join(rows, ["event_type", "part"]), f"{path}/manifest")
    told = jsonl.read_objects(spark, f"{path}/manifest", "event_type string, part bigint, rows bigint, sha256 string")
    counted = table(spark, sf_dir, "events").groupBy("event_type", F.expr(_PART).alias("part")).agg(F.count("*").alias("n"))
    again = files().withColumnRenamed("sha256", "now")
    parts = told.join(counted, ["event_type", "part"], "full_outer").join(again, ["event_type", "part"], "full_outer")
    sound = F.coalesce((F.col("sha256") == F.col("now")) & (F.col("rows") == F.col("n")), F.lit(False))
    digest = T.sha256(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "sha256"))), lambda x: x["sha256"]), "\n"))  # a line for each part of a journal
    return parts.groupBy("event_type").agg(F.sum("rows").alias("rows"), F.count("*").alias("parts"), digest.alias("parts_sha256"), F.min(sound).alias("sound"))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a table that is one file is read by its folder and name
    if os.path.basename(path).endswith(".parquet") and not _is_folder(spark, path):
        return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(f"select question_id as key, seq, value from (select *, row_number() over (partition by question_id order by seq desc) as i from ({b.SQL_EVENTS})) where i = 1 and action = 'label'")
def stream_reduce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _stream(spark, sf_dir).selectExpr("cast(user_id as string) as key", "event_id as seq", f"{b.EVENT_ACTION} as action", f"{b.EVENT_VALUE} as value")
    return logs.standing(logs.drain(spark, logs.latest(events), shared.folder(spark), "update"))


@query("select distinct user_id as question_id from events")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.drain(spark, logs.once(_stream(spark, sf_dir).select(F.col("user_id").alias("question_id")), "question_id"), shared.folder(spark))


@query("select time_bucket(interval '30 seconds', ts) as start, count(*) as n, max(value) as peak from events group by 1")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "value")
    out = logs.drain(spark, logs.windows(samples, "ts", "value"), shared.folder(spark), "update")
    # each batch gives a window's new state: the last one has the most rows
    return out.groupBy("start").agg(F.max_by(F.struct("n", "peak"), "n").alias("w")).select(F.col("start").cast("timestamp_ntz").alias("start"), "w.n", "w.peak")


@query(f"""
with e as (select cast(user_id as varchar) as key, event_id as seq, event_type = 'error' as error from events),
islands as (select *, sum(case when error then 0 else 1 end) over (partition by key order by seq) as island from e),
streaks as (select *, sum(case when error then 1 else 0 end) over (partition by key, island order by seq) as streak from islands)
select key, cast(count(*) filter (error) as bigint) as errors, coalesce(min(seq) filter (error and streak = 3), -1) as tripped_at, max(seq) as last from streaks group by key
""")
def stream_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and the breaker of each key as a stream that is stopped after half of the log and resumed with the rest."""
    base = shared.folder(spark)
    log = table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as key", "event_id as seq", "event_type = 'error' as error")
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for i, part in enumerate((F.col("seq") <= half, F.col("seq") > half)):
        log.filter(part).write.mode("append").parquet(f"{base}/log")
        told = spark.readStream.schema(log.schema).parquet(f"{base}/log")
        out = logs.drain(spark, logs.attempts(told), base, "update", "attempts")
    return logs.counted(out).select("key", "errors", F.coalesce("tripped_at", F.lit(-1)).alias("tripped_at"), "last")


_SESSIONS = """
e as (select user_id as key, event_id as seq, value, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
s as (select *, sum(case when before is null or ts - before > interval '1 day' then 1 else 0 end) over (partition by key order by ts, seq) as session from e),
g as (select key, session, count(*) as n, sum(value) as total, arg_min(value, (ts, seq)) as cold, min(ts) as start, max(ts) as "end" from s group by key, session),
sessions as (select key, start, "end", round(cold, 6) as cold, n - 1 as iterations, round((total - cold) / nullif(n - 1, 0), 6) as warm_mean, round((n - 1) / nullif(epoch_us("end") / 1e6 - epoch_us(start) / 1e6, 0), 9) as per_second from g)"""


def _rounded(rows: DataFrame) -> DataFrame:
    plain = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return rows.select("key", plain("start"), plain("end"), F.round("cold", 6).alias("cold"), "iterations", F.round("warm_mean", 6).alias("warm_mean"), F.round("per_second", 9).alias("per_second"))


@query(f"with {_SESSIONS} select * from sessions")
def soak_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, their warm-up apart, with mean and throughput of what follows (specified only)."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _rounded(logs.sessions(e, "user_id", "ts", "event_id", "value", "1 day"))


@query(f"""with {_SESSIONS} select * from sessions where "end" + interval '1 day' <= (select max(ts) from events) - interval '1 hour'""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: sessions that no sample of the last hour can still change."""
    samples = _stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return _rounded(logs.drain(spark, logs.sessions(samples, "user_id", "ts", "event_id", "value", "1 day", "1 hour"), shared.folder(spark)))
