"""Scans, text functions, retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators import contracts, corpus, dense, retrieval
from sparkassay.plans import base as b
from sparkassay.plans.base import query, table
from sparkassay.sources import providers


@query(f"""
select d.doc_id as chunk_id, concat('doc:', d.doc_id, ':chunk:0:sha256:', sha256(d.text)) as content_id, d.source as title,
    '2024-01-01T00:00:00Z' as retrieved_at, case when toxic = 1 then '2024-02-02T00:00:00Z' else '2024-01-01T00:00:00Z' end as source_revision,
    case when quality = 1 then 'CC-BY' else 'unknown' end as license_basis, {b.URL.format(text="varchar").replace("doc_id", "d.doc_id")} as source_url
from documents d join labels l on d.doc_id = l.doc_id where length(d.text) >= 120
""")
def corpus_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.load_chunks(b.chunks(spark, sf_dir), b.parents(spark, sf_dir)).select("chunk_id", "content_id", "title", "retrieved_at", "source_revision", "license_basis", "source_url")


@query("""
select (select count(*) from labels) as documents, (select count(*) from documents) as chunks,
    (select count(*) from documents where doc_id not in (select doc_id from labels)) as orphans, 'ok' as status
""")
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.integrity(b.chunks(spark, sf_dir), b.parents(spark, sf_dir))


@query(f"select url as source_url from pages where url <> '' union all select {b.URL.format(text='varchar')} from documents where source is not null")
def url_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.source_urls(table(spark, sf_dir, "pages").select(F.col("url").alias("source_url")), b.chunks(spark, sf_dir))


@query(f"select doc_id, cast(len(t) as bigint) as n_tokens, sha256(array_to_string(t, ' ')) as digest from (select doc_id, {b.sql_tokens('text')} as t from documents)")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens("text").alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), T.sha256(F.array_join("t", " ")).alias("digest"))


@query(f"""
with corpus as ({b.SQL_CORPUS}), n as (select count(*) as n from corpus),
t as (select term, count(*) as df from (select unnest(list_distinct({b.sql_tokens("text")})) as term from corpus) group by term)
select term, df, round(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)), 8) as idf from t, n
""")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.term_stats(b.corpus(spark, sf_dir)).withColumn("idf", F.round("idf", 8))


@query(f"with corpus as ({b.SQL_CORPUS}) select count(*) as n, round(avg(len({b.sql_tokens('text')})), 8) as avgdl from corpus")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.length_stats(b.corpus(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 8))


def hits(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    return retrieval.bm25(b.corpus(spark, sf_dir), b.questions(spark, sf_dir), k)


@query(f"with {b.SQL_HITS} select * from hits")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir)


_EVIDENCE = f"select h.question_id, h.rank, concat('C', h.rank) as citation_key, concat('doc:', c.doc_id, ':chunk:0:sha256:', sha256(c.body)) as content_id, h.score, 'lexical' as arm, c.title, rtrim(substring({b.sql_collapse('c.body')}, 1, 360)) as excerpt, c.source_url, c.doc_id from hits h join corpus c on h.doc_id = c.doc_id"


@query(f"with {b.SQL_HITS} {_EVIDENCE}")
def bm25_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.evidence(hits(spark, sf_dir), b.corpus(spark, sf_dir))


@query(f"select doc_id, rtrim(substring({b.sql_collapse('text')}, 1, 360)) as excerpt, sha256(substring({b.sql_collapse('text')}, 1, 1800)) as bounded_digest, sha256(right(text, 1000)) as tail_digest from documents")
def excerpt_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"), T.sha256(T.bounded("text")).alias("bounded_digest"), T.sha256(T.tail("text")).alias("tail_digest"))


@query(f"select doc_id, sha256({b.sql_key('text')}) as joined_digest, sha256({b.sql_casefold(b.sql_collapse('text'))}) as collapsed_digest from documents")
def whitespace_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.sha256(T.joined_key("text")).alias("joined_digest"), T.collapsed_digest("text").alias("collapsed_digest"))


#: Whole questions that stand in one row, and key words of questions up to which they do.
HEADS, KEYS = 256, 10_000
_ITEM_KIND = b.KIND.replace("turn", "item_id")


@query(f"""
with {b.SQL_HITS}, truth as (
    select b.item_id as question_id, {_ITEM_KIND} as query_kind, d.doc_id from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''
), each_ as (
    select t.question_id, t.query_kind, max(case when h.doc_id is null then 0 else 1 end) as hit
    from truth t left join hits h on t.question_id = h.question_id and t.doc_id = h.doc_id group by t.question_id, t.query_kind
)
select case when grouping(query_kind) = 1 then 'overall' else query_kind end as query_kind, count(*) as questions, cast(sum(hit) as bigint) as hits, round(avg(hit), 8) as rate from each_ group by grouping sets ((query_kind), ())
having count(*) > 0
""")
def source_hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions that find a document they stand in, overall and by kind of question."""
    q = table(spark, sf_dir, "benchmark").filter("text <> ''").select(F.col("item_id").alias("question_id"), F.expr(_ITEM_KIND).alias("query_kind"), F.col("text").alias("asked"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    # any text that holds a question holds its words as they are, but for the first and last; the longest names it
    words = lambda x: F.filter(F.split(x, r"[\s\p{Z}]+"), lambda w: w != "")
    inner = words(F.regexp_replace("asked", r"\A\S*|\S*\z", ""))
    longest = F.get(F.array_sort(F.transform(inner, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), F.lit(0))["w"]
    q = q.withColumn("key", longest)
    short, q = q.filter(F.col("key").isNull()), q.filter(F.col("key").isNotNull())
    keys = q.select("key").distinct()
    n = keys.count()
    if n <= KEYS:  # one row of them goes to where texts are read
        known = F.broadcast(keys.agg(F.collect_list("key").alias("keys")))
        near = d.crossJoin(known).withColumn("key", F.explode(F.array_intersect("keys", words(F.col("text"))))).drop("keys")
    else:
        near = d.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("key")).join(keys, "key", "left_semi").join(d, "doc_id")
    truth = near.join(q, "key").filter(F.contains("text", "asked")).select("question_id", "query_kind", "doc_id")
    # questions without an inner word: documents meet all of them, in blocks of bounded size
    blocks = -(-short.count() // HEADS)
    if blocks:
        block = F.pmod(F.xxhash64("question_id"), F.lit(blocks))
        held = short.groupBy(block.alias("block")).agg(F.collect_list(F.struct("question_id", "query_kind", "asked")).alias("heads"))
        each = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).join(held, "block")
        found = each.select("doc_id", F.explode(F.filter("heads", lambda h: F.contains(F.col("text"), h["asked"]))).alias("h"))
        truth = truth.unionByName(found.select("h.question_id", "h.query_kind", "doc_id"))
    return retrieval.source_hits(hits(spark, sf_dir), truth, "query_kind")


#: An answer for each question, sound or broken in a way that its id decides.
_STATUS = "case question_id % 5 when 1 then 'abstain' when 2 then 'other' else 'answered' end"
_ANSWER = "case question_id % 5 when 1 then '' when 3 then '  ' else 'text' end"
_CITED = {"spark": "case question_id % 10 when 1 then cast(array() as array<string>) when 4 then array('C1', 'C9') when 6 then array('C1') else array('C1', 'C2') end", "sql": "case question_id % 10 when 1 then []::varchar[] when 4 then ['C1', 'C9'] when 6 then ['C1'] else ['C1', 'C2'] end"}


@query(f"""
with {b.SQL_HITS}, evidence as ({_EVIDENCE}),
answers as (select item_id as question_id from benchmark),
cited as (select question_id, {_STATUS} as status, {_ANSWER} as answer, unnest({_CITED["sql"]}) as key from answers),
named as (select c.question_id, coalesce(e.content_id, c.key) as id, e.content_id is not null as known from cited c left join evidence e on c.question_id = e.question_id and c.key = e.citation_key),
each_ as (select question_id, count(*) as n, bool_and(known) as known, string_agg(id, ',' order by id) as citations from named group by question_id)
select a.question_id, coalesce(e.citations, '') as citations,
    coalesce(e.known, true) and case when {_STATUS} = 'abstain' then {_ANSWER} = '' and e.n is null when {_STATUS} = 'answered' then trim({_ANSWER}) <> '' and e.n > 0 else false end as valid
from answers a left join each_ e using (question_id)
""")
def answer_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.gathered(retrieval.evidence(hits(spark, sf_dir), b.corpus(spark, sf_dir)))
    answers = b.questions(spark, sf_dir).selectExpr("question_id", f"{_STATUS} as status", f"{_ANSWER} as answer", f"{_CITED['spark']} as keys").join(found, "question_id", "left")
    answers = answers.withColumn("retrieval", F.coalesce("retrieval", F.slice(F.array(F.struct(F.lit(0).cast("bigint").alias("rank"), *(F.lit("").alias(c) if c != "score" else F.lit(0.0).alias(c) for c in ("content_id", "score", "arm", "title", "excerpt", "source_url")))), 1, 0)))
    cited = answers.withColumn("citations", retrieval.cite(F.col("keys"), F.col("retrieval")))
    allowed = F.transform("retrieval", lambda h: h["content_id"])
    return cited.select("question_id", F.array_join(F.array_sort("citations"), ",").alias("citations"), retrieval.valid_answer(F.col("status"), F.col("answer"), F.col("citations"), allowed).alias("valid"))


@query("select question_id, fact_cluster_id, query, query_kind, 'run1' as fixture_run_fingerprint from (" + b.SQL_FIXTURES + ")")
def qa_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.qa_projection(b.fixtures(spark, sf_dir).withColumn("fixture_run_fingerprint", F.lit("run1")))


@query("""
select event_id, array_to_string(list_sort([k for k in json_keys(props) if k not in ('question_id', 'query')]), ',') as forbidden
from events where len([k for k in json_keys(props) if k not in ('question_id', 'query')]) > 0
""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "events").select("event_id", contracts.forbidden_keys("props", ["question_id", "query"]).alias("f"))
    return found.filter(F.size("f") > 0).select("event_id", F.array_join("f", ",").alias("forbidden"))


_DOMAINS = ["ththhe.example.com", "www.ththhe.example.com", "blog.tionsh.example.net", "thther.example.org"]


@query(f"select page_id, {b.sql_host('url')} as host from pages where {b.sql_host('url')} not in ({', '.join(map(repr, _DOMAINS))})")
def domain_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.outside(table(spark, sf_dir, "pages").withColumnRenamed("url", "source_url"), _DOMAINS)
    return found.select("page_id", T.host("source_url").alias("host"))


@query("select page_id, url from pages where not regexp_matches(url, '^(?i)https://[^/?#]+')")
def https_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(~T.is_https("url")).select("page_id", "url")


_LOOP = "case page_id % 4 when 0 then 'http://localhost:11434/x' when 1 then 'http://[::1]/' when 2 then 'https://127.0.0.1/' else url end"


@query(f"with e as (select page_id, {_LOOP} as endpoint from pages) select page_id, endpoint, regexp_matches(endpoint, '^(?i)http://') and {b.sql_host('endpoint')} in ('127.0.0.1', 'localhost', '::1') as loopback from e")
def loopback_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{_LOOP} as endpoint").withColumn("loopback", T.is_loopback("endpoint"))


@query("select page_id, url, position('script' in html) > 0 as hit from pages where contains(html, 'track(1')")
def canary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contracts.canary_hits(table(spark, sf_dir, "pages"), "html", "track(1")
    return found.select("page_id", "url", F.contains("html", F.lit("script")).alias("hit"))


@query(None)
def focused_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focused on the words of one question; a fold over parts that SQL has no plain form for."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.focused("text", T.query_terms(F.lit("Where do the inner nation and 2 other regions meet?")), 600).alias("excerpt"))


@query(None)
def answer_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the extractive provider to every question with hits."""
    return providers.answer(retrieval.gathered(retrieval.evidence(hits(spark, sf_dir), b.corpus(spark, sf_dir))))


_DENSE_HITS = """
pairs as (
    select b.item_id as question_id, c.vec_id, round(list_inner_product([x::double for x in q.embedding], [x::double for x in c.embedding]), 6) as score
    from benchmark b join embeddings q on q.vec_id = b.item_id join embeddings c on c.vec_id <> q.vec_id
), dense as (select question_id, rank, vec_id, score from (select *, row_number() over (partition by question_id order by score desc, vec_id) as rank from pairs) where rank <= 5)"""


@query(f"with {_DENSE_HITS} select * from dense")
def dense_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors nearest to that of each question, by inner product."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = table(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("question_id"), F.col("vec_id").alias("own"), F.col("v").alias("q"))
    return dense.search(e, asked, 5)


_DENSE = "select question_id, concat('doc:', vec_id) as content_id, 'dense' as arm, rank from dense"


@query(f"""
with {b.SQL_HITS}, {_DENSE_HITS},
arms as ({_DENSE} union all select question_id, concat('doc:', doc_id), 'lexical', rank from hits),
once as (select * from (select *, row_number() over (partition by question_id, content_id order by rank, arm) as i from arms) where i = 1),
kept as (select * from (select * exclude (i), row_number() over (partition by question_id order by rank, arm, content_id) as i from once) where i <= 8)
select question_id, row_number() over (partition by question_id order by sha256(concat_ws('|', question_id, content_id))) as card, content_id, arm, rank as rank_before_dedup from kept
""")
def evidence_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specified only: lexical and dense candidates as blind cards."""
    dense_ = dense_hits(spark, sf_dir).select("question_id", F.concat(F.lit("doc:"), F.col("vec_id").cast("string")).alias("content_id"), F.lit("dense").alias("arm"), "rank")
    lexical = hits(spark, sf_dir).select("question_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("content_id"), F.lit("lexical").alias("arm"), "rank")
    return retrieval.pool(dense_.unionByName(lexical))
