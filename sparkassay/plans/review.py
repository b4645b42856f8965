"""Contracts, review, triage and attempt logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators import contracts, metrics, review, runlog
from sparkassay.plans import base as b
from sparkassay.plans.base import query, table

# -- gates -----------------------------------------------------------------------------------------


@query("""
select count(*) as rows, count(*) filter (source <> 'src0' or lang = 'de') as violations, count(*) > 0 and count(*) filter (source <> 'src0' or lang = 'de') = 0 as accepted from documents
""")
def public_only_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("case when source = 'src0' then 'public_web' else 'private' end as source_type", "lang = 'de' as private_input_used", "'run1' as run_fingerprint")
    return contracts.public_only(rows, F.lit("run1"))


@query("""
select mode, n, case when n < least_ then 'too_few' when n % 4 <> 0 then 'not_a_multiple_of_four' end as violation
from (select count(*) as n from benchmark), (values ('smoke', 12), ('diagnostic', 32), ('full', 1000)) m(mode, least_)
""")
def mode_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    modes = F.array(*(F.struct(F.lit(m).alias("mode"), contracts.mode_violation(m, F.col("n")).alias("violation")) for m in contracts.MODES))
    return n.select("n", F.explode(modes).alias("m")).select("m.mode", "n", "m.violation")


@query("""
select count(*) as rows, count(distinct event_id) as keys, count(distinct user_id) as runs, count(*) filter (user_id is null) as unbound,
    count(*) = count(distinct event_id) and count(distinct user_id) = 1 and count(*) filter (user_id is null) = 0 as accepted from events
""")
def uniqueness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.uniqueness(table(spark, sf_dir, "events"), "event_id", "user_id")


_MANIFEST = {
    "source_type": "case when page_id % 5 = 2 then 'other' else 'public_web_snapshot' end",
    "license_basis": "case when page_id % 7 <> 1 then 'CC' end",
    "approved_for_public_test": "page_id % 9 <> 4",
    "contains_private_data": "page_id % 6 = 3",
    "trusted": "case when page_id % 8 = 5 then 'x' else 'm' end",
    "snapshot": "case when page_id % 10 = 6 then 'x' else 's' end",
    "domain": "case page_id % 4 when 1 then 'other.example' when 2 then null else {host} end",
}


@query(f"""
with m as (select page_id, {b.sql_host("url")} as host_, {', '.join(f'{v.format(host=b.sql_host("url"))} as {k}_' for k, v in _MANIFEST.items())} from pages)
select page_id, case when license_basis_ is null then 'missing'
    when source_type_ <> 'public_web_snapshot' then 'unsupported'
    when not approved_for_public_test_ or contains_private_data_ then 'not_public'
    when trusted_ <> 'm' then 'untrusted_manifest'
    when snapshot_ <> 's' then 'snapshot_mismatch'
    when domain_ is null then 'allowed_domains'
    when host_ <> domain_ then 'foreign_domain' end as violation
from m
""")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest for each page, many with several faults, whose only address is the page's own."""
    rows = table(spark, sf_dir, "pages").withColumn("host", T.host("url"))
    f = {k: F.expr(v.format(host="host")) for k, v in _MANIFEST.items()}
    domains = F.when(f["domain"].isNotNull(), F.array(f["domain"])).otherwise(F.slice(F.array(F.lit("")), 1, 0))
    m = F.struct(F.lit(1).alias("schema_version"), F.lit("s").alias("snapshot_sha256"), domains.alias("allowed_domains"), *(f[k].alias(k) for k in ("source_type", "license_basis", "approved_for_public_test", "contains_private_data")))
    foreign = (~F.array_contains(domains, F.col("host"))).cast("int")
    return rows.select("page_id", contracts.source_manifest_violation(m, F.lit("m"), f["trusted"], f["snapshot"], foreign).alias("violation"))


_BUNDLE = {
    "trusted": "case when page_id % 9 = 1 then 'x' else 'm' end",
    "bundle": "case when page_id % 9 in (2, 6) then 'other' else 'bundle' end",
    "method": "case when page_id % 5 <> 1 then 'independent_public_web' end",
    "public_only": "page_id % 7 <> 2",
    "private_used": "case when page_id % 11 <> 3 then page_id % 13 = 4 end",
    "license": "case page_id % 6 when 1 then '' when 2 then null else 'CC-BY' end",
    "own": "{html}",
    "other": "case page_id % 8 when 3 then {html} when 5 then null else {url} end",
    "domains": "case when page_id % 10 = 4 then 0 when page_id % 10 <> 7 then 1 end",
}


@query(f"""
with m as (select page_id, {', '.join(f'{v.format(html="sha256(html)", url="sha256(url)")} as {k}_' for k, v in _BUNDLE.items())} from pages)
select page_id, case when trusted_ <> 'm' then 'untrusted_manifest' when bundle_ <> 'bundle' then 'bundle_mismatch' when method_ is null then 'collection_method'
    when not public_only_ or private_used_ is null or private_used_ then 'not_public' when coalesce(license_, '') = '' then 'license_basis'
    when other_ is null or own_ = other_ then 'same_snapshot' when coalesce(domains_, 0) = 0 then 'allowed_domains' end as violation
from m
""")
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference bundle's manifest for each page, many with several faults at once."""
    f = {k: F.expr(v.format(html="sha2(html, 256)", url="sha2(url, 256)")) for k, v in _BUNDLE.items()}
    names = {"bundle": "bundle_sha256", "method": "collection_method", "public_only": "public_only", "private_used": "private_input_used", "license": "license_basis", "own": "local_corpus_sha256", "other": "reference_snapshot_sha256"}
    domains = F.when(f["domains"].isNotNull(), F.slice(F.array(F.lit("a.example")), 1, F.coalesce(f["domains"], F.lit(0))))
    m = F.struct(*(f[k].alias(name) for k, name in names.items()), domains.alias("allowed_domains"))
    return table(spark, sf_dir, "pages").select("page_id", contracts.bundle_violation(m, F.lit("m"), f["trusted"], F.lit("bundle")).alias("violation"))


_ROWS_DIGEST = "sha256(cast(coalesce(sum(cast(('0x' || substring(sha256({x}), 1, 15))::bigint as hugeint)), 0) as varchar))"


@query(f"""
with f as (select source, {_ROWS_DIGEST.format(x="concat_ws('|', doc_id, text)")} as fixtures, count(*) as n from documents group by source),
p as (select source, {_ROWS_DIGEST.format(x="concat_ws('|', doc_id, quality)")} as prelabels from documents join labels using (doc_id) group by source)
select source, case when length(source) % 7 = 3 then 'no_manifest' when n % 3 = 0 then 'incomplete' when n % 2 = 0 then 'other_fixtures' when p.prelabels is null then 'other_prelabels' end as violation, f.fixtures as fixtures_sha256 from f left join p using (source)
""")
def triage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as fixtures and its labels as prelabels, with a triage manifest for each that may not fit them."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = lambda *x: F.conv(F.substring(F.sha2(F.concat_ws("|", *x), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    whole = lambda x: F.sha2(F.coalesce(F.sum(x), F.lit(0)).cast("string"), 256)
    f = d.groupBy("source").agg(whole(part(F.col("doc_id").cast("string"), "text")).alias("f"), F.count("*").alias("n"))
    p = d.join(l, "doc_id").groupBy("source").agg(whole(part(F.col("doc_id").cast("string"), F.col("quality").cast("string"))).alias("p"))
    rows = f.join(p, "source", "left")
    m = F.when(F.length("source") % 7 != 3, F.struct((F.col("n") % 3 != 0).alias("complete"), F.when(F.col("n") % 2 != 0, F.col("f")).otherwise("other").alias("fixtures_sha256"), F.col("p").alias("prelabels_sha256")))
    return rows.select("source", contracts.triage_binding(m, F.col("f"), F.col("p")).alias("violation"), F.col("f").alias("fixtures_sha256"))


@query(f"""
select count(*) as fixtures, case when bool_and(url like 'http%') then {_ROWS_DIGEST.format(x="concat_ws('|', page_id, html)")} end as fixtures_sha256, case when bool_and(url like 'http%') then sha256('manifest') end as source_manifest_sha256, bool_and(url like 'http%') as public_only from pages
""")
def public_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as public fixtures, bound to a manifest by a digest of all of it."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "html", "case when url like 'http%' then 'public_web' else 'private' end as source_type", "false as private_input_used", "'run1' as run_fingerprint")
    manifest = F.sha2(F.lit("manifest").cast("binary"), 256)
    return contracts.receipt(rows, ["page_id", "html"], F.lit("run1"), manifest, manifest)


@query("select source, bool_and(lang = 'en') or bool_and(doc_id % 7 <> 3) as bound from documents group by source")
def review_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source as a file of fixtures: reviewed itself if all English, else by what its rows derive from."""
    rows = table(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("doc_id") % 7 != 3, "reviewed").alias("parent_fixture_sha256"))
    return contracts.review_binding(rows, "source", F.when(F.col("lang") == "en", "reviewed").otherwise("own"), F.lit("reviewed"))


# -- validators --------------------------------------------------------------------------------------
# Rows of a table as JSON whose fields follow from the id by different divisors, so that many rows break several rules at
# once.  Both engines make the fields by the same expressions; the SQL then states the rules and their order over the fields.


def _fields(fields: dict[str, str], text: str, sha: str) -> dict[str, str]:
    return {k: v.format(text=text, sha=sha) for k, v in fields.items()}


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_FIXTURE = {
    "question_id": "concat('q', cast(doc_id as {text}))",
    "query": "case when doc_id % 9 <> 1 then text end",
    "source_type": "case doc_id % 8 when 2 then 'private_web' when 5 then 'synthetic_template' else 'public_web' end",
    "content_digest": "case when doc_id % 11 = 4 then upper({sha}) else {sha} end",
    "retrieved_at": "case when doc_id % 10 = 5 then '2024-01-01T00:00:00' else '2024-01-01T00:00:00+00:00' end",
    "source_url": "case when doc_id % 7 = 6 then 'http://a.example/' when doc_id % 7 <> 3 then 'https://a.example/' end",
    "private_input_used": "case when doc_id % 13 = 3 then true when doc_id % 13 <> 9 then false end",
    "license_basis": "case when doc_id % 15 = 13 then '7' else 'CC-BY' end",
    "predicate_text": "case when doc_id % 5 = 3 then '' else 't' end",
    "importance": "case when doc_id % 17 = 10 then 'odd' else 'optional' end",
}


@query(f"""
with f as (select doc_id, {', '.join(f'{v} as {k}_' for k, v in _fields(_FIXTURE, "varchar", "sha256(text)").items())} from documents where length(text) > 0)
select doc_id, case when coalesce(query_, '') = '' or doc_id % 19 = 1 then 'missing'
    when license_basis_ = '7' then 'non_empty_strings'
    when source_type_ not in {_in(contracts.SOURCE_TYPES)} then 'source_type'
    when private_input_used_ is null or private_input_used_ then 'private_input_used'
    when not regexp_full_match(content_digest_, '[0-9a-f]{{64}}') then 'content_digest'
    when not regexp_matches(retrieved_at_, '(Z|[+-]\\d\\d:\\d\\d)$') then 'retrieved_at'
    when source_url_ not like 'https://%' then 'source_url'
    when source_type_ = 'public_web' and source_url_ is null then 'source_url_missing'
    when predicate_text_ = '' or importance_ not in {_in(contracts.IMPORTANCE)} then 'predicates' end as violation
from f
""")
def fixture_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {k: F.expr(v) for k, v in _fields(_FIXTURE, "string", "sha2(text, 256)").items()}
    part = F.struct(F.lit("p1").alias("predicate_id"), f.pop("predicate_text").alias("text"), f.pop("importance").alias("importance"))
    row = {c: F.lit("x") for c in contracts.FIXTURE_TEXTS} | f
    row["predicates"] = F.when(F.col("doc_id") % 19 != 1, F.array(part)).otherwise(F.slice(F.array(part), 1, 0))
    d = table(spark, sf_dir, "documents").filter("length(text) > 0")
    raw = F.replace(F.to_json(F.struct(*(v.alias(k) for k, v in row.items()))), F.lit('"license_basis":"7"'), F.lit('"license_basis":7'))
    return contracts.fixture_violations(d.select("doc_id", raw.alias("raw")), "raw").drop("raw")


_LABEL_ROW = {
    "question_id": "cast(user_id as {text})",
    "target_type": "case when event_id % 7 = 1 then null when event_id % 6 = 3 then 'mood' else 'query_natural' end",
    "target_id": "case when event_id % 23 = 5 then '' else 't' end",
    "value": f"case when event_id % 11 = 4 then 'X' else {b.EVENT_VALUE} end",
    "reason": "case event_id % 3 when 0 then 'wording_unclear' when 1 then case when event_id % 9 = 4 then 'tired' end end",
    "elapsed_ms": "case event_id % 8 when 6 then -1 when 3 then 12 end",
    "decision_source": "case when event_id % 10 = 8 then 'oracle' when event_id % 10 < 4 then 'human' end",
    "confidence": "case when event_id % 12 = 9 then 1.5 when event_id % 4 = 1 then 0.5 end",
    "free_text": "case when event_id % 13 = 2 then 'y' end",
}


@query(f"""
with e as (select event_id, {', '.join(f'{v} as {k}_' for k, v in _fields(_LABEL_ROW, "varchar", "").items())} from events)
select event_id, case when question_id_ is null or target_type_ is null or value_ is null or target_id_ = '' then 'missing'
    when free_text_ is not null then 'additional_properties'
    when target_type_ not in {_in(contracts.TARGET_TYPES)} then 'target_type'
    when value_ not in {_in(contracts.VALUES)} then 'value'
    when value_ = 'U' and coalesce(reason_ not in {_in(contracts.U_REASONS)}, true) then 'reason_required'
    when value_ <> 'U' and reason_ is not null then 'reason_without_u'
    when elapsed_ms_ < 0 or elapsed_ms_ is null and event_id % 16 = 11 then 'elapsed_ms'
    when decision_source_ not in {_in(contracts.DECISION_SOURCES)} then 'decision_source'
    when confidence_ not between 0 and 1 then 'confidence' end as violation
from e
""")
def label_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {k: F.expr(v) for k, v in _fields(_LABEL_ROW, "string", "").items()}
    f["confidence"] = f["confidence"].cast("double")
    row = F.to_json(F.struct(*(v.alias(k) for k, v in f.items())))
    # a boolean is no whole number
    raw = F.when(F.expr("event_id % 16 = 11") & f["elapsed_ms"].isNull(), F.regexp_replace(row, r"\}$", ',"elapsed_ms":true}')).otherwise(row)
    return contracts.label_violations(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw").drop("raw")


_CANDIDATE_ROW = {
    "question_id": "'q'",
    "content_id": "case when event_id % 7 <> 1 then 'c' end",
    "arm": "case when event_id % 6 = 3 then 'magic' when event_id % 6 = 4 then 'hard_negative' else 'dense' end",
    "content_digest": "case when event_id % 11 = 4 then 'abc' else {sha} end",
    "rank_before_dedup": "case event_id % 8 when 6 then 0 when 5 then null else 2 end",
    "inspection_receipt": "case event_id % 9 when 5 then '1' when 6 then 'r' end",
    "extra": "case when event_id % 5 = 2 then 'x' end",
}


@query(f"""
with e as (select event_id, {', '.join(f'{v} as {k}_' for k, v in _fields(_CANDIDATE_ROW, "varchar", "sha256(props)").items())} from events)
select event_id, case when event_id % 10 = 7 then 'not_an_object'
    when content_id_ is null or rank_before_dedup_ is null then 'missing'
    when extra_ is not null then 'additional_properties'
    when arm_ not in {_in(contracts.ARMS)} then 'arm'
    when not regexp_full_match(content_digest_, '[0-9a-f]{{64}}') then 'content_digest'
    when inspection_receipt_ = '1' then 'inspection_receipt'
    when rank_before_dedup_ < 1 or event_id % 12 = 10 and rank_before_dedup_ = 2 then 'rank_before_dedup' end as violation
from e
""")
def candidate_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = {k: F.expr(v) for k, v in _fields(_CANDIDATE_ROW, "string", "sha2(props, 256)").items()}
    row = F.replace(F.to_json(F.struct(*(v.alias(k) for k, v in f.items()))), F.lit('"inspection_receipt":"1"'), F.lit('"inspection_receipt":1'))
    row = F.when(F.expr("event_id % 12 = 10"), F.replace(row, F.lit('"rank_before_dedup":2'), F.lit('"rank_before_dedup":true'))).otherwise(row)
    raw = F.when(F.expr("event_id % 10 = 7"), F.concat(F.lit("["), row, F.lit("]"))).otherwise(row)
    return contracts.candidate_violations(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw").drop("raw")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, pass_, a, b): each eight turns of a conversation as two candidates of a model, of four turns each."""
    eight = F.floor(F.col("turn") / 8).cast("bigint")
    half = lambda i: F.transform(F.sort_array(F.collect_list(F.when(F.floor(F.col("turn") % 8 / 4) == i, F.struct("turn", "text")))), lambda x: x["text"])
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id", eight.alias("pass_")).agg(half(0).alias("t"), half(1).alias("u"))

    def made(part: Column, shift: int) -> Column:
        kinds = F.array(*(F.lit(k) for k in contracts.KINDS))
        kind = lambda i: F.when((F.col("conv_id") + shift) % 5 == 0, F.element_at(kinds, F.least(i + 1, F.lit(3)))).otherwise(F.element_at(kinds, i + 1))
        text = lambda x, i: F.when((F.col("conv_id") % 3 == 0) & (i == 2), F.concat(F.lit("AB  "), x)).when((F.col("conv_id") % 7 == 0) & (i == 3), F.lit("   ")).otherwise(x)
        queries = F.transform(part, lambda x, i: F.struct(kind(i).alias("kind"), text(x, i).alias("text")))
        first = F.get(part, F.lit(0))
        return F.struct(((F.col("conv_id") + shift) % 11 == 0).alias("skip"), F.when((F.col("conv_id") + shift) % 13 != 0, first).alias("reference_answer"), F.when((F.col("conv_id") + shift) % 9 != 0, first).otherwise(" ").alias("predicate"), queries.alias("queries"))

    return turns.select("conv_id", "pass_", made(F.col("t"), 0).alias("a"), made(F.col("u"), 1).alias("b"))


def _sql_candidate(rows: str, shift: int) -> str:
    """Rule by rule over a list of texts `t`, with the same odd values as candidates()."""
    text = "case when conv_id % 3 = 0 and i = 3 then concat('AB  ', t[i]) when conv_id % 7 = 0 and i = 4 then '   ' else t[i] end"
    return f"""(select *, case
        when (conv_id + {shift}) % 11 = 0 then 'explicit_skip'
        when (conv_id + {shift}) % 13 = 0 or coalesce({_sql_strip("t[1]")}, '') = '' then 'missing_reference_answer'
        when (conv_id + {shift}) % 9 = 0 then 'missing_predicate'
        when len(t) <> 4 then 'queries_not_four'
        when (conv_id + {shift}) % 5 = 0 then 'kinds_incomplete'
        when len([x for x in q if x = '']) > 0 then 'empty_query_text'
        when len(list_distinct([{b.sql_key("x")} for x in q])) <> 4 then 'duplicate_query_text'
        when not regexp_matches(q[2], '[A-Za-z]') then 'mixed_has_no_latin'
        when not (regexp_matches(q[3], '[A-Z]{{2,}}') or contains(q[3], '  ')) then 'spacing_has_no_marker' else 'ok' end as reason
        from (select conv_id, pass_, t, [{_sql_strip(text)} for i in range(1, len(t) + 1)] as q from {rows}))"""


def _sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{b.WS}+|{b.WS}+$', '', 'g')"


_TURNS = "(select conv_id, turn // 8 as pass_, coalesce(list(text order by turn) filter (turn % 8 < 4), []) as t, coalesce(list(text order by turn) filter (turn % 8 >= 4), []) as u from conversations group by conv_id, turn // 8)"
_FIRST = _sql_candidate(f"(select conv_id, pass_, t from {_TURNS})", 0)
_LAST = _sql_candidate(f"(select conv_id, pass_, u as t from {_TURNS})", 1)
_MERGED = f"""(select a.conv_id, a.pass_, a.reason as ra, case when a.reason = 'ok' and b.reason = 'ok' and {b.sql_key("a.t[1]")} = {b.sql_key("b.t[1]")} then 'duplicate_of_previous_pass' else b.reason end as rb
    from {_FIRST} a join {_LAST} b on a.conv_id = b.conv_id and a.pass_ = b.pass_)"""


@query(f"select conv_id, pass_, reason from {_FIRST}")
def candidate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("conv_id", "pass_", contracts.candidate_reason("a").alias("reason"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("conv_id", "pass_", contracts.merge_passes(F.col("a"), F.col("b")).alias("m")).select("conv_id", "pass_", "m.*")


_STATUS = "case when ra = 'ok' or rb = 'ok' then 'valid' when ra = 'explicit_skip' or rb = 'explicit_skip' then 'explicit_skip' else 'invalid' end"


@query(f"select conv_id, pass_, {_STATUS} as status, concat(ra, ',', rb) as reasons, cast((case when ra = 'ok' then 1 else 0 end) + (case when rb = 'ok' then 1 else 0 end) as integer) as accepted from {_MERGED}")
def two_pass_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("conv_id", "pass_", "status", F.array_join("reasons", ",").alias("reasons"), F.size("answers").alias("accepted"))


@query(f"select a.conv_id, a.pass_, a.reason = 'ok' and b.reason = 'ok' and {b.sql_key('a.t[1]')} <> {b.sql_key('b.t[1]')} as usable from {_FIRST} a join {_LAST} b on a.conv_id = b.conv_id and a.pass_ = b.pass_")
def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("conv_id", "pass_", contracts.valid_candidates(F.array("a", "b")).alias("usable"))


@query("select conv_id, count(*) >= 4 and bool_and(role in ('user', 'assistant')) as valid from conversations group by conv_id having count(*) > 0")
def judgment_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as judgments: user Y, assistant N, anything else odd; the first turns as the expected four."""
    value = F.when(F.col("role") == "user", "Y").when(F.col("role") == "assistant", "N").otherwise("?")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", value.alias("value")))), lambda x: x["value"]).alias("v"))
    return turns.select("conv_id", contracts.valid_judgment(F.get("v", F.lit(0)), F.col("v"), F.greatest(F.size("v"), F.lit(4))).alias("valid"))


@query(f"with p as (select unnest([ra, rb]) as reason from {_MERGED} where {_STATUS} = 'invalid') select reason, count(*) as n, round(count(*) / (select count(*) from p), 8) as share from p group by reason")
def reject_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shares(_merged(spark, sf_dir).filter("status = 'invalid'").select(F.explode("reasons").alias("reason")), "reason")


@query(f"with p as (select {_STATUS} as status from {_MERGED}) select status, count(*) as n, round(count(*) / (select count(*) from p), 8) as share from p group by status")
def attempt_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shares(_merged(spark, sf_dir), "status")


# -- triage ------------------------------------------------------------------------------------------

_REJECTED = f"(regexp_matches(q, '[\\x{{4e00}}-\\x{{9fff}}]') or length({b.sql_key('a')}) >= 8 and contains({b.sql_key('q')}, {b.sql_key('a')}) or length({_sql_strip('q')}) < 3)"
_JUDGED = f"(select doc_id, {_REJECTED} as rejected, case when quality = 0 then 'N' else 'Y' end as j1, case when toxic = 0 then 'N' else 'Y' end as j2 from (select d.doc_id, d.text as q, string_split(d.text, ' ')[d.doc_id % len(string_split(d.text, ' ')) + 1] as a, quality, toxic from documents d join labels l on d.doc_id = l.doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.split("text", " ", -1)
    q, a = F.col("text"), F.get(words, F.expr("doc_id") % F.size(words))
    rows = d.select("doc_id", review.rejected_outright(q, a).alias("rejected"), F.when(F.col("quality") == 0, "N").otherwise("Y").alias("j1"), F.when(F.col("toxic") == 0, "N").otherwise("Y").alias("j2"))
    return rows.withColumn("c", review.consensus(F.col("rejected"), F.col("j1"), F.col("j2")))


@query(f"select doc_id, 'N' as value, case when rejected then 'deterministic' else 'local_model_consensus' end as decision_source, case when rejected then 1.0::double else 0.8::double end as confidence from {_JUDGED} where rejected or (j1 = 'N' and j2 = 'N')")
def triage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter(F.col("c").isNotNull()).select("doc_id", "c.*")


@query(f"select doc_id, concat(j1, ',', j2) as suggested from {_JUDGED} where not (rejected or (j1 = 'N' and j2 = 'N'))")
def triage_uncertain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter(F.col("c").isNull()).select("doc_id", F.concat_ws(",", "j1", "j2").alias("suggested"))


# -- review ------------------------------------------------------------------------------------------

_QUEUE = f"""(with f as ({b.SQL_FIXTURES}) select pos, 0 as kind, question_id, 'reference_supported' as target_type, fact_cluster_id as target_id
    from (select *, row_number() over (partition by fact_cluster_id order by pos, question_id) as i from f) where i = 1
    union all select pos, 1, question_id, 'query_natural', question_id from f)"""
_ACTIVE = f"(select * from (select *, row_number() over (partition by question_id, target_type, target_id order by seq desc) as i from ({b.SQL_EVENTS})) where i = 1 and action = 'label')"
_PRELABELS = "(select doc_id as pos, cast(doc_id % 200 as varchar) as question_id, 'query_natural' as target_type, cast(doc_id % 200 as varchar) as target_id, case when quality = 0 then 'N' else 'Y' end as value, 'deterministic' as decision_source from labels)"


@query(f"select * from {_QUEUE}")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue(b.fixtures(spark, sf_dir))


@query(f"select question_id, target_type, target_id, seq, value from {_ACTIVE}")
def reduce_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.reduce_events(b.review_events(spark, sf_dir), "value")


@query(f"select question_id, seq, row_number() over (order by seq) as place from {_ACTIVE}")
def label_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.label_order(review.reduce_events(b.review_events(spark, sf_dir), "value")).select("question_id", "seq", "place")


def _prelabels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id as pos", "cast(doc_id % 200 as string) as question_id", "'query_natural' as target_type", "cast(doc_id % 200 as string) as target_id", "case when quality = 0 then 'N' else 'Y' end as value", "'deterministic' as decision_source")


@query(f"""
select question_id, target_type, target_id, value, 'human' as decision_source from {_ACTIVE} union all
select question_id, target_type, target_id, value, decision_source from (select *, row_number() over (partition by question_id order by pos) as i from {_PRELABELS}) where i = 1 and question_id not in (select question_id from {_ACTIVE})
""")
def prelabel_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.overlay(review.reduce_events(b.review_events(spark, sf_dir), "value"), _prelabels(spark, sf_dir))


@query(f"select pos, question_id from {_PRELABELS} where question_id not in (select cast(user_id as varchar) from events)")
def prelabel_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = b.review_events(spark, sf_dir).select(*review.KEY).distinct()
    return review.orphans(_prelabels(spark, sf_dir), items).select("pos", "question_id")


@query(f"select fact_cluster_id, count(distinct query_kind) = 4 as complete from ({b.SQL_FIXTURES}) group by fact_cluster_id")
def cluster_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.complete_clusters(b.fixtures(spark, sf_dir), contracts.KINDS)


@query(f"select fact_cluster_id, question_id, sha256(query) as digest from (select *, row_number() over (partition by fact_cluster_id order by pos) as i from ({b.SQL_FIXTURES})) where i = 1")
def first_per_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = b.fixtures(spark, sf_dir).groupBy("fact_cluster_id").agg(F.min_by(F.struct("question_id", "query"), "pos").alias("f"))
    return first.select("fact_cluster_id", "f.question_id", T.sha256("f.query").alias("digest"))


@query(f"""
select fact_cluster_id from ({b.SQL_FIXTURES}) group by fact_cluster_id, conv_id
having count(distinct question_id) = 4 and bool_and((conv_id * 7 + turn) % 9 <> 0) and conv_id % 3 <> 0
""")
def cluster_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.fixtures(spark, sf_dir)
    queries = f.selectExpr("'query_natural' as target_type", "question_id as target_id", "case when (conv_id * 7 + turn) % 9 = 0 then 'N' else 'Y' end as value", "pos as seq")
    refs = f.selectExpr("'reference_supported' as target_type", "fact_cluster_id as target_id", "case when conv_id % 3 = 0 then 'N' else 'Y' end as value", "pos as seq")
    return review.approved(f, queries.unionByName(refs))


_OVERLAID = f"""(select value, 'human' as decision_source from {_ACTIVE} union all
    select value, decision_source from (select *, row_number() over (partition by question_id order by pos) as i from {_PRELABELS}) where i = 1 and question_id not in (select question_id from {_ACTIVE}))"""


@query(f"select decision_source, count(*) as n, count(*) filter (value = 'Y') as yes from {_OVERLAID} group by decision_source")
def label_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = prelabel_overlay(spark, sf_dir)
    return labels.groupBy(F.coalesce("decision_source", F.lit("human")).alias("decision_source")).agg(F.count("*").alias("n"), F.count_if(F.col("value") == "Y").alias("yes"))


@query(f"select (select count(*) from {_ACTIVE}) as labels, (select count(distinct user_id) from events) as items, (select count(*) from {_ACTIVE}) = (select count(distinct user_id) from events) as complete")
def review_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.review_events(spark, sf_dir)
    labels = review.reduce_events(e, "value").agg(F.count("*").alias("labels"))
    return labels.crossJoin(e.agg(F.count_distinct("question_id").alias("items"))).withColumn("complete", F.col("labels") == F.col("items"))  # one row each


# -- attempts ----------------------------------------------------------------------------------------

_RUN = "case when event_id % 10 < 8 then 'run1' else 'run0' end"
_ERRORS = f"(select cast(user_id as varchar) as question_id, count(*) as errors from events where event_type = 'error' and {_RUN} = 'run1' group by user_id)"
_DONE = "(select distinct cast(user_id as varchar) as question_id from events where event_type = 'purchase' and value > 60)"
_LEFT = f"(select q.question_id, coalesce(e.errors, 0) as errors from (select distinct cast(user_id as varchar) as question_id from events) q left join {_ERRORS} e using (question_id) where q.question_id not in (select question_id from {_DONE}))"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("cast(user_id as string) as question_id", "event_id as seq", "case when event_type = 'error' then 'error' else 'success' end as status", f"{_RUN} as run_fingerprint")


def _run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    attempts = _attempts(spark, sf_dir)
    done = table(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 60").selectExpr("cast(user_id as string) as question_id")
    return attempts.select("question_id").distinct(), done, runlog.error_counts(attempts, "run1")


@query(f"select * from {_ERRORS}")
def attempt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.error_counts(_attempts(spark, sf_dir), "run1")


@query(f"select * from {_LEFT} where errors < 12")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.pending(*_run(spark, sf_dir), most=12)


@query(f"select question_id, errors, errors >= 12 as exhausted from {_LEFT}")
def exhausted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.verdict(*_run(spark, sf_dir), most=12)


@query("""
with a as (select user_id, event_id, event_type = 'error' as e, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by event_id) as island from events),
s as (select user_id, event_id, row_number() over (partition by user_id, island order by event_id) as streak from a where e)
select cast(user_id as varchar) as question_id, min(event_id) as tripped_at from s where streak = 3 group by user_id
""")
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.breaker(_attempts(spark, sf_dir), "question_id")


@query("select item_id, printf('q%04d', row_number() over (order by item_id)) as question_id from benchmark")
def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.numbered(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", F.format_string("q%04d", "number").alias("question_id"))


@query("""
with n as (select item_id, row_number() over (order by item_id) as number, count(*) over () as total from benchmark)
select item_id, number, (number - 1) // 12 as page, printf('cases-%04d-%04d.md', (number - 1) // 12 * 12 + 1, least((number - 1) // 12 * 12 + 12, total)) as filename from n
""")
def pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.paged(runlog.numbered(table(spark, sf_dir, "benchmark"), "item_id"), 12).select("item_id", "number", "page", "filename")
