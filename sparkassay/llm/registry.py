"""The queries of the numbered operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkassay.llm import decontam, htmltext, katz, langid, lexical, licences, linededup, merkle, mixing, packing, resample, simhash, topk


def tokenizer_path() -> str:
    """The public tokenizer file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.report(_table(spark, sf_dir, "documents"))


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.report(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(_table(spark, sf_dir, "embeddings"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(_table(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Words of the benchmark contract; A-Z only are lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = r"""
with lines as (
    select doc_id, unnest(l) as line, unnest(range(len(l))) as i
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
), shared as (
    select key, max(doc_id) as keeper from keyed where length(key) >= 40
    group by key having count(distinct doc_id) >= 5
), judged as (
    select k.doc_id, k.line, k.i, s.key is not null and k.doc_id <> s.keeper as gone
    from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP10_SQL = rf"""
with items as (
    select item_id, {_WORDS} as w from benchmark where item_id is not null
), wins as (
    select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as win
    from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)
), docs as (
    select doc_id, {_WORDS} as w from documents
), spans as (
    select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
          from docs, (select distinct n from wins) where len(w) >= n)
), found as (
    select s.doc_id, s.i, s.n, w.item_id from spans s join wins w on s.n = w.n and s.win = w.win
), hit as (
    select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from found) group by doc_id
), named as (
    select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as names
    from (select distinct doc_id, cast(item_id as varchar) as x from found) group by doc_id
)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(names, '')) as items_sha256,
    coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs d left join hit using (doc_id) left join named using (doc_id)
"""

OP9_SQL = """
with usable as (
    select vec_id, [floor(1024 * cast(x as double)) for x in embedding] as e from embeddings
    where vec_id is not null and embedding is not null
        and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
    from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
where rank <= 10
"""

_FIELD = "coalesce(concat(strlen({0}), ':', {0}), '-')"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "{n}", "text")) + "))"
#: A CRC-32 by its reflected polynomial, bit by bit over the bytes of the decimal number.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, step: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295)"""

OP11_SQL = f"""
with recursive rows_ as (
    select doc_id, coalesce('+' || lang, '') as g, {_LEAF.format(n="n_chars")} as leaf,
        case when {_CRC} % 7 = 0 then {_LEAF.format(n="n_chars + 1")} end as bad
    from documents
), leaves as (
    select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from rows_
), tree as (
    select g, 0 as level, pos, leaf as digest, n from leaves
    union all
    select g, level + 1, pos // 2, sha256(concat(digest, sibling)), (n + 1) // 2
    from (select *, lead(digest) over (partition by g order by pos) as sibling from tree where n > 1) where pos % 2 = 0
), roots as (
    select g, digest as subroot, row_number() over (order by g) - 1 as pos, count(*) over () as n from tree where n = 1
), upper as (
    select 0 as level, pos, subroot as digest, n from roots
    union all
    select level + 1, pos // 2, sha256(concat(digest, sibling)), (n + 1) // 2
    from (select *, lead(digest) over (order by pos) as sibling from upper where n > 1) where pos % 2 = 0
), nodes as (
    select g, false as top, level, pos, digest from tree union all select '', true, level, pos, digest from upper
), climb as (
    select l.doc_id, l.leaf, l.g, r.subroot, r.pos as top_pos, r.n as top_n, false as top, 0 as level, l.pos, l.n, coalesce(bad, leaf) as now, '' as proof
    from leaves l join roots r using (g)
    union all
    select c.doc_id, c.leaf, c.g, c.subroot, c.top_pos, c.top_n, c.top or c.n = 1, case when c.n = 1 then 0 else c.level + 1 end,
        case when c.n = 1 then c.top_pos else c.pos // 2 end, case when c.n = 1 then c.top_n else (c.n + 1) // 2 end,
        case when c.n = 1 then now when c.pos % 2 = 0 then sha256(concat(now, s.digest)) else sha256(concat(s.digest, now)) end,
        concat(proof, case when c.n > 1 then s.digest end)
    from climb c left join nodes s on s.top = c.top and s.g = case when c.top then '' else c.g end and s.level = c.level and s.pos = xor(c.pos, 1)
    where not (c.top and c.n = 1)
)
select doc_id, leaf, subroot, (select digest from upper where n = 1) as root, sha256(proof) as proof_sha256, now as folded_root,
    now = (select digest from upper where n = 1) as verified
from climb where top and n = 1
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '{lexical.TERM}')"

OP13_SQL = rf"""
with docs as (
    select row_number() over () as row_id, doc_id, {_TERMS} as t from documents
), corpus as (
    select count(*) filter (len(t) > 0) as n, cast(sum(len(t)) as bigint) as words from docs
), postings as (
    select row_id, doc_id, len(t) as length, term, count(*) as tf from (select row_id, doc_id, t, unnest(t) as term from docs) group by all
), dfs as (
    select term, count(*) as df from postings group by term
), asked as (
    select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark where item_id is not null) group by all
), scored as (
    select item_id, row_id, any_value(doc_id) as doc_id,
        cast(sum(times * cast(floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double)) as bigint)
            * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * length * n) // words)))) as bigint) as score
    from asked join dfs using (term) join postings using (term), corpus group by item_id, row_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0)
where rank <= 10
"""

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_licence_scan": op5_licence_scan,
    "op6_katz_scores": op6_katz_scores,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_importance_resampling": op8_importance_resampling,
    "op9_exact_topk": op9_exact_topk,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mixing": op12_source_mixing,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE = {"op3_line_dedup": OP3_SQL, "op9_exact_topk": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_lexical_search": OP13_SQL}
