"""Row contracts.  A validator gives the name of the first rule a row breaks, or null.

Rows come as JSON text, so that unknown keys and types (a boolean is no integer) can be seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import text as T

# The closed vocabularies of the contracts.
VALUES = ["Y", "N", "U"]
U_REASONS = ["version_unknown", "evidence_conflict", "wording_unclear", "expertise_missing"]
SOURCE_TYPES = ["public_web", "synthetic_template"]
ARMS = ["lexical", "dense", "entity", "glossary", "oracle", "random", "hard_negative", "full_document"]
TARGET_TYPES = ["corpus_evidence", "retrieval_success", "predicate_answered", "predicate_supported", "claim_supported", "contradiction_present", "citation_valid", "abstention_appropriate", "reference_supported", "query_natural"]
DECISION_SOURCES = ["human", "deterministic", "local_model_consensus"]
IMPORTANCE = ["mandatory", "optional", "excluded"]
MODES = {"smoke": 12, "diagnostic": 32, "full": 1000}
KINDS = ["natural", "mixed", "spacing_abbreviation", "paraphrase"]
REASONS = ["ok", "explicit_skip", "missing_reference_answer", "missing_predicate", "queries_not_four", "query_item_malformed", "kinds_incomplete", "empty_query_text", "duplicate_query_text", "mixed_has_no_latin", "spacing_has_no_marker", "duplicate_of_previous_pass"]
FIXTURE_TEXTS = ["question_id", "fact_cluster_id", "query", "source_type", "source_title", "retrieved_at", "source_revision", "content_digest", "derivation", "license_basis", "reference_answer"]
QA_KEYS = ["question_id", "fact_cluster_id", "query", "query_kind", "fixture_run_fingerprint"]


class Json:
    """Typed looks into a column of JSON text.

    The text is parsed once: `df` holds each key's type and text as columns of their own, which the
    optimizer does not merge into the rules that read them many times.
    """

    def __init__(self, df: DataFrame, raw: str, names: list[str]) -> None:
        parsed = df.withColumns({"__keys": F.json_object_keys(raw), "__value": F.try_parse_json(raw)})
        at = lambda k, kind: F.try_variant_get("__value", f"$.{k}", kind)
        kinds = {f"__kind_{k}": F.coalesce(F.schema_of_variant(at(k, "variant")), F.lit("VOID")) for k in names}
        self.df = parsed.withColumns(kinds | {f"__text_{k}": at(k, "string") for k in names})
        self.keys = F.col("__keys")

    def kind(self, key: str) -> Column:
        return F.col(f"__kind_{key}")

    def text(self, key: str) -> Column:
        return F.col(f"__text_{key}")

    def number(self, key: str) -> Column:
        return self.text(key).try_cast("double")

    def has(self, key: str) -> Column:
        return F.coalesce(F.array_contains(self.keys, key), F.lit(False))

    def is_text(self, key: str) -> Column:
        return (self.kind(key) == "STRING") & (F.coalesce(self.text(key), F.lit("")) != "")

    def missing(self, key: str) -> Column:
        """Absent, null, an empty text or an empty list; zero, false and an empty object are not missing."""
        text = F.coalesce(self.text(key), F.lit(""))
        return (self.kind(key) == "VOID") | (self.kind(key) == "ARRAY<VOID>") & text.isin("", "[]") | (self.kind(key) == "STRING") & (text == "")

    def is_number(self, key: str, whole: bool) -> Column:
        kind = self.kind(key)
        return kind == "BIGINT" if whole else (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")

    def isin(self, key: str, values: list[str]) -> Column:
        return (self.kind(key) == "STRING") & F.coalesce(self.text(key).isin(*values), F.lit(False))

    def judged(self, rules: list[tuple[str, Column]]) -> DataFrame:
        """The rows with `violation`."""
        out = self.df.withColumn("violation", first_broken(rules))
        return out.drop(*(c for c in out.columns if c.startswith("__")))


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule whose condition holds; a null condition does not hold."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def fixture_violations(df: DataFrame, raw: str) -> DataFrame:
    """Public fixtures: traceable, public, with atomic predicates."""
    j = Json(df, raw, [*FIXTURE_TEXTS, "private_input_used", "source_url", "predicates"])
    # each predicate's keys, and the types and texts of the three it may have
    parts = ("predicate_id", "text", "importance")
    look = lambda p, k: F.struct(F.coalesce(F.schema_of_variant(F.try_variant_get(p, f"$.{k}", "variant")), F.lit("VOID")).alias("kind"), F.try_variant_get(p, f"$.{k}", "string").alias("text"))
    listed = F.transform(F.try_variant_get("__value", "$.predicates", "array<variant>"), lambda p: F.struct(F.json_object_keys(F.to_json(p)).alias("keys"), *(look(p, k).alias(k) for k in parts)))
    j.df = j.df.withColumn("__predicates", listed)

    def odd(p: Column) -> Column:
        named = lambda k: (p[k]["kind"] == "STRING") & (F.coalesce(p[k]["text"], F.lit("")) != "")
        importance = F.array_contains(p["keys"], "importance") & ~((p["importance"]["kind"] == "STRING") & F.coalesce(p["importance"]["text"].isin(*IMPORTANCE), F.lit(False)))
        return F.coalesce(p["keys"].isNull() | (F.size(F.array_except(p["keys"], F.array(*map(F.lit, parts)))) > 0) | ~named("predicate_id") | ~named("text") | importance, F.lit(True))

    return j.judged(
        [
            ("not_an_object", j.keys.isNull()),
            ("missing", _any([j.missing(k) for k in (*FIXTURE_TEXTS, "predicates")])),
            ("non_empty_strings", _any([~j.is_text(k) for k in FIXTURE_TEXTS])),
            ("source_type", ~j.isin("source_type", SOURCE_TYPES)),
            ("private_input_used", ~((j.kind("private_input_used") == "BOOLEAN") & (j.text("private_input_used") == "false"))),
            ("content_digest", ~T.is_sha256(j.text("content_digest"))),
            ("retrieved_at", ~T.has_zone(j.text("retrieved_at"))),
            ("source_url", j.has("source_url") & ((j.kind("source_url") != "STRING") | ~T.is_https(j.text("source_url")))),
            ("source_url_missing", (j.text("source_type") == "public_web") & j.missing("source_url")),
            ("predicates", ~j.kind("predicates").startswith("ARRAY") | F.exists("__predicates", odd)),
        ]
    )


def label_violations(df: DataFrame, raw: str) -> DataFrame:
    """Atomic labels: closed keys, Y, N or U, a reason with U only."""
    needed, others = ["question_id", "target_type", "target_id", "value"], ["reason", "elapsed_ms", "decision_source", "confidence"]
    j = Json(df, raw, [*needed, *others])
    reason = j.has("reason") & ~j.missing("reason") & ~F.coalesce(j.text("reason").isin("false", "0", "{}"), F.lit(False))
    return j.judged(
        [
            ("not_an_object", j.keys.isNull()),
            ("missing", _any([j.missing(k) for k in needed])),
            ("additional_properties", F.size(F.array_except(j.keys, F.array(*map(F.lit, (*needed, *others))))) > 0),
            ("non_empty_strings", _any([~j.is_text(k) for k in needed])),
            ("target_type", ~j.isin("target_type", TARGET_TYPES)),
            ("value", ~j.isin("value", VALUES)),
            ("reason_required", (j.text("value") == "U") & ~j.isin("reason", U_REASONS)),
            ("reason_without_u", (j.text("value") != "U") & reason),
            ("elapsed_ms", j.has("elapsed_ms") & (~j.is_number("elapsed_ms", True) | (j.number("elapsed_ms") < 0))),
            ("decision_source", j.has("decision_source") & ~j.isin("decision_source", DECISION_SOURCES)),
            ("confidence", j.has("confidence") & (~j.is_number("confidence", False) | ~j.number("confidence").between(0, 1))),
        ]
    )


def candidate_violations(df: DataFrame, raw: str) -> DataFrame:
    """Retrieval candidates: known arm, digest, rank from 1."""
    texts, others = ["question_id", "content_id", "arm", "content_digest"], ["rank_before_dedup", "inspection_receipt"]
    j = Json(df, raw, [*texts, *others])
    return j.judged(
        [
            ("not_an_object", j.keys.isNull()),
            ("missing", _any([j.missing(k) for k in (*texts, "rank_before_dedup")])),
            ("additional_properties", F.size(F.array_except(j.keys, F.array(*map(F.lit, (*texts, *others))))) > 0),
            ("non_empty_strings", _any([~j.is_text(k) for k in texts])),
            ("arm", ~j.isin("arm", ARMS)),
            ("content_digest", ~T.is_sha256(j.text("content_digest"))),
            ("inspection_receipt", j.has("inspection_receipt") & (j.kind("inspection_receipt") != "STRING")),
            ("rank_before_dedup", ~j.is_number("rank_before_dedup", True) | (j.number("rank_before_dedup") < 1)),
        ]
    )


CANDIDATE = "skip boolean, reference_answer string, predicate string, queries array<struct<kind:string,text:string>>"


def candidate_reason(c: str | Column) -> Column:
    """Why a model's candidate (a struct of CANDIDATE) is not used; `ok` if it is."""
    c = F.col(c) if isinstance(c, str) else c
    queries = c["queries"]
    texts = F.transform(queries, lambda q: T.collapse_ends(q["text"]))
    of = lambda kind: F.get(F.transform(F.filter(queries, lambda q: q["kind"] == kind), lambda q: T.collapse_ends(q["text"])), F.lit(0))
    broken = first_broken(
        [
            ("explicit_skip", c["skip"]),
            ("missing_reference_answer", F.coalesce(T.collapse_ends(c["reference_answer"]), F.lit("")) == ""),
            ("missing_predicate", F.coalesce(T.collapse_ends(c["predicate"]), F.lit("")) == ""),
            ("queries_not_four", queries.isNull() | (F.size(queries) != 4)),
            ("query_item_malformed", F.exists(queries, lambda q: q.isNull() | q["text"].isNull() | ~F.coalesce(q["kind"].isin(*KINDS), F.lit(False)))),
            ("kinds_incomplete", F.size(F.array_distinct(F.transform(queries, lambda q: q["kind"]))) != 4),
            ("empty_query_text", F.exists(texts, lambda t: t == "")),
            ("duplicate_query_text", F.size(F.array_distinct(F.transform(texts, T.joined_key))) != 4),
            ("mixed_has_no_latin", ~of("mixed").rlike("[A-Za-z]")),
            ("spacing_has_no_marker", ~(of("spacing_abbreviation").rlike("[A-Z]{2,}") | F.contains(of("spacing_abbreviation"), F.lit("  ")))),
        ]
    )
    return F.coalesce(broken, F.lit("ok"))


def merge_passes(first: Column, second: Column) -> Column:
    """Both passes of one chunk: (status, reasons, accepted answers).  The second must give another answer."""
    a, b = candidate_reason(first), candidate_reason(second)
    same = (a == "ok") & (b == "ok") & (T.joined_key(first["reference_answer"]) == T.joined_key(second["reference_answer"]))
    b2 = F.when(same, F.lit("duplicate_of_previous_pass")).otherwise(b)
    accepted = F.array_compact(F.array(F.when(a == "ok", T.collapse_ends(first["reference_answer"])), F.when(b2 == "ok", T.collapse_ends(second["reference_answer"]))))
    skipped = F.coalesce(first["skip"], F.lit(False)) | F.coalesce(second["skip"], F.lit(False))
    status = F.when(F.size(accepted) > 0, "valid").when(skipped, "explicit_skip").otherwise("invalid")
    return F.struct(status.alias("status"), F.array(a, b2).alias("reasons"), accepted.alias("answers"))


def valid_candidates(candidates: Column) -> Column:
    """One or two candidates, all usable, with different answers."""
    answers = F.transform(candidates, lambda c: T.joined_key(c["reference_answer"]))
    return F.coalesce(F.size(candidates).between(1, 2) & F.forall(candidates, lambda c: candidate_reason(c) == "ok") & (F.size(F.array_distinct(answers)) == F.size(candidates)), F.lit(False))


def valid_judgment(reference: Column, queries: Column, expected: int | Column) -> Column:
    """A judgment with a known value for the reference and for each expected query."""
    return F.coalesce(reference.isin(*VALUES) & (F.size(queries) == expected) & F.forall(queries, lambda q: F.coalesce(q.isin(*VALUES), F.lit(False))), F.lit(False))


def forbidden_keys(raw: str | Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that are not allowed; null if it is no object."""
    return F.array_sort(F.array_except(F.json_object_keys(F.col(raw) if isinstance(raw, str) else raw), F.array(*map(F.lit, allowed))))


def qa_projection(rows: DataFrame) -> DataFrame:
    """The only columns that reach the answering model; the first four are required."""
    lost = [k for k in QA_KEYS[:4] if k not in rows.columns]
    if lost:
        raise ValueError(f"missing required fields: {', '.join(lost)}")
    return rows.select(*[k for k in QA_KEYS if k in rows.columns])


def mode_violation(mode: str, count: Column) -> Column:
    """Whether a number of cases suits an evaluation mode."""
    if mode not in MODES:
        raise ValueError(f"unknown evaluation mode: {mode}")
    return F.when(count < MODES[mode], "too_few").when(count % 4 != 0, "not_a_multiple_of_four")


def public_only(rows: DataFrame, fingerprint: Column) -> DataFrame:
    """One row: whether rows are one public-only run (source_type, private_input_used, run_fingerprint)."""
    fine = F.coalesce((F.col("source_type") == "public_web") & (F.col("private_input_used") == F.lit(False)) & (F.col("run_fingerprint") == fingerprint), F.lit(False))
    return rows.agg(F.count("*").alias("rows"), F.count_if(~fine).alias("violations")).withColumn("accepted", (F.col("rows") > 0) & (F.col("violations") == 0))


def uniqueness(rows: DataFrame, key: str, single: str) -> DataFrame:
    """One row: whether `key` is unique and `single` has one value in all rows."""
    out = rows.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_distinct(single).alias("runs"), F.count_if(F.col(single).isNull()).alias("unbound"))
    return out.withColumn("accepted", (F.col("rows") == F.col("keys")) & (F.col("runs") == 1) & (F.col("unbound") == 0))


def canary_hits(rows: DataFrame, column: str, canary: str) -> DataFrame:
    """Rows whose text holds an evaluation-only mark."""
    if not canary:
        raise ValueError("canary must not be empty")
    return rows.filter(F.contains(F.col(column), F.lit(canary)))


def source_manifest_violation(m: Column, manifest_sha256: Column, trusted: Column, snapshot_sha256: Column, foreign_urls: Column) -> Column:
    """First broken rule of a source manifest (a struct); foreign_urls counts addresses outside its domains."""
    names = ("schema_version", "snapshot_sha256", "source_type", "allowed_domains", "license_basis", "approved_for_public_test", "contains_private_data")
    return first_broken(
        [
            ("missing", _any([m[k].isNull() for k in names])),
            ("unsupported", (m["schema_version"] != 1) | (m["source_type"] != "public_web_snapshot")),
            ("not_public", ~(m["approved_for_public_test"] & ~m["contains_private_data"])),
            ("untrusted_manifest", ~F.coalesce(manifest_sha256 == trusted, F.lit(False))),
            ("snapshot_mismatch", ~F.coalesce(snapshot_sha256 == m["snapshot_sha256"], F.lit(False))),
            ("allowed_domains", F.size(m["allowed_domains"]) == 0),
            ("foreign_domain", foreign_urls > 0),
        ]
    )


def bundle_violation(m: Column, manifest_sha256: Column, trusted: Column, bundle_sha256: Column) -> Column:
    """First broken rule of a reference bundle's manifest (a struct), before any of its rows is looked at."""
    digests = T.is_sha256(m["local_corpus_sha256"]) & T.is_sha256(m["reference_snapshot_sha256"])
    return first_broken(
        [
            ("untrusted_manifest", ~F.coalesce(manifest_sha256 == trusted, F.lit(False))),
            ("bundle_mismatch", ~F.coalesce(m["bundle_sha256"] == bundle_sha256, F.lit(False))),
            ("collection_method", ~F.coalesce(m["collection_method"] == "independent_public_web", F.lit(False))),
            ("not_public", ~F.coalesce(m["public_only"] & ~m["private_input_used"], F.lit(False))),
            ("license_basis", F.coalesce(m["license_basis"], F.lit("")) == ""),
            ("same_snapshot", ~F.coalesce(digests & (m["local_corpus_sha256"] != m["reference_snapshot_sha256"]), F.lit(False))),
            ("allowed_domains", F.coalesce(F.size(m["allowed_domains"]), F.lit(0)) <= 0),
        ]
    )


def triage_binding(m: Column, fixtures_sha256: Column, prelabels_sha256: Column) -> Column:
    """Why prelabels may not be used: a triage that is not complete, or that was made of other fixtures or gave other labels."""
    return first_broken(
        [
            ("no_manifest", m.isNull()),
            ("incomplete", ~F.coalesce(m["complete"], F.lit(False))),
            ("other_fixtures", ~F.coalesce(m["fixtures_sha256"] == fixtures_sha256, F.lit(False))),
            ("other_prelabels", ~F.coalesce(m["prelabels_sha256"] == prelabels_sha256, F.lit(False))),
        ]
    )


def digest_of_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many rows there are, and a digest of them in any order: the sum of 60-bit parts of their own digests."""
    own = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)
    part = F.conv(F.substring(own, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sha2(F.coalesce(F.sum(part), F.lit(0)).cast("string"), 256).alias("sha256"))


def receipt(rows: DataFrame, columns: list[str], fingerprint: Column, trusted: Column, manifest_sha256: Column) -> DataFrame:
    """One row: the receipt that binds public-only fixtures to an approved manifest; its digest is null where they are not to be bound."""
    public = public_only(rows, fingerprint).select("accepted")
    made = digest_of_rows(rows, columns).crossJoin(public)  # one row each
    bound = F.col("accepted") & F.coalesce(manifest_sha256 == trusted, F.lit(False))
    return made.select(F.col("n").alias("fixtures"), F.when(bound, F.col("sha256")).alias("fixtures_sha256"), F.when(bound, manifest_sha256).alias("source_manifest_sha256"), bound.alias("public_only"))


def review_binding(fixtures: DataFrame, by: str, own_sha256: Column, reviewed_sha256: Column) -> DataFrame:
    """(by, bound): whether fixtures are the reviewed file itself, or all derive from it (parent_fixture_sha256)."""
    derived = F.coalesce(F.col("parent_fixture_sha256") == reviewed_sha256, F.lit(False))
    return fixtures.groupBy(by).agg((F.min(own_sha256 == reviewed_sha256) | F.min(derived)).alias("bound"))


def same_run(manifest_fingerprint: str | None, fingerprint: str, artifacts_exist: bool) -> str | None:
    """Why a run may not go on: artifacts without a manifest, or a manifest of another run.  Checked on the driver, before a job."""
    if manifest_fingerprint is None:
        return "orphan_artifacts" if artifacts_exist else None
    return None if manifest_fingerprint == fingerprint else "fingerprint_mismatch"
