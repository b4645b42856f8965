"""External references: bundle checks and the join that brings them in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import text as T
from sparkassay.operators.contracts import IMPORTANCE, first_broken

NEEDED = ["fact_cluster_id", "reference_answer", "source_url", "source_title", "retrieved_at", "source_revision", "content_digest", "evidence_excerpt", "evidence_digest", "license_basis", "source_independence", "private_input_used", "predicates"]
REVIEW_COLUMNS = ["reference_review", "query_natural_review", "parent_fixture_sha256"]
TAKEN = ["reference_answer", "source_url", "source_title", "retrieved_at", "source_revision", "content_digest", "evidence_excerpt", "predicates", "license_basis"]


def violations(rows: DataFrame, fixtures: DataFrame, domains: list[str]) -> DataFrame:
    """rows (columns NEEDED) with `violation`, the first rule each breaks against its cluster's first fixture.

    fixtures: fact_cluster_id, pos, content_digest, evidence_excerpt.
    """
    first = fixtures.groupBy("fact_cluster_id").agg(F.min_by(F.struct("content_digest", "evidence_excerpt"), "pos").alias("f"))
    repeated = rows.groupBy("fact_cluster_id").agg(F.count("*").alias("n"))
    joined = rows.join(first, "fact_cluster_id", "left").join(repeated, "fact_cluster_id", "left")
    odd = F.exists("predicates", lambda p: p.isNull() | p["text"].isNull() | ~F.coalesce(p["importance"], F.lit("mandatory")).isin(*IMPORTANCE))
    missing = F.lit(False)
    for c in NEEDED:
        missing = missing | F.col(c).isNull()
    rules = [
        ("missing", missing),
        ("unknown_or_duplicated_cluster", F.col("f").isNull() | (F.col("n") > 1)),
        ("domain", ~T.is_https("source_url") | ~T.host("source_url").isin(*domains)),
        ("content_digest", ~T.is_sha256("content_digest")),
        ("evidence_digest", F.col("evidence_digest") != T.sha256("evidence_excerpt")),
        ("retrieved_at", ~T.has_zone("retrieved_at")),
        ("not_public", F.col("private_input_used") | (F.col("license_basis") == "")),
        ("source_independence", ~F.col("source_independence").isin("different_domain", "same_source_new_revision")),
        ("predicates", (F.size("predicates") == 0) | odd),
        ("identical_bytes", F.col("content_digest") == F.col("f.content_digest")),
        ("identical_text", T.collapsed_digest("evidence_excerpt") == T.collapsed_digest("f.evidence_excerpt")),
    ]
    return joined.withColumn("violation", first_broken(rules)).drop("f", "n")


def enrich(fixtures: DataFrame, references: DataFrame, manifest_sha256: str) -> DataFrame:
    """fixtures with what their cluster's reference gives; earlier review columns go, and matched rows need a new review."""
    kept = fixtures.drop(*REVIEW_COLUMNS)
    found = references.select("fact_cluster_id", F.struct(*TAKEN, "source_independence").alias("r"))
    joined = kept.join(found, "fact_cluster_id", "left")
    matched = F.col("r").isNotNull()
    taken = {c: F.when(matched, F.col(f"r.{c}")).otherwise(F.col(c)) if c in kept.columns else F.col(f"r.{c}") for c in TAKEN}
    added = {
        "original_fixture_license_basis": F.when(matched, F.col("license_basis")),
        "reference_provenance": F.when(matched, F.when(F.col("r.source_independence") == "different_domain", "independent_web_verified").otherwise("same_source_web_refreshed")),
        "reference_source_independence": F.col("r.source_independence"),
        "reference_manifest_sha256": F.when(matched, F.lit(manifest_sha256)),
        "review_required_after_reference_join": F.when(matched, F.lit(True)),
    }
    return joined.withColumns(added | taken).drop("r")
