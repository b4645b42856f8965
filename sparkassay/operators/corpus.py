"""Corpus scans: chunks with their parents, counts, source addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.functions import text as T


def load_chunks(chunks: DataFrame, documents: DataFrame, min_chars: int = 120) -> DataFrame:
    """Chunks of min_chars characters or more with their document's revision, licence and retrieval time.

    chunks: chunk_id, document_id, chunk_number, title, body, source_url, content_hash.
    documents: document_id, retrieved_at, modified_at, license_url.
    """
    kept = chunks.filter(F.length("body") >= min_chars).join(documents, "document_id")
    return kept.select("chunk_id", "document_id", "chunk_number", "title", "body", "source_url", "content_hash", "retrieved_at", F.coalesce("modified_at", "retrieved_at").alias("source_revision"), F.col("license_url").alias("license_basis"), T.content_id(F.col("document_id"), F.col("chunk_number"), F.col("content_hash")).alias("content_id"))


def integrity(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: status, documents, chunks, and chunks without a document."""
    n = documents.agg(F.count("*").alias("documents"))
    m = chunks.agg(F.count("*").alias("chunks"))
    lost = chunks.join(documents, "document_id", "left_anti").agg(F.count("*").alias("orphans"))
    return n.crossJoin(m).crossJoin(lost).withColumn("status", F.lit("ok"))  # one row each


def source_urls(*tables: DataFrame) -> DataFrame:
    """All non-empty addresses of the tables' source_url columns."""
    out = None
    for t in tables:
        urls = t.select("source_url").filter(F.col("source_url").isNotNull() & (F.col("source_url") != ""))
        out = urls if out is None else out.unionByName(urls)
    return out


def outside(urls: DataFrame, domains: list[str]) -> DataFrame:
    """Rows whose host is not one of the domains; no host is outside."""
    return urls.filter(~T.host("source_url").isin(*domains))
