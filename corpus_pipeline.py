"""From raw documents to packed training sequences, in five stages.

Each stage reads the documents its predecessor wrote.  All but the last return the columns of documents, whatever their names:
operators see doc_id and text by name and all others by place, so no column clashes with one of theirs.

Cases: a document of null text, or without a letter, goes in the first stage.  Repeated rows are learned from and counted each;
near_copies keeps those that repeat the doc_id it keeps.  A document without a doc_id stays a document: it is no copy of
another, and the last stage packs it without a doc_id.  A document that loses all its lines stays, empty; of empty ones near_copies
keeps one.  A very long text is one row in every stage.  An empty table, or an empty benchmark, gives empty tables or clean ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkassay.llm import decontam, langid, linededup, nearcopies, packing
from sparkassay.llm.frames import carried, pick
from sparkassay.llm.registry import tokenizer_path
from sparkassay.llm.store import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no known language (operator 4)."""
    held = carried(docs)
    found = langid.identify(held.df, pick(docs, doc_id="bigint", text="string", lang="string").filter(~langid.held_out(F.col("doc_id"), 4)))
    return found.filter(F.col("lang_pred") != "und").select(*held.df.columns).toDF(*held.names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share (operator 3); a document with no other lines stays, empty."""
    held = carried(docs)
    new = {"text": F.col("kept_text")} | {f"c{i}": F.length("kept_text").cast("bigint") for i, c in enumerate(held.names) if c == "n_chars"}
    return linededup.dedup(held.df).withColumns(new).select(*held.df.columns).toDF(*held.names)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five words, similarity 0.8 or more (operator 7 with wide fingerprints)."""
    return nearcopies.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by the benchmark (operator 10)."""
    held = carried(docs)
    found = decontam.contamination(held.df, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter(~F.col("contaminated")).select(*held.df.columns).toDF(*held.names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left (operator 1)."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("packing", pack)]

#: SQL has no tokenizer, mixture inference or XXH64; the test compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
