"""JSON lines and manifests as sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as t

from sparkassay.sources.shared import written


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(raw, valid): lines that are not blank; valid tells whether a line is a JSON object."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("raw"), F.json_object_keys("value").isNotNull().alias("valid"))


def _faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bad line with its number in its block of a file, and of each block how many lines it has (error null)."""
    at: dict[tuple[str, int], int] = {}
    names = ["path", "block", "line", "error"]
    for batch in batches:
        if not batch.num_rows:
            continue
        path, block = batch.column("path").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.append(True, (path[1:] != path[:-1]) | (block[1:] != block[:-1]))).tolist()
        number = np.empty(batch.num_rows, np.int64)
        for x, y in zip(cuts, [*cuts[1:], batch.num_rows]):  # lines of a block come in order
            before = at.get(key := (path[x], int(block[x])), 0)
            number[x:y] = np.arange(before + 1, before + 1 + y - x)
            at[key] = before + y - x
        bad = batch.column("error").is_valid()
        yield pa.RecordBatch.from_arrays([c.filter(bad) for c in (batch.column("path"), batch.column("block"), pa.array(number), batch.column("error"))], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in at], pa.string()), pa.array([k[1] for k in at], pa.int64()), pa.array(list(at.values()), pa.int64()), pa.nulls(len(at), pa.string())], names=names)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, error) of every line that is neither blank nor a JSON object; lines count from 1 in each file.

    Files may be read in parts by many tasks: a part numbers its own lines, and the lines of the parts before it are added.
    """
    raw = F.col("value")
    error = F.when(F.trim(raw) == "", None).when(F.try_parse_json(raw).isNull(), "invalid JSON").when(F.json_object_keys(raw).isNull(), "object required")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), error.alias("error"))
    told = written(lines.mapInArrow(_faults, "path string, block bigint, line bigint, error string"))
    bad = told.filter("error is not null")
    counts = told.filter("error is null").join(bad.select("path").distinct(), "path", "left_semi")  # only files with a bad line
    before = F.sum("line").over(Window.partitionBy("path").orderBy("block")) - F.col("line")
    return bad.join(counts.select("path", "block", before.alias("before")), ["path", "block"]).select("path", (F.col("before") + F.col("line")).alias("line"), "error")


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a schema; any other line stops the read with its file and number."""
    first = bad_lines(spark, path).orderBy("path", "line").first()
    if first is not None:
        raise ValueError(f"{first.path}:{first.line}: {first.error}")
    return read_jsonl(spark, path).select(F.from_json("raw", schema).alias("r")).select("r.*")


def canonical(columns: dict[str, Column]) -> Column:
    """JSON with sorted keys, no spaces, nulls kept.  For text, whole numbers, booleans and structs of them."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


@F.pandas_udf(t.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON texts of any depth with the keys of each level sorted and numbers as short as they can be told apart.  Null stays null."""
    return raw.map(lambda x: None if x is None else json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


#: Types that `canonical` writes as they are.
_PLAIN = (t.StringType, t.IntegralType, t.BooleanType)


def canonical_row(df: DataFrame) -> Column:
    """A row as canonical JSON: built in if its columns are texts, whole numbers and booleans, else level by level."""
    flat = canonical({c: F.col(c) for c in df.columns})
    return flat if all(isinstance(f.dataType, _PLAIN) for f in df.schema.fields) else canonical_json(flat)


def object_hash(columns: dict[str, Column]) -> Column:
    return F.sha2(canonical(columns), 256)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One canonical line a row.  errorifexists guards an output that must be new; append extends a journal."""
    df.select(canonical_row(df).alias("value")).write.mode(mode).text(path)


def write_manifest(spark: SparkSession, row: dict, path: str) -> None:
    """A small indented JSON document, written by Spark so that any file system will do."""
    text = json.dumps(row, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], t.StructType([t.StructField("value", t.StringType())])).coalesce(1).write.mode("errorifexists").text(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A whole JSON document that must be an object; it describes a run and is small."""
    text = spark.read.text(path, wholetext=True).first()
    out = json.loads(text[0]) if text else None
    if not isinstance(out, dict):
        raise ValueError("object required")
    return out


def canary_files(spark: SparkSession, path: str, canary: str) -> DataFrame:
    """Files that hold an evaluation-only mark; bytes that are no UTF-8 do not hide it."""
    if not canary:
        raise ValueError("canary must not be empty")
    return spark.read.format("binaryFile").load(path).filter(F.contains(F.col("content"), F.lit(canary.encode()))).select("path")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def total_bytes(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and their bytes, for a limit on what a run may keep."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
