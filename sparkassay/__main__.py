"""Command line: validate artifacts, look for a canary, run a registered query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkassay.operators import contracts
from sparkassay.plans import registry
from sparkassay.sources import jsonl

VALIDATORS = {"fixture": contracts.fixture_violations, "label": contracts.label_violations, "candidate": contracts.candidate_violations}


def validate(spark: SparkSession, kind: str, path: str) -> list[tuple[str, int]]:
    """(rule, rows) of the rules that lines of a file break."""
    found = VALIDATORS[kind](jsonl.read_jsonl(spark, path), "raw").filter(F.col("violation").isNotNull())
    return [(r["violation"], r["n"]) for r in found.groupBy("violation").agg(F.count("*").alias("n")).orderBy("violation").collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all is well, 2 for violations or hits."""
    parser = argparse.ArgumentParser(prog="sparkassay")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("validate")
    one.add_argument("kind", choices=sorted(VALIDATORS))
    one.add_argument("path")
    two = commands.add_parser("scan-canary")
    two.add_argument("canary")
    two.add_argument("path")
    three = commands.add_parser("query")
    three.add_argument("name", choices=sorted(registry.QUERIES))
    three.add_argument("tables")
    three.add_argument("output")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparkassay").getOrCreate()
    if args.command == "query":
        registry.QUERIES[args.name](spark, args.tables).write.mode("errorifexists").parquet(args.output)
        return 0
    if args.command == "validate":
        found = [f"{rule}: {n}" for rule, n in validate(spark, args.kind, args.path)]
    else:
        found = [r["path"] for r in jsonl.canary_files(spark, args.path, args.canary).orderBy("path").limit(1000).collect()]
    print("\n".join(found) or "ok")
    return 2 if found else 0


if __name__ == "__main__":
    sys.exit(main())
