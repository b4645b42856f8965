"""Attempt logs: counts, what is left to do, the circuit breaker, ids and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def error_counts(attempts: DataFrame, fingerprint: str) -> DataFrame:
    """(question_id, errors) of a run (attempts: question_id, status, run_fingerprint)."""
    mine = attempts.filter((F.col("run_fingerprint") == fingerprint) & (F.col("status") == "error") & F.col("question_id").isNotNull())
    return mine.groupBy("question_id").agg(F.count("*").alias("errors"))


def pending(questions: DataFrame, results: DataFrame, errors: DataFrame, most: int = 3) -> DataFrame:
    """Questions without a result and with fewer than `most` errors."""
    left = questions.join(results.select("question_id").distinct(), "question_id", "left_anti").join(errors, "question_id", "left")
    return left.withColumn("errors", F.coalesce("errors", F.lit(0))).filter(F.col("errors") < most)


def verdict(questions: DataFrame, results: DataFrame, errors: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, errors, exhausted) of the questions without a result."""
    left = questions.join(results.select("question_id").distinct(), "question_id", "left_anti").join(errors, "question_id", "left")
    return left.select("question_id", F.coalesce("errors", F.lit(0)).alias("errors"), (F.coalesce("errors", F.lit(0)) >= most).alias("exhausted"))


def breaker(attempts: DataFrame, by: str, limit: int = 3) -> DataFrame:
    """Where a run first meets `limit` errors in a row (attempts: by, seq, status); runs without are left out."""
    order = Window.partitionBy(by).orderBy("seq")
    island = attempts.withColumn("island", F.sum((F.col("status") != "error").cast("int")).over(order))
    streak = Window.partitionBy(by, "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    tripped = island.filter("status = 'error'").withColumn("streak", F.count("*").over(streak)).filter(F.col("streak") == limit)
    return tripped.groupBy(by).agg(F.min("seq").alias("tripped_at"))


def numbered(rows: DataFrame, order: str, *ties: str, cells: int = 256) -> DataFrame:
    """rows with `number` from 1 in the order of a column (and of ties).

    The column is cut into `cells` ranges at its approximate quantiles, so that outliers do not gather the other rows in one.
    Rows are numbered within their range, after the counts of the ranges before; the one task that adds these up sees a
    row a range, however many rows there are.  rows are read three times: a costly plan is better written first.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / cells for i in range(1, cells)], 2000)).first()[0] or []
    cuts = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array(F.lit(0))
    ranged = rows.withColumn("__range", F.size(F.filter(cuts, lambda x: x < F.col(order))))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order, *ties))
    return ranged.join(starts, "__range").withColumn("number", (F.col("__before") + place).cast("bigint")).drop("__range", "__before")


def paged(rows: DataFrame, size: int = 100) -> DataFrame:
    """Numbered rows with their page and its file name."""
    total = rows.agg(F.max("number").alias("__total"))
    first = (F.floor((F.col("number") - 1) / size) * size + 1).cast("bigint")
    last = F.least(first + size - 1, F.col("__total"))
    return rows.crossJoin(F.broadcast(total)).withColumn("page", F.floor((F.col("number") - 1) / size).cast("bigint")).withColumn("filename", F.format_string("cases-%04d-%04d.md", first, last)).drop("__total")  # total is one row
