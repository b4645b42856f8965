"""Streams with state: stopped, resumed, read again, late."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from sparkassay.operators import runlog
from sparkassay.streaming import logs

LOG = "key string, seq bigint, error boolean"


def test_attempts_of_a_stream_that_is_resumed(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"k{rng.randint(0, 8)}", i, rng.random() < 0.5) for i in range(400)]
    log, base = str(tmp_path / "log"), str(tmp_path)
    parts = [rows[:150], rows[150:151], [*rows[140:151], *rows[151:300]], rows[300:]]  # some are read again
    for part in parts:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(log)
        out = logs.drain(spark, logs.attempts(spark.readStream.schema(LOG).parquet(log)), base, "update", "one")
    got = {r.key: (r.errors, r.tripped_at) for r in logs.counted(out).collect()}
    batch = spark.createDataFrame(rows, LOG).select("key", "seq", F.when(F.col("error"), "error").otherwise("ok").alias("status"))
    tripped = {r.key: r.tripped_at for r in runlog.breaker(batch, "key").collect()}
    errors = {r["key"]: r.n for r in batch.groupBy("key").agg(F.count_if(F.col("status") == "error").alias("n")).collect()}
    assert got == {k: (n, tripped.get(k)) for k, n in errors.items()} and tripped
    assert len({b.name for b in (tmp_path / "stream-one" / "out").glob("batch=*")}) == 4


def test_attempts_of_keys_that_come_in_many_parts(spark, tmp_path):
    """A batch with more rows of a key than one Arrow batch holds, in no order, some of them twice."""
    rng = random.Random(6)
    rows = [(f"k{i % 3}", i, rng.random() < 0.2) for i in range(45_000)]
    mixed = rows + rows[:2_000]
    rng.shuffle(mixed)
    spark.createDataFrame(mixed, LOG).repartition(6).write.parquet(str(tmp_path / "log"))
    out = logs.drain(spark, logs.attempts(spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))), str(tmp_path), "update", "many")
    want = {}
    for k, i, error in rows:
        errors, row, tripped, _ = want.get(k, (0, 0, None, -1))
        row = row + 1 if error else 0
        want[k] = (errors + error, row, i if row == 3 and tripped is None else tripped, i)
    assert {r.key: (r.errors, r.in_a_row, r.tripped_at, r.last) for r in logs.counted(out).collect()} == want


def test_sessions_with_late_samples(spark, tmp_path):
    at = lambda m: f"2024-01-01 {10 + m // 60:02d}:{m % 60:02d}:00"
    schema = "u string, seq bigint, ts string, value double"
    first = [("a", 1, at(0), 9.0), ("a", 2, at(4), 1.0), ("b", 3, at(5), 4.0), ("a", 6, at(30), 7.0)]
    late = [("a", 4, at(8), 2.0), ("a", 5, at(2), 3.0), ("b", 7, at(200), 1.0), ("a", 8, at(201), 5.0)]
    for rows in (first, late, [("c", 9, at(400), 1.0)]):
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("u string, seq bigint, ts timestamp, value double").parquet(str(tmp_path / "in"))
        out = logs.drain(spark, logs.sessions(stream, "u", "ts", "seq", "value", late="1 hour"), str(tmp_path), at="s")
    whole = spark.createDataFrame(first + late, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sorted(map(str, logs.sessions(whole, "u", "ts", "seq", "value").collect()))
    assert sorted(map(str, out.collect())) == want and len(want) == 5
    one = next(r for r in out.collect() if r.key == "a" and r.iterations == 3)
    assert (one.cold, one.warm_mean, round(one.per_second, 6)) == (9.0, 2.0, round(3 / 480, 6))
