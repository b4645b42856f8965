"""Append-only logs as streams: standing labels, resumed results, sampled windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest(events: DataFrame) -> DataFrame:
    """A row for each batch in which a key has events: its last event (by seq) so far: key, seq, action, value.

    The state is one event a key, kept and combined in the JVM; a replayed or late older event changes nothing.
    """
    last = events.groupBy("key").agg(F.max_by(F.struct("seq", "action", "value"), "seq").alias("e"))
    return last.select("key", "e.seq", "e.action", "e.value")


def standing(changes: DataFrame) -> DataFrame:
    """Labels that stand, from the changes that the stream gave."""
    return changes.groupBy("key").agg(F.max_by(F.struct("seq", "action", "value"), "seq").alias("e")).filter("e.action = 'label'").select("key", "e.seq", "e.value")


def once(results: DataFrame, id_: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Exactly one row an id, also across restarts from one checkpoint.

    With a time column, an id is forgotten once results as old as its first cannot come any more, so that the state is bounded by
    what arrives within `late`; without one it holds every id, as a run that may be resumed at any time needs.
    """
    return results.dropDuplicates([id_]) if time is None else results.withWatermark(time, late).dropDuplicatesWithinWatermark([id_])


def windows(samples: DataFrame, time: str, value: str, width: str = "30 seconds", late: str = "1 minute") -> DataFrame:
    """Tumbling windows of samples: number and peak."""
    return samples.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.max(value).alias("peak")).select(F.col("w.start").alias("start"), "n", "peak")


_ATTEMPTS = "key string, errors bigint, in_a_row bigint, tripped_at bigint, last bigint"


def attempts(log: DataFrame, limit: int = 3) -> DataFrame:
    """A row for each batch in which a key has attempts: its errors, those in a row just now, where it first met `limit` of these (or -1).

    log (key, seq, error) comes in the order of seq from batch to batch for each key, in any order within one; an attempt that is read
    again changes nothing.  Rows of a key reach a task in several parts that no order ties together, so they are sorted as a whole: nine
    bytes for each of a batch.  The state is four numbers a key and lives in the stream's checkpoint, so that a run that was stopped counts on.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        errors, row, tripped, last = state.get if state.exists else (0, 0, -1, -1)
        told = [(part["seq"].to_numpy(np.int64, copy=True), part["error"].to_numpy(bool, copy=True)) for part in parts]
        seq, error = (np.concatenate(x) for x in zip(*told))
        order = np.argsort(seq, kind="stable")
        seq, error = seq[order], error[order]
        new = np.diff(seq, prepend=last) > 0
        new &= seq > last
        seq, error = seq[new], error[new]
        if len(seq):
            place = np.arange(len(seq))
            sound = np.maximum.accumulate(np.where(error, -1, place))
            streak = np.where(sound < 0, place + 1 + row, place - sound)  # errors in a row up to each attempt
            trips = np.flatnonzero(error & (streak == limit))
            tripped = int(seq[trips[0]]) if tripped < 0 and len(trips) else tripped
            errors, row, last = errors + int(error.sum()), int(streak[-1]), int(seq[-1])
        state.update((errors, row, tripped, last))
        yield pd.DataFrame({"key": [key[0]], "errors": [errors], "in_a_row": [row], "tripped_at": [tripped], "last": [last]})

    kinds = "errors bigint, in_a_row bigint, tripped bigint, last bigint"
    return log.select("key", "seq", F.coalesce("error", F.lit(False)).alias("error")).groupBy("key").applyInPandasWithState(step, _ATTEMPTS, kinds, "update", GroupStateTimeout.NoTimeout)


def counted(changes: DataFrame) -> DataFrame:
    """The last state of each key, from the changes that the stream gave."""
    state = F.max_by(F.struct("errors", "in_a_row", "tripped_at", "last"), "last").alias("s")
    return changes.groupBy("key").agg(state).select("key", "s.*").withColumn("tripped_at", F.when(F.col("tripped_at") >= 0, F.col("tripped_at")))


def sessions(samples: DataFrame, key: str, time: str, seq: str, value: str, gap: str = "10 minutes", late: str | None = None) -> DataFrame:
    """Sessions of samples with their first one, which warms up, apart: (key, start, end, cold, iterations, warm_mean, per_second).

    Late samples join the session that they belong to as long as they come within `late`.  All parts are sums and extremes, so a
    session's state does not grow with it.
    """
    if late is not None:
        samples = samples.withWatermark(time, late)
    order = F.struct(time, seq)
    grouped = samples.groupBy(F.col(key).alias("key"), F.session_window(time, gap).alias("w")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.min_by(value, order).alias("cold"), F.min(time).alias("first"), F.max(time).alias("last")
    )
    warm: Column = F.col("n") - 1
    seconds = F.unix_micros("last") / 1e6 - F.unix_micros("first") / 1e6
    return grouped.select("key", F.col("first").alias("start"), F.col("last").alias("end"), "cold", warm.alias("iterations"), F.when(warm > 0, (F.col("total") - F.col("cold")) / warm).alias("warm_mean"), F.when(seconds > 0, warm / seconds).alias("per_second"))


def drain(spark: SparkSession, stream: DataFrame, base: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote, from files under `base`; a stream `at` a place goes on from there."""
    path = f"{base}/stream-{at or uuid.uuid4().hex}"

    def keep(df: DataFrame, batch: int) -> None:
        # a batch that is run again replaces its own files
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    write.foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").select(*stream.columns)
