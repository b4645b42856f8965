"""Places of rows in an order, for groups of any size, and tables small enough to send."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written

#: Rows up to which a table goes to every executor: some 100 bytes each.
SMALL = 100_000


def sent(df: DataFrame) -> DataFrame:
    """df to every executor if it has at most SMALL rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each group within a sorted partition."""
    from pyspark import TaskContext

    part, last, before = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        g = batch.column("g").to_numpy(zero_copy_only=False)
        start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        at = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        if g[0] == last:
            at[: start[1] if len(start) > 1 else n] += before
        last, before = g[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)], names=[*batch.schema.names, "part", "at"])


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (g, ...) with their place pos in the order of keys within g, and n, the rows of g.

    The parts of a range partition know their own places; the places before them come from a count for each part and group.
    Rows with equal keys are dealt out by number, as any order of theirs is the same.
    """
    salt = F.xxhash64(F.monotonically_increasing_id()).alias("salt")
    dealt = rows.select("*", salt).repartitionByRange("g", *keys, "salt").sortWithinPartitions("g", *keys, "salt").drop("salt")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    placed = written(dealt.mapInArrow(tidy(_count), f"{schema}, part int, at bigint"), "placed")
    whole = Window.partitionBy("g")  # a row for each part of a group
    counts = placed.groupBy("g", "part").agg(F.count("*").alias("rows"))
    counts = counts.select("g", "part", (F.sum("rows").over(whole.orderBy("part")) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("n"))
    return placed.join(sent(written(counts, "counts")), ["g", "part"]).withColumn("pos", F.col("at") + F.col("before")).drop("part", "at", "before")
