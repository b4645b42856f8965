"""Operator 1 - best-fit packing of tokenised documents into fixed-length training sequences.

Hierarchical residual packing.  Every partition packs its own pieces best-fit and emits the bins
that are nearly full; what is left becomes items of the next round, in fewer and larger groups, until
one bounded group is left.  A bin carries the coordinates of its pieces, so no round joins anything.

Cases: a null or empty text is one end token.  Repeated rows are packed once each.  A null doc_id
stays null.  Pieces of one length are packed in the order in which they come, and of bins with the same room the one filled last takes
a piece; where a piece lands is any result's own.  A very long text is tokenised whole and cut into pieces, which are rows like any
other's.  An empty table gives no rows.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written
from sparkassay.llm.tokens import WordPieces
from sparkassay.llm.words import rows

CAPACITY = 2048
#: A bin this full is emitted before the last round.
NEARLY_FULL = CAPACITY - 16
#: Pieces packed together in a partition, and bins packed together in a later round.
BLOCK = 100_000
GROUP = 50_000
#: Groups that meet in one group of the next round.
FAN_IN = 8

PIECE = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>"
BIN = f"level int, task bigint, bin bigint, used int, pieces array<{PIECE}>"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing: each item, largest first, goes to the fullest bin that still takes it.

    Open bins are kept by free space, with one bit for each free space in use, so the tightest bin is
    the lowest bit at or above the item's size.
    """
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = used >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                used &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        by_free[free - size].append(b)
        used |= 1 << (free - size)
    return bins


def _pieces(path: str, capacity: int) -> Callable:
    """Tokenise: one row for each piece of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordPieces.shared(path).encode
        for batch in rows(batches, 4000):
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple] = []
            for doc, data in zip(ids, encode(batch.column("text"))):
                data += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[at : at + 4 * capacity]
                    out.append((doc, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _bins(level: int, task: int, at: int, groups: list[list[int]], sizes: np.ndarray, held: pa.ListArray | pa.StructArray) -> pa.RecordBatch:
    """Rows of BIN for groups of items; an item holds one piece or the pieces of a bin."""
    flat = np.fromiter((i for g in groups for i in g), np.int64)
    ends = np.cumsum([len(g) for g in groups], dtype=np.int64)
    used = np.add.reduceat(sizes[flat], np.r_[0, ends[:-1]])
    if isinstance(held, pa.ListArray):
        per = pa.compute.list_value_length(held).to_numpy(zero_copy_only=False)[flat]
        ends = np.cumsum(per, dtype=np.int64)[ends - 1]
        held = held.take(pa.array(flat)).flatten()
    else:
        held = held.take(pa.array(flat))
    n = len(groups)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, level), pa.int32()), pa.array(np.full(n, task), pa.int64()), pa.array(np.arange(at, at + n), pa.int64()), pa.array(used, pa.int32()), pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), held)],
        names=["level", "task", "bin", "used", "pieces"],
    )


def _pack_partition(path: str, capacity: int, full: int) -> Callable:
    """Best-fit in blocks of a partition; the underfull bins of a block join the next block as items."""
    cut = _pieces(path, capacity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        open_bins: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []

        def pack(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at, open_bins, waiting
            pieces = pa.Table.from_batches(waiting).combine_chunks() if waiting else None
            waiting = []
            structs = [c for c in ([] if pieces is None else [pieces.to_struct_array().combine_chunks()])]
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1), pa.int32()), s) for s in structs]
            sizes = [pieces["length"].to_numpy()] if pieces is not None else []
            if open_bins is not None:
                lists.append(open_bins["pieces"].combine_chunks())
                sizes.append(open_bins["used"].to_numpy())
            if not lists:
                return
            held = pa.concat_arrays([x.cast(lists[0].type) for x in lists])
            size = np.concatenate(sizes).astype(np.int64)
            out = _bins(0, task, at, best_fit(size, capacity), size, held)
            at += out.num_rows
            if last:
                open_bins = None
                yield out
            else:
                done = pa.array(out.column("used").to_numpy() >= full)
                open_bins = pa.Table.from_batches([out.filter(pa.compute.invert(done))])
                yield out.filter(done)

        found = 0
        for batch in cut(batches):
            waiting.append(batch)
            found += batch.num_rows
            if found >= BLOCK:
                yield from pack(False)
                found = 0
        yield from pack(True)

    return run


def _pack_group(level: int, capacity: int) -> Callable:
    """Best-fit of one group of underfull bins."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sizes = table["used"].to_numpy().astype(np.int64)
        held = table["pieces"].combine_chunks()
        return pa.Table.from_batches([_bins(level, key[0].as_py(), 0, best_fit(sizes, capacity), sizes, held)])

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """Pack docs (doc_id, text): one row per piece with its sequence_id and offset there.

    path is the tokenizer file.  Rounds end when the underfull bins fit one group of GROUP bins, or
    when a round merges less than a fiftieth of them: with larger leftovers no further merging pays.
    """
    plain = pick(docs, doc_id="bigint", text="string")
    tables = [written(plain.mapInArrow(tidy(_pack_partition(path, capacity, nearly_full), tokenizes=True), BIN), "bins0")]
    sequences = []
    groups = None
    for level in range(1, 16):
        last = tables[-1]
        under = last.filter(F.col("used") < nearly_full)
        found = under.agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).first()
        if not found["n"] or (found["tasks"] == 1 and level > 1):
            break
        groups = max(-(-found["n"] // GROUP), -(-found["tasks"] // FAN_IN) if found["n"] > GROUP else 1)
        sequences.append(last.filter(F.col("used") >= nearly_full))
        merged = written(under.withColumn("task", F.pmod(F.xxhash64("task", "bin"), F.lit(groups))).groupBy("task").applyInArrow(_pack_group(level, capacity), BIN), f"bins{level}")
        tables.append(merged)
        if groups == 1 or merged.count() > 0.98 * found["n"]:
            break
    sequences.append(tables[-1])
    out = sequences[0]
    for x in sequences[1:]:
        out = out.unionByName(x)
    # level, task and number of a bin are unique together
    sequence = F.shiftleft(F.col("level").cast("bigint"), 58) + F.shiftleft(F.col("task"), 34) + F.col("bin")
    at = F.expr("transform(sequence(1, size(pieces)), i -> aggregate(slice(pieces, 1, i - 1), 0L, (a, p) -> a + p.length))")
    return out.select(sequence.alias("sequence_id"), F.explode(F.arrays_zip(F.col("pieces").alias("p"), at.alias("offset"))).alias("x")).select("x.p.*", "sequence_id", "x.offset")
