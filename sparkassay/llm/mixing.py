"""Operator 12 - mix sources to target weights, with budgets fitted by subset sums.

Targets share a multiple of all words by weight; what a source may not take beyond its cap is shared again.  A source's whole
multiples of itself come first; for the rest of its budget documents are counted by their exact length, and how many of each
length to take is found by a bounded knapsack: a share of every length while more than WINDOW words are left, then dynamic
programming over the sums of what is left of the counts, exact in reach of the budget.  Of the documents of one length, those of the
smallest seeded hashes are taken.  Their threshold is found by counts of hash ranges, then within one range, so that no length is
gathered, however many documents share it.

A source sends one row for each length that it has: d different lengths need d (d + 1) / 2 words at least, so even 10^12 words
make fewer than 1.5 million rows.

Cases: a null text has no words, and documents without words are taken for nothing.  Null is a source of its own, the last.  Rows
that repeat a document are counted and taken one by one; rows of one doc_id with different texts are documents of their own.  A
null doc_id is a document.  A very long text is scanned alone and is one length.  An empty table has no rows.  Columns
are found by name as `frames.pick` has it; others, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.memory import tidy
from sparkassay.llm.order import numbered, sent
from sparkassay.llm.store import written
from sparkassay.llm.words import NOT_SPACE, scan

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, 42
#: Words that dynamic programming fits at most.
WINDOW = 1 << 18
#: Documents of a range of hashes, about.
RANGE = 10_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.concatenate([np.empty(0, np.int64), *(w.counts() for w in scan(batch.column("text"), NOT_SPACE))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("h"), pa.array(n)], names=["doc_id", "source", "h", "size"])


def counted(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, h, size, m): different documents with their seeded hash, words, and rows."""
    d = pick(docs, doc_id="bigint", source="string", text="string")
    sized = d.select("doc_id", "source", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h")).mapInArrow(tidy(_sizes), "doc_id bigint, source string, h bigint, size bigint")
    return sized.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("m"))


# -- targets -------------------------------------------------------------------------------------


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): share times all words by weight; weights go round the sources in order, null last."""
    placed = numbered(sources.select(F.lit("").alias("g"), F.col("source").isNull().alias("none"), "source", "source_size"), "none", "source")
    weigh = F.get(F.array(*(F.lit(w).cast("bigint") for w in weights)), (F.col("pos") % len(weights)).cast("int"))
    held = written(placed.select("source", "source_size", weigh.alias("weight")), "sources")
    # each round shares out what the capped leave; sums are whole numbers, so every run finds the same level
    level, whole, size = 0.0, held.agg(F.sum("source_size")).first()[0] or 0, F.col("source_size") * cap
    while True:
        full = size < F.col("weight") * F.lit(level)
        capped, open_ = held.agg(F.sum(F.when(full, size)), F.sum(F.when(~full, F.col("weight")))).first()
        new = max(0.0, share * whole - (capped or 0)) / open_ if open_ else level
        if new <= level:
            break
        level = new
    return held.select("source", "source_size", F.least(size.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


# -- how many of each length -----------------------------------------------------------------------


def reach(length: np.ndarray, count: np.ndarray, goal: float) -> np.ndarray:
    """How many of each length so that their sum is nearest to goal, the smaller of two: a bounded knapsack over all sums."""
    most = int(2 * goal)  # beyond it, nothing is nearer
    able = np.zeros(most + 1, bool)
    able[0] = True
    by, uses = np.zeros(most + 1, np.int32), np.zeros(most + 1, np.int32)
    fits = np.flatnonzero((length <= most) & (count > 0))
    step = int(np.gcd.reduce(length[fits])) if len(fits) else 1
    best = int(goal // step) * step
    best = best + step if 2 * (goal - best) > step else best  # the nearest that any sum can be
    for i in np.random.default_rng(SEED).permutation(fits).tolist():
        if able[best]:
            break
        n = int(length[i])
        rows = -(-(most + 1) // n)
        grid = np.zeros(rows * n, bool)
        grid[: most + 1] = able
        grid = grid.reshape(rows, n)
        at = np.arange(rows, dtype=np.int32)[:, None]
        last = np.maximum.accumulate(np.where(grid, at, np.int32(-(1 << 30))), axis=0)
        used = (at - last).ravel()[: most + 1]  # copies of this length above the nearest sum without it
        new = np.flatnonzero(~able & (used <= count[i]))
        able[new], by[new], uses[new] = True, i, used[new]
    sums = np.flatnonzero(able)
    at = int(sums[np.argmin(np.abs(sums - goal))])  # the first of equals is the smaller
    out = np.zeros(len(length), np.int64)
    while at:
        i = int(by[at])
        out[i] += uses[at]
        at -= int(uses[at]) * int(length[i])
    return out


def fit(length: np.ndarray, count: np.ndarray, goal: float, window: int = WINDOW) -> np.ndarray:
    """How many documents of each length (all over 0) to take for about goal words."""
    whole = int((length * count).sum())
    if goal >= whole:
        return count.copy()
    taken, left = np.zeros(len(length), np.int64), goal
    if left > window:
        owed = count * ((left - window // 2) / whole)
        taken = np.floor(owed).astype(np.int64)
        left -= int((taken * length).sum())
        for i in np.argsort(taken - owed, kind="stable").tolist():  # one more of each, the most owed first
            if left - length[i] >= window // 2:
                taken[i] += 1
                left -= int(length[i])
    for i in np.argsort(-length, kind="stable").tolist() if left > window else ():  # only documents beyond the window are left
        more = min(int(count[i] - taken[i]), int(left // int(length[i])))
        taken[i] += more
        left -= more * int(length[i])
    if left > window:
        spare = np.flatnonzero(count > taken)
        i = spare[np.argmin(length[spare])]
        taken[i] += 2 * left > length[i]
        return taken
    return taken + reach(length, count - taken, left)


def _plan(window: int) -> Callable:
    """How often to take each length of a source as a whole, and how many documents once more."""

    def run(table: pa.Table) -> pa.Table:
        length, count = table["size"].to_numpy(), table["n"].to_numpy()
        target, whole = table["target"][0].as_py(), table["source_size"][0].as_py()
        times = int(min(target / whole, 1 << 30)) if whole else 0
        order = np.argsort(length)
        order = order[length[order] > 0]
        extra = np.zeros(len(length), np.int64)
        extra[order] = fit(length[order], count[order], target - times * whole, window)
        return pa.table({"source": table["source"], "size": table["size"], "n": table["n"], "source_size": table["source_size"], "target": table["target"], "times": pa.array(np.full(len(length), times)), "extra": pa.array(extra)})

    return run


# -- which documents -------------------------------------------------------------------------------


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"]) & (a["size"] == b["size"])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, window: int = WINDOW, per_range: int = RANGE) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of docs (doc_id, source, text)."""
    rows = written(counted(docs, seed), "counted")
    lengths = written(rows.groupBy("source", "size").agg(F.sum("m").alias("n")), "lengths")
    wanted = written(targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "targets")
    each = lengths.join(sent(wanted.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = written(each.groupBy("source").applyInArrow(_plan(window), "source string, size bigint, n bigint, source_size bigint, target double, times bigint, extra bigint"), "plan")
    ranges = F.ceil(F.col("n") / per_range)
    cut = F.floor(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) * ranges).cast("bigint")
    planned = rows.join(p := sent(plan), _same(rows, plan)).select("doc_id", rows["source"], "h", rows["size"], "m", *(p[c] for c in ("n", "source_size", "target", "times", "extra"))).withColumn("cut", cut)
    # the range of hashes in which a length's last document is: counts of ranges are added up, then documents within that range
    some = planned.filter("extra > 0 and extra < n").groupBy("source", "size", "cut").agg(F.sum("m").alias("k"), F.first("extra").alias("extra"))
    before = F.sum("k").over(Window.partitionBy("source", "size").orderBy("cut")) - F.col("k")
    edge = written(some.withColumn("before", before).filter("before < extra and before + k >= extra").select("source", "size", F.col("cut").alias("at"), (F.col("extra") - F.col("before")).alias("need")), "edge")
    near = planned.join(e := sent(edge), _same(planned, edge), "left").select(*(planned[c] for c in planned.columns), e["at"], e["need"])
    inside = near.filter("cut = at")
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("h", F.asc_nulls_first("doc_id"))) - F.col("m")
    inside = inside.withColumn("more", F.greatest(F.lit(0), F.least("m", F.col("need") - upto)))
    outside = near.filter("at is null or cut <> at").withColumn("more", F.when(F.col("extra") >= F.col("n"), F.col("m")).when((F.col("extra") > 0) & (F.col("cut") < F.col("at")), F.col("m")).otherwise(0))
    both = inside.unionByName(outside)
    # a row for each row of the table: those that are taken once more, and the others
    kinds = both.withColumn("kind", F.explode(F.array(F.struct((F.col("times") + 1).alias("copies"), F.col("more").alias("rows")), F.struct(F.col("times").alias("copies"), (F.col("m") - F.col("more")).alias("rows"))))).filter("kind.rows > 0")
    upto_ = lambda n: F.sequence(F.lit(0), n - 1)
    parts = kinds.withColumn("part", F.explode(upto_(F.ceil(F.col("kind.rows") / 1000)))).withColumn("i", F.explode(upto_(F.least(F.lit(1000), F.col("kind.rows") - F.col("part") * 1000))))
    return parts.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("kind.copies")).alias("taken"))


def report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken")
