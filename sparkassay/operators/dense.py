"""Exact search of the greatest inner products, by clusters that bound what is in them.

Pivots are a bounded sample of the vectors.  Each vector goes to its nearest pivot; a block holds vectors of one pivot, those of the
smallest distances d to it first, so that one number bounds them all: q.v <= q.pivot + |q| d, and q.v <= |q| |v|.  Pivots
are vectors too, so the k-th best of them is a first bound of a question's k-th score.  Blocks that cannot reach it, or what a
task has found since, are not opened for the question; in an opened one the nearer vectors than the bound allows are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.sources.shared import written

#: Pivots at most; vectors of a block on average; questions of a turn.
PIVOTS, BLOCK, TURN = 1024, 2048, 4096
SLACK = 1e-5
_BLOCK = "pivot int, far double, longest double, ids array<bigint>, away array<double>, flat array<double>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, width)


def _near(pivots: object) -> Callable:
    """Each vector's nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        half = (p * p).sum(1) / 2
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cut = batch.slice(at, 1000)
                v = _matrix(cut.column("v"), p.shape[1])
                near = np.argmax(v @ p.T - half, axis=1).astype(np.int32) if len(v) else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([cut.column("vec_id"), cut.column("v"), pa.array(near)], names=["vec_id", "v", "pivot"])

    return run


def _pack(pivots: object, block: int) -> Callable:
    """Blocks of a partition sorted by pivot and piece; a piece is at most some block's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def made(table: pa.Table) -> pa.RecordBatch:
            v, which = _matrix(table["v"].combine_chunks(), p.shape[1]), table["pivot"][0].as_py()
            away = np.sqrt(((v - p[which]) ** 2).sum(1))
            order = np.argsort(-away, kind="stable")
            lists = [pa.array([x]) for x in (table["vec_id"].to_numpy()[order], away[order], v[order].ravel())]
            return pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([float(away.max())]), pa.array([float(np.sqrt((v * v).sum(1)).max())]), *lists], names=names)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            key = table["pivot"].to_numpy() * np.int64(1 << 32) + table["piece"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist()]
            for a, z in zip(cuts, cuts[1:]):
                yield from (made(table.slice(x, min(block, z - x))) for x in range(a, z, block))
            held = table.slice(cuts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from (made(table.slice(x, block)) for x in range(0, len(table), block))

    return run


def clustered(vectors: DataFrame, pivots: np.ndarray, block: int) -> DataFrame:
    """Blocks of vectors (vec_id, v)."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)
    near = written(vectors.mapInArrow(_near(sent), "vec_id bigint, v array<double>, pivot int"))
    # a pivot's vectors are dealt to pieces, so that none is gathered, however many are alike
    pieces = near.groupBy("pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("pieces"))  # as many rows as pivots
    dealt = near.join(F.broadcast(pieces), "pivot").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("pieces")).cast("int"))
    return written(dealt.select("vec_id", "v", "pivot", "piece").repartition("pivot", "piece").sortWithinPartitions("pivot", "piece").mapInArrow(_pack(sent, block), _BLOCK))


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits


def _search(model: object, k: int, digits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, ids, own, q, least = model.value
        least, length, seen = least.copy(), np.sqrt((q * q).sum(1)), 0
        to_pivot = q @ pivots.T if len(pivots) else np.empty((len(q), 0))
        best: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                c, far, longest = (row[x].as_py() for x in ("pivot", "far", "longest"))
                ask = np.flatnonzero(np.minimum(to_pivot[:, c] + length * far, length * longest) >= least)
                if not len(ask):
                    continue
                vec, away = row["ids"].values.to_numpy(), row["away"].values.to_numpy()
                # so far from the pivot a vector must be to matter for some question
                beyond = np.where(length[ask] > 0, (least[ask] - to_pivot[ask, c]) / np.maximum(length[ask], 1e-300), -np.inf).min()
                n = int(np.searchsorted(-away, -beyond, "right")) if beyond > 0 else len(vec)
                v = row["flat"].values.to_numpy().reshape(len(vec), -1)[:n]
                found = rounded(q[ask] @ v.T, digits)
                seen += found.size
                for x, i in enumerate(ask.tolist()):
                    keep = np.flatnonzero((found[x] >= least[i]) & (vec[:n] != own[i]))
                    if len(keep) > 4 * k:
                        keep = keep[found[x, keep] >= np.partition(found[x, keep], len(keep) - k)[len(keep) - k]]
                    if len(keep):
                        order = keep[np.lexsort((vec[keep], -found[x, keep]))[:k]]
                        best[i] = sorted(best[i] + [(-float(found[x, y]), int(vec[y])) for y in order])[:k]
                        if len(best[i]) == k:
                            least[i] = max(least[i], -best[i][-1][0] - SLACK)
        rows = [(ids[i], v, -s) for i, held in enumerate(best) for s, v in held]
        yield pa.RecordBatch.from_pydict({"question_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64()), "scored": pa.array([seen] * len(rows), pa.int64())})

    return run


def found(vectors: DataFrame, asked: DataFrame, k: int, digits: int = 6, pivots: int = PIVOTS, block: int = BLOCK, turn: int = TURN) -> DataFrame | None:
    """(question_id, vec_id, score, scored): each task's best; scored is how many pairs it has computed.  None without vectors."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(7)), "vec_id").limit(pivots).toArrow()  # a bounded sample
    if not len(sample):
        return None
    # a third of all may be one vector: pivots are different
    width = len(sample["v"][0])
    p, first = np.unique(_matrix(sample["v"].combine_chunks(), width), axis=0, return_index=True)
    names = sample["vec_id"].to_numpy()
    blocks = clustered(vectors, p, block)
    turns, out = max(1, math.ceil(asked.count() / turn)), None
    for t in range(turns):
        rows = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(turns)) == t).toArrow()
        q = _matrix(rows["q"].combine_chunks(), width) if len(rows) else np.empty((0, width))
        own = rows["own"].to_numpy(zero_copy_only=False)
        score = np.where(names[first][None, :] == own[:, None], -np.inf, q @ p.T)
        least = np.partition(score, len(p) - k, axis=1)[:, len(p) - k] - SLACK if len(p) >= k else np.full(len(q), -np.inf)
        model = spark.sparkContext.broadcast((p, rows["question_id"].to_pylist(), own, q, least))
        some = blocks.mapInArrow(_search(model, k, digits), "question_id bigint, vec_id bigint, score double, scored bigint")
        out = some if out is None else out.unionByName(some)
    return out


def search(vectors: DataFrame, asked: DataFrame, k: int, digits: int = 6, **options: int) -> DataFrame:
    """(question_id, rank, vec_id, score): the k best of vectors (vec_id, v) for asked (question_id, own, q), but for vec_id own.

    Vectors are as long as the questions' and hold numbers only.  Scores are rounded before ranking, ties go to the smaller id.
    """
    rows = found(vectors, asked, k, digits, **options)
    if rows is None:
        rows = asked.sparkSession.createDataFrame([], "question_id bigint, vec_id bigint, score double, scored bigint")
    order = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")).cast("bigint")
    part = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(32))).withColumn("rank", order("question_id", "part")).filter(F.col("rank") <= k)
    return part.withColumn("rank", order("question_id")).filter(F.col("rank") <= k).select("question_id", "rank", "vec_id", "score")
