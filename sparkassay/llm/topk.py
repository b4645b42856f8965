"""Operator 9 - exact top-k by inner product of integer vectors.

Candidates are dealt to shards and queries to blocks; a task multiplies one block with one shard, in
tiles, and keeps each query's k best there.  The lists of a query are merged in a tree: over groups of
shards, then over all.  Products are exact: in 64-bit floats while no sum can reach 2^53, else in integers.

Cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null
id; vectors meet those of their own length only.  All rows with a query's id count as its own.  A query
id on several rows is one query, by the vector that sorts first.  Equal rows are candidates each.  A
score beyond 64 bits is cut to the nearest 64-bit number after ranking.  Empty tables give no rows.  Columns besides vec_id
and embedding, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
SCALE = 1024
#: Bytes of doubles of a shard and of a block of queries, at most; smaller tables have up to LEAST_SHARDS shards of SMALLEST rows.
SHARD, BLOCK, LEAST_SHARDS, SMALLEST = 128 << 20, 16 << 20, 64, 1024
#: Rows and columns of a tile.
TILE_QUERIES, TILE_ROWS = 256, 8192
#: Lists of shards that meet in the first merge.
FAN_IN = 32


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows of floor(SCALE * x): whole numbers as doubles, or as integers of any size where a double would overflow."""
    lists = vectors.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (np.abs(flat) > np.finfo(np.float64).max / SCALE).any():
        # a double this large is a whole number
        flat = np.array([int(x) * SCALE if abs(x) > 2**53 else math.floor(x * SCALE) for x in flat.tolist()], object)
    else:
        flat = np.floor(flat * SCALE)
    return flat.reshape(len(lists), -1) if len(lists) else np.empty((0, 0))


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    largest = lambda x: int(np.abs(x).max(initial=0))
    bound = largest(queries) * largest(rows) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries @ rows.T).astype(np.float64)
    exact = np.array([[int(x) for x in q] for q in queries], object).reshape(queries.shape) @ np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape).T
    return exact if bound >= 2**62 else exact.astype(np.int64)


def _beyond(score: int) -> bytes | None:
    """A score that 64 bits do not hold, as bytes that sort like the number."""
    if abs(score) < (1 << 63) - 1:
        return None
    size = abs(score).bit_length() // 8 + 1
    if score > 0:
        return b"\1" + size.to_bytes(4) + score.to_bytes(size)
    return b"\0" + ((1 << 32) - 1 - size).to_bytes(4) + ((1 << 8 * size) + score).to_bytes(size)


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query id, row id, score) of each query's k best rows; ties go to the smaller row id."""
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order], row_ids[order]
    out_q, out_r, out_s = [], [], []
    for a in range(0, len(queries), TILE_QUERIES):
        q, q_ids = queries[a : a + TILE_QUERIES], query_ids[a : a + TILE_QUERIES]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in range(0, len(rows), TILE_ROWS):
            ids = row_ids[b : b + TILE_ROWS]
            score = _products(q, rows[b : b + TILE_ROWS])
            other = q_ids[:, None] != ids[None, :]
            if score.dtype == object:
                at = [(i, j) for i in range(len(q)) for j in sorted(np.flatnonzero(other[i]).tolist(), key=lambda j, i=i: (-score[i, j], ids[j]))[:k]]
                x, y = (np.array([p[c] for p in at], np.int64) for c in (0, 1))
            else:
                low = np.iinfo(np.int64).min if score.dtype == np.int64 else -np.inf
                masked = np.where(other, score, low)
                n = min(k, masked.shape[1])
                least = np.partition(masked, masked.shape[1] - n, axis=1)[:, masked.shape[1] - n]
                x, y = np.nonzero(other & (masked >= least[:, None]))  # every tie with the last place
                s = score[x, y]
                first = np.lexsort((y, -s, x))
                x, y = x[first], y[first]
                place = np.arange(len(x)) - np.searchsorted(x, x)
                x, y = x[place < k], y[place < k]
            held.append((x, ids[y], score[x, y]))
        x, ids, s = (np.concatenate(c) for c in zip(*held)) if held else (np.empty(0, np.int64),) * 3
        values = s.tolist()
        rank = sorted(range(len(x)), key=lambda i: (x[i], -values[i], ids[i])) if s.dtype == object else np.lexsort((ids, -s, x))
        taken = dict.fromkeys(range(len(q)), 0)
        for i in rank:
            if taken[int(x[i])] < k:
                taken[int(x[i])] += 1
                out_q.append(int(q_ids[x[i]]))
                out_r.append(int(ids[i]))
                out_s.append(int(values[i]))
    return out_q, out_r, out_s


def _tile(k: int) -> Callable:
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = ([], [], [])
        if rows.num_rows and queries.num_rows:
            found = best(_matrix(queries["embedding"]), queries["vec_id"].to_numpy(), _matrix(rows["embedding"]), rows["vec_id"].to_numpy(), k)
        n, shard = len(found[0]), (rows if rows.num_rows else queries)["shard"][0].as_py()
        score = [max(-(1 << 63), min((1 << 63) - 1, x)) for x in found[2]]
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(score, pa.int64()), pa.array(list(map(_beyond, found[2])), pa.binary()), pa.array([shard] * n, pa.int32())], names=["query_id", "vec_id", "score", "beyond", "shard"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors for each row of queries (vec_id, embedding)."""
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min(F.struct("embedding", "dim")).alias("q")).select("vec_id", "q.*")
    size = lambda df: [x or 0 for x in df.agg(F.count("*"), F.sum(8 * F.greatest("dim", F.lit(1)).cast("bigint"))).first()]
    (n, wide), (_, asked_wide) = size(rows), size(asked)
    shards = max(-(-wide // SHARD), min(LEAST_SHARDS, -(-n // SMALLEST)), 1)
    blocks = max(-(-asked_wide // BLOCK), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    right = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    keys = ("dim", "shard", "block")
    cut = ("vec_id", "embedding", *keys)
    lists = left.select(*cut).groupBy(*keys).cogroup(right.select(*cut).groupBy(*keys)).applyInArrow(_tile(k), "query_id bigint, vec_id bigint, score bigint, beyond binary, shard int")
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("beyond"), F.asc("vec_id")))
    lists = lists.withColumn("group", (F.col("shard") / FAN_IN).cast("int"))
    merged = lists.withColumn("rank", rank("query_id", "group")).filter(F.col("rank") <= k)
    return merged.withColumn("rank", rank("query_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def report(vectors: DataFrame, k: int = K, every: int = 100) -> DataFrame:
    """The search for every row whose vec_id is divisible by `every`."""
    return search(vectors, vectors.filter(F.col("vec_id") % every == 0), k)
