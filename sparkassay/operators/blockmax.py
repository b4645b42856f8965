"""Ranked search by blocks of postings with their greatest scores.

A block holds the postings of some documents, term by term, and of each term the greatest share of its weight that a document of the
block has.  The heaviest terms of a question are added up first.  What all lighter terms could add at most, by the block's
greatest shares, tells when no new document can reach the k-th score so far, and from then on which of the documents found
still can: only these are looked up in the lighter terms, and fewer with each.  A block whose terms together cannot reach
it is not opened.

Blocks are made where texts are read and are searched where they lie, each sealed as one compressed value and opened by itself; what moves is counts of terms and, of each task, the k best
of each question, merged in two steps.  Questions go in turns of a bounded number of terms, so what is sent is bounded too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.sources.shared import written

#: Documents of a block at most, and terms of a turn's questions (about: a question goes whole).
BLOCK, TURN = 4096, 500_000
#: What rounding may hide between a bound and a score.
SLACK = 1e-6
#: Parts in which a question's best are merged first.
PARTS = 32
#: Tokens of a block's documents that are numbered at once (about: a document goes whole).
TOKENS = 250_000
_BLOCKS = "block binary, terms array<bigint>, ends array<bigint>, n bigint, words bigint"
_POSTINGS = ("docs", "lens", "terms", "ends", "places", "tfs")


def _sealed(arrays: list[pa.Array]) -> bytes:
    """A block's arrays, compressed: a task is sent all of its blocks at once and opens one after the other."""
    row = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays], names=list(_POSTINGS))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, row.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(row)
    return out.getvalue().to_pybytes()


def _opened(block: pa.BinaryScalar) -> tuple[np.ndarray, ...]:
    row = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
    docs, *rest = (row.column(c)[0].values for c in _POSTINGS)
    return docs.fill_null(_NONE).to_numpy(), *(x.to_numpy() for x in rest)


def _pack(vocabulary: object, block: int) -> Callable:
    """Blocks of documents: terms with the ends of their postings, (place, tf).  A task's last row has its counts: terms, ends as
    documents with each, n documents and words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary.value, pa.string())
        df, n, words = np.zeros(len(known), np.int64), 0, 0
        schema = pa.schema([("block", pa.binary()), ("terms", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n", pa.int64()), ("words", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                cut = batch.slice(at, block)
                tokens, docs = cut.column("tokens"), cut.column("doc_id")
                length = np.nan_to_num(tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                ends = np.cumsum(length)
                keys, tfs, i = [], [], 0
                while i < cut.num_rows:
                    j = max(i + 1, int(np.searchsorted(ends, ends[i] - length[i] + TOKENS, "right")))
                    found = pc.index_in(tokens.slice(i, j - i).flatten(), known).fill_null(-1).to_numpy()
                    mine = found >= 0
                    key, tf = np.unique(found[mine].astype(np.int64) * cut.num_rows + np.repeat(np.arange(i, j), length[i:j])[mine], return_counts=True)
                    keys.append(key)
                    tfs.append(tf.astype(np.int32))
                    i = j
                key, tf = np.concatenate(keys), np.concatenate(tfs)
                order = np.argsort(key, kind="stable")
                key, tf = key[order], tf[order]
                terms, counts = np.unique(key // cut.num_rows, return_counts=True)
                df[terms] += counts
                n, words = n + cut.num_rows, words + int(length.sum())
                held = _sealed([docs, pa.array(length), pa.array(terms), pa.array(np.cumsum(counts), pa.int64()), pa.array(key % cut.num_rows, pa.int32()), pa.array(tf)])
                yield pa.RecordBatch.from_pylist([{"block": held}], schema)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pylist([{"terms": some, "ends": df[some], "n": n, "words": words}], schema)
        pa.default_memory_pool().release_unused()

    return run


@dataclass
class Asked:
    """The questions of a turn: question i has terms[ends[i-1]:ends[i]] with their weights."""

    ids: list
    ends: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


class Best:
    """The k best documents so far of each question, and how many pairs were scored in full."""

    def __init__(self, questions: int, k: int) -> None:
        self.k = k
        self.rows: list[list[tuple]] = [[] for _ in range(questions)]
        self.scored = 0

    def least(self, i: int) -> float:
        return -self.rows[i][-1][0] - SLACK if len(self.rows[i]) == self.k else 0.0

    def add(self, i: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """docs, null last, of equal scores the smaller first."""
        self.scored += len(scores)
        keep = np.flatnonzero((scores >= self.least(i)) & (scores > 0))
        if len(keep) > 4 * self.k:  # the first k in order are among those from the k-th score on
            keep = keep[scores[keep] >= -np.partition(-scores[keep], self.k - 1)[self.k - 1]]
        if len(keep):
            order = np.lexsort((docs[keep], -scores[keep]))[: self.k]
            self.rows[i] = sorted(self.rows[i] + [(-float(scores[x]), float(docs[x] == _NONE), int(docs[x])) for x in keep[order]])[: self.k]


_NONE = np.iinfo(np.int64).max


def scan(block: tuple[np.ndarray, ...], asked: Asked, best: Best, avgdl: float, k1: float, b: float, digits: int) -> None:
    """Rank a block's documents for every question."""
    docs, lens, terms, ends, places, tfs = block
    if not len(terms):
        return
    share = (k1 + 1) * tfs / (tfs + k1 * (1 - b + b * lens[places] / max(1.0, avgdl)))
    starts = np.append(0, ends[:-1])
    top = np.maximum.reduceat(share, starts)
    at = np.minimum(np.searchsorted(terms, asked.terms), len(terms) - 1)
    held = terms[at] == asked.terms
    most = np.where(held, asked.weights * top[at], 0.0)
    first, scale = 0, 10.0**digits
    for i, last in enumerate(asked.ends.tolist()):
        order = first + np.argsort(-most[first:last], kind="stable")
        order = order[held[order]]
        first = last
        left = np.append(np.cumsum(most[order][::-1])[::-1], 0.0)  # what a term and all lighter ones add at most
        need = best.least(i)
        if not len(order) or left[0] < need:
            continue
        total = np.zeros(len(docs))

        def whole(y: int) -> None:
            x = at[order[y]]
            total[places[starts[x] : ends[x]]] += asked.weights[order[y]] * share[starts[x] : ends[x]]

        def looked_up(y: int, of: np.ndarray) -> np.ndarray:
            """What the documents `of` have of a term."""
            x = at[order[y]]
            own = places[starts[x] : ends[x]]
            spot = np.minimum(np.searchsorted(own, of), len(own) - 1)
            return np.where(own[spot] == of, asked.weights[order[y]] * share[starts[x] + spot], 0.0)

        j, k = 0, best.k
        if need <= 0 and len(docs) > 8 * k:  # no bound yet: the documents with most of the heavier half give one
            while j < len(order) and 2 * left[j] > left[0]:
                whole(j)
                j += 1
            some = np.sort(np.argpartition(-total, 4 * k)[: 4 * k])
            full = total[some] + sum(looked_up(y, some) for y in range(j, len(order)))
            need = np.partition(full, len(full) - k)[len(full) - k] - SLACK
        while j < len(order) and left[j] >= need:  # a document may still start here
            whole(j)
            j += 1
        found = np.flatnonzero((total > 0) & (total + left[j] >= need))
        for y in range(j, len(order)):
            if not len(found):
                break
            total[found] += looked_up(y, found)
            found = found[total[found] + left[y + 1] >= need]
        best.add(i, np.floor(total[found] * scale + 0.5) / scale, docs[found])


def _search(model: object, k: int, k1: float, b: float, digits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, avgdl = model.value
        best = Best(len(asked.ids), k)
        for batch in batches:
            for r in range(batch.num_rows):
                scan(_opened(batch.column("block")[r]), asked, best, avgdl, k1, b, digits)
        rows = [(asked.ids[i], None if none else doc, -score) for i, held in enumerate(best.rows) for score, none, doc in held]
        yield pa.RecordBatch.from_pydict({"question_id": pa.array([r[0] for r in rows], pa.int64()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64()), "scored": pa.array([best.scored] * len(rows), pa.int64())})
        pa.default_memory_pool().release_unused()

    return run


def idf(n: int, df: int) -> float:
    return math.log(1 + (n - df + 0.5) / (df + 0.5))


def _turn(docs: DataFrame, asked: DataFrame, k: int, digits: int, k1: float, b: float, block: int) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.select("question_id", "term", "mult").toArrow().sort_by("question_id")  # a turn's at most
    known = sorted(set(rows["term"].to_pylist()))
    blocks = written(docs.mapInArrow(_pack(spark.sparkContext.broadcast(known), block), _BLOCKS))
    counts = blocks.filter("n is not null")
    n, words = counts.agg(F.sum("n"), F.sum("words")).first()
    df = np.zeros(len(known), np.int64)
    each = counts.select(F.explode(F.arrays_zip("terms", "ends")).alias("x")).groupBy("x.terms").agg(F.sum("x.ends").alias("df")).toArrow()
    df[each["terms"].to_numpy()] = each["df"].to_numpy()
    number = {t: i for i, t in enumerate(known)}
    term = np.array([number[t] for t in rows["term"].to_pylist()], np.int64)
    heft = np.array([idf(n, x) if x else 0.0 for x in df.tolist()])
    ids, ends = np.unique(rows["question_id"].to_numpy(), return_counts=True)
    held = Asked(ids.tolist(), np.cumsum(ends), term, rows["mult"].to_numpy() * heft[term])
    model = spark.sparkContext.broadcast((held, words / n if n else 0.0))
    return blocks.filter("n is null").mapInArrow(_search(model, k, k1, b, digits), "question_id bigint, doc_id bigint, score double, scored bigint")


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def found(docs: DataFrame, asked: DataFrame, k: int, digits: int = 8, k1: float = 1.5, b: float = 0.75, turn: int = TURN, block: int = BLOCK) -> DataFrame:
    """(question_id, doc_id, score, scored): each task's k best of each question, and how many pairs it scored in full."""
    turns = max(1, math.ceil(asked.count() / turn))
    out = None
    for t in range(turns):
        mine = asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(turns)) == t)
        some = _turn(docs, mine, k, digits, k1, b, block)
        out = some if out is None else out.unionByName(some)
    return out


def search(docs: DataFrame, asked: DataFrame, k: int, digits: int = 8, k1: float = 1.5, b: float = 0.75, turn: int = TURN, block: int = BLOCK) -> DataFrame:
    """(question_id, rank, doc_id, score): docs (doc_id, tokens) ranked for asked (question_id, term, mult)."""
    rows = found(docs, asked, k, digits, k1, b, turn, block)
    parts = _best(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), k, "question_id", "part")
    return _best(parts, k, "question_id").select("question_id", "rank", "doc_id", "score")
