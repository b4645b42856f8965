"""Operator 8 - quality by importance resampling.

Two generative models of hashed word n-grams are counted: of target texts (labelled good) and of all raw
texts.  A document's log ratio is log(target / raw) of its whole text: the sum over its n-grams.  Adding Gumbel noise and
taking the k largest samples k documents without replacement, in proportion to the ratio of the two models.
The noise is a hash of the document, so the sample can be repeated.

Raw counts cover all documents.  Target labels are learned from at most MAX_LABELLED documents, those
with the smallest hash of doc_id, so their ids go to all executors in bounded size.

Cases: a null or empty text has log ratio 0.  Equal keys at the last place are all taken, as are repeated
rows.  Without labels every log ratio is 0.  Null labels or ids teach nothing.  Empty tables give no rows.  A very long
text counts whole and is scanned alone; its log ratio is as large as it is long.  Columns besides those named, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.langid import held_out
from sparkassay.llm.store import written
from sparkassay.llm.words import NOT_SPACE, U64, Words, mix, scan

BITS = 14
MAX_LABELLED = 50_000
#: Share of all documents that the sample takes.
SHARE = 0.8
SEED = 1
#: Keys closer than this may tie.
RESOLUTION = 1e-9
_STEP = U64(0x9E3779B97F4A7C15)


def bins(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(bins of all words and word pairs, document of each)."""
    h, doc = w.hashes(), w.doc_of()
    inside = doc[1:] == doc[:-1]
    pairs = mix(h[:-1] * _STEP + h[1:])[inside]
    return (np.concatenate([h, pairs]) >> U64(64 - BITS)).astype(np.int64), np.concatenate([doc, doc[:-1][inside]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        target = batch.column("target").to_numpy(zero_copy_only=False)
        for w in scan(batch.column("text"), NOT_SPACE):
            bin_, doc = bins(w)
            counts[0] += np.bincount(bin_, minlength=1 << BITS)
            counts[1] += np.bincount(bin_[target[w.first + doc]], minlength=1 << BITS)
    model, bin_ = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(counts[model, bin_])], names=["model", "bin", "n"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> np.ndarray:
    """log(target / raw) of each bin."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("__good")).distinct()
    good = good.orderBy(F.xxhash64("__good"), "__good").limit(most)
    plain = pick(docs, doc_id="bigint", text="string")
    marked = plain.join(F.broadcast(good), F.col("doc_id") == F.col("__good"), "left").select("text", F.col("__good").isNotNull().alias("target"))
    found = marked.mapInArrow(_count, "model int, bin int, n bigint").groupBy("model", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[found["model"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
    if not counts[1].any():
        return np.zeros(1 << BITS)
    p = (counts + 1) / (counts + 1).sum(1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def _weigh(ratio: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for w in scan(batch.column("text"), NOT_SPACE):
                bin_, doc = bins(w)
                out[w.first : w.first + w.n] = np.bincount(doc, table[bin_], minlength=w.n)
            keep = [i for i, c in enumerate(batch.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(out)], names=[*(batch.schema.names[i] for i in keep), "log_ratio"])

    return run


def kth_largest(values: DataFrame, k: int, cells: int = 1 << 12) -> int:
    """The k-th largest of a column `rank_key` of whole numbers, by counts over ever finer ranges."""
    lo, hi = values.agg(F.min("rank_key"), F.max("rank_key")).first()
    above = 0
    while lo < hi:
        step = -(-(hi - lo + 1) // cells)
        inside = values.filter(F.col("rank_key").between(lo, hi))
        counts = dict(inside.groupBy(F.expr(f"(rank_key - {lo}) div {step}").alias("cell")).count().collect())
        for i in sorted(counts, reverse=True):
            if above + counts[i] >= k:
                lo, hi = lo + i * step, min(hi, lo + (i + 1) * step - 1)
                break
            above += counts[i]
    return lo


def sample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_ratio, gumbel_key, selected) of every row of docs (doc_id, text).

    labels (doc_id, quality) are the ones to learn from.  Keys are compared to RESOLUTION of their value.
    """
    spark = docs.sparkSession
    ratio = spark.sparkContext.broadcast(train(docs, labels))
    plain = pick(docs, doc_id="bigint", text="string")
    uniform = (F.pmod(F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)), F.lit((1 << 53) - 1)) + 1) / float(1 << 53)
    noisy = plain.withColumn("noise", -F.ln(-F.ln(uniform)))
    weighed = noisy.mapInArrow(_weigh(ratio), "doc_id bigint, noise double, log_ratio double")
    keyed = weighed.select("doc_id", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("gumbel_key"))
    keyed = written(keyed.withColumn("rank_key", F.floor(F.col("gumbel_key") / RESOLUTION).cast("bigint")), "keys")
    n = keyed.count()
    k = min(n, math.ceil(share * n))
    last = kth_largest(keyed, k) if k else 0
    return keyed.select("doc_id", "log_ratio", "gumbel_key", (F.col("rank_key") >= last).alias("selected"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, log_ratio, gumbel_key, selected; held-out documents' labels are not learned from."""
    known = labels.filter(~held_out(F.col("doc_id"), 4))
    return sample(docs, known).withColumn("held_out", held_out(F.col("doc_id"), 4))
