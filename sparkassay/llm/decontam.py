"""Operator 10 - benchmark contamination by a prefix-filtered set join on word shingles.

A window is `window` consecutive words of an item (an item with fewer is one window), taken as the set
of its word shingles.  Containment is exact, so one shingle is the whole necessary prefix: the rarest,
by its count over all documents.  Documents are joined on these prefix shingles only; the shingle's
place in the window and the document's bounds give the one span that can match (length and positional
filter), and the span's words are then compared with the window's.

1. rarity: every document counts the shingles that windows have; counts are summed by shingle.
2. candidates: where a prefix shingle stands in a document, the words that a window around it could cover are sent to
   the prefix table, by shingle.  A sketch of at most SKETCH bits, whatever the benchmark's size, goes to all
   executors and keeps nearly all other shingles at home; the join and the words decide.
3. hits: equal spans are gathered by the digest of the document's text, so texts are never shuffled for the search.
   Rows with one text have one result.

Cases: a null or empty text has no words and is clean.  Repeated documents get a row each.  Items with
a null id, or without words, take no part; repeated items count once.  Empty tables give no rows, or clean ones.  A very long
text is scanned by itself; its candidates are rows like any other's.  Other columns of documents, of any name, pass
through `contamination`; columns named like a result are replaced, and columns of items but item_id and text ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from sparkassay.llm.frames import carried, pick, with_columns
from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written
from sparkassay.llm.words import ALNUM, U64, mix, rows, scan

WINDOW = 13
SHINGLE = 4
#: A document is contaminated if at least one word in this many is hit.
RATIO = 20
#: Bits of a sketch: 64 a key, within these powers of two (32 MB at most).
SKETCH = (16, 28)
#: Rows of a table up to which it is sent to every executor, and bytes of their words on average.
SMALL, BYTES = 200_000, 200
#: Tasks that share the windows of one shingle where the prefix table is too large to be sent.
SALTS = 8
_STEP = U64(0x9E3779B97F4A7C15)


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of size words, given each word's hash; runs may cross documents."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    h = np.zeros(n, U64)
    for i in range(size):
        h = h * _STEP + words[i : i + n]
    return mix(h + U64(size))


# -- windows of items ----------------------------------------------------------------------


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, size, k, shingles): the windows of each item with the hashes of their k-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for w in scan(batch.column("text"), ALNUM):
                h = w.hashes()
                out: list[tuple] = []
                for d in range(w.n):
                    a, b = int(w.doc[d]), int(w.doc[d + 1])
                    if a == b or ids[w.first + d] is None:
                        continue
                    n = min(window, b - a)
                    k = min(shingle, n)
                    for i in range(a, b - n + 1):
                        out.append((ids[w.first + d], w.text(i, i + n).decode(), n, k, run_hashes(h[i : i + n], k).view(np.int64).tolist()))
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["item_id", "words", "size", "k", "shingles"])

    plain = pick(items, item_id="bigint", text="string")
    return plain.mapInArrow(run, "item_id bigint, words string, size int, k int, shingles array<bigint>")


# -- sketches ------------------------------------------------------------------------------


class Sketch:
    """A bit for the first bits of each key."""

    def __init__(self, bits: int, chunks: list[tuple[int, bytes]], sizes: list[int]) -> None:
        self.shift, self.sizes = U64(64 - bits), sizes
        self.table = np.zeros(1 << bits >> 3, np.uint8)
        for i, data in chunks:
            self.table[i * _CHUNK : (i + 1) * _CHUNK] = np.frombuffer(data, np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that may be keys."""
        at = hashes >> self.shift
        return np.flatnonzero(self.table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8) & 1)


#: Bytes of a part of a sketch that one group makes.
_CHUNK = 1 << 13


def _sketch(keys: DataFrame) -> Sketch:
    """The sketch of a written table (k, shingle); only its bits, at most SKETCH, come to the driver."""
    n, sizes = keys.count(), sorted(r["k"] for r in keys.select("k").distinct().collect())
    bits = min(max(SKETCH[0], 6 + n.bit_length()), SKETCH[1])
    at = F.shiftrightunsigned("shingle", 64 - bits)
    per = 8 * _CHUNK

    def run(key: tuple, table: pa.Table) -> pa.Table:
        made = np.zeros(per, bool)
        made[table["bit"].to_numpy()] = True
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([np.packbits(made, bitorder="little").tobytes()], pa.binary())})

    # distinct bits first: a group has no more than a chunk's
    bit = keys.select(F.floor(at / per).cast("bigint").alias("chunk"), (at % per).cast("int").alias("bit")).distinct()
    chunks = bit.groupBy("chunk").applyInArrow(run, "chunk bigint, data binary").collect()
    return Sketch(bits, [(r["chunk"], bytes(r["data"])) for r in chunks], sizes)


# -- documents -----------------------------------------------------------------------------


def _count(sketch: object) -> Callable:
    """How often shingles that windows may have stand in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sketch.value
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate([np.empty(0, U64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["shingle", "n"])

        for batch in batches:
            for w in scan(batch.column("text"), ALNUM):
                h = w.hashes()
                for k in known.sizes:
                    runs = run_hashes(h, k)
                    at = known.find(runs)
                    held.append(runs[at[at + k <= w.doc[np.searchsorted(w.doc, at, "right")]]])
            if sum(map(len, held)) > 1_000_000:
                yield flush()
        yield flush()

    return run


def _candidates(sketch: object, window: int) -> Callable:
    """The words around every place that a prefix shingle may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sketch.value
        for batch in rows(batches):
            for w in scan(batch.column("text"), ALNUM):
                h, out = w.hashes(), []
                digests: dict[int, bytes] = {}
                for k in known.sizes:
                    runs = run_hashes(h, k)
                    at = known.find(runs)
                    doc = np.searchsorted(w.doc, at, "right") - 1
                    inside = at + k <= w.doc[doc + 1]
                    at, doc = at[inside], doc[inside]
                    low = np.maximum(w.doc[doc], at - (window - k))
                    high = np.minimum(w.doc[doc + 1], at + window)
                    for a, d, x, y, key in zip(at.tolist(), doc.tolist(), low.tolist(), high.tolist(), runs[at].view(np.int64).tolist()):
                        if d not in digests:
                            digests[d] = _digest(batch.column("text")[w.first + d])
                        out.append((digests[d], key, x - int(w.doc[d]), a - x, w.text(x, y).decode()))
                if out:
                    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["digest", "shingle", "first", "before", "around"])

    return run


def _digest(text: pa.Scalar) -> bytes:
    return xxhash.xxh3_128_digest(text.as_buffer()) if text.is_valid else b""


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its text's digest; empty ones, which have no hits, get shorter numbers, so that no key gathers them."""
    from pyspark import TaskContext

    own = TaskContext.get().partitionId() << 40
    for batch in batches:
        digests = [_digest(x) if x.is_valid and x.as_py() else (own := own + 1).to_bytes(8) for x in batch.column("text")]
        yield with_columns(batch, ["digest"], [pa.array(digests, pa.binary())])


def hits(docs: DataFrame, items: DataFrame, window: int, shingle: int, small: int) -> DataFrame:
    """(digest, spans, items): of each text with an occurring window, the spans and the ids of their items."""
    spark = docs.sparkSession
    text = docs.select("text")
    owned = written(windows(items, window, shingle), "owned")
    # a window may be that of very many items: their ids are a table of their own, joined to what was found
    wins = written(owned.groupBy("words").agg(*(F.any_value(c).alias(c) for c in ("size", "k", "shingles"))), "windows")
    owners = owned.select("words", "item_id").distinct()
    shingles = written(wins.select("k", F.explode("shingles").alias("shingle")).distinct(), "shingles")
    counts = text.mapInArrow(tidy(_count(spark.sparkContext.broadcast(_sketch(shingles)))), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    each = wins.select("words", F.posexplode("shingles").alias("place", "shingle")).join(counts, "shingle", "left")
    prefix = each.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "shingle")).alias("p"))
    # a window whose rarest shingle stands nowhere does not occur
    prefix = written(wins.join(prefix.filter("p.n > 0"), "words").select("k", "p.shingle", "p.place", "size", "words"), "prefix")
    found = text.mapInArrow(tidy(_candidates(spark.sparkContext.broadcast(_sketch(prefix)), window)), "digest binary, shingle bigint, first bigint, before int, around string")
    n, size = prefix.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    if n <= small and size <= BYTES * small:
        joined = found.join(F.broadcast(prefix), "shingle")
    else:
        salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = found.withColumn("salt", F.pmod(F.xxhash64("digest", "first", "before"), F.lit(SALTS)).cast("int")).join(salted, ["shingle", "salt"])
    place = F.col("before") - F.col("place")
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(place, F.lit(0)) + 1, F.col("size")), " ") == F.col("words")
    spans = joined.filter((place >= 0) & same).select("digest", F.struct((F.col("first") + place).alias("start"), "size").alias("span"), "words").distinct()
    return spans.join(owners, "words").groupBy("digest").agg(F.collect_set("span").alias("spans"), F.collect_set("item_id").alias("items"))


def _judge(ratio: int) -> Callable:
    """Count words and what spans cover of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            words = np.zeros(batch.num_rows, np.int64)
            for w in scan(batch.column("text"), ALNUM):
                words[w.first : w.first + w.n] = w.counts()
            n_hit, items = np.zeros(batch.num_rows, np.int64), []
            for i, (spans, ids) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                end = 0
                for s in sorted(spans or (), key=lambda s: (s["start"], s["size"])):
                    to = s["start"] + s["size"]
                    n_hit[i] += max(0, to - max(end, s["start"]))
                    end = max(end, to)
                items.append(sorted(ids or ()))
            digest = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in items]
            yield with_columns(batch, _NAMES, [pa.array(words), pa.array(n_hit), pa.array(items, pa.list_(pa.int64())), pa.array(digest, pa.string()), pa.array((n_hit > 0) & (ratio * n_hit >= words))], without=("digest", "spans", "items"))

    return run


_ADDED = "n_words bigint, n_hit bigint, items array<bigint>, items_sha256 string, contaminated boolean"
_NAMES = [c.split()[0] for c in _ADDED.split(", ")]


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, ratio: int = RATIO, small: int = SMALL) -> DataFrame:
    """docs (doc_id, text, ...) with n_words, n_hit, items (ids found), items_sha256 and contaminated."""
    held = carried(docs, _ADDED)
    found = written(hits(held.df, items, window, shingle, small), "hits")
    keyed = held.df.mapInArrow(tidy(_keyed), StructType([*held.schema.fields, StructField("digest", BinaryType())]))
    few = found.agg(F.count("*"), F.coalesce(F.sum(F.size("spans") + F.size("items")), F.lit(0))).first()
    joined = keyed.join(F.broadcast(found) if max(few) <= small else found, "digest", "left")
    return held.to_arrow(_judge(ratio), _ADDED, joined)


def report(docs: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(pick(docs, doc_id="bigint", text="string"), items, **options)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items_sha256", "contaminated")
