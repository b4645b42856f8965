"""Operator 3 - removal of lines that many documents share.

A sharded minimal perfect hash over the distinct line hashes that recur indexes compact arrays of fingerprints,
counts and keepers; documents probe these arrays instead of joining their lines.

1. Each document gives its distinct line keys as 128-bit hashes; one aggregation, combined before its
   shuffle, counts the documents of each and finds the largest doc_id.
2. Hashes of two or more documents go to shards by their first bits; a task builds each shard's arrays.
3. While all arrays fit INDEX_BYTES they are broadcast and documents probe them where they are read: a line goes if its
   count reaches min_docs and its keeper is another.  Beyond it, each shard's arrays meet the line hashes of that
   shard only, split by salt.

Cases: a null or empty text is one empty line.  Each row is a document; rows that repeat a doc_id
count once each, and all rows of the largest doc_id keep the line.  A null doc_id counts as the
smallest.  An empty table gives no rows.  A very long text is cut by line and probed at once; its lines are held in memory, no
other document's are.  Other columns of any name pass through `dedup`; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import carried, pick, with_columns
from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written
from sparkassay.llm.words import mix
from sparkassay.llm.words import rows as few

MIN_CHARS, MIN_DOCS = 40, 5
#: Most bytes of arrays that are sent to every executor.
INDEX_BYTES = 32 << 20
#: Lines of fewer documents are in no array.
RECURS = 2
#: Line hashes of a shard, and probes that meet a shard in one task.
SHARD_KEYS, SHARD_PROBES = 200_000, 500_000
_BLANK = b" \t\n\x0b\x0c\r"
_NONE = -(1 << 63)
U64 = np.uint64


# -- minimal perfect hash ------------------------------------------------------------------


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(29))) * U64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> U64(32))) % U64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: in each level, a key alone in its place is settled
    there; the others go on.  A key's number is the rank of its place among all settled places."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.rank = []
        before = 0
        for taken in levels:
            self.rank.append(before + np.cumsum(taken, dtype=np.int64) - taken)
            before += int(taken.sum())

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = max(2, int(1.6 * len(keys)))
            at = _place(keys, len(levels), size)
            taken = np.bincount(at, minlength=size) == 1
            levels.append(taken)
            keys = keys[~taken[at]]
            assert len(levels) < 64, "keys must be distinct"
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number from 0; for a key not built in, any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (taken, rank) in enumerate(zip(self.levels, self.rank)):
            at = _place(keys[left], level, len(taken))
            hit = taken[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, bits: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            m = -(-n // 8)
            levels.append(np.unpackbits(np.frombuffer(bits, np.uint8, m, at), count=n).astype(bool))
            at += m
        return cls(levels)


class Shard:
    """One shard: the hash function and the arrays in its order."""

    def __init__(self, row: dict) -> None:
        self.hash, self.seed = PerfectHash.load(row["bits"], row["sizes"]), row["seed"]
        self.fingerprint = np.frombuffer(row["fingerprints"], U64)
        self.count = np.frombuffer(row["counts"], "<u4")
        self.keeper = np.frombuffer(row["keepers"], np.int64)

    def drops(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        """Whether documents lose the line hashes (a, b)."""
        at = self.hash.index(_fold(a, b, self.seed))
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        gone = (self.fingerprint[at] == b[hit]) & (self.count[at] >= min_docs) & (self.keeper[at] != doc[hit])
        out = np.zeros(len(a), bool)
        out[hit] = gone
        return out


def _fold(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Line hashes as one number each; another seed tells apart those that coincide."""
    return (mix(a + U64(seed)) if seed else a) ^ (b << U64(1))


_SHARD = "shard int, seed int, bits binary, sizes array<int>, fingerprints binary, counts binary, keepers binary"


def _build(key: tuple, table: pa.Table) -> pa.Table:
    a, b, n, keeper = (table[c].to_numpy() for c in ("a", "b", "n", "keeper"))
    a, b = a.view(U64), b.view(U64)
    seed, keys = 0, _fold(a, b, 0)
    while len(np.unique(keys)) < len(keys):  # the hashes themselves are distinct
        seed += 1
        keys = _fold(a, b, seed)
    function = PerfectHash.of(keys)
    order = np.empty(len(keys), np.int64)
    order[function.index(keys)] = np.arange(len(keys))
    bits, sizes = function.dump()
    row = {"shard": [key[0].as_py()], "seed": [seed], "bits": [bits], "sizes": [sizes], "fingerprints": [b[order].tobytes()], "counts": [np.minimum(n[order], (1 << 32) - 1).astype("<u4").tobytes()], "keepers": [keeper[order].tobytes()]}
    return pa.table(row, pa.schema([("shard", pa.int32()), ("seed", pa.int32()), ("bits", pa.binary()), ("sizes", pa.list_(pa.int32())), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("keepers", pa.binary())]))


# -- documents -----------------------------------------------------------------------------


def _keys(text: str | None, min_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """(lines, numbers of those long enough, their 16-byte hashes)."""
    lines = (text or "").encode().split(b"\n")
    at, hashes = [], []
    for i, line in enumerate(lines):
        key = line.strip(_BLANK)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, at, hashes


def _halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 2).astype(U64)
    return both[:, 0].copy(), both[:, 1].copy()


def _distinct(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
            found = [list(dict.fromkeys(_keys(t, min_chars)[2])) for t in batch.column("text").to_pylist()]
            a, b = _halves([h for x in found for h in x])
            doc = np.repeat(ids, [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(doc)], names=["a", "b", "doc_id"])

    return run


def line_counts(docs: DataFrame, min_chars: int, least: int) -> DataFrame:
    """(a, b, n, keeper): hashes of lines in at least so many documents."""
    lines = docs.mapInArrow(tidy(_distinct(min_chars)), "a bigint, b bigint, doc_id bigint")
    return lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).filter(F.col("n") >= least)


def _result(texts: list, ids: np.ndarray, min_chars: int, drops: Callable) -> tuple[list, list, list]:
    """(lines, lines dropped, kept text) of each document; drops tells which hashes of which ids go."""
    cut = [_keys(t, min_chars) for t in texts]
    a, b = _halves([h for x in cut for h in x[2]])
    gone = drops(a, b, np.repeat(ids, [len(x[2]) for x in cut]))
    n, dropped, kept, at = [], [], [], 0
    for lines, numbers, hashes in cut:
        out = {i for i, g in zip(numbers, gone[at : at + len(hashes)]) if g}
        at += len(hashes)
        n.append(len(lines))
        dropped.append(len(out))
        kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in out) if out else b"\n".join(lines))
    return n, dropped, kept


_ADDED = "n_lines bigint, n_dropped bigint, kept_text string"


def _append(batch: pa.RecordBatch, n: list, dropped: list, kept: list) -> pa.RecordBatch:
    text = pa.array(kept, pa.binary()).cast(pa.string())
    return with_columns(batch, ["n_lines", "n_dropped", "kept_text"], [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), text], without=("row", "gone"))


def _probe_all(rows: object, shards: int, min_chars: int, min_docs: int) -> Callable:
    """Probe broadcast arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {r["shard"]: Shard(r) for r in rows.value}

        def drops(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> np.ndarray:
            gone, shard = np.zeros(len(a), bool), a.view(np.int64) % shards
            for s, x in index.items():
                mine = np.flatnonzero(shard == s) if shards > 1 else np.arange(len(a))
                gone[mine] = x.drops(a[mine], b[mine], doc[mine], min_docs)
            return gone

        for batch in few(batches):
            ids = batch.column("doc_id").fill_null(_NONE).to_numpy()
            yield _append(batch, *_result(batch.column("text").to_pylist(), ids, min_chars, drops))

    return run


def _requests(shards: int, min_chars: int) -> Callable:
    """Line hashes of each document, dealt to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            row = batch.column("row").to_numpy()
            found = [_keys(t, min_chars)[2] for t in batch.column("text").to_pylist()]
            a, b = _halves([h for x in found for h in x])
            per = [len(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array((a.view(np.int64) % shards).astype(np.int32)), pa.array(np.repeat(row, per)), pa.array(np.repeat(batch.column("doc_id").fill_null(_NONE).to_numpy(), per)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                names=["shard", "row", "doc_id", "a", "b"],
            )

    return run


def _answer(min_docs: int) -> Callable:
    """Probe one shard: the hashes of each row that its document loses."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = pa.schema([("row", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        shard = Shard(right.slice(0, 1).to_pylist()[0])
        a, b, doc = (left[c].to_numpy() for c in ("a", "b", "doc_id"))
        return left.filter(pa.array(shard.drops(a.view(U64), b.view(U64), doc, min_docs))).select(["row", "a", "b"]).cast(kinds)

    return run


def _apply(min_chars: int) -> Callable:
    """Drop the answered hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            gone = batch.column("gone").to_pylist()
            texts = batch.column("text").to_pylist()
            n, dropped, kept = [], [], []
            for text, out in zip(texts, gone):
                lost = {(x["a"], x["b"]) for x in out or ()}

                def drops(a: np.ndarray, b: np.ndarray, _: np.ndarray, lost: set = lost) -> np.ndarray:
                    return np.fromiter(((x, y) in lost for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())), bool, len(a))

                x, y, z = _result([text], np.zeros(1, np.int64), min_chars, drops)
                n += x
                dropped += y
                kept += z
            yield _append(batch, n, dropped, kept)

    return run


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs (doc_id, text, ...) with n_lines, n_dropped and kept_text."""
    spark = docs.sparkSession
    two = pick(docs, doc_id="bigint", text="string")
    counts = written(line_counts(two, min_chars, min(RECURS, min_docs)), "lines")
    keys = counts.count()
    shards = max(1, -(-keys // SHARD_KEYS))
    index = written(counts.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, _SHARD), "index")
    held = carried(docs, _ADDED)
    size = index.agg(F.sum(sum((F.length(c) for c in ("bits", "fingerprints", "counts", "keepers")), F.lit(0)))).first()[0] or 0
    if size <= index_bytes:
        rows = spark.sparkContext.broadcast([r.asDict() for r in index.collect()])
        return held.to_arrow(_probe_all(rows, shards, min_chars, min_docs), _ADDED)
    probes = held.df.withColumn("row", F.monotonically_increasing_id())
    probes = written(probes, "documents")  # row numbers must not change between the two readings
    lines = written(probes.mapInArrow(_requests(shards, min_chars), "shard int, row bigint, doc_id bigint, a bigint, b bigint"), "probes")
    # a shard with a hot line is met by its probes in as many tasks as they need
    salts = lines.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_PROBES).cast("int").alias("salts"))
    salted = lines.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).drop("salts")
    spread = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    gone = salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(_answer(min_docs), "row bigint, a bigint, b bigint")
    gone = gone.groupBy("row").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    return held.to_arrow(_apply(min_chars), _ADDED, probes.join(gone, "row", "left"))


def report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    return dedup(pick(docs, doc_id="bigint", text="string"), **options).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
