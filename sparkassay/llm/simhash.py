"""Operator 7 - near-duplicate documents by SimHash and anchor-point covering.

The 64 bits are cut into BLOCKS parts.  Of two fingerprints within the threshold, some part differs
in at most threshold // BLOCKS bits.  Over each part a covering code is chosen as anchors: the direct
sum of a perfect Hamming code (covering radius 1) and all words of the bits left over.  A fingerprint
is at home at its nearest anchor, within the covering radius of 1, and is replicated to every anchor
within 1 + threshold // BLOCKS.  So of two linked fingerprints one is at home at an anchor that holds
the other, and comparing homes with replicas of each anchor finds every link.

Only distinct fingerprints are compared.  An anchor's comparison gives a spanning forest of its
links, never all pairs, and an anchor that holds more than TILE rows is compared in tiles.

Cases: null, empty and blank texts have fingerprint zero and link like any other.  Each row gets its
own result; rows with one doc_id share the smallest component.  A null doc_id links but is never the smallest.  A very
long text is scanned alone.  An empty table gives no rows.  Columns besides doc_id and text, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.components import components
from sparkassay.llm.fingerprints import simhash
from sparkassay.llm.frames import pick
from sparkassay.llm.store import written
from sparkassay.llm.words import U64

THRESHOLD = 4
#: Parts of a fingerprint.  3 suits up to some 10^8 distinct fingerprints; 2 makes 8 times the replicas
#: and a hundredth of the comparisons.  Both find every link.
BLOCKS = 3
#: Rows of one side of an anchor that are compared at once.
TILE = 4096
PAIRS = 1 << 22
#: Rows of the table of large anchors up to which it is sent to every executor.
SMALL = 100_000


# -- the code ------------------------------------------------------------------------------


@lru_cache
def _code(width: int) -> tuple[int, int]:
    """(m, n): the largest Hamming code of n = 2^m - 1 bits that fits width."""
    m = max(m for m in range(2, 7) if 2**m - 1 <= width)
    return m, 2**m - 1


@lru_cache
def _parity(m: int) -> np.ndarray:
    """Masks of the Hamming code's check bits: bit i - 1 is in check j if i has bit j."""
    return np.array([sum(1 << (i - 1) for i in range(1, 2**m) if i >> j & 1) for j in range(m)], U64)


def home(part: np.ndarray, width: int) -> np.ndarray:
    """The nearest anchor of each part value."""
    m, _ = _code(width)
    syndrome = np.zeros(len(part), np.int64)
    for j, mask in enumerate(_parity(m)):
        syndrome |= (np.bitwise_count(part & mask).astype(np.int64) & 1) << j
    flip = np.where(syndrome > 0, U64(1) << np.maximum(syndrome - 1, 0).astype(U64), U64(0))
    return part ^ flip


@lru_cache
def _ball(width: int, radius: int) -> np.ndarray:
    """All words of weight up to radius."""
    words = {0}
    for _ in range(radius):
        words |= {w ^ (1 << i) for w in words for i in range(width)}
    return np.array(sorted(words), U64)


@lru_cache
def _anchor_offsets(width: int, radius: int) -> list[np.ndarray]:
    """For each syndrome, what takes a value with it to every anchor within radius."""
    m, _ = _code(width)
    ball = _ball(width, radius)
    syndrome = np.zeros(len(ball), np.int64)
    for j, mask in enumerate(_parity(m)):
        syndrome |= (np.bitwise_count(ball & mask).astype(np.int64) & 1) << j
    return [ball[syndrome == s] for s in range(2**m)]


def anchors(part: np.ndarray, width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the value, anchor) for every anchor within radius of each part value."""
    m, _ = _code(width)
    syndrome = np.zeros(len(part), np.int64)
    for j, mask in enumerate(_parity(m)):
        syndrome |= (np.bitwise_count(part & mask).astype(np.int64) & 1) << j
    which, to = [], []
    for s, offsets in enumerate(_anchor_offsets(width, radius)):
        mine = np.flatnonzero(syndrome == s)
        which.append(np.repeat(mine, len(offsets)))
        to.append((part[mine][:, None] ^ offsets[None, :]).ravel())
    return np.concatenate(which), np.concatenate(to)


def parts(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each part."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


# -- tasks ---------------------------------------------------------------------------------


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(simhash(batch.column("text")).view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, fp bigint")


def _replicate(blocks: int, threshold: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                cut = batch.slice(at, 20_000)
                fp, node = cut.column("fp").to_numpy().view(U64), cut.column("node").to_numpy()
                for p, (shift, width) in enumerate(parts(blocks)):
                    part = (fp >> U64(shift)) & U64((1 << width) - 1)
                    which, anchor = anchors(part, width, 1 + threshold // blocks)
                    own = home(part, width)[which] == anchor
                    key = (anchor | U64(p) << U64(60)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[which].view(np.int64)), pa.array(node[which]), pa.array(own)], names=["anchor", "fp", "node", "home"])

    return run


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (u, v): each node to the smallest node it reaches."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    hangs = label != np.arange(len(nodes))
    return nodes[hangs], nodes[label[hangs]]


def _compare(threshold: int) -> Callable:
    """Compare homes with replicas of each anchor; a partition comes sorted by anchor and tile."""

    def links(fp: np.ndarray, node: np.ndarray, own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole groups; rows of a group stand together."""
        cuts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        sizes = np.diff(np.append(cuts, len(group)))
        homes = np.flatnonzero(own)
        of = np.searchsorted(cuts, homes, "right") - 1
        reps, first = sizes[of], cuts[of]
        us, vs = [], []
        ends = np.cumsum(reps)
        i = 0
        while i < len(homes):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            n = reps[i:j]
            x = np.repeat(homes[i:j], n)
            y = np.arange(int(n.sum())) + np.repeat(first[i:j] - (np.cumsum(n) - n), n)
            near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (node[x] != node[y])
            if near.any():
                u, v = _forest(node[x[near]], node[y[near]])
                us.append(u)
                vs.append(v)
            i = j
        if not us:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return _forest(np.concatenate(us), np.concatenate(vs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table[c].to_numpy() for c in ("anchor", "i", "j")]
            new = np.zeros(len(table), bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            group = np.cumsum(new)
            whole = len(table) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                u, v = links(table["fp"].to_numpy()[:whole].view(U64), table["node"].to_numpy()[:whole], table["home"].to_numpy()[:whole], group[:whole])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held = table.slice(whole).to_batches()
            rows = len(table) - whole

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 100_000:
                yield from flush(False)
        yield from flush(True)

    return run


def links(nodes: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) whose components are those of all links between rows of nodes (node, fp)."""
    spread = nodes.select("fp", "node").mapInArrow(_replicate(blocks, threshold), "anchor bigint, fp bigint, node bigint, home boolean")
    large = spread.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).filter(F.col("n") > tile)
    large = written(large.select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("gr"), F.ceil(F.col("h") / tile).cast("int").alias("gh")), "large")
    if large.count() <= SMALL:
        large = F.broadcast(large)
    tiled = spread.join(large, "anchor", "left").withColumns({"gr": F.coalesce("gr", F.lit(1)), "gh": F.greatest(F.coalesce("gh", F.lit(1)), F.lit(1))})
    # a home row meets every part of the replicas, and a replica every part of the homes
    own = F.pmod(F.xxhash64("fp"), F.col("gh")).cast("int")
    other = F.pmod(F.xxhash64("fp"), F.col("gr")).cast("int")
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("gr") - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("home"))))
    as_replica = F.transform(F.sequence(F.lit(0), F.col("gh") - 1), lambda i: F.struct(i.alias("i"), other.alias("j"), F.lit(False).alias("home")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home")))
    spots = F.when((F.col("gr") == 1) & (F.col("gh") == 1), single).otherwise(F.concat(F.coalesce(as_home, F.slice(as_replica, 1, 0)), as_replica))
    rows = tiled.select("anchor", "fp", "node", F.explode(spots).alias("t")).select("anchor", "t.i", "t.j", "fp", "node", "t.home")
    return rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").mapInArrow(_compare(threshold), "u bigint, v bigint")


def classes(docs: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text)."""
    marked = written(fingerprints(docs), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    # a fingerprint of null ids only still links others: it gets a number above all ids
    top = F.lit(1 << 62) + F.abs(F.xxhash64("fp") % (1 << 61))
    nodes = nodes.withColumn("node", F.coalesce("node", top))
    found = components(links(nodes, threshold, blocks))
    # one doc_id on rows with different fingerprints joins them
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") < (1 << 62), F.col("component_id")))
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return classes(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
