"""Operator 13 - ranked lexical search of many questions at once, with what they share computed once.

Questions (items) come in blocks.  In a block, sets of terms that several items share are mined: terms that the same items hold are
one sum, then the pair of sums that most items hold becomes a sum of its own, again and again.  What is left of each item is added
up to its root.  So a block is a graph of sums over (term, repeats in the item), which items share.  For a slice of documents the
accumulators of all terms are laid down once, then those of the sums layer by layer, each once, however many items use it; the
roots are the scores.

Texts are taken apart once: a document leaves its terms that any item asks for, a task its counts of them.  Items go in turns of a
bounded number of terms, so that what is sent to executors is bounded too; a turn more is a scan more.  Tasks send on the k best of
each item, which are merged in two steps.

Scores are whole numbers, the same in any order of sums.

Cases: a null or empty text has no terms and is found by none.  Rows of one item_id are one item with all their terms, rows without
one ask for nothing.  Rows of one doc_id are documents of their own and are ranked each, as are those without a doc_id, which come
last of equals.  Long texts are scanned alone.  Empty tables give no rows.  Columns are found by name as
`frames.pick` has it; others, whatever their names, take no part.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written
from sparkassay.llm.words import ALNUM, U64, Words, scan

K = 10
#: Terms of a block of items and of a turn (about: items are dealt whole).
BLOCK, TURN = 20_000, 500_000
#: Sums of an item that are looked at in pairs, the most shared first; others are only shared as they are.
PAIRED = 200
#: Accumulators (8 bytes each) that a slice of documents has at once.
CELLS = 1 << 22
#: Parts that an item's best are merged in, before all of them are.
PARTS = 32
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


# -- words that are asked for ----------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Terms in order of their hashes, told apart by their bytes."""

    hashes: np.ndarray
    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    ids: dict[str, int]
    #: The most terms of one hash.
    deep: int

    @classmethod
    def of(cls, terms: list[str]) -> Vocabulary:
        raw = [t.encode() for t in terms]
        data = np.frombuffer(b"".join(raw) + bytes(8), np.uint8)
        size = np.array([len(x) for x in raw], np.int64)
        start = np.cumsum(size) - size
        h = Words(0, 1, data[:-8], start, start + size, np.array([0, len(raw)])).hashes()
        order = np.argsort(h, kind="stable")
        h = h[order]
        return cls(h, data, start[order], size[order], {terms[i]: n for n, i in enumerate(order.tolist())}, max(Counter(h.tolist()).values(), default=0))

    def find(self, w: Words) -> np.ndarray:
        """The number of each word's term, or -1."""
        h, size = w.hashes(), w.end - w.start
        out = np.full(len(h), -1)
        first = np.searchsorted(self.hashes, h)
        buf = np.concatenate([w.buf, np.zeros(8, np.uint8)])
        for deeper in range(self.deep):
            at = np.minimum(first + deeper, len(self.hashes) - 1)
            ask = np.flatnonzero((self.hashes[at] == h) & (self.size[at] == size) & (out < 0))
            out[ask[self._same(buf, w.start[ask], at[ask])]] = 1
            out[ask] = np.where(out[ask] == 1, at[ask], -1)
        return out

    def _same(self, buf: np.ndarray, start: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Whether the bytes from each start are those of the term."""
        if not len(start):
            return np.empty(0, bool)
        runs = (self.size[term] + 7) // 8
        first = np.cumsum(runs) - runs
        place = 8 * (np.arange(int(runs.sum())) - np.repeat(first, runs))
        eight = lambda x: np.ndarray((len(x) - 7,), np.dtype("<u8"), x, 0, (1,))
        left = np.repeat(self.size[term], runs) - place
        mask = np.where(left >= 8, U64(2**64 - 1), (U64(1) << (8 * np.minimum(left, 7)).astype(U64)) - U64(1))
        a, b = eight(buf)[np.repeat(start, runs) + place], eight(np.ascontiguousarray(self.data))[np.repeat(self.start[term], runs) + place]
        return np.logical_and.reduceat((a & mask) == (b & mask), first)


def _take(words: object) -> Callable:
    """kind 0: a document's length and terms with their counts.  kind 1: a task's documents, words, and documents with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Vocabulary = words.value
        total = len(known.hashes)
        df, docs, length = np.zeros(total, np.int64), 0, 0
        names = ["kind", "doc_id", "n", "terms", "counts"]
        for batch in batches:
            ids = batch.column("doc_id")
            for w in scan(batch.column("text"), ALNUM):
                n, found = w.counts(), known.find(w) if total else np.full(len(w.start), -1)
                hit = np.flatnonzero(found >= 0)
                key, tf = np.unique(w.doc_of()[hit] * max(total, 1) + found[hit], return_counts=True)
                doc, term = key // max(total, 1), key % max(total, 1)
                df += np.bincount(term, minlength=total)
                docs, length = docs + int((n > 0).sum()), length + int(n.sum())
                cuts = pa.array(np.searchsorted(doc, np.arange(w.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int64))) for x in (term, tf)]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(w.n, np.int32)), ids.slice(w.first, w.n), pa.array(n), *lists], names=names)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([docs]), pa.array([length]), pa.array([some]), pa.array([df[some]])], names=names)

    return run


# -- what items share ------------------------------------------------------------------------------


def share(items: list[list[int]], leaves: int) -> tuple[list[tuple[int, int]], list[int]]:
    """(sums, roots): a graph of sums of two nodes; sum i is node leaves + i.  An item is a set of leaves, its root their sum."""
    sums: list[tuple[int, int]] = []

    def add(a: int, b: int) -> int:
        sums.append((a, b))
        return leaves + len(sums) - 1

    def whole(nodes: list[int]) -> int:
        while len(nodes) > 1:
            nodes = [add(*nodes[i : i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    holders: dict[int, list[int]] = {}
    for i, held in enumerate(items):
        for x in held:
            holders.setdefault(x, []).append(i)
    classes: dict[tuple, list[int]] = {}
    for x in sorted(holders):
        classes.setdefault(tuple(holders[x]), []).append(x)
    has: list[set[int]] = [set() for _ in items]
    width: dict[int, int] = {}
    for holding, same in classes.items():
        node = whole(same)
        width[node] = len(holding)
        for i in holding:
            has[i].add(node)
    # the pairs that several items hold, most first
    paired = [set(heapq.nsmallest(PAIRED, (x for x in held if width[x] > 1), key=lambda x: (-width[x], x))) for held in has]
    of: dict[int, set[int]] = {}
    for i, held in enumerate(paired):
        for x in held:
            of.setdefault(x, set()).add(i)
    count = Counter((a, b) for held in paired for a in held for b in held if a < b)
    heap = [(-n, pair) for pair, n in count.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        now = count[a, b]
        if now < -n:
            if now > 1:
                heapq.heappush(heap, (-now, (a, b)))
            continue
        node, both = add(a, b), sorted(of[a] & of[b])
        of[node] = set(both)
        for i in both:
            for x in (a, b):
                paired[i].discard(x)
                has[i].discard(x)
                of[x].discard(i)
            for x in paired[i]:
                for y in (a, b):
                    count[min(x, y), max(x, y)] -= 1
                count[x, node] += 1
            paired[i].add(node)
            has[i].add(node)
        count[a, b] = 0
        heap_new = {x for i in both for x in paired[i] if x != node and count[x, node] > 1}
        for x in sorted(heap_new):
            heapq.heappush(heap, (-count[x, node], (x, node)))
    return sums, [whole(sorted(held)) for held in has]


def _mine(table: pa.Table) -> pa.Table:
    """A block's graph: its leaves (term, times), its sums in layers, its roots (item_id)."""
    operands = sorted(set(zip(table["term"].to_pylist(), table["times"].to_pylist())))
    number = {x: i for i, x in enumerate(operands)}
    held: dict[int, list[int]] = {}
    for item, term, times in zip(table["item_id"].to_pylist(), table["term"].to_pylist(), table["times"].to_pylist()):
        held.setdefault(item, []).append(number[term, times])
    ids = sorted(held)
    sums, roots = share([held[i] for i in ids], len(operands))
    depth = [0] * len(operands)
    for a, b in sums:
        depth.append(1 + max(depth[a], depth[b]))
    order = sorted(range(len(sums)), key=lambda i: (depth[len(operands) + i], i))
    to = list(range(len(operands))) + [0] * len(sums)
    for new, old in enumerate(order):
        to[len(operands) + old] = len(operands) + new
    block = table["block"][0].as_py()
    rows = [(block, 0, 0, -1, -1, t, n, None) for t, n in operands]
    rows += [(block, 1, depth[len(operands) + i], to[sums[i][0]], to[sums[i][1]], None, None, None) for i in order]
    rows += [(block, 2, 0, to[r], -1, None, None, i) for i, r in zip(ids, roots)]
    rows = [(n, *r) for n, r in enumerate(rows)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _GRAPH)], schema=_GRAPH)


_GRAPH = pa.schema([("row", pa.int64()), ("block", pa.int32()), ("kind", pa.int32()), ("depth", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("term", pa.string()), ("times", pa.int64()), ("item_id", pa.int64())])
_GRAPH_SQL = "row bigint, block int, kind int, depth int, a int, b int, term string, times bigint, item_id bigint"


@dataclass
class Graph:
    """A block of items: leaves are times[i] of local term leaf[i]; sums stand in layers after them."""

    terms: np.ndarray  # the numbers of its terms, ascending
    leaf: np.ndarray
    times: np.ndarray
    a: np.ndarray
    b: np.ndarray
    layers: list[tuple[int, int]]
    roots: np.ndarray
    items: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, ids: dict[str, int]) -> Graph:
        rows = rows.sort_by("row")
        kind = rows["kind"].to_numpy()
        cut = lambda c, k: rows[c].filter(pa.array(kind == k)).to_numpy()
        terms, leaf = np.unique([ids[t] for t in cut("term", 0)], return_inverse=True)
        depth = cut("depth", 1)
        edges = np.flatnonzero(np.diff(depth, prepend=0)).tolist() + [len(depth)]
        return cls(terms, leaf, cut("times", 0).astype(np.int64), cut("a", 1), cut("b", 1), list(zip(edges, edges[1:])), cut("a", 2), cut("item_id", 2).astype(np.int64))

    def scores(self, doc: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """Scores of each item for n documents, from the parts of their terms."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        mine = self.terms[at] == term
        one = np.zeros((len(self.terms), n), np.int64)
        one[at[mine], doc[mine]] = part[mine]
        sums = np.empty((len(self.leaf) + len(self.a), n), np.int64)
        sums[: len(self.leaf)] = one[self.leaf] * self.times[:, None]
        for i, j in self.layers:
            np.add(sums[self.a[i:j]], sums[self.b[i:j]], out=sums[len(self.leaf) + i : len(self.leaf) + j])
        return sums[self.roots]


# -- scores ------------------------------------------------------------------------------------------


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _lengths(n: np.ndarray, docs: int, words: int) -> np.ndarray:
    """m of documents of n terms."""
    if 75 * int(n.max(initial=0)) * docs < 1 << 63:
        return 25 + 75 * n * docs // words
    return np.array([25 + 75 * int(x) * docs // words for x in n], np.int64)


def _score(model: object, k: int) -> Callable:
    """The k best documents of each item among a task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs, weights, docs, words = model.value
        best = [np.empty((4, 0), np.int64) for _ in graphs]  # item, score, no doc_id, doc_id
        least = [np.ones(len(g.items), np.int64) for g in graphs]
        step = max(1, CELLS // max((len(g.leaf) + len(g.a) for g in graphs), default=1))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                cut = batch.slice(at, step)
                ids, lists, tf = cut.column("doc_id"), cut.column("terms"), cut.column("counts").flatten().to_numpy()
                none = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                ids = ids.fill_null(0).to_numpy()
                doc, term = np.repeat(np.arange(cut.num_rows), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
                m = _lengths(cut.column("n").to_numpy(), docs, words)
                part = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                for i, g in enumerate(graphs):
                    found = g.scores(doc, term, part, cut.num_rows)
                    item, d = np.nonzero(found >= least[i][:, None])
                    if not len(item):
                        continue
                    rows = np.concatenate([best[i], np.stack([item, found[item, d], none[d], ids[d]])], axis=1)
                    rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
                    first = np.searchsorted(rows[0], rows[0])
                    rank = np.arange(rows.shape[1]) - first
                    best[i] = rows[:, rank < k]
                    last = rank == k - 1
                    least[i][rows[0][last]] = rows[1][last]
        for g, (item, score, none, ids) in zip(graphs, best):
            yield pa.RecordBatch.from_arrays([pa.array(g.items[item]), pa.array(ids, mask=none.astype(bool)), pa.array(score)], names=["item_id", "doc_id", "score"])

    return run


def _best(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _turn(docs: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    known = Vocabulary.of(sorted(r.term for r in asked.select("term").distinct().collect()))  # a turn's at most
    schema = "kind int, doc_id bigint, n bigint, terms array<bigint>, counts array<bigint>"
    taken = written(docs.mapInArrow(tidy(_take(spark.sparkContext.broadcast(known))), schema), "terms")
    tasks = taken.filter("kind = 1")
    n, words = tasks.agg(F.sum("doc_id"), F.sum("n")).first()
    df = np.zeros(len(known.hashes), np.int64)
    counts = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df")).toArrow()
    df[counts["terms"].to_numpy()] = counts["df"].to_numpy()
    weights = np.array([weight(n or 0, x) for x in df.tolist()], np.int64)
    graph = asked.withColumn("block", F.pmod(F.xxhash64("item_id", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_mine, _GRAPH_SQL)
    rows = written(graph, "graph").toArrow()
    number = rows["block"].to_numpy()
    graphs = [Graph.of(rows.filter(pa.array(number == x)), known.ids) for x in np.unique(number).tolist()]
    model = spark.sparkContext.broadcast((graphs, weights, n or 0, words or 1))
    return taken.filter("kind = 0 and size(terms) > 0").mapInArrow(tidy(_score(model, k)), "item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = K, turn: int = TURN, block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text)."""
    texts = pick(docs, doc_id="bigint", text="string")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = pick(items, item_id="bigint", text="string").filter("item_id is not null and text is not null")
    asked = written(asked.select("item_id", F.explode(F.regexp_extract_all(low, F.lit(TERM), F.lit(0))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")), "asked")
    terms = asked.count()
    turns = max(1, math.ceil(terms / turn))
    blocks = max(1, math.ceil(terms / turns / block))
    found = None
    for t in range(turns):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", F.lit(2)), F.lit(turns)) == t)
        some = written(_turn(texts, mine, blocks, k), "best")
        found = some if found is None else found.unionByName(some)
    parts = _best(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), k, "item_id", "part")
    return _best(parts, k, "item_id").select("item_id", "rank", "doc_id", "score")
