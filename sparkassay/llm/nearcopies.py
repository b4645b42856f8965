"""Near copies by wide SimHash: operator 7 for texts that share a given part of their word shingles.

Two texts with Jaccard similarity 0.8 differ in 15 % of the bits of any SimHash, far from where copies and other texts can
be told apart within 64 bits.  So sets of distinct shingles get wide fingerprints, cut into parts that must agree in one
part at least.  With no bit to spare in a part, the covering code is that of all words: radius 0, each value its own
anchor, one replica a part.  Parts have PART bits, and one more with every doubling of the table beyond ROWS texts an anchor, so that
anchors do not fill up; their number follows, so that of two texts at similarity 0.8 no part agrees with probability MISS at most,
at 0.85 and 0.9 with 0.0001 and 0.0000001.  The first FILTER bits drop other pairs at an anchor, all bits most of the
rest, and an exact comparison of the two shingle sets decides every link.

Only distinct shingle sets are compared.  An anchor gives a spanning forest of its candidates, never all pairs; in a large
one, rows first gather about a few of them, and those that stand together are not compared with each other again.
Classes that no failed candidate lies between are settled.  The members of the others meet once more, with all their bits, and
give all candidates between what are different classes so far, so that a candidate that is no link hides none that is.

Cases: null, empty and blank texts have no shingles and are copies of each other; texts of fewer words than a shingle have one.
Rows without a doc_id always stay, as do rows that repeat the doc_id that is kept, by the same text or another of the class.
Rows of one doc_id with different texts are judged apart.  A very long text is one set and is compared whole.  An empty
table gives no rows.  Other columns of any name stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.components import components
from sparkassay.llm.decontam import run_hashes
from sparkassay.llm.fingerprints import majority
from sparkassay.llm.frames import carried, pick
from sparkassay.llm.memory import tidy
from sparkassay.llm.store import written
from sparkassay.llm.words import NOT_SPACE, U64, Words, mix, scan

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a part of a fingerprint, texts an anchor from which parts grow, and how often a pair may have no part alike.
PART, ROWS, MISS = 16, 64, 0.0025
#: Bits that filter pairs at an anchor, and how many of them may differ: 3.5 standard deviations above what similarity 0.8 gives.
FILTER, MOST = 128, 34
#: Rows of an anchor that are compared in one group; more are dealt to tiles.
TILE = 4096
#: Pairs that are compared at once, and rows from which an anchor is compared by itself.
PAIRS, LARGE = 1 << 18, 256
#: Rows that gather those within TIGHT differing bits about them before the rest of a large anchor is compared.
PIVOTS, TIGHT = 64, 12
#: Keys up to which a table goes to every executor: 16 or 32 bytes each.
SMALL = 1_000_000
_STEP = U64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Shape:
    """A fingerprint: the width and number of its parts, its 64-bit words, and how many of all bits two near copies may differ in."""

    width: int
    parts: int
    words: int
    most: int

    @classmethod
    def of(cls, texts: int, similarity: float = SIMILARITY, rows: int = ROWS) -> Shape:
        apart = math.acos(2 * similarity / (1 + similarity)) / math.pi  # the share of bits in which sets of one size differ
        width = min(32, PART + max(0, math.ceil(math.log2(max(1, texts) / rows)) - PART))
        parts = math.ceil(math.log(MISS) / math.log(1 - (1 - apart) ** width))
        words = -(-parts * width // 64)
        return cls(width, parts, words, int(64 * words * apart + 4 * math.sqrt(64 * words * apart * (1 - apart))))


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, how many of each document): the distinct shingles of each text, sorted."""
    h, per = w.hashes(), w.counts()
    out, doc = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for n in range(1, size + 1):  # texts of fewer words are one shingle
        if n < size and not (per == n).any():
            continue
        runs = run_hashes(h, n)
        if n == size:
            of = np.searchsorted(w.doc, np.arange(len(runs)), "right") - 1
            mine = np.flatnonzero(np.arange(len(runs)) + n <= w.doc[of + 1]) if len(runs) else np.empty(0, np.int64)
            of = of[mine]
        else:
            of = np.flatnonzero(per == n)
            mine = w.doc[of]
        out.append(runs[mine] if len(mine) else np.empty(0, U64))
        doc.append(of)
    hashes, docs = np.concatenate(out), np.concatenate(doc)
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], np.bincount(docs[new], minlength=w.n)


def _mark(size: int, words: int) -> Callable:
    """The digest of each text's shingle set, and its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, prints = [], []
            for w in scan(batch.column("text"), NOT_SPACE):
                h, n = shingle_sets(w, size)
                upto = np.append(U64(0), np.cumsum(mix(h)))
                ends = np.cumsum(n)
                digest.append(mix(upto[ends] - upto[ends - n] + n.astype(U64) * _STEP))
                made = np.stack([majority(mix(h + step), n) for step in _STEP * np.arange(1, words + 1, dtype=U64)], axis=1)
                prints += [row.tobytes() for row in np.ascontiguousarray(made)]
            set_ = np.concatenate([np.empty(0, U64), *digest]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("key2"), pa.array(set_), pa.array(prints, pa.binary())], names=["doc_id", "key", "key2", "set", "print"])

    return run


def part_values(prints: np.ndarray, shape: Shape) -> np.ndarray:
    """The value of each part of each fingerprint (a row of 64-bit words)."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    held = np.zeros((len(prints), shape.parts, 32), np.uint8)
    held[:, :, : shape.width] = bits[:, : shape.parts * shape.width].reshape(len(prints), shape.parts, shape.width)
    return np.packbits(held.reshape(len(prints), -1), axis=1, bitorder="little").view("<u4").astype(np.int64)


def _replicate(shape: Shape, whole: bool) -> Callable:
    """A row for each part of each fingerprint, at the part's value; with all its bits, if whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                cut = batch.slice(at, 2000)
                n = cut.num_rows
                prints = np.frombuffer(b"".join(cut.column("print").to_pylist()), "<u8").reshape(n, -1)
                anchor = (part_values(prints, shape) | np.arange(shape.parts, dtype=np.int64)[None, :] << 32).ravel()
                again = np.repeat(np.arange(n), shape.parts)
                numbers = (cut.column("node").to_numpy(), cut.column("label").to_numpy(), prints[:, 0].view(np.int64), prints[:, 1].view(np.int64))
                arrays = [pa.array(anchor), *(pa.array(x[again]) for x in numbers)]
                names = ["anchor", "node", "label", "f0", "f1"]
                if whole:
                    arrays, names = [*arrays, cut.column("print").take(pa.array(again))], [*names, "print"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def spanning(u: np.ndarray, v: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Numbers of the edges of a spanning forest: each component takes its nearest edge, until none is left."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((v, u, distance))] = np.arange(len(u))
    label, taken = np.arange(len(nodes)), []
    live = np.arange(len(u))
    while len(live):
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            break
        live = live[np.argsort(-rank[live])]
        nearest = np.full(len(nodes), -1)
        nearest[label[a[live]]] = live  # the last one written is the nearest
        other = np.full(len(nodes), -1)
        other[label[b[live]]] = live
        both = (nearest >= 0) & (other >= 0)
        pick = np.where(both, np.where(rank[nearest] < rank[other], nearest, other), np.maximum(nearest, other))
        new = np.unique(pick[pick >= 0])
        taken.append(new)
        while True:  # join what the new edges connect
            low = np.minimum(label[a[new]], label[b[new]])
            before = label.copy()
            np.minimum.at(label, label[a[new]], low)
            np.minimum.at(label, label[b[new]], low)
            label = label[label]
            if (label == before).all():
                break
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _compare(most: int, forest: bool, shape: Shape | None = None) -> Callable:
    """Pairs of rows of an anchor whose filter bits are near; a partition comes sorted by anchor and tile.

    Rows that come with all their bits (of a shape) are near if these are, too, and only at the first part that both have alike.
    """

    def near_whole(x: np.ndarray, y: np.ndarray, c: list[np.ndarray]) -> np.ndarray:
        near = np.bitwise_count(c[5][x] ^ c[5][y]).sum(1, dtype=np.int64) <= shape.most
        at = np.flatnonzero(near)
        for i in range(0, len(at), 8000):
            some = at[i : i + 8000]
            near[some] = (c[6][x[some]] == c[6][y[some]]).argmax(1) == c[7][x[some]]
        return near

    def small(at: np.ndarray, later: np.ndarray, c: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """Near pairs of the rows `at` with so many rows after each."""
        side, _, label, f0, f1 = c[:5]
        x = np.repeat(at, later)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
        first = np.bitwise_count(f0[x] ^ f0[y])
        keep = np.flatnonzero((first <= most) & (label[x] != label[y]) & ((side[x] != side[y]) | (side[x] == 2)))
        x, y = x[keep], y[keep]
        d = first[keep].astype(np.int64) + np.bitwise_count(f1[x] ^ f1[y])
        keep = d <= most
        if shape is not None:
            keep[keep] = near_whole(x[keep], y[keep], c)
        return x[keep], y[keep], d[keep]

    def large(a: int, b: int, c: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """Near pairs of rows a..b-1, without those whose rows a pivot or their label puts together."""
        side, node, label, f0, f1 = (x[a:b] for x in c[:5])
        group = np.unique(label, return_inverse=True)[1]
        if forest:  # any two rows of an anchor may be joined, whatever their sides
            left = np.arange(b - a)
            for _ in range(PIVOTS):
                if len(left) < 2:
                    break
                pivot, left = left[0], left[1:]
                d = np.bitwise_count(f0[left] ^ f0[pivot]).astype(np.int64) + np.bitwise_count(f1[left] ^ f1[pivot])
                tight = d <= min(most, TIGHT)
                tight &= node[left] != node[pivot]
                group[left[tight]] = group[pivot]
                yield np.full(int(tight.sum()), a + pivot), a + left[tight], d[tight]
                left = left[~tight]
        main = group == np.bincount(group).argmax()
        rest, step = np.flatnonzero(~main), max(1, PAIRS // (b - a))
        for i in range(0, len(rest), step):
            x = rest[i : i + step, None]
            y = np.arange(b - a)[None, :]
            first = np.bitwise_count(f0[x] ^ f0[y])
            u, v = np.nonzero((first <= most) & (group[x] != group[y]) & (main[y] | (y > x)) & ((side[x] != side[y]) | (side[x] == 2)))
            d = first[u, v].astype(np.int64)
            u = x[u, 0]
            d += np.bitwise_count(f1[u] ^ f1[v])
            keep = d <= most
            if shape is not None:
                keep[keep] = near_whole(a + u[keep], a + v[keep], c)
            yield a + u[keep], a + v[keep], d[keep]

    def near(key: np.ndarray, c: list[np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor, u, v, distance) of near pairs of nodes, anchor by anchor."""
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=key[:1] - 1)), len(key))
        size = np.diff(cuts)
        later = np.repeat(cuts[1:], size) - np.arange(len(key)) - 1
        later[np.repeat(size >= LARGE, size)] = 0
        for i in np.flatnonzero(size >= LARGE).tolist():
            for x, y, d in large(int(cuts[i]), int(cuts[i + 1]), c):
                yield key[x], c[1][x], c[1][y], d
        ends, i = np.cumsum(later), 0
        while i < len(key):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PAIRS, "right")))
            x, y, d = small(np.arange(i, j), later[i:j], c)
            yield key[x], c[1][x], c[1][y], d
            i = j

    def thin(found: list[tuple]) -> list[tuple]:
        """Candidates of whole anchors, without those that a forest can spare."""
        g, u, v, d = (np.concatenate(c) for c in zip(*found))
        if forest and len(g):
            order = np.argsort(g, kind="stable")
            g, u, v, d = g[order], u[order], v[order], d[order]
            bounds = np.flatnonzero(np.diff(g, prepend=g[0] - 1))
            kept = np.concatenate([a + spanning(u[a:b], v[a:b], d[a:b]) for a, b in zip(bounds, [*bounds[1:], len(g)])])
            g, u, v, d = g[kept], u[kept], v[kept], d[kept]
        return [(g, u, v, d)]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        _, u, v, _ = found[0]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            names = [table[c].to_numpy() for c in ("anchor", "i", "j")]
            new = np.zeros(len(table), bool)
            for k in names:
                new[1:] |= k[1:] != k[:-1]
            group = np.cumsum(new)
            whole = len(table) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
            columns = [table[c].to_numpy()[:whole] for c in ("side", "node", "label", "f0", "f1")]
            columns[3:] = [x.view(U64) for x in columns[3:]]  # bits of signed numbers are those of their absolute values
            if shape is not None:
                prints = np.frombuffer(b"".join(table["print"].slice(0, whole).to_pylist()), "<u8").reshape(whole, shape.words)
                columns += [prints, part_values(prints, shape).astype(np.uint32), table["anchor"].to_numpy()[:whole] >> 32]
            some: list[tuple] = []
            for part in near(group[:whole], columns) if whole else ():
                some.append(part)
                if not forest or sum(len(x[0]) for x in some) > PAIRS:
                    some = thin(some)
                    if not forest:
                        yield rows_of(some)
                        some = []
            if some:
                yield rows_of(thin(some))
            held = table.slice(whole).to_batches()
            rows = len(table) - whole

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= (50_000 if shape is None else 20_000):
                yield from flush(False)
        yield from flush(True)

    return run


def candidates(nodes: DataFrame, shape: Shape, forest: bool, tile: int | None = None) -> DataFrame:
    """Distinct pairs (u, v) of nodes (node, label, print) of different labels that an anchor holds near each other.

    Without a forest rows bring all their bits, so that few pairs come that are no links.
    """
    tile = tile or TILE
    held = "anchor bigint, node bigint, label bigint, f0 bigint, f1 bigint" + ("" if forest else ", print binary")
    spread = nodes.select("node", "label", "print").mapInArrow(tidy(_replicate(shape, not forest)), held)
    large = written(spread.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("anchor", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "large")
    tiled = spread.join(_send(large), "anchor", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    # part i meets part j in tile (i, j), i <= j; side 2: the tile's rows are all of one part and meet each other
    spot = lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j"), F.when(own == j, 2).when(own < j, 0).otherwise(1).alias("side"))
    rows = tiled.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), spot))).select("anchor", "t.i", "t.j", "t.side", "node", "label", "f0", "f1", *(() if forest else ("print",)))
    found = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "node").mapInArrow(tidy(_compare(MOST, forest, None if forest else shape)), "u bigint, v bigint")
    return found.distinct()


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node")
            for w in scan(batch.column("text"), NOT_SPACE):
                h, n = shingle_sets(w, size)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([node.slice(w.first, w.n), lists], names=["node", "shingles"])

    return run


def _word(print_: str, i: Column) -> Column:
    """The i-th eight bytes of a fingerprint as a number."""
    return F.conv(F.hex(F.substring(print_, i * 8 + 1, F.lit(8))), 16, -10).cast("bigint")


def _keys() -> dict[str, Column]:
    """Two digests that tell rows apart by id and text."""
    return {"key": F.xxhash64("doc_id", "text"), "key2": F.xxhash64("text", "doc_id", F.lit(SHINGLE))}


def _send(df: DataFrame) -> DataFrame:
    """df to every executor if it has at most SMALL rows; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL else df


def linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, similarity: float) -> DataFrame:
    """Pairs (u, v) with ok: whether their shingle sets are so similar.

    texts (key, key2, text); nodes (node, key, key2) names one text of each.
    """
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    named = written(nodes.join(wanted, "node", "left_semi").select("node", "key", "key2"), "named")
    shingles = written(texts.join(_send(named), ["key", "key2"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(tidy(_sets(size)), "node bigint, shingles array<bigint>"), "sets")
    one, two = (shingles.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in "uv")
    n = F.size(F.array_intersect("of_u", "of_v"))
    # v first: a smallest neighbour u may have very many pairs, which are then rows wide enough for Spark to split its partition
    both = pairs.join(two, "v").join(one, "u").select("u", "v", n.alias("n"), (F.size("of_u") + F.size("of_v")).alias("sum"))
    return both.select("u", "v", (F.col("n") >= similarity * (F.col("sum") - F.col("n")) - 1e-9).alias("ok"))


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, key2, class) of every row of docs (doc_id, text): rows of a class are near copies, directly or in steps."""
    texts = pick(docs, doc_id="bigint", text="string").withColumns(_keys())
    shape = Shape.of(docs.count(), similarity)
    marked = written(texts.mapInArrow(tidy(_mark(size, shape.words)), "doc_id bigint, key bigint, key2 bigint, set bigint, print binary"), "marked")
    one = F.min(F.struct("key", "key2", "print")).alias("x")
    nodes = written(marked.groupBy(F.col("set").alias("node")).agg(one).select("node", F.col("node").alias("label"), "x.*"), "nodes")
    # all bits drop most pairs that no exact comparison would keep
    bits = [nodes.select(F.col("node").alias(end), F.col("print").alias(f"bits_{end}")) for end in "uv"]
    near = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(shape.words - 1)), lambda i: F.bit_count(_word("bits_u", i).bitwiseXOR(_word("bits_v", i)))), F.lit(0), lambda a, x: a + x) <= shape.most
    pairs = written(written(candidates(nodes, shape, True), "near").join(bits[1], "v").join(bits[0], "u").filter(near).select("u", "v"), "pairs")
    # of each node the pair with its smallest neighbour comes first: these join most of a group, whose other pairs need no check then
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("e")).select("e.*")
    least = ends.groupBy("node").agg(F.min("other").alias("other"))
    first = written(least.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct(), "first")
    judged = written(linked(first, texts, nodes, size, similarity), "judged")
    so_far = written(components(judged.filter("ok").select("u", "v")), "classes")
    rest = pairs.join(first, ["u", "v"], "left_anti")
    for end in "uv":
        rest = rest.join(so_far.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    rest = written(rest.filter(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select("u", "v"), "rest")
    judged = judged.unionByName(written(linked(rest, texts, nodes, size, similarity), "judged"))
    links = judged.filter("ok").select("u", "v")
    failed = judged.filter(~F.col("ok")).select("u", "v")
    found = components(links)
    if not failed.isEmpty():
        # a hidden link joins classes that pairs which are no links lie between: their members meet once more
        found = written(found, "so_far")
        label = lambda pairs, node: pairs.join(found.select(F.col("node").alias(node), F.col("component").alias(f"of_{node}")), node, "left").withColumn(f"of_{node}", F.coalesce(f"of_{node}", node))
        between = label(label(failed, "u"), "v").filter("of_u <> of_v")
        odd = between.select(F.explode(F.array("of_u", "of_v")).alias("label")).distinct()
        again = written(nodes.drop("label").join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).join(odd, "label", "left_semi").select("node", "label", "key", "key2", "print"), "again")
        more = written(candidates(again, shape, False).join(failed, ["u", "v"], "left_anti"), "pairs")
        new = label(label(linked(more, texts, nodes, size, similarity).filter("ok").select("u", "v"), "u"), "v")
        joined = components(new.select(F.col("of_u").alias("u"), F.col("of_v").alias("v")))
        # classes of classes: every class that is joined, and every node of it
        upper = joined.select(F.col("node").alias("component"), F.col("component").alias("upper"))
        members = found.select("node", "component").unionByName(joined.select("node", F.col("node").alias("component"))).distinct()
        found = members.join(upper, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
    named = marked.select("doc_id", "key", "key2", F.col("set").alias("node"))
    return named.join(found, "node", "left").select("doc_id", "key", "key2", F.coalesce("component", "node").alias("class"))


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but the document of the smallest doc_id of each class."""
    held = carried(docs)
    found = written(classes(held.df, size, similarity).filter("doc_id is not null"), "classes")
    first = found.groupBy("class").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("class", "first")
    lost = written(found.join(first, "class").filter(F.col("doc_id") > F.col("first")).select("key", "key2").distinct(), "lost")
    return held.df.withColumns(_keys()).join(_send(lost), ["key", "key2"], "left_anti").drop("key", "key2").toDF(*held.names)
