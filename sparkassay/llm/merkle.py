"""Operator 11 - a Merkle manifest of a dataset with a proof for every row, by butterfly exchange.

Rows are leaves; a group's leaves stand in order, every FANOUT consecutive nodes become one, and the roots of the groups, in
order, likewise give the root.  Leaves are dealt to aligned blocks of FANOUT^INNER; a block hashes its own subtree.  Then
aligned sets of FANOUT^OUTER blocks swap their subtree roots, and sets of these, round by round: in round r, blocks whose numbers
differ in digit r only send each other what they have, and each of them hashes the same ancestors.  So every block has its
proof up to the root when the last round ends, and nothing goes down the tree.  Where a set is not full, blocks that hold no leaves take
part as replicas, so that whoever is needed in the next round is there; they never number more than the others.

No group is gathered: order comes from a range partition, places from the counts of its parts, and a message is one digest.

Cases: any column may be null (`-`).  Null ids and the null group come first.  Rows that repeat an id stand in the order of their
leaves; wholly repeated rows are leaves of their own.  A very long text is one value, hashed where it is read.  An empty table has no
rows.  Columns are found by name as `frames.pick` has it; others, whatever their names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.memory import tidy
from sparkassay.llm.order import numbered, sent
from sparkassay.llm.store import written

#: Children of a node; levels that a block hashes by itself, and levels a round.
FANOUT, INNER, OUTER = 2, 10, 4
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}


def leaf(*values: Column) -> Column:
    """The digest of a row's values: each `-` if null, else its UTF-8 length, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


# -- hashing -------------------------------------------------------------------------------------


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def join(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def tree(leaves: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of each level, the leaves first."""
    out = [leaves]
    for _ in range(levels):
        out.append([join(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def fold(digest: str, siblings: Iterator[str], pos: int, n: int, fanout: int = FANOUT) -> str:
    """The root above leaf pos of n, from its digest and its siblings level by level, left to right."""
    while n > 1:
        first = pos - pos % fanout
        run = [digest if i == pos else next(siblings) for i in range(first, min(first + fanout, n))]
        digest, pos, n = join(run), pos // fanout, -(-n // fanout)
    return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """(g, block, rows) of a partition sorted by g, block and pos."""
    held: list[pa.RecordBatch] = []

    def whole(last: bool) -> Iterator[tuple[str, int, pa.Table]]:
        nonlocal held
        table = pa.Table.from_batches(held).combine_chunks()
        g, block = table["g"].to_numpy(), table["block"].to_numpy()
        cuts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (block[1:] != block[:-1])))
        ends = [*cuts[1:].tolist(), len(table)]
        for a, b in list(zip(cuts.tolist(), ends))[: None if last else -1]:
            yield g[a], int(block[a]), table.slice(a, b - a)
        held = [] if last else table.slice(int(cuts[-1])).to_batches()

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            yield from whole(False)
    if held:
        yield from whole(True)


def _roots(fanout: int, inner: int) -> Callable:
    """The subtree root of each block of leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, block, rows in _blocks(batches):
            n = rows["n"][0].as_py()
            levels = height(n, fanout)
            top = tree([x.hex() for x in rows["leaf"].to_pylist()], min(inner, levels), fanout)[-1][0]
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([block]), pa.array([n]), pa.array([levels], pa.int32()), pa.array([top])], names=["g", "block", "n", "height", "digest"])

    return run


def _swap(state: DataFrame, r: int, fanout: int, inner: int, outer: int) -> DataFrame:
    """One round: sets of blocks swap subtree roots and hash what stands above them, `outer` levels at most.

    Blocks differ in digit r of their number only; each has the root of its own child of their common ancestor.
    """
    width = fanout**outer
    step, todo = width**r, F.col("height") - (inner + r * outer)
    block = F.col("block")
    digit = F.floor(block / step) % width
    first = block - digit * step
    blocks = F.ceil(F.col("n") / fanout**inner)
    partners = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: (first + k * step).cast("bigint"))
    partners = F.when(todo > outer, partners).otherwise(F.filter(partners, lambda to: to < blocks))  # the last round needs no replicas
    sent = state.withColumn("to", F.explode(F.when(todo > 0, partners).otherwise(F.array(block))))
    sent = sent.select("g", "to", "n", "height", F.struct(digit.cast("int").alias("digit"), "digest").alias("one"), F.when(block == F.col("to"), F.col("siblings")).alias("siblings"))
    # width messages at most for each block
    got = sent.groupBy("g", "to").agg(F.first("n").alias("n"), F.first("height").alias("height"), F.sort_array(F.collect_list("one")).alias("all"), F.first("siblings", ignorenulls=True).alias("siblings"))
    got = got.withColumnsRenamed({"to": "block"}).withColumn("own", (F.floor(block / step) % width).cast("int"))
    nodes, own, siblings = F.transform("all", lambda x: x["digest"]), F.col("own"), F.col("siblings")
    for level in range(outer):
        left, at = todo > level, own  # todo reads got's height, the same
        got = got.withColumns({"nodes": nodes, "at": at})
        run = F.slice("nodes", (F.floor(F.col("at") / fanout) * fanout + 1).cast("int"), F.lit(fanout))
        others = F.filter(run, lambda _, i: i != F.col("at") % fanout)
        above = F.transform(F.sequence(F.lit(0), F.ceil(F.size("nodes") / fanout).cast("int") - 1), lambda i: F.sha2(F.array_join(F.slice("nodes", i * fanout + 1, F.lit(fanout)), ""), 256))
        got = got.select("g", "block", "n", "height", F.when(left, above).otherwise(F.col("nodes")).alias("nodes"), F.when(left, F.floor(F.col("at") / fanout).cast("int")).otherwise(F.col("at")).alias("own"), F.when(left, F.concat("siblings", others)).otherwise(F.col("siblings")).alias("siblings"))
        nodes, own = F.col("nodes"), F.col("own")
    # a replica that holds no leaves has no proof of its own
    return got.select("g", "block", "n", "height", F.get(nodes, F.lit(0)).alias("digest"), F.coalesce("siblings", F.array().cast("array<string>")).alias("siblings"))


def _dealt(leaves: DataFrame, fanout: int, inner: int) -> DataFrame:
    return leaves.withColumn("block", F.floor(F.col("pos") / fanout**inner).cast("bigint"))


def exchange(leaves: DataFrame, fanout: int = FANOUT, inner: int = INNER, outer: int = OUTER) -> DataFrame:
    """(g, block, digest, siblings): for each block of leaves (g, pos, n, leaf) its group's root and its proof up to there."""
    dealt = _dealt(leaves.select("g", "pos", "n", "leaf"), fanout, inner)
    roots = dealt.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(tidy(_roots(fanout, inner)), "g string, block bigint, n bigint, height int, digest string")
    state = written(roots.withColumn("siblings", F.array().cast("array<string>")), "roots")
    top, r = state.agg(F.max("height")).first()[0] or 0, 0
    while inner + r * outer < top:
        state = written(_swap(state, r, fanout, inner, outer), f"round{r}")
        r += 1
    return state.filter(F.col("block") * fanout**inner < F.col("n")).select("g", "block", "digest", "siblings")


def _prove(fanout: int, inner: int, whole: bool) -> Callable:
    """The proof of each leaf.  A block's first row is what its rounds have brought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _blocks(batches):
            head, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
            pos, n = rows["pos"].to_pylist(), rows["n"][0].as_py()
            levels = tree([x.hex() for x in rows["leaf"].to_pylist()], min(inner, height(n, fanout)), fanout)
            upper, size = head["siblings"] + head["top"], fanout**inner
            proofs, folded = [], []
            for p, own, bad in zip(pos, levels[0], rows["bad"].to_pylist()):
                at, siblings = p % size, []
                for level in levels[:-1]:
                    first = at - at % fanout
                    siblings += level[first:at] + level[at + 1 : first + fanout]
                    at //= fanout
                siblings += upper
                it = iter(siblings)
                to = fold(bad.hex() if bad else own, it, p, n, fanout)
                folded.append(fold(to, it, head["top_pos"], head["top_n"], fanout))
                proofs.append(siblings)
            same = lambda x: pa.array([x] * len(pos))
            columns = {"doc_id": rows["doc_id"].combine_chunks(), "leaf": pa.array(levels[0]), "subroot": same(head["digest"]), "root": same(head["root"]), "proof_sha256": pa.array([join(p) for p in proofs]), "folded_root": pa.array(folded), "verified": pa.array([x == head["root"] for x in folded])}
            if whole:
                columns |= {"pos": rows["pos"].combine_chunks(), "n": rows["n"].combine_chunks(), "top_pos": same(head["top_pos"]), "top_n": same(head["top_n"]), "siblings": pa.array(proofs, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


_PROOF = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proofs(leaves: DataFrame, fanout: int = FANOUT, inner: int = INNER, outer: int = OUTER, whole: bool = True) -> DataFrame:
    """The manifest of leaves (g, doc_id, leaf, bad): every leaf with its proof, folded again from bad, or leaf if that is null.

    g orders the groups by its bytes.  With whole, also the places and the siblings that a reader needs to check a leaf.
    """
    placed = numbered(leaves, "doc_id", "leaf")
    state = written(exchange(placed, fanout, inner, outer), "state")
    # the groups' roots are the leaves of a tree of their own
    roots = state.filter("block = 0").select(F.lit("").alias("g"), F.col("g").alias("group"), F.unhex("digest").alias("leaf"))
    upper = _dealt(numbered(roots, "group"), fanout, inner)
    above = exchange(upper, fanout, inner, outer).withColumnsRenamed({"digest": "root", "siblings": "upper"})
    tops = _tops(upper, above, fanout, inner)
    heads = state.join(sent(written(tops, "tops")), "g")
    both = _dealt(placed, fanout, inner).unionByName(heads.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    schema = _PROOF + (", pos bigint, n bigint, top_pos bigint, top_n bigint, siblings array<string>" if whole else "")
    return both.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(tidy(_prove(fanout, inner, whole)), schema)


def _tops(roots: DataFrame, above: DataFrame, fanout: int, inner: int) -> DataFrame:
    """(g, top_pos, top_n, top, root) of each group: its root's place and proof among the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, rows in _blocks(batches):
            head, rows = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
            levels = tree([x.hex() for x in rows["leaf"].to_pylist()], min(inner, height(rows["n"][0].as_py(), fanout)), fanout)
            top = []
            for p in rows["pos"].to_pylist():
                at, siblings = p % fanout**inner, []
                for level in levels[:-1]:
                    first = at - at % fanout
                    siblings += level[first:at] + level[at + 1 : first + fanout]
                    at //= fanout
                top.append(siblings + head["upper"])
            yield pa.RecordBatch.from_arrays([rows["group"].combine_chunks(), rows["pos"].combine_chunks(), rows["n"].combine_chunks(), pa.array(top, pa.list_(pa.string())), pa.array([head["root"]] * len(top))], names=["g", "top_pos", "top_n", "top", "root"])

    both = roots.unionByName(above.withColumn("pos", F.lit(-1).cast("bigint")), allowMissingColumns=True)
    return both.repartition("g", "block").sortWithinPartitions("g", "block", "pos").mapInArrow(tidy(run), "g string, top_pos bigint, top_n bigint, top array<string>, root string")


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """(g, doc_id, leaf, bad) of documents grouped by lang; where tamper holds, bad is the leaf with one more in n_chars."""
    d = pick(docs, **FIELDS)
    values = [F.col(c) for c in FIELDS]
    bad = [v + 1 if c == "n_chars" else v for c, v in zip(FIELDS, values)]
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), "lang"))  # null before any text
    return d.select(group.alias("g"), "doc_id", F.unhex(leaf(*values)).alias("leaf"), (F.when(tamper, F.unhex(leaf(*bad))) if tamper is not None else F.lit(None).cast("binary")).alias("bad"))


def report(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; rows whose id's CRC 7 divides are tampered with."""
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return proofs(written(leaves(docs, tamper), "leaves"), whole=False, **options)
