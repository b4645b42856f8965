"""Operator 2 - main text of HTML pages by wrapper induction.

Pages of a host share a few layouts.  Every page's block tree is aligned by simple tree matching with its host's reference
pages (of each of the most frequent shapes the smallest and largest page_id with text).  A wrapper is induced of each shape
from what all aligned pages of the host have in its nodes:

* a node whose text mostly equals a reference's is constant, hence template; the others are slots;
* slots are weighed by the text outside links that pages have there.  The wrapper's content lies where this weight is: from
  the root, down to the part that holds MOST of it; a slot that is mostly links is a menu.

Each page is read by the wrapper of the shape that it aligns with best.  What lies in content slots is its text, and
so is what aligns with nothing but stands inside the content.  A page that no wrapper of its host fits is its own.

Names (elements, roles, classes) do not find the content; they correct the weights.  What says it is furniture weighs
NAMED_WEIGHT of its text and is left out inside the content too, where adverts, notices and reader comments vary as the
article does.  The descent ends at an article or main element, and of several parts with much weight marked ones come first.
A page whose text would all be template keeps it: it is a copy of others.

Alignments are summed up per host and node before any shuffle, and the trees, not the pages, meet
their reference, so a host of any size is spread over many tasks.

Cases: a null or empty html gives an empty text.  Pages without a host (null or odd url) share one group.
Repeated rows are pages each.  An empty table gives no rows.  Columns besides page_id, url and html, of any name, are ignored.
A very long page is parsed whole; nothing bounds its nesting or its nodes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.llm.dom import HEADER, HEADING, INSIDE, MARK, NAMED, match, parse
from sparkassay.llm.store import written
from sparkassay.llm.words import rows as few

#: A node is template if it is constant in so large a share of so many aligned pages.
SHARE, SUPPORT = 0.6, 4
#: Shapes of a host that have wrappers.
LAYOUTS = 3
#: Most of a slot outside any article that may be link text.
LINKED = 0.5
#: Share of the weight that the part holding the content has.
MOST = 0.6
NAMED_WEIGHT = 0.1


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A page's tree with what names tell of its nodes, and its pieces of text."""
    kinds = {"shape": pa.string(), "digests": pa.list_(pa.int64()), "nodes": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "linked": pa.list_(pa.int32())}
    for batch in few(batches, 200):
        out: list[tuple] = []
        for text in batch.column("html").to_pylist():
            page = parse(text or "")
            nodes, texts, linked = zip(*page.pieces) if page.pieces else ((), (), ())
            out.append((json.dumps([page.label, page.children, page.flags], separators=(",", ":")), page.digests(), nodes, texts, linked))
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), *(pa.array(list(c), k) for c, k in zip(columns, kinds.values()))], names=["page_id", "url", "host", *kinds])


_TREE = "shape string, digests array<bigint>, nodes array<int>, texts array<string>, linked array<int>"


class _Aligner:
    """Alignments with references; layouts repeat, so they are remembered by both shapes."""

    def __init__(self) -> None:
        self.trees: dict[str, list] = {}
        self.pairs: dict[tuple[str, str], dict[int, int]] = {}

    def tree(self, shape: str) -> list:
        """[labels, children, flags, parents]"""
        if shape not in self.trees:
            label, children, flags = json.loads(shape)
            parent = [-1] * len(label)
            for n, kids in enumerate(children):
                for k in kids:
                    parent[k] = n
            self.trees[shape] = [label, children, flags, parent]
        return self.trees[shape]

    def __call__(self, shape: str, reference: str) -> dict[int, int]:
        if (shape, reference) not in self.pairs:
            if len(self.pairs) > 2000:
                self.pairs.clear()
                self.trees.clear()
            self.pairs[shape, reference] = match(tuple(self.tree(shape)[:2]), tuple(self.tree(reference)[:2]))
        return self.pairs[shape, reference]


def _weights(row: dict) -> dict[int, list[int]]:
    """Characters outside links, and inside, of each node that has text."""
    out: dict[int, list[int]] = {}
    for n, t, inside in zip(row["nodes"], row["texts"], row["linked"]):
        w = out.setdefault(n, [0, 0])
        w[0] += len(t) - inside
        w[1] += inside
    return out


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node of a reference: aligned pages, those with equal text, their characters outside and inside links."""
    align, counts = _Aligner(), {}
    names = ["host", "ref_shape", "ref", "node", "aligned", "differ", "equal", "plain", "linked"]

    def flush() -> pa.RecordBatch:
        rows = [(*key, *n) for key, n in counts.items()]
        counts.clear()
        columns = list(zip(*rows)) if rows else [()] * len(names)
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), *(pa.int64(),) * 5)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in few(batches, 200):
        for row in batch.to_pylist():
            # a copy of the reference says nothing about its template
            copy = row["digests"] == row["ref_digests"] and row["shape"] == row["ref_shape"]
            weights = _weights(row)
            for mine, node in align(row["shape"], row["ref_shape"]).items():
                if mine in weights or row["ref_digests"][node]:
                    n = counts.setdefault((row["host"], row["ref_shape"], row["ref"], node), [0] * 5)
                    plain, linked = weights.get(mine, (0, 0))
                    n[0] += 1
                    if not copy and row["ref_digests"][node]:
                        n[1] += 1
                        n[2] += row["digests"][mine] == row["ref_digests"][node]
                    n[3] += plain
                    n[4] += linked
        if len(counts) > 100_000:
            yield flush()
    yield flush()


def induce(tree: list, slots: dict[int, tuple[float, float, bool]]) -> tuple[set[int], set[int]]:
    """(nodes inside the content, content slots) of a shape.

    tree: [labels, children, flags, parents]; slots: of each node with text, the characters outside and inside links
    that a page has there, and whether it is constant.
    """
    label, children, flags, parent = tree
    own, whole, marks, raw = [0.0] * len(label), [0.0] * len(label), [0] * len(label), [0.0] * len(label)
    for n in range(len(label) - 1, -1, -1):
        plain, _, constant = slots.get(n, (0.0, 0.0, False))
        own[n] = 0.0 if constant else plain * (NAMED_WEIGHT if flags[n] & NAMED else 1.0)
        whole[n] += own[n]
        raw[n] += plain * (NAMED_WEIGHT if flags[n] & NAMED else 1.0)
        marks[n] += bool(flags[n] & MARK)
        if parent[n] >= 0:
            whole[parent[n]] += whole[n]
            raw[parent[n]] += raw[n]
            marks[parent[n]] += marks[n]
    at = 0
    while True:
        best = max(children[at], key=lambda c: whole[c], default=None)
        if best is None or whole[best] < MOST * whole[at] or whole[best] == own[best]:
            break  # spread over several parts, or in one block of text
        if flags[at] & MARK and not marks[best]:
            break
        at = best
    content = [at]
    if not flags[at] & INSIDE and marks[at]:
        found, todo = [], list(children[at])
        while todo:
            n = todo.pop()
            if flags[n] & MARK and not flags[n] & NAMED:
                found.append(n)
            else:
                todo += children[n]
        # constant text counts here: an article may be the same on many pages
        if found and 2 * sum(raw[n] for n in found) >= raw[at]:
            content = found
    inside, todo = set(), content
    while todo:
        n = todo.pop()
        inside.add(n)
        todo += children[n]
    kept = set()
    for n in inside:
        plain, linked, constant = slots.get(n, (0.0, 0.0, False))
        menu = linked > LINKED * (plain + linked) and not flags[n] & INSIDE
        if not constant and not menu and not out_of_text(flags[n]):
            kept.add(n)
    return inside, kept


def out_of_text(flags: int) -> bool:
    """Furniture by its name, or in a header but no heading."""
    return bool(flags & NAMED) or bool(flags & HEADER) and not flags & HEADING


def _induce(share: float, support: int):
    """The wrapper of each shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _Aligner()
        for batch in few(batches, 200):
            inside, content = [], []
            for row in batch.to_pylist():
                slots: dict[int, tuple[float, float, bool]] = {}
                for s in row["slots"]:
                    constant = s["differ"] >= support and s["equal"] >= share * s["differ"]
                    slots[s["node"]] = (s["plain"] / s["aligned"], s["linked"] / s["aligned"], constant or slots.get(s["node"], (0, 0, False))[2])
                found = induce(align.tree(row["ref_shape"]), slots)
                inside.append(sorted(found[0]))
                content.append(sorted(found[1]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("ref_shape"), pa.array(inside, pa.list_(pa.int32())), pa.array(content, pa.list_(pa.int32()))], names=["host", "ref_shape", "inside", "content"])

    return run


def _read(row: dict, align: _Aligner) -> str:
    """A page's text by the wrapper that it aligns with best."""
    label, _, flags, parent = tree = align.tree(row["shape"])
    best, fit = None, 0.0
    for known in row["known"] or ():
        pairs = align(row["shape"], known["ref_shape"])
        like = len(pairs) / (len(label) + len(align.tree(known["ref_shape"])[0]) - len(pairs))
        if like > fit:
            best, fit = (known, pairs), like
    if best:
        known, pairs = best
        inside, content = set(known["inside"]), set(known["content"])
        within, kept = [False] * len(label), [False] * len(label)
        for n in range(len(label)):
            if n in pairs:
                within[n], kept[n] = pairs[n] in inside, pairs[n] in content and not out_of_text(flags[n])
            elif parent[n] >= 0:
                within[n] = within[parent[n]]
                kept[n] = within[n] and not out_of_text(flags[n])
        fits = any(within[n] for n in row["nodes"])
    if not best or not fits:
        inside, content = induce(tree, {n: (*w, False) for n, w in _weights(row).items()})
        within, kept = ([n in x for n in range(len(label))] for x in (inside, content))
    text = [t for n, t in zip(row["nodes"], row["texts"]) if kept[n]]
    return "\n".join(text or (t for n, t in zip(row["nodes"], row["texts"]) if within[n] and not out_of_text(flags[n])))


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    align = _Aligner()
    for batch in few(batches, 200):
        out = [_read(row, align) for row in batch.select(["shape", "nodes", "texts", "linked", "known"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, share: float = SHARE, support: int = SUPPORT) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host.alias("host"), F.col("html").cast("string").alias("html"))
    url = plain.schema["url"].dataType.simpleString()
    trees = written(plain.mapInArrow(_parse, f"page_id bigint, url {url}, host string, {_TREE}"), "trees")
    page = F.struct("page_id", "digests")
    layouts = trees.filter(F.exists("digests", lambda x: x != 0)).groupBy("host", "shape").agg(F.count("*").alias("n"), F.min(page).alias("low"), F.max(page).alias("high"))
    often = Window.partitionBy("host").orderBy(F.desc("n"), "shape")
    layouts = layouts.withColumn("i", F.row_number().over(often)).filter(F.col("i") <= LAYOUTS)
    reference = layouts.select("host", F.col("shape").alias("ref_shape"), F.posexplode(F.array_distinct(F.array("low.digests", "high.digests"))).alias("ref", "ref_digests"))
    shapes = trees.select("host", "shape", "digests", "nodes", "texts", "linked").join(written(reference, "references"), "host")
    sums = ("aligned", "differ", "equal", "plain", "linked")
    agreed = shapes.mapInArrow(_agree, f"host string, ref_shape string, ref int, node int, {', '.join(f'{x} bigint' for x in sums)}").groupBy("host", "ref_shape", "ref", "node").agg(*(F.sum(x).alias(x) for x in sums))
    # a shape has as many slots as nodes
    slots = agreed.groupBy("host", "ref_shape").agg(F.sort_array(F.collect_list(F.struct("node", "ref", *sums))).alias("slots"))
    wrappers = slots.mapInArrow(_induce(share, support), "host string, ref_shape string, inside array<int>, content array<int>")
    known = wrappers.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("ref_shape", "inside", "content"))).alias("known"))
    texts = trees.select("page_id", "url", "host", "shape", "nodes", "texts", "linked").join(written(known, "wrappers"), "host", "left").mapInArrow(_assemble, f"page_id bigint, url {url}, text string")
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))
