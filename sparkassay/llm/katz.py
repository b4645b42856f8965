"""Operator 6 - language-model scores by Katz backoff of bigrams.

P(w | h) is d(c) c(h w) / c(h) for a pair seen in training, else alpha(h) P(w).  P(w) is d(c) c(w) / N for a known
word; what the discounts leave is the probability of an unknown one.  alpha(h) shares out exactly what
the discounts leave of h: (lost(h) / c(h)) / (1 - sum of P(w) over the words seen after h).

The count tables are partitioned by the hash of the n-gram.  Documents form blocks of about BLOCK tokens
in place; a block asks each partition once for its distinct n-grams, as packed sorted hashes with their
counts in the block's training documents.  A partition adds these up and answers with the corpus
counts, in the order asked.  So a frequent n-gram costs one entry a block, whatever its count, and
neither the driver nor a task holds a table that grows with the corpus.

1. blocks: token numbers and the block's words.   2. counts: answers of all partitions, for words and pairs.
3. partial: each document's score but for the alphas it needs, and each block's share of what contexts
   lose; a pair is accounted by the first block that holds it.   4. alphas: added up by context, answered to the blocks.
   A context that stands in one block only needs no answer: the block has all of its alpha.

Good-Turing discounts apply to counts up to TRUSTED, from counts of counts over the whole corpus, smoothed
where copies make them uneven; above, a count loses LEAST, so that every context leaves something.

Words are known by a 64-bit hash that mixes every eight bytes with their place, so texts cannot be made to collide by repeating
patterns.  In some 3 of 100 corpora of 10^9 different words, two words share a hash.

Cases: a null or empty text is the end token alone.  Without training documents every text has score
0.  Repeated rows are learned and scored once each.  A null doc_id is learned from.  A very long text makes a block by itself.
An empty table gives no rows.  Columns besides doc_id, text and held_out, of any name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import pick
from sparkassay.llm.langid import held_out
from sparkassay.llm.store import written
from sparkassay.llm.words import NOT_SPACE, U64, mix, scan

BLOCK = 1_000_000
#: Tokens of the corpus for each partition of the tables.
PARTITION = 1_000_000
TRUSTED = 5
LEAST = 0.01
#: The context before a document's first word, and the token after its last: hashes of no word in practice.
START, END = U64(1), U64(2)
_STEP = U64(0x9E3779B97F4A7C15)
WORD, PAIR = 0, 1


# -- discounts -----------------------------------------------------------------------------


def _factors(ratios: np.ndarray, cut: float) -> np.ndarray | None:
    """Katz's factors d(0..TRUSTED) from r*/r of r = 1..TRUSTED and what counts above keep; None where they are not between 0 and 1."""
    d = (ratios - cut) / (1 - cut) if cut < 1 else np.zeros(TRUSTED)
    return np.append(1.0, d) if ((d > 0) & (d < 1)).all() else None


def _slope(n: list[int]) -> float:
    """b of the log-linear fit n(r) ~ r^b of Simple Good-Turing; gaps thin out the counts beside them."""
    r = [c for c in range(1, len(n)) if n[c]]
    if len(r) < 2:
        return 0.0
    after = [*r[1:], 2 * r[-1] - r[-2]]
    z = [2 * n[c] / (t - q) for q, c, t in zip([0, *r], r, after)]
    return float(np.polyfit(np.log(r), np.log(z), 1)[0])


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Katz's factors d(0..TRUSTED) from the numbers of n-grams seen 1, 2, .. TRUSTED + 1 times.

    Copies in the corpus make counts of counts uneven, so that Turing's r* = (r + 1) n(r + 1) / n(r) can exceed r.
    Then n(r) is smoothed by a log-linear fit (Simple Good-Turing), which gives r*/r = (1 + 1/r)^(b + 1) and
    factors between 0 and 1 for any b < -1.  Without such a fit a count loses a constant share of one.
    """
    n, k = [0, *counts_of_counts], TRUSTED
    r = np.arange(1, k + 1)
    d = None
    if all(n[1 : k + 2]):
        d = _factors(np.array([(c + 1) * n[c + 1] / (c * n[c]) for c in r.tolist()]), (k + 1) * n[k + 1] / n[1])
    if d is None and (b := _slope(n)) < -1:
        d = _factors((1 + 1 / r) ** (b + 1), float(k + 1) ** (b + 1))
    if d is None:
        one = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = np.append(1.0, (r - one) / r)
    return d


@dataclass
class Totals:
    """What the whole corpus tells."""

    tokens: int
    types: int
    word: np.ndarray
    pair: np.ndarray
    unknown: float  # probability of all unknown words together

    def kept(self, counts: np.ndarray, kind: int) -> np.ndarray:
        """Discounted counts."""
        d = self.pair if kind == PAIR else self.word
        return np.where(counts <= TRUSTED, d[np.minimum(counts, TRUSTED)] * counts, counts - LEAST)

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.kept(counts, WORD) / max(1, self.tokens), self.unknown)


def _totals(stats: list) -> Totals:
    """From (kind, sum, types, n1..n6) summed over partitions."""
    by = {r["kind"]: r["stats"] for r in stats}
    tokens, types, *words = by.get(WORD, [0] * (TRUSTED + 3))
    _, _, *pairs = by.get(PAIR, [0] * (TRUSTED + 3))
    out = Totals(tokens, types, discounts(words), discounts(pairs), 1.0)
    if tokens:
        small = sum(c * words[c - 1] * (1 - out.word[c]) for c in range(1, TRUSTED + 1))
        out.unknown = (small + LEAST * (types - sum(words[:TRUSTED]))) / tokens
    return out


# -- blocks --------------------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its documents and their tokens as places in the block's sorted words."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids: list = []
    held: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    tokens = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, tokens
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        # frequent words get small numbers, which take few bytes once compressed
        order = np.argsort(-np.bincount(at), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at = rank[at]
        train = np.repeat(~np.concatenate(held), np.concatenate(sizes))
        row = [number, list(ids), np.concatenate(held), np.concatenate(sizes).astype("<i4").tobytes(), words[order].tobytes(), _planes(at), _small(np.bincount(at[train], minlength=len(words))), tokens]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["block", "doc_ids", "held", "sizes", "words", "tokens", "trained", "n_tokens"])
        number += 1
        tokens = 0
        for x in (ids, held, sizes, hashes):
            x.clear()
        return out

    for batch in batches:
        doc, out = batch.column("doc_id").to_pylist(), batch.column("held_out").to_numpy(zero_copy_only=False)
        for w in scan(batch.column("text"), NOT_SPACE):
            n = w.counts()
            h = np.full(int(n.sum()) + w.n, END)
            h[np.arange(int(n.sum())) + np.repeat(np.arange(w.n), n)] = w.hashes()
            ids += doc[w.first : w.first + w.n]
            held.append(out[w.first : w.first + w.n])
            sizes.append(n + 1)
            hashes.append(h)
            tokens += len(h)
            if tokens >= BLOCK:
                yield flush()
    if ids:
        yield flush()


_BLOCKS = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes binary, words binary, tokens binary, trained binary, n_tokens bigint"


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their first bytes, then their second, and so on."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Block:
    """A block's tokens with their words and pairs."""

    def __init__(self, row: dict) -> None:
        self.number, self.ids = row["block"], row["doc_ids"]
        self.held = np.array(row["held"], bool)
        self.sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        words = np.frombuffer(row["words"], U64)
        order = np.argsort(words)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.words, self.trained = words[order], _wide(row["trained"])[order]
        self.word = place[_from_planes(row["tokens"])]
        self.train = np.repeat(~self.held, self.sizes)
        first = np.cumsum(self.sizes) - self.sizes
        #: contexts as places in the words, START after the last
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[first] = len(self.words)
        h = np.append(self.words, START)
        self.pairs, self.pair = np.unique(mix(h[self.context] * _STEP + self.words[self.word]), return_inverse=True)

    def asks(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted hashes, counts in training documents); START counts as a word here."""
        words = np.append(START, self.words)
        trained = np.append(int((~self.held).sum()), self.trained)
        return [(WORD, words, trained), (PAIR, self.pairs, np.bincount(self.pair[self.train], minlength=len(self.pairs)))]


def _ranges(keys: np.ndarray, partitions: int) -> list[tuple[int, int, int]]:
    """(partition, from, to) of sorted hashes: partitions are equal ranges of hashes."""
    edges = [((p << 64) // partitions) for p in range(1, partitions)]
    cuts = [0, *np.searchsorted(keys, np.array(edges, U64)).tolist(), len(keys)]
    return [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _ask(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for kind, keys, trained in block.asks():
                    cuts = _ranges(keys, partitions)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(cuts), pa.int32()), pa.array([p for p, _, _ in cuts], pa.int32()), pa.array([block.number] * len(cuts), pa.int64()), pa.array([keys[a:b].tobytes() for _, a, b in cuts], pa.binary()), pa.array([_small(trained[a:b]) for _, a, b in cuts], pa.binary())],
                        names=["kind", "part", "block", "keys", "counts"],
                    )

    return run


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + counts.astype(kind.newbyteorder("<")).tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


_ANSWER = "kind int, part int, block bigint, counts binary, first binary, stats array<bigint>"
_ANSWER_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("counts", pa.binary()), ("first", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """Corpus counts of one partition, to each block that asked; and the partition's counts of counts."""
    kind, part = (k.as_py() for k in key)
    table = table.sort_by("block")
    blocks = table["block"].to_pylist()
    asked = [np.frombuffer(x.as_py(), U64) for x in table["keys"]]
    trained = np.concatenate([_wide(x.as_py()) for x in table["counts"]])
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, trained)
    # the first block with a key in training accounts for it
    rows = np.flatnonzero(trained > 0)[::-1]
    owner = np.full(len(keys), -1)
    owner[at[rows]] = rows
    first = np.zeros(len(at), bool)
    first[owner[owner >= 0]] = True
    if kind == WORD:  # for words: whether the block is the only one that has it
        first = np.bincount(at)[at] == 1
    out, begin = {c: [] for c in _ANSWER_ARROW.names}, 0
    for block, x in zip(blocks, asked):
        end = begin + len(x)
        values = (kind, part, block, _small(counts[at[begin:end]]), np.packbits(first[begin:end]).tobytes(), None)
        for c, v in zip(out, values):
            out[c].append(v)
        begin = end
    real = counts[(counts > 0) & (keys != START)] if kind == WORD else counts[counts > 0]
    stats = [int(real.sum()), len(real), *(int((real == c).sum()) for c in range(1, TRUSTED + 2))]
    for c, v in zip(out, (kind, part, -1, b"", b"", stats)):
        out[c].append(v)
    return pa.table(out, _ANSWER_ARROW)


# -- scores --------------------------------------------------------------------------------

_PARTIAL = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes binary, known binary, base binary, score binary, contexts binary, lost binary, seen binary, totals binary, docs binary, places binary"
_PARTIAL_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("sizes", "known", "base", "score", "contexts", "lost", "seen", "totals", "docs", "places"))])


def _partial(totals: object):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _PARTIAL_ARROW.empty_table()
        block, all_ = Block(left.slice(0, 1).to_pylist()[0]), totals.value
        right = right.sort_by([("kind", "ascending"), ("part", "ascending")]).to_pylist()
        words = np.concatenate([_wide(r["counts"]) for r in right if r["kind"] == WORD])
        starts, words = words[0], words[1:]  # START sorts first
        pairs = np.concatenate([_wide(r["counts"]) for r in right if r["kind"] == PAIR])
        marks = lambda kind: np.concatenate([np.unpackbits(np.frombuffer(r["first"], np.uint8), count=len(_wide(r["counts"]))) for r in right if r["kind"] == kind]).astype(bool)
        first, alone = marks(PAIR), marks(WORD)
        documents = np.repeat(np.arange(len(block.sizes)), block.sizes)
        total = lambda x: np.bincount(documents, x, minlength=len(block.sizes))
        own = words[block.word]
        base = np.log10((words + 1) / (all_.tokens + all_.types + 1))[block.word]
        contexts = np.append(words, starts)  # each context's count
        seen = pairs[block.pair] > 0
        chance = np.log10(all_.word_probability(words))[block.word]
        context = contexts[block.context]
        score = np.where(seen, np.log10(np.where(seen, all_.kept(pairs, PAIR)[block.pair], 1) / np.maximum(context, 1)), chance)
        # what each context loses, by the pairs this block accounts for
        which = np.zeros(len(block.pairs), np.int64)
        which[block.pair] = np.arange(len(block.pair))
        mine = which[first]
        lost = np.bincount(block.context[mine], (pairs - all_.kept(pairs, PAIR))[first], minlength=len(contexts))
        after = np.bincount(block.context[mine], all_.word_probability(words)[block.word[mine]], minlength=len(contexts))
        # alphas of contexts that stand in no other block are known here
        whole = np.append(alone[1:], alone[0]) & (contexts > 0)
        alpha = np.zeros(len(contexts))
        alpha[whole] = _log_alpha(lost[whole], after[whole], contexts[whole])
        waits = ~seen & (context > 0)
        score = score + np.where(waits, alpha[block.context], 0)
        # documents wait for the others
        waits = np.flatnonzero(waits & ~whole[block.context])
        used = np.zeros(len(contexts), bool)
        used[block.context[mine]] = True
        used[block.context[waits]] = True
        used &= ~whole
        keys = np.append(block.words, START)[used]
        order = np.argsort(keys)
        place = np.empty(len(contexts), np.int64)
        place[np.flatnonzero(used)[order]] = np.arange(len(keys))
        cut = np.flatnonzero(used)[order]
        row = {
            "block": block.number, "doc_ids": block.ids, "held": block.held, "sizes": block.sizes.astype("<i4").tobytes(), "known": total(own > 0).astype("<i4").tobytes(), "base": total(base).tobytes(), "score": total(score).tobytes(),
            "contexts": keys[order].tobytes(), "lost": lost[cut].tobytes(), "seen": after[cut].tobytes(), "totals": _small(contexts[cut]), "docs": documents[waits].astype("<u4").tobytes(), "places": place[block.context[waits]].astype("<u4").tobytes(),
        }
        return pa.table({c: [v] for c, v in row.items()}, _PARTIAL_ARROW)

    return run


def _log_alpha(lost: np.ndarray, seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log10 alpha from the counts a context loses, the word probability of what follows it, and its count."""
    with np.errstate(divide="ignore"):
        return np.log10(lost / np.maximum(n, 1)) - np.log10(np.maximum(1 - seen, 1e-300))


def _ask_alpha(partitions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, lost, seen, n = np.frombuffer(row["contexts"], U64), np.frombuffer(row["lost"]), np.frombuffer(row["seen"]), _wide(row["totals"])
                cuts = _ranges(keys, partitions)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _, _ in cuts], pa.int32()), pa.array([row["block"]] * len(cuts), pa.int64()), *(pa.array([x[a:b].tobytes() for _, a, b in cuts], pa.binary()) for x in (keys, lost, seen)), pa.array([_small(n[a:b]) for _, a, b in cuts], pa.binary())],
                    names=["part", "block", "keys", "lost", "seen", "totals"],
                )

    return run


def _answer_alpha(key: tuple, table: pa.Table) -> pa.Table:
    """log10 alpha of one partition's contexts, to each block that asked."""
    asked = [np.frombuffer(x.as_py(), U64) for x in table["keys"]]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    lost, seen, n = np.zeros(len(keys)), np.zeros(len(keys)), np.zeros(len(keys), np.int64)
    np.add.at(lost, at, np.concatenate([np.frombuffer(x.as_py()) for x in table["lost"]]))
    np.add.at(seen, at, np.concatenate([np.frombuffer(x.as_py()) for x in table["seen"]]))
    np.maximum.at(n, at, np.concatenate([_wide(x.as_py()) for x in table["totals"]]))
    alpha = _log_alpha(lost, seen, n)
    cuts = np.cumsum([len(x) for x in asked])
    return pa.table({"part": pa.array([key[0].as_py()] * len(asked), pa.int32()), "block": table["block"], "alpha": pa.array([alpha[at[b - len(x) : b]].tobytes() for x, b in zip(asked, cuts)], pa.binary())})


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    kinds = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    if not left.num_rows:
        return kinds.empty_table()
    row = left.slice(0, 1).to_pylist()[0]
    score = np.frombuffer(row["score"]).copy()
    answers = right.sort_by("part")["alpha"].to_pylist()
    if answers:
        alpha = np.concatenate([np.frombuffer(x) for x in answers])
        np.add.at(score, np.frombuffer(row["docs"], "<u4"), alpha[np.frombuffer(row["places"], "<u4")])
    return pa.table([pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(np.frombuffer(row["sizes"], "<i4").astype(np.int64)), pa.array(np.frombuffer(row["known"], "<i4").astype(np.int64)), pa.array(np.frombuffer(row["base"])), pa.array(score)], schema=kinds)


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text, held_out): token counts, base_score and score.

    Documents are learned from unless held_out.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    blocks = written(plain.mapInArrow(_blocks, _BLOCKS), "blocks")
    partitions = max(1, math.ceil((blocks.agg(F.sum("n_tokens")).first()[0] or 0) / PARTITION))
    asks = blocks.mapInArrow(_ask(partitions), "kind int, part int, block bigint, keys binary, counts binary")
    counts = written(asks.groupBy("kind", "part").applyInArrow(_answer, _ANSWER), "counts")
    each = counts.filter("block = -1").select("kind", F.posexplode("stats").alias("i", "n")).groupBy("kind", "i").agg(F.sum("n").alias("n"))
    stats = each.groupBy("kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("stats")).collect()
    totals = _totals(stats)
    answers = counts.filter("block >= 0").select("kind", "part", "block", "counts", "first")
    partial = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_partial(spark.sparkContext.broadcast(totals)), _PARTIAL), "partial")
    asks = partial.select("block", "contexts", "lost", "seen", "totals").mapInArrow(_ask_alpha(partitions), "part int, block bigint, keys binary, lost binary, seen binary, totals binary")
    alphas = asks.groupBy("part").applyInArrow(_answer_alpha, "part int, block bigint, alpha binary")
    done = partial.select("block", "doc_ids", "held", "sizes", "known", "base", "score", "docs", "places").groupBy("block").cogroup(alphas.groupBy("block"))
    out = done.applyInArrow(_finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(totals.tokens).cast("bigint"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    found = score(pick(docs, doc_id="bigint", text="string").select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held_out")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
