"""Operator 4 - language identification by mixture inference.

Each language has a distribution over hashed byte n-grams, counted over all labelled training
documents.  A document's n-grams are taken as drawn from a mixture of languages; expectation-
maximisation estimates the proportions.  The language set is chosen by penalised likelihood: sets
nested by proportion are compared, and a further language must raise the log likelihood by more than
penalty * log(n-grams).  The prediction is the language with the largest share of the chosen set.

The log likelihood is concave in the proportions s: with g(k) the mean of p(k) / p(mixture) over the n-grams, no mixture
exceeds the present one by more than n * log(max g).  Rounds go on until this bound is within TOLERANCE or shows on
which side of the penalty the maximum lies, so their number is no setting.

The model takes 128 KB a language, whatever the corpus; the estimation holds VALUES values at once for any number of languages.

Cases: null texts and texts without a letter (a character of Unicode category L) are `und` with score 0, and so
is every text when nothing can be learned from.  A null language is not learned from.  Ties go to the language that
sorts first.  Repeated documents count, and are predicted, once each.  A very long text is held as the counts of its distinct
n-grams, 32,768 at most.  An empty table gives no rows.  Other columns of any name pass through; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import carried, pick, with_columns
from sparkassay.llm.memory import tidy
from sparkassay.llm.words import ALNUM, LOWER, rows, slices, utf8

ORDER = 4
BINS = 1 << 15
PENALTY = 1.0
SMOOTHING = 0.5
#: Estimation ends when no mixture can have a log likelihood greater by this, or when more would not change the decision.
TOLERANCE = 0.05
#: Bytes of text in one run of the estimation, and values (n-grams x languages) that it holds at once.
SLICE, VALUES = 1 << 18, 1 << 19
_LETTER = regex.compile(r"\p{L}")
_KEPT = ALNUM.copy()
_KEPT[0x30:0x3A] = False


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    """Whether crc32 of doc_id's text falls in the part that is not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def grams(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bins of all n-grams, how many of each document) for slices of a text column.

    Letters are lower-cased (A-Z); runs of other characters are one blank, as is either end.
    """
    data, offsets = utf8(column)
    for i, j in slices(offsets, limit):
        at = offsets[i : j + 1] - offsets[i]
        n = at[1:] - at[:-1]
        # one blank before and one after each document
        to = at[:-1] + 2 * np.arange(j - i) + 1
        buf = np.full(int(at[-1]) + 2 * (j - i), 0x20, np.uint8)
        raw = LOWER[data[offsets[i] : offsets[j]]]
        raw[~_KEPT[raw]] = 0x20
        buf[np.arange(len(raw)) + np.repeat(to - at[:-1], n)] = raw
        starts = to - 1
        blank = buf == 0x20
        drop = np.zeros(len(buf), bool)
        drop[1:] = blank[1:] & blank[:-1]
        drop[starts] = False
        kept = np.flatnonzero(~drop)
        buf = buf[kept]
        cut = np.append(np.searchsorted(kept, starts), len(buf))
        size = np.maximum(np.diff(cut) - ORDER + 1, 1)  # a text of under ORDER bytes has one n-gram
        padded = np.concatenate([buf, np.full(ORDER, 0x20, np.uint8)]).astype(np.uint32)
        h = np.zeros(len(buf), np.uint32)
        for k in range(ORDER):
            h = (h << np.uint32(8)) | padded[k : k + len(buf)]
        h = h * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        h = (h * np.uint32(2246822519)) >> np.uint32(32 - 15)
        where = np.arange(int(size.sum())) + np.repeat(cut[:-1] - (np.cumsum(size) - size), size)
        yield i, h[where], size


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language in a partition."""
    counts: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["lang", "bin", "n"])
        counts.clear()

    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        codes, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        for first, bins, size in grams(batch.column("text")):
            own = np.repeat(codes[first : first + len(size)], size)
            for c in np.unique(own):
                counts.setdefault(names[c], np.zeros(BINS, np.int64))
                counts[names[c]] += np.bincount(bins[own == c], minlength=BINS)
        if len(counts) > 32:
            yield from flush()
    yield from flush()


class Model:
    """Log probabilities of each n-gram in each language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        p = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BINS)
        self.p = np.ascontiguousarray(p.T.astype(np.float32))  # a row for each n-gram
        self.log = np.log(self.p)

    def infer(self, bins: np.ndarray, size: np.ndarray, penalty: float) -> Iterator[tuple[int, float, dict[int, float]]]:
        """(language, score, proportions of the chosen set) of each document."""
        ends, i = np.cumsum(size), 0
        room = max(1, VALUES // len(self.names))
        while i < len(size):
            begin = int(ends[i] - size[i])
            j = max(i + 1, int(np.searchsorted(ends, begin + room, "right")))
            part, times = bins[begin : int(ends[j - 1])], None
            n = size[i:j]
            if j == i + 1 and n[0] > BINS:
                counts = np.bincount(part, minlength=BINS)
                part = np.flatnonzero(counts)
                times, n = counts[part].astype(np.float32), np.array([len(part)])
            yield from self._infer(part, n, times, penalty)
            i = j

    def _infer(self, bins: np.ndarray, size: np.ndarray, times: np.ndarray | None, penalty: float) -> Iterator[tuple[int, float, dict[int, float]]]:
        first = np.cumsum(size) - size
        log = self.log[bins] if times is None else self.log[bins] * times[:, None]
        alone = np.add.reduceat(log, first, axis=0, dtype=np.float64)
        total = size.astype(np.float64) if times is None else np.array([times.sum(dtype=np.float64)])
        best = alone.argmax(1)
        cost = penalty * np.log(np.maximum(total, 2))
        relative = np.exp(alone - alone.max(1, keepdims=True))
        relative /= relative.sum(1, keepdims=True)
        p = self.p[bins]
        share, full = proportions(p, size, times, alone.max(1) + cost)
        for i, lang in enumerate(best.tolist()):
            chosen = {lang: 1.0}
            # the whole mixture is the best any set can do
            if full[i] - alone[i, lang] > cost[i]:
                order = np.argsort(-share[i], kind="stable").tolist()
                rows, reached = p[first[i] : first[i] + size[i]], alone[i, lang]
                for k in range(2, len(order) + 1):
                    part, found = proportions(np.ascontiguousarray(rows[:, order[:k]]), size[i : i + 1], times)
                    if found[0] - reached <= cost[i]:
                        break
                    reached, chosen = found[0], {order[x]: float(part[0, x]) for x in range(k)}
                lang = min(chosen, key=lambda x: (-chosen[x], x))
            sure = relative[i, lang] if len(chosen) == 1 else 1.0
            yield lang, min(1.0, max(0.0, chosen[lang] * float(sure))), chosen


def proportions(p: np.ndarray, size: np.ndarray, times: np.ndarray | None = None, line: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each document by expectation-maximisation.

    p: the probability of each n-gram in each language; size: n-grams of each document; times: how often each occurs.
    Documents whose maximum is shown to be on one side of `line` are not estimated further.
    """
    share = np.full((len(size), p.shape[1]), 1 / p.shape[1], np.float64)
    reached = np.empty(len(size))
    live = np.arange(len(size))
    while len(live):
        first = np.cumsum(size) - size
        now = share[live]
        mixed = np.einsum("ij,ij->i", p, np.repeat(now.astype(np.float32), size, axis=0))
        part = p / mixed[:, None]
        logs = np.log(mixed)
        if times is not None:
            part *= times[:, None]
            logs *= times
        total = size if times is None else times.sum(dtype=np.float64)
        g = np.add.reduceat(part, first, axis=0, dtype=np.float64) / np.reshape(total, (-1, 1))
        found = np.add.reduceat(logs, first, dtype=np.float64)
        reached[live] = found
        slack = total * np.log(np.maximum(g.max(1), 1.0))
        # steps beyond what 4-byte probabilities tell are no progress
        done = (slack <= TOLERANCE) | (np.abs(now * g - now).max(1) <= 1e-6)
        if line is not None:
            done |= found + slack <= line[live]
        share[live[~done]] = (now * g)[~done]
        if done.any():
            keep = np.repeat(~done, size)
            p, times = p[keep], times if times is None else times[keep]
            live, size = live[~done], size[~done]
    return share, reached


def train(docs: DataFrame) -> Model | None:
    """Count n-grams of every document that has a language and a text."""
    known = pick(docs, text="string", lang="string").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.mapInArrow(tidy(_count), "lang string, bin int, n bigint")
    table = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    table = table.toArrow()
    names = sorted(table["lang"].unique().to_pylist())
    if not names:
        return None
    dense = np.zeros((len(names), BINS))
    code = {x: i for i, x in enumerate(names)}
    dense[[code[x] for x in table["lang"].to_pylist()], table["bin"].to_numpy()] = table["n"].to_numpy()
    return Model(names, dense)


_ADDED = "lang_pred string, score double, mixture map<string,double>"
_NAMES = [c.split()[0] for c in _ADDED.split(", ")]


def _predict(model: object, penalty: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model.value
        for batch in rows(batches):
            texts = batch.column("text")
            lang, score = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            mixture: list[list] = [[] for _ in lang]
            has = [bool(t and _LETTER.search(t)) for t in texts.to_pylist()]
            if made is not None:
                for first, bins, size in grams(texts):
                    for i, (best, s, chosen) in enumerate(made.infer(bins, size, penalty), first):
                        if has[i]:
                            lang[i], score[i] = made.names[best], s
                            mixture[i] = [(made.names[x], v) for x, v in sorted(chosen.items(), key=lambda y: (-y[1], y[0]))]
            yield with_columns(batch, _NAMES, [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixture, pa.map_(pa.string(), pa.float64()))])

    return run


def identify(docs: DataFrame, learn_from: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """docs (text, ...) with lang_pred, score and mixture (language to proportion of the chosen set)."""
    model = docs.sparkSession.sparkContext.broadcast(train(learn_from))
    return carried(docs, _ADDED).to_arrow(_predict(model, penalty), _ADDED)


def report(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    out = held_out(F.col("doc_id"), 4)
    own = pick(docs, doc_id="bigint", text="string", lang="string")
    found = identify(own.select("doc_id", "text", out.alias("held_out")), own.filter(~out), penalty)
    return found.select("doc_id", "held_out", "lang_pred", "score")
