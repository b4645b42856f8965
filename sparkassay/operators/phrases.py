"""Phrases of a glossary found in token sequences: all of them at once, wherever they stand, overlapping or not.

Phrases make one automaton over tokens: a state for each beginning of a phrase, and a step for each token that goes on.  All places of
a slice of documents take their steps together, so a text is looked at as often as its longest phrase is long.  Phrases go in turns by
their first tokens, so that an automaton that is sent is bounded; a turn more is a scan more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a turn's phrases (about: those with one first token go together).
TURN = 1_000_000


class Automaton:
    """Steps (state, token) -> state as sorted numbers; state 0 is the start, ends tells the phrase that is whole at a state."""

    def __init__(self, phrases: list[list[str]]) -> None:
        self.tokens = sorted({t for p in phrases for t in p})
        number = {t: i for i, t in enumerate(self.tokens)}
        self.width = max(1, len(self.tokens))
        steps: dict[int, int] = {}
        ends = [-1]
        for i, phrase in enumerate(phrases):
            state = 0
            for t in phrase:
                key = state * self.width + number[t]
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                state = steps[key]
            ends[state] = i
        self.keys = np.array(sorted(steps), np.int64)
        self.to = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.ends = np.array(ends)

    def find(self, tokens: pa.Array, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, phrase) of every phrase; last[i]: the end of the text that token i is in."""
        code = pc.index_in(tokens, pa.array(self.tokens, pa.string())).fill_null(-1).to_numpy().astype(np.int64)
        place = np.flatnonzero(code >= 0)
        state, depth = np.zeros(len(place), np.int64), 0
        places, phrases = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(place) and len(self.keys):
            key = state * self.width + code[place + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            place, state = place[on], self.to[at[on]]
            whole = self.ends[state] >= 0
            places.append(place[whole])
            phrases.append(self.ends[state[whole]])
            depth += 1
            more = place + depth < last[place]
            place, state = place[more], state[more]
            known = code[place + depth] >= 0
            place, state = place[known], state[known]
        return np.concatenate(places), np.concatenate(phrases)


def _find(sent: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = sent.value
        names = pa.array(names, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                cut = batch.slice(at, 1000)
                n = np.nan_to_num(cut.column("tokens").value_lengths().fill_null(0).to_numpy()).astype(np.int64)
                ends = np.cumsum(n)
                place, phrase = automaton.find(cut.column("tokens").flatten(), np.repeat(ends, n))
                doc = np.searchsorted(ends, place, "right")
                order = np.lexsort((phrase, place, doc))
                cuts = np.searchsorted(doc[order], np.arange(cut.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts), names.take(pa.array(phrase[order])))], names=["doc_id", "found"])

    return run


def found(docs: DataFrame, phrases: DataFrame, turn: int = TURN) -> DataFrame:
    """(doc_id, found): the phrases (phrase, tokens) that stand in docs (doc_id, tokens), one for each place, in a row of each document a turn."""
    whole = phrases.filter("size(tokens) > 0").dropDuplicates(["tokens"])
    turns = max(1, math.ceil((whole.agg(F.sum(F.size("tokens"))).first()[0] or 0) / turn))
    out = None
    for t in range(turns):
        rows = whole.filter(F.pmod(F.xxhash64(F.get("tokens", F.lit(0))), F.lit(turns)) == t).select("phrase", "tokens").toArrow().sort_by("phrase")
        sent = docs.sparkSession.sparkContext.broadcast((Automaton(rows["tokens"].to_pylist()), rows["phrase"].to_pylist()))
        some = docs.select("doc_id", "tokens").mapInArrow(_find(sent), "doc_id bigint, found array<string>")
        out = some if out is None else out.unionByName(some)
    return out if turns == 1 else out.groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))  # a row a turn
