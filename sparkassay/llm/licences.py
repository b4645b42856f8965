"""Operator 5 - licence scans by a generalised suffix automaton of licence words.

The automaton holds every run of words of every template.  A text is streamed through it, which gives at each
word the longest run of a template that ends there (matching statistics).  Runs of MIN_MATCH words or
more are chained, in the order of their template, into spans; a template that a chain covers well
enough gives its label.  A base phrase is a template whose whole run must match; each place counts.

Words that no template has reset the automaton, so only runs of template words are streamed.

Templates are given to a Scanner, or read from a table of (text, label) by `scanner_of`, whose words must fit MOST_WORDS: the
automaton goes to every executor.

Cases: a null or empty text has no words, labels or score.  Repeated rows get their result each.  An empty table gives no
rows.  Of chains of one label that start at one word, the one that covers most of its template is the span, the first
found of equals; base phrases that start at one word count each.  A very long text is streamed whole.  Other columns of any name pass
through `scan_licences`; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.frames import carried, pick, with_columns
from sparkassay.llm.words import ALNUM, U64, Words, scan

MIN_MATCH = 4
#: Words of the text, or of the template, that may lie between two chained runs.
MAX_GAP = 12
#: Share of a template's words that a chain must cover.
COVERAGE = 0.75
#: Words of all templates that an automaton may hold: some 200 MB of states.
MOST_WORDS = 400_000

# The phrases and labels of the contract.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices of public licences, in their own words.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gpl-2"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates: list[list[str]]) -> None:
        self.sizes = [len(t) for t in templates]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in templates for w in t}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]  # (template, place of the last word)
        for t, template in enumerate(templates):
            last = 0
            for place, word in enumerate(template):
                last = self._extend(last, self.vocabulary[word])
                self.ends[last].add((t, place))
        for s in sorted(range(1, len(self.len)), key=lambda s: -self.len[s]):
            if self.link[s] > 0:
                self.ends[self.link[s]] |= self.ends[s]
        # templates that a match in a state can end with, the whole of them: its own and its suffixes'
        self.whole: list[list[int]] = [[] for _ in self.ends]
        for s in sorted(range(1, len(self.len)), key=lambda s: self.len[s]):
            own = {t for t, place in self.ends[s] if place == self.sizes[t] - 1 == self.len[s] - 1}
            self.whole[s] = sorted(own.union(self.whole[self.link[s]]))

    def _new(self, size: int, after: dict[int, int], link: int) -> int:
        self.len.append(size)
        self.next.append(after)
        self.link.append(link)
        self.ends.append(set())
        return len(self.len) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of q's strings no longer than p's and one word."""
        twin = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, word, q)
        state, p = self._new(self.len[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[state] = q if self.len[q] == self.len[p] + 1 else self._split(p, word, q)
        return state

    def occurrences(self, state: int, length: int, least: int) -> Iterator[tuple[int, int, int]]:
        """(template, place of the last word, words) of a match and of its suffixes of least words or more."""
        seen: set[tuple[int, int]] = set()
        while length >= least:
            for end in self.ends[state] - seen:
                yield *end, length
            seen |= self.ends[state]
            state = self.link[state]
            length = self.len[state]

    def stream(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length of the longest match) after each word; -1 is a word of no template."""
        state = length = 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if (to := self.next[state].get(w)) is not None:
                state, length = to, length + 1
            else:
                state = length = 0
            yield state, length


def chains(matches: list[tuple[int, int, int, int]], sizes: list[int]) -> Iterator[tuple[int, int, int, float]]:
    """(template, first word, last word, share covered) of the best chain that ends with each match.

    matches: (template, first word, last word, place of the last word in the template).
    """
    by_template: dict[int, list[tuple[int, int, int]]] = {}
    for t, a, b, place in matches:
        by_template.setdefault(t, []).append((a, b, place))
    for t, found in by_template.items():
        found.sort(key=lambda m: (m[1], m[0], m[2]))
        done: list[tuple[int, int, int, int, int]] = []  # (first, last, place, covered, start of the chain)
        for a, b, place in found:
            best, start = b - a + 1, a
            for x in range(len(done) - 1, -1, -1):
                _, end, at, covered, began = done[x]
                if end < a - MAX_GAP - sizes[t]:
                    break
                new = min(b - max(a - 1, end), place - max(at, place - (b - a + 1)))  # words not covered yet
                if new > 0 and at < place and 0 <= a - 1 - end <= MAX_GAP and 0 <= place - (b - a + 1) - at <= MAX_GAP and covered + new > best:
                    best, start = covered + new, began
            done.append((a, b, place, best, start))
            yield t, start, b, best / sizes[t]


class Scanner:
    """The automaton of base phrases and templates, and their labels."""

    def __init__(self, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> None:
        self.base = len(base)
        self.labels = [x for _, x in (*base, *templates)]
        texts = [t.split() for t, _ in (*base, *templates)]
        self.automaton = Automaton(texts)
        self.shortest = min(MIN_MATCH, min(len(t) for t in texts[: self.base]) if base else MIN_MATCH)
        names = list(self.automaton.vocabulary)
        hashes = np.concatenate([w.hashes() for w in scan(pa.array([" ".join(names)]), ALNUM)])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.names = hashes[order], order, names
        self.known = np.zeros(1 << 16, bool)
        self.known[(hashes >> U64(48)).astype(np.int64)] = True

    def runs(self, w: Words) -> Iterator[tuple[int, int, list[int]]]:
        """(document, its first word's place in the document, word numbers) of runs of template words."""
        h = w.hashes()
        at = np.flatnonzero(self.known[(h >> U64(48)).astype(np.int64)])
        to = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[to] == h[at]
        at, word = at[same], self.ids[to[same]]
        if not len(at):
            return
        doc = np.searchsorted(w.doc, at, "right") - 1
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
        starts, ends = np.r_[0, cut], np.r_[cut, len(at)]
        long = ends - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            first = int(at[a])
            ids = word[a:b].tolist()
            # hashes only point at words: the words themselves decide
            ids = [x if w.text(first + i, first + i + 1).decode() == self.names[x] else -1 for i, x in enumerate(ids)]
            yield int(doc[a]), first - int(w.doc[doc[a]]), ids

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]]:
        """(words, base places with labels, spans of covered templates) of each text."""
        for w in scan(column, ALNUM):
            counts = w.counts().tolist()
            base: list[list[tuple[int, str]]] = [[] for _ in counts]
            matches: list[list[tuple[int, int, int, int]]] = [[] for _ in counts]
            for d, first, ids in self.runs(w):
                stats = list(self.automaton.stream(ids))
                for i, (state, length) in enumerate(stats):
                    for t in self.automaton.whole[state]:
                        if t < self.base and self.automaton.sizes[t] <= length:
                            base[d].append((first + i - self.automaton.sizes[t] + 1, self.labels[t]))
                    if length >= MIN_MATCH and (i + 1 == len(stats) or stats[i + 1][1] <= length):
                        matches[d] += [(t, first + i - n + 1, first + i, place) for t, place, n in self.automaton.occurrences(state, length, MIN_MATCH) if t >= self.base]
            for n, b, m in zip(counts, base, matches):
                spans: dict[tuple[str, int], tuple[str, int, int, float]] = {}
                for t, x, y, share in chains(m, self.automaton.sizes):
                    if share >= COVERAGE and share > spans.get((self.labels[t], x), ("", 0, 0, 0.0))[3]:
                        spans[self.labels[t], x] = (self.labels[t], x, y, min(1.0, share))
                yield n, b, sorted(spans.values(), key=lambda s: (s[1], s[2], s[0]))


_ADDED = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,last:bigint,covered:double>>"
_NAMES = [c.split()[0] for c in _ADDED.split(", ")]


def _scan(scanner: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = scanner.value
        kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
        for batch in batches:
            out: list[list] = [[] for _ in _NAMES]
            for n, base, spans in made.scan(batch.column("text")):
                places, own = [p for p, _ in base], {x for _, x in base}
                row = (n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), 1.0 if base else max((s[3] for s in spans), default=0.0), [dict(zip(("label", "first", "last", "covered"), s)) for s in spans])
                for c, v in zip(out, row):
                    c.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), kind]
            yield with_columns(batch, _NAMES, [pa.array(c, k) for c, k in zip(out, kinds)])

    return run


def scanner_of(templates: DataFrame, base: list[tuple[str, str]] = BASE) -> Scanner:
    """A scanner of templates held as rows (text, label); null ones and those without words are left out.

    More words than MOST_WORDS are refused before any comes to the driver.
    """
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = templates.filter("label is not null").select(F.regexp_extract_all(lower, F.lit(word), F.lit(0)).alias("words"), F.col("label").cast("string").alias("label")).filter(F.size("words") > 0).distinct()
    n = cut.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    if n > MOST_WORDS:
        raise ValueError(f"{n} words of templates; an automaton holds {MOST_WORDS}")
    return Scanner(base, [(" ".join(r["words"]), r["label"]) for r in cut.orderBy("label", "words").collect()])


def scan_licences(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """docs (text, ...) with word counts, base places, labels, score and spans."""
    return carried(docs, _ADDED).to_arrow(_scan(docs.sparkSession.sparkContext.broadcast(scanner or Scanner())), _ADDED)


def report(docs: DataFrame) -> DataFrame:
    """doc_id and all but the spans."""
    return scan_licences(pick(docs, doc_id="bigint", text="string")).select("doc_id", *_NAMES[:-1])
