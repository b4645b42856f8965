"""Operator 1 against the tokenizer itself: every piece is there once, in gapless sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkassay.llm import packing
from sparkassay.llm.registry import tokenizer_path
from sparkassay.llm.tokens import WordPieces
from tests.llm.common import documents

tokenizers = pytest.importorskip("tokenizers")


def expected(rows, capacity):
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    out = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            out.append((d, piece, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("capacity", [8, 64, 2048])
def test_pieces_and_sequences(spark, capacity):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Beta,", "é", "x1", "中文", "it's"]) for _ in range(rng.randint(0, 90))) for _ in range(300)]
    rows = [*enumerate(texts), (5, texts[5]), (None, "no id"), (1000, None), (1001, ""), (1002, "long " * 9000), (1003, "<|endoftext|>a")]
    got = packing.pack(documents(spark, rows).repartition(5), tokenizer_path(), capacity, capacity - capacity // 64 - 1).collect()
    assert order([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]) == order(expected(rows, capacity))
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
    # as few as best-fit over everything at once, but for what one round may leave
    alone = len(packing.best_fit(np.array([r.length for r in got]), capacity))
    assert len(sequences) <= alone * 1.02 + 1


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aB'sé<|>endoftx 0१½\x1c\x85　́ΣİAßſ中😀_-\n\t²")), max_size=30), max_size=8))
def test_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(WordPieces.shared(tokenizer_path()).encode(pa.array(texts, pa.string()))) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_best_fit_bins(sizes):
    bins = packing.best_fit(np.array(sizes), 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= 2 * -(-sum(sizes) // 50)


def test_memory_is_given_up_and_learned_again():
    """Ids stay right where chunks and pieces are forgotten between and within slices, and a worker keeps no object for each of them."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice("abcé'1,\x85\xa0 \n") for _ in range(rng.randint(0, 60))) for _ in range(200)] + ["中 a", None, "<|endoftext|>", "\xa0", "a\x1cb"]
    whole = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = [np.array(whole.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    words = WordPieces(tokenizer_path())
    words.chunks.limit, words.pieces.limit = 150, 60
    for at in range(0, len(texts), 20):
        assert list(words.encode(pa.array(texts[at : at + 20], pa.string()))) == want[at : at + 20]
    assert isinstance(words.chunks.names, pa.Array)
    assert len(words.chunks.names) < len({c for t in texts[:200] for c in t.lower().split()})
