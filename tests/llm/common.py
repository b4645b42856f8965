"""Small documents for the operators' tests."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows with columns whose names clash with those of results."""
    full = [(d, t, "en", "src", len(t or ""), "x", 7) for d, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, sequence_id int")


def near_copies(rng: random.Random, n: int, vocabulary: int = 400) -> list[tuple]:
    """Random texts, some of them copies of earlier ones with a few words changed."""
    words = [f"w{i}" for i in range(vocabulary)]
    out: list[tuple] = []
    for i in range(n):
        if out and rng.random() < 0.6:
            text = rng.choice(out)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        out.append((i * 3 + 1, " ".join(text)))
    return out
