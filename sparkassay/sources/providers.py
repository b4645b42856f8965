"""Answering models as partition functions; a plain one that extracts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

ANSWER = "question_id bigint, status string, answer string, citations array<string>"


def extractive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Answers with the first sentence of the best hit and cites C1; abstains without hits.

    Input: question_id, retrieval (array of hits in rank order).
    """
    for batch in batches:
        rows = []
        for question, hits in zip(batch["question_id"], batch["retrieval"]):
            first = re.split(r"(?<=[.!?])\s+", hits[0]["excerpt"], maxsplit=1)[0].strip() if hits is not None and len(hits) else ""
            rows.append((question, "answered", first, ["C1"]) if first else (question, "abstain", "", []))
        yield pd.DataFrame(rows, columns=["question_id", "status", "answer", "citations"])


def answer(questions: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] = extractive) -> DataFrame:
    """Run a provider over (question_id, retrieval)."""
    return questions.select("question_id", "retrieval").mapInPandas(provider, ANSWER)
