"""Every registered query of the evaluation engine, with its DuckDB SQL."""

from __future__ import annotations

from sparkassay.plans import arms, corpus, measures, review  # noqa: F401  each module registers its queries
from sparkassay.plans.base import ORACLE, QUERIES  # noqa: F401
