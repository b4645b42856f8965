"""Every registered query against its DuckDB SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkassay.plans import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    rows = [tuple(None if v is None or v != v else str(v).replace(".0", "") if isinstance(v, float) else str(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)]
    return columns, sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, duck, name):
    assert plain(entry.queries()[name](spark, TABLES).toPandas()) == plain(duck.execute(entry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "rank", "doc_id", "score"]


def test_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
