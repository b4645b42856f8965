"""Tables with columns of any name: inside an operator by place, outside by their own names.

An operator knows `doc_id` and `text`; every other column is carried as c0, c1, .. while it works, so no name that
a table may have (marks of the operators' own, backticks, dots, two that differ in case) can clash with one made here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkassay.llm.memory import tidy

#: Columns that operators look at, with the types that they read.
KNOWN = {"doc_id": "bigint", "text": "string"}


def quoted(names: list[str]) -> list[Column]:
    """Columns by their whole names."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def place(names: list[str], name: str) -> int | None:
    """Where a column stands: the first of just that name, else the first that differs in case only."""
    same = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
    return same[0] if same else None


def pick(table: DataFrame, **types: str) -> DataFrame:
    """The named columns with these types, found by place; null where the table has none of the name."""
    by_place = table.toDF(*(f"c{i}" for i in range(len(table.columns))))
    at = {n: place(table.columns, n) for n in types}
    return by_place.select(*((F.lit(None) if at[n] is None else F.col(f"c{at[n]}")).cast(t).alias(n) for n, t in types.items()))


@dataclass
class Carried:
    """A table by place, and the names that it has outside."""

    df: DataFrame
    names: list[str]

    @property
    def schema(self) -> StructType:
        return self.df.schema

    def to_arrow(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str, source: DataFrame | None = None) -> DataFrame:
        """The carried columns and those that run adds, under the names outside.

        run reads source (the table itself, if none) and gives the carried columns, then the added ones.
        """
        more = StructType.fromDDL(added)
        return (self.df if source is None else source).mapInArrow(tidy(run), StructType([*self.df.schema.fields, *more.fields])).toDF(*self.names, *more.names)


def carried(docs: DataFrame, added: str = "") -> Carried:
    """docs without columns that have the name of an added one."""
    taken = {c.split()[0].lower() for c in added.split(", ") if c}
    by_place = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in taken]
    known = {i: n for n in KNOWN if (i := place(docs.columns, n)) is not None}
    columns = [F.col(f"c{i}").cast(KNOWN[known[i]]).alias(known[i]) if i in known else F.col(f"c{i}") for i in keep]
    return Carried(by_place.select(*columns), [docs.columns[i] for i in keep])


def with_columns(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array], without: tuple[str, ...] = ()) -> pa.RecordBatch:
    """A batch with columns added at its end."""
    keep = [i for i, c in enumerate(batch.schema.names) if c not in without]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *arrays], names=[*(batch.schema.names[i] for i in keep), *names])
