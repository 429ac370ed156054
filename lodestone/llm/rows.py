"""Whole rows carried as one struct, so that no helper column can clash with a column of theirs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "__row"
SLICE = 500


def slices(batches: Iterator[pa.RecordBatch], n: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a few at a time: what a worker holds as Python objects stays small."""
    for b in batches:
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def wrap(docs: DataFrame, **more: Column) -> DataFrame:
    """One struct of all columns, and the columns named here."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(ROW)
    return docs.select(row, *(v.alias(k) for k, v in more.items()))


def unwrap(rows: DataFrame, **changed: Column) -> DataFrame:
    """The columns of the struct again, some of them replaced."""
    names = rows.schema[ROW].dataType.names
    return rows.select(*(changed[n].alias(n) if n in changed else F.col(f"{ROW}.`{n}`").alias(n) for n in names))
