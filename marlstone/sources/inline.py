"""Inline tables: rows given in place of a stored relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import errors as E
from ..types import SqlType, convert


def inline(spark: SparkSession, columns: list[tuple[str, SqlType]], rows: list[tuple]) -> DataFrame:
    """Rows of literals, converted to the columns' types with the checks of an INSERT."""
    out = []
    for row in rows:
        if len(row) < len(columns):
            raise E.MissingValues([n for n, _ in columns[len(row) :]])
        if len(row) > len(columns):
            raise E.TooManyValues(len(columns), len(row))
        out.append(tuple(convert(v, kind) for v, (_, kind) in zip(row, columns, strict=True)))
    return spark.createDataFrame(out, ", ".join(f"`{n}` {kind.spark().simpleString()}" for n, kind in columns))
