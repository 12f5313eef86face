"""Cardinality of a filtered relation from its sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No filter is taken for more selective than one row in this many.
FLOOR = 2048


def filtered(matches: int, sampled: int, total: int) -> int:
    """max(floor(matches / sampled * total), floor(total / 2048), 1)."""
    return max(matches * total // sampled if sampled else 0, total // FLOOR, 1)


def estimate(sample: DataFrame, predicate: Column | None, total: int) -> int:
    """Rows of ``total`` that satisfy ``predicate``; NULLs don't.  Without predicate all."""
    if predicate is None:
        return total
    r = sample.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(predicate, 1)).alias("m")).head()
    return filtered(r.m, r.n, total)
