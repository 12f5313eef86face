"""Bound SELECTs as DataFrames; Catalyst pushes filters and columns into the scans."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fanout
from .binder import BoundSelect, Column, Predicate
from .joinorder import LIMIT, Tree, best_tree
from .parser import Bool

#: Estimated bytes of a build side in one partition up to which it is hashed.
BUILD_BYTES = 16 << 20


def _quoted(binding: str, name: str) -> SparkColumn:
    return F.col(f"`{binding}`.`{name}`")


def condition(x: Predicate | Bool) -> SparkColumn:
    """SQL three-valued logic: a comparison with NULL is never true."""
    if isinstance(x, Bool):
        return reduce((lambda a, b: a & b) if x.op == "AND" else (lambda a, b: a | b), map(condition, x.parts))
    a, b = (_quoted(s.binding, s.name) if isinstance(s, Column) else F.lit(s.value) for s in (x.left, x.right))
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[x.op]


def output_names(q: BoundSelect) -> list[str]:
    """``binding.column`` for aliased relations, else the column's name."""
    return [f"{c.binding}.{c.name}" if c.binding in q.aliased else c.name for c in q.output]


def to_dataframe(q: BoundSelect, table: Callable[[str], DataFrame], sizes: Callable[[BoundSelect], dict[str, float] | None] | None = None, names: list[str] | None = None) -> DataFrame:
    """The query's rows.  ``sizes`` may estimate the filtered relations; they then set the join order."""
    base = {}
    for binding, name in q.tables.items():
        df = table(name).alias(binding)
        for x in q.filters.get(binding, ()):
            df = df.where(condition(x))
        base[binding] = df
    pairs = [(p.left.binding, p.right.binding) for p in q.joins]
    wide = fanout.wide(base, q.joins)
    estimate = sizes(q) if sizes and not wide and 1 < len(base) <= LIMIT else None
    if wide:
        df = _deal(q, base, wide)
    elif estimate:
        df, _ = _emit(best_tree(estimate, pairs), base, q.joins)
    else:
        df, done, left = None, set(), list(base)
        while left:  # written order, as far as each relation is connected to those before
            b = next((x for x in left if any({x} < {m, n} <= done | {x} for m, n in pairs)), left[0])
            left.remove(b)
            df = base[b] if df is None else df.join(base[b], _on(q.joins, done, {b}))
            done.add(b)
    for x in q.constants:
        df = df.where(condition(x))
    return df.select([_quoted(c.binding, c.name).alias(n) for c, n in zip(q.output, names or output_names(q), strict=True)])


def _on(joins: list[Predicate], a: set[str], b: set[str]) -> SparkColumn:
    both = [condition(p) for p in joins if {p.left.binding, p.right.binding} <= a | b and (p.left.binding in a) != (p.right.binding in a)]
    return reduce(lambda x, y: x & y, both)


def _deal(q: BoundSelect, base: dict[str, DataFrame], wide: dict[frozenset[str], fanout.Pairs]) -> DataFrame:
    """Joins of which some multiply rows: these come last, over rows that are dealt out before the first of them."""
    names = fanout.order(list(base), q.joins, wide)
    needed = {b: dict.fromkeys(c.name for c in [*q.output, *(c for p in q.joins for c in p.columns())] if c.binding == b) for b in names}
    df, columns, n = base[names[0]], {names[0]: [_quoted(names[0], c) for c in needed[names[0]]]}, fanout.tasks(names, wide)
    for b in names[1:]:
        done = set(columns)
        on = _on(q.joins, done, {b})
        if own := [p for pair, p in wide.items() if b in pair and pair <= done | {b}]:
            keys = {c.name for p in q.joins for c in p.columns() if c.binding == b and {p.left.binding, p.right.binding} <= done | {b}}
            stream = [c for x in columns.values() for c in x]
            df = fanout.multiply(df, base[b], b, sorted(keys), [c for c in needed[b] if c not in keys], on, stream, min(own, key=lambda p: p.rows), n)
            columns[b], n = [F.col(f"`{b}`")], 0
        else:
            df = df.join(base[b], on)
            columns[b] = [_quoted(b, c) for c in needed[b]]
    return df


def _emit(tree: Tree, base: dict[str, DataFrame], joins: list[Predicate]) -> tuple[DataFrame, set[str]]:
    if tree.left is None:
        return base[tree.order[0]], set(tree.relations)
    (a, of_a), (b, of_b) = _emit(tree.left, base, joins), _emit(tree.right, base, joins)
    return _build(a, tree.left.cardinality).join(b, _on(joins, of_a, of_b)), of_a | of_b


def _build(df: DataFrame, rows: float) -> DataFrame:
    """The smaller side as the one to build a hash table of, if a partition's share of its estimated size is sure to fit; else Spark sorts."""
    width = sum(24 if t in ("string", "binary") else 8 for _, t in df.dtypes) + 16
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if rows * width / partitions <= BUILD_BYTES else df
