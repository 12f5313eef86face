"""Joins that multiply rows: found by counting keys, and run so that pairs, not input rows, are dealt out evenly.

Few keys with many rows on both sides make far more pairs than rows.  Spark deals such a join out by its input, which
can be one split of a small file, or by its keys.  Here one side is dealt out row by row and meets the other's rows as
arrays of one key's values, which whole-stage code walks through without a look-up for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binder import Predicate

#: Keys are counted by hash in so many buckets.
BUCKETS = 1 << 16
#: A relation of up to so many bytes has too few rows to count: what it joins grows by those at most.
SMALL_BYTES = 64 << 10
#: A join multiplies if it makes so many rows for each of its inputs' rows, and more than a task's.
FACTOR = 16
#: Rows that a task is to make.
DEALT_ROWS = 1 << 24
#: Rows of one key in an array, and those that a row may meet in a task: whole-stage code holds what one row makes.
BLOCK_ROWS, SLICE_ROWS = 1 << 10, 1 << 16
#: Estimated bytes of arrays up to which every executor gets them all.
SHARED_BYTES = 16 << 20
#: Copies of arrays that are shuffled, so that the pairs of one key go to as many tasks.
MAX_COPIES = 1 << 10


@dataclass(frozen=True)
class Pairs:
    """What an equality of two relations makes, as counted by their keys' buckets."""

    rows: float  # of the join, estimated
    most: float  # at most of one key
    sizes: dict[str, int]  # binding -> rows with a key
    widest: dict[str, int]  # binding -> rows of one key at most
    used: dict[str, int]  # binding -> buckets in use

    @property
    def multiplies(self) -> bool:
        return self.rows > max(DEALT_ROWS, FACTOR * sum(self.sizes.values()))


def wide(base: dict[str, DataFrame], joins: list[Predicate]) -> dict[frozenset[str], Pairs]:
    """The pairs of relations whose join multiplies rows."""
    size = {b: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for b, df in base.items()} if joins else {}
    out = {}
    for pair in dict.fromkeys(frozenset((p.left.binding, p.right.binding)) for p in joins):
        if min(size[b] for b in pair) > SMALL_BYTES:
            found = _count(base, sorted(pair), [p for p in joins if {p.left.binding, p.right.binding} == pair])
            if found.multiplies:
                out[pair] = found
    return out


def _count(base: dict[str, DataFrame], pair: list[str], joins: list[Predicate]) -> Pairs:
    """One pass over both relations' keys, which shuffles a count a bucket at most from each task."""
    none, n = F.lit(0).cast("bigint"), F.count(F.lit(1))
    keys = {b: [c.name for p in joins for c in p.columns() if c.binding == b] for b in pair}
    own = {b: base[b].dropna(subset=list(dict.fromkeys(keys[b]))).select(*[F.col(f"`{b}`.`{c}`").alias(f"k{i}") for i, c in enumerate(keys[b])]) for b in pair}
    same = own[pair[0]].sameSemantics(own[pair[1]])  # a table joined with itself is counted once
    sides = []
    for b, counts in zip(pair, ((n, n if same else none), (none, n)), strict=True):
        columns = [F.col(c) if kind == "string" else F.col(c).cast("bigint") for c, kind in own[b].dtypes]
        df = own[b].groupBy(F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).alias("h"))
        sides.append(df.agg(*[m.alias(x) for x, m in zip("xy", counts, strict=True)]))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    both = (sides[0] if same else sides[0].unionAll(sides[1])).groupBy("h").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    found = both.agg(F.sum(x * y), F.max(x * y), F.sum("x"), F.sum("y"), F.max("x"), F.max("y"), F.count_if(x > 0), F.count_if(y > 0)).head()
    met, most, n, m, *rest = (v or 0 for v in found)
    rows = max(0.0, (met - n * m / BUCKETS) * BUCKETS / (BUCKETS - 1))  # less what keys make that share a bucket by chance
    return Pairs(rows, most, *(dict(zip(pair, v, strict=True)) for v in ((n, m), rest[:2], rest[2:])))


def order(bindings: list[str], joins: list[Predicate], found: dict[frozenset[str], Pairs]) -> list[str]:
    """Relations as they are joined: from the largest that multiplies, by joins that don't multiply as long as there are any."""
    rows = {b: n for p in found.values() for b, n in p.sizes.items()}
    out = [max((b for b in bindings if b in rows), key=rows.get)]
    while left := [b for b in bindings if b not in out]:
        near = [b for b in left if any({b} < {p.left.binding, p.right.binding} <= {b, *out} for p in joins)]
        out.append(next((b for b in near if not any(frozenset((b, a)) in found for a in out)), near[0]))
    return out


def tasks(names: list[str], found: dict[frozenset[str], Pairs]) -> int:
    """How many tasks the rows of all joins that multiply are dealt to, with the relations joined as they are named."""
    total = max(p.sizes.get(names[0], 0) for p in found.values())
    for i, b in enumerate(names):
        total *= min((p.rows / p.sizes[a] for a in names[:i] if (p := found.get(frozenset((a, b))))), default=1)
    return ceil(total / DEALT_ROWS)


def multiply(df: DataFrame, other: DataFrame, binding: str, keys: list[str], values: list[str], on: Column, stream: list[Column], p: Pairs, n: int) -> DataFrame:
    """The columns ``stream`` of ``df``, joined with ``other``, whose ``keys`` and ``values`` become fields of a column ``binding``.

    The rows of ``df`` are dealt to ``n`` tasks if that isn't 0.
    """
    own = {c: F.col(f"`{binding}`.`{c}`") for c in (*keys, *values)}
    rows, blocks, slices = p.sizes[binding], ceil(p.widest[binding] / BLOCK_ROWS), ceil(p.widest[binding] / SLICE_ROWS)
    block = F.pmod(F.xxhash64(*(own[c] for c in values)), F.lit(blocks)) if values else F.lit(0)
    items = F.collect_list(F.struct(*[own[c].alias(f"v{i}") for i, c in enumerate(values)] or [F.lit(0).alias("v0")]))
    lists = [f"__v{i}" for i in range(len(values) or 1)]  # one a column: those of numbers need no object for each row
    arrays = other.groupBy(*(own[c] for c in keys), block.alias("__block")).agg(items.alias("__items"))
    arrays = arrays.select(*keys, "__block", *(F.col("__items")[x[2:]].alias(x) for x in lists)).alias(binding)
    if slices > 1:
        df = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__slice"))
        on &= F.col("__slice") == F.pmod("__block", F.lit(slices))
    width = sum(24 if t in ("string", "binary") else 8 for c, t in other.dtypes if c in values) or 4
    groups = min(rows, 3 * p.used[binding] * blocks) if p.used[binding] < 0.9 * BUCKETS else rows
    if rows * width + groups * 128 <= SHARED_BYTES:
        df = df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism)) if n else df
        arrays = F.broadcast(arrays)
    elif (copies := min(MAX_COPIES, ceil(p.most / slices / DEALT_ROWS))) > 1:
        df = df.withColumn("__copy", F.pmod(F.xxhash64(*stream), F.lit(copies)).cast("int"))
        arrays = arrays.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__of"))
        on &= F.col("__copy") == F.col("__of")
    kept = [*stream, *(own[c] for c in keys)]
    df = df.join(arrays, on).select(*kept, F.posexplode(lists[0]).alias("__at", "__x"), *lists[1:])
    fields = [F.col("__x"), *(F.get(F.col(x), F.col("__at")) for x in lists[1:])]
    return df.select(*stream, F.struct(*(own[c] for c in keys), *(x.alias(c) for c, x in zip(values, fields, strict=False))).alias(binding))
