"""Connected components of an edge table by alternating large and small stars; few edges are joined up in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

#: Edges of one partition, and most edges that a task joins up (some 100 bytes each).
EDGES = 200_000


def partitions_for(rows: int) -> int:
    """Partitions for a narrow table of so many rows."""
    return max(4, rows // EDGES + 1)


def joined_up(edges: DataFrame) -> DataFrame:
    """(v, root) of counted, few edges, by union and find in one task."""

    def solve(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not held:
            return
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        root = list(range(len(names)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[[find(x) for x in range(len(names))]])], names=["v", "root"])

    return edges.select("u", "v").coalesce(1).mapInArrow(solve, "v long, root long")


def connected_components(edges: DataFrame, few_edges: int = EDGES) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (u, v: long); root is the component's least vertex.

    While there are more than ``few_edges``, each round relinks every vertex to its least neighbour, so that trees become
    stars in a logarithmic number of rounds.  Hubs meet in joins that Spark
    splits when skewed; minima are combined before they are shuffled.
    """
    hi, lo = F.greatest("u", "v"), F.least("u", "v")
    now = settled(edges.where("u <> v").select(hi.alias("u"), lo.alias("v")).distinct())
    mark = _mark(now)
    while mark[0] > few_edges:
        few = partitions_for(mark[0])  # few edges don't need all partitions, nor a file in each
        now = now.coalesce(few)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Large star: a vertex's larger neighbours move to its least neighbour.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few)
        # Small star: its smaller neighbours, and it itself, move to the least of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(few).distinct()
        now = settled(small.coalesce(few))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        return joined_up(now)
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()
    return r.n, r.x
