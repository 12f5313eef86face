"""Fixed-size uniform table samples: the rows of the least key hashes (bottom-k).

The sample doesn't depend on partitions, and samples of parts merge; a top-k
keeps k rows a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1024


def key_hash(keys: list[str]):
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("\x1e")) for k in keys]))


def bottom_k(df: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """``size`` rows, uniform if ``keys`` are distinct, with their hash as ``__hash__``."""
    return df.withColumn("__hash__", key_hash(keys)).orderBy("__hash__", *keys).limit(size)


def merge(a: DataFrame, b: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    return a.unionByName(b).orderBy("__hash__", *keys).limit(size)


def remaining(sample: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """The sampled rows that aren't among ``removed``; a sample that loses none stays one, else it is drawn anew."""
    gone = removed.select(key_hash(keys).alias("__hash__"))
    return sample.join(gone, "__hash__", "left_anti").select(sample.columns)
