"""Counting HyperLogLog as a relation (bucket, lz, cnt): mergeable, and values can be deleted.

A value's hash is the first 48 bits of the md5 of its text: 6 bits choose one of
64 buckets, lz are the leading zeros of the other 42.  Counts are exact.  The
sketches of a table's columns are one relation, with an ``attribute`` in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the estimator with 64 buckets.
BUCKET_BITS, REST_BITS, ALPHA = 6, 42, 0.709


def _bucket_and_zeros(c: Column) -> tuple[Column, Column]:
    h = F.conv(F.substring(F.md5(c.cast("string")), 1, 12), 16, 10).cast("long")
    rest = h.bitwiseAND(F.lit((1 << REST_BITS) - 1))
    zeros = F.when(rest == 0, F.lit(REST_BITS)).otherwise(F.lit(REST_BITS) - F.length(F.bin(rest)))
    return F.shiftright(h, REST_BITS).cast("int"), zeros.cast("int")


def counters(df: DataFrame, column: str) -> DataFrame:
    """The sketch of a column; NULLs are skipped.  Partial sums keep the shuffle at 64 * 43 rows a task."""
    bucket, lz = _bucket_and_zeros(F.col(column))
    return df.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket"), lz.alias("lz")).agg(F.count(F.lit(1)).alias("cnt"))


def table_counters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, bucket, lz, cnt) of several columns in one pass; the row of a null attribute has the number of rows."""
    none = F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int")
    facts = [F.struct(none[0].alias("attribute"), none[1].alias("bucket"), none[2].alias("lz"))]
    for c in columns:
        bucket, lz = _bucket_and_zeros(F.col(f"`{c}`"))
        facts.append(F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(c).alias("attribute"), bucket.alias("bucket"), lz.alias("lz"))))
    rows = df.select(F.explode(F.array(*facts)).alias("f")).where("f is not null").select("f.*")
    return rows.groupBy("attribute", "bucket", "lz").agg(F.count(F.lit(1)).alias("cnt"))


def _names(sketch: DataFrame) -> list[str]:
    return [c for c in sketch.columns if c != "cnt"]


def merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*_names(out)).agg(F.sum("cnt").alias("cnt"))


def delete(sketch: DataFrame, removed: DataFrame) -> DataFrame:
    """The sketch without ``removed``'s values; counts never fall below 0."""
    left = merge(sketch, removed.withColumn("cnt", -F.col("cnt")))
    return left.withColumn("cnt", F.greatest("cnt", F.lit(0)).cast("long")).where("cnt > 0")


def update(sketch: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    return merge(delete(sketch, old), new)


def estimate(sketch: DataFrame) -> DataFrame:
    """One row ``estimate`` (double): 0 for an empty sketch."""
    m = float(1 << BUCKET_BITS)
    tops = sketch.where("cnt > 0").groupBy("bucket").agg((F.max("lz") + 1).alias("top"))
    sums = tops.agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("top"))).alias("s"))
    empty = F.lit(m) - F.col("used")
    raw = F.lit(ALPHA * m * m) / (F.coalesce("s", F.lit(0.0)) + empty)
    big = F.lit(float(1 << 32))
    large = F.when(raw < big, -big * F.log(1 - raw / big)).otherwise(raw)
    corrected = F.when((raw <= 2.5 * m) & (empty > 0), m * F.log(m / empty)).when(raw <= big / 30, raw).otherwise(large)
    return sums.select(corrected.alias("estimate"))
