"""Writes: append, and update or delete by key as a staged rewrite."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hll, sample
from ..sources.catalog import Catalog


def updated(df: DataFrame, key: Column, values: dict[str, Column]) -> DataFrame:
    """``df`` with new values where ``key`` is true."""
    return df.select(*[F.when(key, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in df.dtypes])


def deleted(df: DataFrame, key: Column) -> DataFrame:
    """``df`` without the rows where ``key`` is true; rows where it is NULL stay."""
    return df.where(~F.coalesce(key, F.lit(False)))


def lookup(df: DataFrame, key: Column) -> DataFrame:
    """The rows of a key; the comparison is pushed into the scan."""
    return df.where(key)


def append(catalog: Catalog, table: str, rows: DataFrame) -> None:
    """Append rows (one file a partition) and merge their statistics, both from the same rows."""
    kinds = catalog.table(table).schema
    s = catalog.statistics(table)
    rows = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in kinds])
    if not s:
        rows.write.insertInto(catalog.path(table))
        return
    rows = rows.persist()
    try:
        rows.write.insertInto(catalog.path(table))
        drawn = sample.merge(s["sample"], sample.bottom_k(rows, s["keys"]), s["keys"])
        catalog.keep(table, s["keys"], s["columns"], hll.merge(s["sketches"], hll.table_counters(rows, s["columns"])), drawn)
    finally:
        rows.unpersist()
    catalog.save_statistics(table)


def rewrite(catalog: Catalog, table: str, new: DataFrame) -> None:
    """Replace a table's rows.

    They are written to a table beside it, which takes its name when it is
    whole; until then the table stays as it is, whatever fails.
    """
    spark, mark = catalog.spark, uuid.uuid4().hex[:8]
    stage, old = (catalog.path(f"{table}__{kind}_{mark}") for kind in ("stage", "old"))
    spark.sql(f"CREATE TABLE {stage} LIKE {catalog.path(table)}")
    try:
        new.write.insertInto(stage)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {stage}")
        raise
    spark.sql(f"ALTER TABLE {catalog.path(table)} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {stage} RENAME TO {catalog.path(table)}")
    except Exception:
        spark.sql(f"ALTER TABLE {old} RENAME TO {catalog.path(table)}")
        raise
    spark.sql(f"DROP TABLE {old}")


def delete(catalog: Catalog, table: str, key: Column) -> int:
    """Delete rows; sketches lose their values, the sample is refilled only if it lost rows.  Returns the number deleted."""
    s = catalog.statistics(table)
    gone = catalog.table(table).where(key).persist()
    try:
        n = gone.count()
        if not n:
            return 0
        # Taken while the rows are there: the rewrite drops the files they come from.
        left = sketches = None
        if s:
            sketches = hll.delete(s["sketches"], hll.table_counters(gone, s["columns"])).collect()
            left = sample.remaining(s["sample"], gone, s["keys"]).collect()
        rewrite(catalog, table, deleted(catalog.table(table), key))
    finally:
        gone.unpersist()
    if s:
        spark, full = catalog.spark, len(left) == s["sample"].count()
        kept = spark.createDataFrame(left, s["sample"].schema) if full else sample.bottom_k(catalog.table(table), s["keys"])
        catalog.keep(table, s["keys"], s["columns"], spark.createDataFrame(sketches, s["sketches"].schema), kept)
        catalog.save_statistics(table)
    return n


def update(catalog: Catalog, table: str, key: Column, values: dict[str, Column]) -> None:
    """Update rows in place; sketches exchange the changed columns' values, and sampled rows change too."""
    s = catalog.statistics(table)
    if not s:
        rewrite(catalog, table, updated(catalog.table(table), key, values))
        return
    changed = [c for c in s["columns"] if c in values]
    old = catalog.table(table).where(key).persist()
    try:
        counts = lambda df: hll.table_counters(df, changed).where("attribute is not null")
        sketches = hll.update(s["sketches"], counts(old), counts(updated(old, F.lit(True), values))).collect()
        rewrite(catalog, table, updated(catalog.table(table), key, values))
    finally:
        old.unpersist()
    named = set(values).isdisjoint(s["keys"])
    drawn = updated(s["sample"], key, values) if named else sample.bottom_k(catalog.table(table), s["keys"])
    catalog.keep(table, s["keys"], s["columns"], catalog.spark.createDataFrame(sketches, s["sketches"].schema), drawn)
    catalog.save_statistics(table)


def compact(catalog: Catalog, table: str, files: int) -> None:
    """Fold the small files of many inserts."""
    rewrite(catalog, table, catalog.table(table).repartition(files))
