"""What several corpus operators share: table access, checkpoints, Arrow batches."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sessions read texts and feed Python in small batches, so that long texts cannot pile up.
READ_ROWS, ARROW_ROWS, ARROW_BYTES = 512, 1024, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, once a context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone_shipped", None):
        return
    package = Path(__file__).resolve().parent.parent
    # The driver serves this file to executors that start later, so it stays while the driver lives.
    sc._marlstone_shipped = folder = tempfile.TemporaryDirectory(prefix="marlstone-")
    path = f"{folder.name}/marlstone.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in package.rglob("*.py"):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that scans fill by rows, and the Arrow batches handed to Python workers by rows and by bytes."""
    ship_code(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a temporary one only where it names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="marlstone-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed and without its estimated size.

    A checkpoint keeps the estimate of the plan behind it, and a join's is the
    product of its sides'.  Where a loop joins what its last turn left, the
    estimate's digits multiply each turn, until they fill the driver's memory.
    """
    spark = df.sparkSession
    done = checkpointed(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done.logicalPlan().rdd(), done.schema(), False), spark)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have, for columns that come and go inside an operator."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name.lower() in taken:
        name += "_"
    return name


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table, written into the plan."""
    names = [c.split()[0] for c in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(",")) + " WHERE false")
    kinds = [c.split()[1] for c in schema.split(",")]
    made = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows])
    return spark.range(1, numPartitions=1).select(F.inline(made))


def utf8(column: pa.Array):
    """(bytes as numpy uint8, int64 offsets of n + 1) of a string or binary column without copies; null is empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def dense_rank(df: DataFrame, group: list[str], order: list[str], into: str, rows_per_bucket: int = 65536) -> DataFrame:
    """Add ``into``: the gapless place from 0 of each row in its ``group``.

    Places follow (cell, ``order``).  No group meets in one task: rows are dealt
    by the md5 of their ``order`` columns into (group, cell) cells, counted there, and a row's place is its place in the cell plus the sizes of
    the group's earlier cells.  The cell table grows with rows / rows_per_bucket.
    """
    from pyspark.sql import Window

    total = df.count()
    buckets = max(16, -(-total // rows_per_bucket))
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in order])
    cell, n, start, rn = (fresh(df, c) for c in ("cell", "n", "start", "rn"))
    celled = df.withColumn(cell, (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    sizes = celled.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, cell, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    w = Window.partitionBy(*group, cell).orderBy(*order)
    placed = celled.withColumn(rn, F.row_number().over(w) - 1)
    return placed.join(starts, [*group, cell]).withColumn(into, (F.col(rn) + F.col(start)).cast("long")).drop(rn, start, cell)
