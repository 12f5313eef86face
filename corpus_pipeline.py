"""A training corpus from ``documents`` in five stages; each works on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import contamination, language, lines, nearjoin, packing
from marlstone.llm.common import remove, shared_folder, table

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that a learned language codes within the model's limit; lang becomes the prediction.

    Null and empty texts have no letter and go; repeated rows share a verdict.
    """
    model = language.fit(docs, limited=True)
    kept = language.identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= model.limit))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; what is left empty by that goes, null and empty texts stay."""
    out = lines.line_dedup(docs)
    kept = out.where((F.col("n_removed_lines") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return kept.select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id; texts without words and rows of a null doc_id stay."""
    gone = nearjoin.jaccard_join(docs).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a whole benchmark window, and of which shorter items make up less than a twentieth; rows of a null doc_id stay."""
    hits = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    longest = F.expr("aggregate(sequence(1, size(hit_spans) div 2), 0, (a, i) -> if(size(hit_spans) = 0, 0, greatest(a, hit_spans[2 * i - 1] - hit_spans[2 * i - 2])))")
    gone = hits.where(F.col("contaminated") | (longest >= contamination.WINDOW)).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("decontaminate", decontaminate), ("best_fit_packing", pack)]

#: SQL can express neither PPM nor packing; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again, and goes when the next one is there."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{base}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
