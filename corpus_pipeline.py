"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next.

Every stage takes all documents the one before kept and returns the columns of ``documents``; the
last returns the packed pieces. Stages call the operators of ``skarn.llm``; nothing is counted,
searched or judged on a part of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.llm import decontamination, line_dedup, packing, quality, simhash
from skarn.llm.common import WORD, written

#: No SQL: compression ratios, fingerprints, words of a BPE and a genetic algorithm are not expressible.
#: ``tests/llm/test_pipeline.py`` holds each stage against a plain version instead.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_rules(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat; one that had words and has none left goes. ``n_chars`` follows the text."""
    cut = line_dedup.drop_repeats(docs)
    cut = cut.where(F.col("dropped").isNull() | F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("dropped").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return cut.select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; one without an id only if all are."""
    return simhash.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens and their places in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
