"""Columns with names that the operators use themselves, and worst cases of a megabyte."""

import time

from pyspark.sql import functions as F

import corpus_pipeline
from skarn.llm.html_text import lines
from skarn.llm.secrets import scan

FOLDER = "/root/testdata/sf0.001"


def test_clashing_columns(spark):
    names = ["_quality", "quality", "_key", "_dropped", "dropped", "whose", "_held", "held", "c0", "c1", "row", "key", "f", "kept"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60").select("*", *[F.lit(n).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names if n != "dropped")


def timed(work):
    start = time.time()
    work()
    return time.time() - start


def test_tags_that_never_end():
    for text in ("<a " * 300_000, '<p class="a ' * 80_000, "<a" * 500_000 + '">', "<script>" + "</script " * 100_000, "<!-- " * 200_000, "<a<a " * 200_000 + ">", "<? " * 300_000):
        assert timed(lambda: lines(text)) < 10, text[:20]  # noqa: B023


def test_secrets_in_a_megabyte(spark):
    worst = ["a." * 500_000 + " ://x", "a-" * 500_000, "http" * 250_000, "token " * 170_000, "user" + " " * 1_000_000, "AKIA" * 250_000, "0123456789abcdef012345g" * 45_000]
    docs = spark.createDataFrame(list(enumerate(worst)), "doc_id long, text string")
    assert timed(lambda: scan(docs).write.format("noop").mode("overwrite").save()) < 60
