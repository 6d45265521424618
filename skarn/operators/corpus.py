"""Text corpus: language gate, routing, de-duplication, scoring, admission, sharding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.functions import text as tx
from skarn.operators.ordered import running_total

# Admission bounds.
MIN_SCORE = 0.6
TOKEN_RANGE = (100, 32768)


def lang_gate(docs: DataFrame, language: Column | None = None, want: str = "en") -> DataFrame:
    """Adds ``language_detected``, ``rejected`` and ``reason``.

    Without a language column the stop-word detector looks at the whole text.
    """
    found = language if language is not None else tx.detect_language(F.col("raw_text"))
    return (
        docs.withColumn("language_detected", found)
        .withColumn("rejected", ~F.col("language_detected").eqNullSafe(want))
        .withColumn(
            "reason",
            F.when(F.col("language_detected").isNull(), "language_detection_failed")
            .when(F.col("rejected"), F.concat(F.lit("language:"), "language_detected")),
        )
    )


def route(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of one gated frame."""
    return docs.filter(~F.col("rejected")), docs.filter("rejected")


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dedup_hash", tx.dedup_hash(F.coalesce("raw_text", F.lit(""))))


def dedup_first(docs: DataFrame, key: str = "dedup_hash", order: str = "doc_id") -> DataFrame:
    """The row of lowest ``order`` per key, with all its columns.

    The keeper is found on two narrow columns with map-side combine, so a huge group of copies
    never meets in one task; wide rows move once, by their own unique id.
    """
    keepers = docs.groupBy(key).agg(F.min(order).alias(order)).select(order)
    return docs.join(keepers, order, "left_semi")


def score(docs: DataFrame) -> DataFrame:
    """Adds ``quality_score`` (4 digits), ``quality_tier`` of the unrounded score, token count.

    Flat text and words are columns of their own: every document is cut into words once.
    """
    body = F.coalesce("raw_text", F.lit(""))
    n_words = F.size("_words")
    parts = F.struct(
        tx.alphabetic_ratio(body).alias("alphabetic_ratio"),
        tx.word_length_score(F.col("_flat"), n_words).alias("word_length"),
        tx.unique_bigram_ratio(F.col("_words")).alias("unique_bigrams"),
        tx.unique_paragraph_ratio(body).alias("unique_paragraphs"),
    )
    return (
        docs.withColumn("_flat", tx.flatten(body))
        .withColumn("_words", tx.words_of_flat(F.col("_flat")))
        .withColumn("_parts", parts)
        .withColumn("_raw", tx.raw_quality_score(F.col("_parts")))
        .withColumn("quality_score", F.round("_raw", 4))
        .withColumn("quality_tier", tx.quality_tier(F.col("_raw")))
        .withColumn("token_count_estimate", tx.tokens_of(n_words))
        .drop("_flat", "_words", "_parts", "_raw")
    )


def pii_flag(docs: DataFrame) -> DataFrame:
    return docs.withColumn("pii_detected", tx.pii_detected(F.col("raw_text")))


def corpus_metadata(scored: DataFrame) -> DataFrame:
    """Metadata rows without the text."""
    return scored.select(
        "document_id", "source", "quality_score", "quality_tier", "dedup_hash",
        "token_count_estimate", "ingested_ms",
    )


def corpus_admit(
    docs: DataFrame, min_score: float = MIN_SCORE, tokens: tuple[int, int] = TOKEN_RANGE
) -> DataFrame:
    return docs.filter(
        F.col("quality_tier").isin("high", "medium")
        & (F.col("language_detected") == "en")
        & (F.col("quality_score") >= min_score)
        & ~F.col("pii_detected")
        & F.col("token_count_estimate").between(*tokens)
    )


def shard_assign(
    docs: DataFrame, shards: int, key: str = "document_id", cell: int = 1 << 48
) -> DataFrame:
    """``shard_id`` by hash of the key, ``shard_offset`` by hash order within the shard.

    Offsets come from a running total over cells of ``cell`` hash values (4096 of them), so a shard may
    be larger than a task.
    """
    place = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    placed = (
        docs.withColumn("_place", place)
        .withColumn("shard_id", (F.col("_place") % shards).cast("int"))
        .withColumn("_one", F.lit(1).cast("bigint"))
    )
    numbered = running_total(
        placed, ["shard_id"], "_place", "_one", "_upto", tie=[key], cell=cell
    )
    return numbered.withColumn("shard_offset", F.col("_upto") - 1).drop("_place", "_one", "_upto")
