"""Corpus plans: raw documents to the clean table, clean table to a sharded dataset version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skarn.operators import corpus as op

CLEAN_COLUMNS = (
    "document_id", "source", "dedup_hash", "language_detected", "quality_score", "quality_tier",
    "token_count_estimate", "file_path", "ingested_ms", "pii_detected",
)


def corpus_clean(docs: DataFrame, language: Column | None = None) -> DataFrame:
    """Gate, hash, score, mark PII, then keep the first document per hash.

    Everything that reads the text is done before the only shuffle, which then carries narrow
    rows; ``min`` over (id, columns) combines map-side, so copies collapse before they move.
    """
    accepted, _ = op.route(op.lang_gate(docs, language))
    narrow = op.pii_flag(op.score(op.with_hash(accepted))).select("doc_id", *CLEAN_COLUMNS)
    rest = [c for c in CLEAN_COLUMNS if c != "dedup_hash"]
    first = F.min_by(F.struct(*rest), "doc_id").alias("row")
    return narrow.groupBy("dedup_hash").agg(first).select("dedup_hash", "row.*")


def training_dataset(
    clean: DataFrame, shards: int
) -> DataFrame:
    """Admitted documents with shard and offset, ready for an immutable version."""
    admitted = op.corpus_admit(clean)
    return op.shard_assign(admitted, shards).select(
        "document_id", "source", "dedup_hash", "token_count_estimate", "quality_score",
        "quality_tier", "file_path", "shard_id", "shard_offset",
    )
