"""Queries of data-quality suites."""

from __future__ import annotations

from skarn.catalog.book import query
from skarn.catalog.corpus import CLEAN, _clean
from skarn.operators import quality as op
from skarn.session import scratch_dir, settle

RUN_AT = "2024-01-31 00:00:00"
AS_OF_MS = 1706659200000


def result_sql(suite: str, rows: str, checks: list[tuple]) -> str:
    """One SELECT per check: ``(name, column, condition of unexpected values)``."""
    parts = []
    for name, column, bad in checks:
        null = f"count(*) FILTER ({column} IS NULL)" if column else "0"
        if name == "row_count":
            ok, count, share, seen = bad, "0", "round(0 * 100.0 / nullif(count(*), 0), 6)", "count(*)"
        elif name == "unique":
            count = f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM r WHERE {column} IS NOT NULL GROUP BY {column}) WHERE n > 1)"
            ok, share, seen = f"{count} = 0", f"round({count} * 100.0 / nullif(count({column}), 0), 6)", "NULL"
        else:
            count = f"count(*) FILTER ({bad})"
            base = "count(*)" if name == "not_null" else f"count({column})"
            ok, share, seen = f"{count} = 0", f"round({count} * 100.0 / nullif({base}, 0), 6)", "NULL"
        label = f"'{column}'" if column else "NULL"
        parts.append(
            f"SELECT '{suite}' AS suite, '{name}' AS expectation, {label} AS \"column\", {ok} AS success, "
            f"count(*) AS element_count, {null} AS null_count, CAST({count} AS BIGINT) AS unexpected_count, "
            f"{share} AS unexpected_pct, CAST({seen} AS BIGINT) AS observed, '{RUN_AT}' AS run_at FROM r"
        )
    return f"WITH r AS ({rows}) " + " UNION ALL ".join(parts)


TELEMETRY_CHECKS = [
    ("not_null", "node_id", "node_id IS NULL"),
    ("not_null", "device_id", "device_id IS NULL"),
    ("not_null", "timestamp_ms", "timestamp_ms IS NULL"),
    ("between", "utilization_pct", "utilization_pct < 0 OR utilization_pct > 100"),
    ("between", "temperature_c", "temperature_c < 20 OR temperature_c > 120"),
    ("between", "power_draw_w", "power_draw_w < 0"),
    ("fresh", "timestamp_ms", f"timestamp_ms < {AS_OF_MS} - 60000"),
    ("row_count", None, "count(*) >= 1"),
]
CORPUS_CHECKS = [
    ("unique", "dedup_hash", None),
    ("between", "token_count_estimate", "token_count_estimate < 100 OR token_count_estimate > 32768"),
    ("in_set", "language_detected", "language_detected <> 'en'"),
    ("between", "quality_score", "quality_score < 0.6 OR quality_score > 1"),
    ("in_set", "pii_detected", "pii_detected"),
    *[("not_null", c, f"{c} IS NULL") for c in ("document_id", "dedup_hash", "source", "quality_score", "quality_tier")],
    ("in_set", "quality_tier", "quality_tier NOT IN ('high', 'medium')"),
]


@query("suite_gpu_telemetry", result_sql("bronze.gpu_telemetry", "SELECT * FROM telemetry", TELEMETRY_CHECKS))
def _(v):
    return op.validate(v.telemetry, op.gpu_telemetry_suite(AS_OF_MS), "bronze.gpu_telemetry", RUN_AT)


@query("suite_training_corpus", result_sql("silver.training_corpus_clean", CLEAN, CORPUS_CHECKS))
def _(v):
    return op.validate(settle(_clean(v), "clean"), op.training_corpus_suite(), "silver.training_corpus_clean", RUN_AT)


def one(key: str, check: tuple, expectation: op.Expectation, view: str, rows: str):
    @query(key, result_sql(key, rows, [check]))
    def _(v):
        return op.validate(getattr(v, view), [expectation], key, RUN_AT)


one("expect_not_null", ("not_null", "val_loss", "val_loss IS NULL"), op.not_null("val_loss"), "training", "SELECT * FROM training")
one("expect_between", ("between", "power_draw_w", "power_draw_w <= 1 OR power_draw_w > 100"),
    op.between("power_draw_w", 1.0, 100.0, strict=True), "telemetry", "SELECT * FROM telemetry")
one("expect_fresh", ("fresh", "timestamp_ms", "timestamp_ms < 1706600000000 - 60000"),
    op.fresh("timestamp_ms", 60_000, 1706600000000), "telemetry", "SELECT * FROM telemetry")
one("expect_row_count", ("row_count", None, "count(*) BETWEEN 1 AND 100"), op.row_count(1, 100), "telemetry", "SELECT * FROM telemetry")
one("expect_unique", ("unique", "raw_text", None), op.unique("raw_text"), "corpus", "SELECT * FROM corpus")
one("expect_in_set", ("in_set", "language", "language NOT IN ('en', 'fr')"), op.in_set("language", ["en", "fr"]), "corpus", "SELECT * FROM corpus")


@query("run_suite", result_sql("bronze.gpu_telemetry", "SELECT * FROM telemetry", TELEMETRY_CHECKS))
def _(v):
    store = scratch_dir(v.spark, "suites")
    for _ in range(2):  # a repeated run replaces its rows
        op.run_suite(v.telemetry, op.gpu_telemetry_suite(AS_OF_MS), "bronze.gpu_telemetry", RUN_AT, store)
    return v.spark.read.parquet(store).drop("of", "at")
