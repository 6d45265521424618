"""Data-quality suites: all checks of a suite in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, functions as F

from skarn.operators.ordered import merge_by_key


@dataclass(frozen=True)
class Expectation:
    """A named check: SQL condition of an unexpected value, or a bound on the row count."""

    name: str
    column: str | None = None
    bad: str | None = None
    rows: tuple[int, int | None] | None = None
    unique: bool = False


def not_null(col: str) -> Expectation:
    return Expectation("not_null", col, f"`{col}` IS NULL")


def between(col: str, low=None, high=None, strict: bool = False) -> Expectation:
    """Values in [low, high], either bound open; ``strict`` leaves the low bound out."""
    bad = [f"`{col}` {'<=' if strict else '<'} {low}"] if low is not None else []
    bad += [f"`{col}` > {high}"] if high is not None else []
    return Expectation("between", col, " OR ".join(bad) or "false")


def fresh(col: str, max_lag_ms: int, as_of_ms: int) -> Expectation:
    return Expectation("fresh", col, f"`{col}` < {as_of_ms - max_lag_ms}")


def row_count(low: int = 1, high: int | None = None) -> Expectation:
    return Expectation("row_count", rows=(low, high))


def unique(col: str) -> Expectation:
    return Expectation("unique", col, unique=True)


def in_set(col: str, values: list) -> Expectation:
    """Values out of a list of strings, numbers or booleans."""
    texts = [str(x).lower() if isinstance(x, bool) else repr(x) for x in values]
    return Expectation("in_set", col, f"`{col}` NOT IN ({', '.join(texts)})")


def gpu_telemetry_suite(as_of_ms: int, max_rows: int | None = None) -> list[Expectation]:
    """Bounds of the telemetry table."""
    return [
        *[not_null(c) for c in ("node_id", "device_id", "timestamp_ms")],
        between("utilization_pct", 0.0, 100.0),
        between("temperature_c", 20.0, 120.0),
        between("power_draw_w", 0.0),
        fresh("timestamp_ms", 60_000, as_of_ms),
        row_count(1, max_rows),
    ]


def training_corpus_suite() -> list[Expectation]:
    """Bounds of the clean corpus table."""
    return [
        unique("dedup_hash"),
        between("token_count_estimate", 100, 32768),
        in_set("language_detected", ["en"]),
        between("quality_score", 0.6, 1.0),
        in_set("pii_detected", [False]),
        *[not_null(c) for c in ("document_id", "dedup_hash", "source", "quality_score", "quality_tier")],
        in_set("quality_tier", ["high", "medium"]),
    ]


def validate(df: DataFrame, suite: list[Expectation], name: str, run_at: str) -> DataFrame:
    """Result rows of a suite.

    Everything but uniqueness comes from one aggregate without a shuffle of rows; uniqueness
    counts per value first.  Nulls are neither expected nor unexpected, save for ``not_null``.
    """
    counts = [F.count("*").alias("_rows")]
    for i, e in enumerate(suite):
        if e.column:
            counts.append(F.count_if(F.col(e.column).isNull()).alias(f"_null{i}"))
        if e.bad:
            counts.append(F.count_if(F.expr(e.bad)).alias(f"_bad{i}"))
    parts = [df.agg(*counts)]
    for i, e in enumerate(suite):
        if e.unique:
            per_value = df.filter(F.col(e.column).isNotNull()).groupBy(e.column).agg(F.count("*").alias("n"))
            copies = F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0))
            parts.append(per_value.agg(copies.cast("bigint").alias(f"_bad{i}")))
    one = merge_by_key([], *parts)
    return one.select(F.inline(F.array(*[_result(i, e, name, run_at) for i, e in enumerate(suite)])))


def _result(i: int, e: Expectation, suite: str, run_at: str) -> Column:
    rows = F.col("_rows")
    nulls = F.col(f"_null{i}") if e.column else F.lit(0).cast("bigint")
    if e.rows:
        low, high = e.rows
        success = (rows >= low) & (F.lit(True) if high is None else rows <= high)
        bad, base, observed = F.lit(0).cast("bigint"), rows, rows
    else:
        bad = F.col(f"_bad{i}")
        success, observed = bad == 0, F.lit(None).cast("bigint")
        base = rows if e.name == "not_null" else rows - nulls
    share = F.when(base > 0, F.round(bad * 100.0 / base, 6))
    return F.struct(
        F.lit(suite).alias("suite"), F.lit(e.name).alias("expectation"), F.lit(e.column).cast("string").alias("column"),
        success.alias("success"), rows.alias("element_count"), nulls.alias("null_count"),
        bad.alias("unexpected_count"), share.alias("unexpected_pct"), observed.alias("observed"),
        F.lit(run_at).alias("run_at"),
    )


def run_suite(
    df: DataFrame, suite: list[Expectation], name: str, run_at: str, store: str | None = None
) -> tuple[bool, str, DataFrame]:
    """Run, store the result rows below ``store``, return pass or fail with a message.

    A run owns the folder of its suite and time, so running it again replaces its rows.
    """
    results = validate(df, suite, name, run_at)
    if store:
        place = f"{store}/of={quote(name, safe='')}/at={quote(run_at, safe='')}"
        results.write.mode("overwrite").parquet(place)
        results = df.sparkSession.read.schema(results.schema).parquet(place)
    rows = results.collect()  # one row per expectation
    failed = [r for r in rows if not r["success"]]
    message = f"{name}: {len(failed)} of {len(rows)} expectations failed" if failed else f"{name}: passed"
    return not failed, message, df.sparkSession.createDataFrame(rows, results.schema)
