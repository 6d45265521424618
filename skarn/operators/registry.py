"""Dataset versions, their use, and logs, as append-only Parquet tables."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from skarn.operators.ordered import running_total
from skarn.sources.tables import path_exists

VERSIONS = (
    "version_id STRING, table_name STRING, snapshot_version BIGINT, "
    "token_count_by_source MAP<STRING, BIGINT>, quality_metrics MAP<STRING, DOUBLE>, "
    "created_at TIMESTAMP, created_by STRING"
)
USAGE = "version_id STRING, run_id STRING, used_at TIMESTAMP"
LOG = "source STRING, message STRING, created_at TIMESTAMP"


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_version(df: DataFrame, base: str, version: int, partitions: list[str]) -> str:
    """Write an immutable dataset version; a version that exists is an error."""
    path = f"{base}/v{version}"
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)
    return path


def register_version(
    spark: SparkSession,
    base: str,
    table_name: str,
    created_by: str,
    tokens: dict[str, int],
    metrics: dict[str, float],
    snapshot_version: int,
    created_at: datetime | None = None,
) -> str:
    version_id = str(uuid.uuid4())
    created = created_at or datetime.now(timezone.utc)
    row = (version_id, table_name, snapshot_version, tokens, metrics, created, created_by)
    _append(spark, f"{base}/versions", VERSIONS, row)
    return version_id


def mark_used(spark: SparkSession, base: str, version_id: str, run_id: str, used_at: datetime | None = None) -> None:
    """Record that a run read a version; repeats are kept."""
    _append(spark, f"{base}/usage", USAGE, (version_id, run_id, used_at or datetime.now(timezone.utc)))


def get_version(spark: SparkSession, base: str, version_id: str) -> dict:
    """One version with the runs that used it, in order; KeyError if there is none."""
    found = _read(spark, f"{base}/versions", VERSIONS).filter(F.col("version_id") == version_id).limit(1).collect()
    if not found:
        raise KeyError(f"no dataset version {version_id}")
    runs: list[str] = []
    if path_exists(spark, f"{base}/usage"):  # else nothing is recorded yet
        usage = _read(spark, f"{base}/usage", USAGE).filter(F.col("version_id") == version_id)
        runs = [r["run_id"] for r in usage.orderBy("used_at", "run_id").select("run_id").toLocalIterator()]
    return {**found[0].asDict(), "used_in_run_ids": runs}


def publish_version(
    admitted: DataFrame, base: str, version: int, created_by: str, shards: int = 64, created_at: datetime | None = None
) -> str:
    """One call from admitted documents to a registered version: shard, write, sum up, register.

    The version is written before its registry row, so a row never points at missing data; what the
    row says is read from the written files.
    """
    from skarn.operators.corpus import shard_assign
    from skarn.operators.telemetry import quality_metrics, tokens_by_source

    path = write_version(shard_assign(admitted, shards), base, version, ["source", "quality_tier"])
    saved = admitted.sparkSession.read.parquet(path)
    tokens = {r["source"]: r["tokens"] for r in tokens_by_source(saved).collect()}  # a row per source
    metrics = {r["metric"]: r["value"] for r in quality_metrics(saved).collect()}
    return register_version(
        admitted.sparkSession, base, f"gold.training_dataset_v{version}", created_by, tokens, metrics, version, created_at
    )


def usage_positions(usage: DataFrame, order: str, cell: int | None = None) -> DataFrame:
    """Run ids per version with their place in the version's list, one row each.

    Rows in place of arrays: a version that everything uses does not become one huge value.
    """
    ones = usage.withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_total(ones, ["version_id"], order, "_one", "position", tie=["run_id"], cell=cell)
    return placed.select("version_id", "position", "run_id")


def log_event(spark: SparkSession, path: str, source: str, message: str, created_at: datetime) -> None:
    _append(spark, path, LOG, (source, message, created_at))
