"""Declared tables: fields, partition columns, clustering columns, retention."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession, types as T


@dataclass(frozen=True)
class Table:
    name: str
    fields: str
    partitions: tuple[str, ...]
    cluster: tuple[str, ...] = ()
    retention_days: int | None = None

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.fields)


_SAMPLE = "node_id STRING NOT NULL, device_id STRING NOT NULL"

# The lake's tables, in the order they are created.
TABLES = (
    Table(
        "bronze.gpu_telemetry",
        f"{_SAMPLE}, timestamp_ms BIGINT NOT NULL, utilization_pct FLOAT, memory_used_gb FLOAT, "
        "memory_total_gb FLOAT, temperature_c FLOAT, power_draw_w FLOAT, hbm_bandwidth_gbps FLOAT, "
        "pcie_bandwidth_gbps FLOAT, ingestion_ts TIMESTAMP NOT NULL, kafka_offset BIGINT, "
        "kafka_partition INT, date DATE NOT NULL",
        ("date", "node_id"), ("device_id", "timestamp_ms"), 90,
    ),
    Table(
        "bronze.inference_logs",
        "request_id STRING NOT NULL, model_id STRING NOT NULL, model_version STRING NOT NULL, "
        "timestamp_ms BIGINT NOT NULL, prompt_tokens INT, completion_tokens INT, latency_ms BIGINT, "
        "ttft_ms BIGINT, status STRING NOT NULL, error_code STRING, user_id STRING, "
        "ingestion_ts TIMESTAMP NOT NULL, date DATE NOT NULL",
        ("date", "model_id"), ("timestamp_ms",), 90,
    ),
    Table(
        "bronze.training_metrics",
        "run_id STRING NOT NULL, step INT NOT NULL, timestamp_ms BIGINT NOT NULL, train_loss FLOAT, "
        "grad_norm FLOAT, learning_rate FLOAT, tokens_per_sec FLOAT, mfu_pct FLOAT, "
        "gpu_memory_per_device_gb FLOAT, ingestion_ts TIMESTAMP NOT NULL, date DATE NOT NULL",
        ("date", "run_id"), ("step",), 365,
    ),
    Table(
        "bronze.raw_text_corpus",
        "document_id STRING NOT NULL, source STRING NOT NULL, raw_text STRING, file_path STRING, "
        "ingested_at TIMESTAMP NOT NULL, language_detected STRING, dedup_hash STRING, byte_size BIGINT, "
        "date DATE NOT NULL",
        ("source", "date"), ("dedup_hash",),
    ),
    Table(
        "silver.gpu_telemetry_hourly",
        f"{_SAMPLE}, hour TIMESTAMP NOT NULL, avg_utilization_pct FLOAT, max_utilization_pct FLOAT, "
        "p95_utilization_pct FLOAT, avg_temperature_c FLOAT, max_temperature_c FLOAT, avg_power_draw_w FLOAT, "
        "max_power_draw_w FLOAT, avg_hbm_bandwidth_gbps FLOAT, avg_pcie_bandwidth_gbps FLOAT, "
        "sample_count BIGINT NOT NULL, date DATE NOT NULL",
        ("date", "node_id"), ("device_id", "hour"), 365,
    ),
    Table(
        "silver.alert_enriched",
        "alert_id STRING NOT NULL, title STRING NOT NULL, severity STRING NOT NULL, status STRING NOT NULL, "
        "source_system STRING NOT NULL, triggered_at TIMESTAMP NOT NULL, node_id STRING, node_hostname STRING, "
        "gpu_count INT, avg_utilization_at_trigger FLOAT, recent_k8s_events_json STRING, "
        "ontology_node_rid STRING, enriched_at TIMESTAMP NOT NULL, date DATE NOT NULL",
        ("date", "severity"), ("node_id",), 365,
    ),
    Table(
        "silver.training_corpus_clean",
        "document_id STRING NOT NULL, source STRING NOT NULL, dedup_hash STRING NOT NULL, "
        "language_detected STRING NOT NULL, quality_score FLOAT NOT NULL, quality_tier STRING NOT NULL, "
        "token_count_estimate INT, file_path STRING NOT NULL, processed_at TIMESTAMP NOT NULL, "
        "pii_detected BOOLEAN NOT NULL",
        ("source", "quality_tier"), ("dedup_hash",),
    ),
    Table(
        "silver.model_evaluations",
        "eval_id STRING NOT NULL, model_id STRING NOT NULL, model_version STRING NOT NULL, "
        "benchmark_name STRING NOT NULL, score FLOAT NOT NULL, evaluated_at TIMESTAMP NOT NULL, "
        "evaluator_version STRING, breakdown_json STRING, run_id STRING, date DATE NOT NULL",
        ("date", "model_id"), ("benchmark_name",),
    ),
    Table(
        "gold.operational_dashboard",
        "snapshot_ts TIMESTAMP NOT NULL, total_gpu_count INT NOT NULL, healthy_gpu_count INT NOT NULL, "
        "cluster_avg_utilization_pct FLOAT, cluster_avg_temperature_c FLOAT, active_training_runs INT NOT NULL, "
        "active_inference_replicas INT NOT NULL, open_p1_alerts INT NOT NULL, open_p2_alerts INT NOT NULL, "
        "tokens_trained_today BIGINT, inference_requests_today BIGINT, avg_inference_latency_ms_1h FLOAT, "
        "date DATE NOT NULL",
        ("date",), ("snapshot_ts",),
    ),
    Table(
        "gold.model_performance",
        "model_id STRING NOT NULL, model_version STRING NOT NULL, benchmark_name STRING NOT NULL, "
        "score FLOAT NOT NULL, p50_latency_ms FLOAT, p95_latency_ms FLOAT, p99_latency_ms FLOAT, "
        "error_rate FLOAT, throughput_rps FLOAT, evaluated_at TIMESTAMP NOT NULL, "
        "training_dataset_version STRING, parameter_count BIGINT, date DATE NOT NULL",
        ("date", "model_id"), ("evaluated_at",),
    ),
)


def training_dataset_table(version: int) -> Table:
    """Immutable sharded dataset of one version."""
    return Table(
        f"gold.training_dataset_v{version}",
        "document_id STRING NOT NULL, source STRING NOT NULL, dedup_hash STRING NOT NULL, "
        "token_count_estimate INT, quality_score FLOAT NOT NULL, quality_tier STRING NOT NULL, "
        "file_path STRING NOT NULL, shard_id INT NOT NULL, shard_offset BIGINT NOT NULL",
        ("source", "quality_tier"), ("shard_id", "shard_offset"), 3650,
    )


def create_tables(spark: SparkSession, base: str, versions: tuple[int, ...] = (1,)) -> list[str]:
    """Create the databases and all tables below ``base``; existing ones stay."""
    tables = [*TABLES, *map(training_dataset_table, versions)]
    for layer in dict.fromkeys(t.name.split(".")[0] for t in tables):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}")
    for t in tables:
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {t.name} ({t.fields}) USING PARQUET "
            f"PARTITIONED BY ({', '.join(t.partitions)}) LOCATION '{base}/{t.name.replace('.', '/')}'"
        )
    return [t.name for t in tables]
