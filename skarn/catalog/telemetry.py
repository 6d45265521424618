"""Queries of rollups, service levels, counters and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from skarn.catalog.book import query
from skarn.operators import telemetry as op

AS_OF = "2024-01-20 12:00:00"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    return df.withColumns(
        {f.name: F.round(f.name, digits) for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    )


HOURLY = """
SELECT node_id, device_id, date_trunc('hour', ts) AS hour,
       round(avg(utilization_pct), 6) AS avg_utilization_pct,
       round(max(utilization_pct), 6) AS max_utilization_pct,
       round(quantile_cont(utilization_pct, 0.95), 6) AS p95_utilization_pct,
       round(avg(temperature_c), 6) AS avg_temperature_c, round(max(temperature_c), 6) AS max_temperature_c,
       round(avg(power_draw_w), 6) AS avg_power_draw_w, round(max(power_draw_w), 6) AS max_power_draw_w,
       round(avg(nullif(hbm_bandwidth_gbps, -1)), 6) AS avg_hbm_bandwidth_gbps,
       round(avg(nullif(pcie_bandwidth_gbps, -1)), 6) AS avg_pcie_bandwidth_gbps,
       count(*) AS sample_count, CAST(date_trunc('hour', ts) AS DATE) AS date
FROM telemetry_dense {where} GROUP BY 1, 2, 3
"""


@query("telemetry_hourly", HOURLY.format(where=""))
def _(v):
    return rounded(op.telemetry_hourly(v.telemetry_dense))


@query(
    "telemetry_hourly_lagged",
    HOURLY.format(where=f"WHERE date_trunc('hour', ts) <= TIMESTAMP '{AS_OF}' - INTERVAL 2 HOUR"),
)
def _(v):
    return rounded(op.telemetry_hourly_lagged(v.telemetry_dense, AS_OF))


SLA = """
SELECT model_id, date_trunc('hour', ts) AS bucket, round(quantile_cont(latency_ms, 0.5), 6) AS p50,
       round(quantile_cont(latency_ms, 0.95), 6) AS p95, round(quantile_cont(latency_ms, 0.99), 6) AS p99,
       round(avg(CASE WHEN status = 'SUCCESS' THEN 0e0 ELSE 1e0 END), 6) AS error_rate,
       round(count(*) / 3600e0, 6) AS rps
FROM inference GROUP BY 1, 2
"""


@query("inference_sla", SLA)
def _(v):
    return rounded(op.inference_sla(v.inference))


@query("sla_breaches", f"SELECT * FROM ({SLA}) AS s WHERE p99 > 500 OR error_rate > 0.01")
def _(v):
    return rounded(op.sla_breaches(op.inference_sla(v.inference)))


OVERVIEW = """
SELECT (SELECT count(*) FROM nodes) AS nodes_total,
       (SELECT count(*) FROM nodes WHERE health = 'healthy') AS nodes_healthy,
       (SELECT count(*) FROM runs WHERE status = 'running') AS active_runs,
       count(*) FILTER (severity = 'P1') AS alerts_p1, count(*) FILTER (severity = 'P2') AS alerts_p2,
       count(*) FILTER (severity = 'P3') AS alerts_p3, count(*) FILTER (severity = 'P4') AS alerts_p4,
       (SELECT round(avg(utilization_pct), 6) FROM telemetry) AS avg_utilization_pct
FROM alerts WHERE status <> 'resolved'
"""


def _overview(v):
    return op.cluster_overview(v.nodes, v.runs, v.alerts, v.telemetry)


@query("cluster_overview", OVERVIEW)
def _(v):
    return rounded(_overview(v))


@query(
    "cluster_health",
    """SELECT CASE WHEN count(*) FILTER (severity = 'P1') > 0 THEN 'critical'
                   WHEN count(*) FILTER (severity = 'P2') > 0 THEN 'degraded' ELSE 'healthy' END AS health
       FROM alerts WHERE status <> 'resolved'""",
)
def _(v):
    return op.cluster_health(_overview(v))


@query(
    "operational_snapshot",
    f"""
WITH p AS (SELECT TIMESTAMP '{AS_OF}' AS t),
dev AS (SELECT node_id, device_id, arg_max(temperature_c, (ts, temperature_c)) AS t FROM telemetry
        WHERE ts <= (SELECT t FROM p) GROUP BY 1, 2),
hour AS (SELECT * FROM telemetry WHERE ts > (SELECT t - INTERVAL 1 HOUR FROM p) AND ts <= (SELECT t FROM p)),
served AS (SELECT * FROM inference WHERE ts > (SELECT t - INTERVAL 1 HOUR FROM p) AND ts <= (SELECT t FROM p))
SELECT (SELECT count(*) FROM dev) AS total_gpu_count, (SELECT count(*) FROM dev WHERE t < 90) AS healthy_gpu_count,
       (SELECT round(avg(utilization_pct), 6) FROM hour) AS cluster_avg_utilization_pct,
       (SELECT round(avg(temperature_c), 6) FROM hour) AS cluster_avg_temperature_c,
       (SELECT count(*) FROM runs WHERE status = 'running') AS active_training_runs,
       (SELECT count(DISTINCT (model_id, replica_id)) FROM served) AS active_inference_replicas,
       (SELECT round(avg(latency_ms), 6) FROM served) AS avg_inference_latency_ms_1h,
       (SELECT count(*) FROM inference WHERE ts >= date_trunc('day', (SELECT t FROM p)) AND ts <= (SELECT t FROM p))
           AS inference_requests_today,
       (SELECT CAST(sum(floor(tokens_per_sec)) AS BIGINT) FROM training
        WHERE ts >= date_trunc('day', (SELECT t FROM p)) AND ts <= (SELECT t FROM p)) AS tokens_trained_today,
       (SELECT count(*) FROM alerts WHERE status = 'open' AND severity = 'P1' AND triggered_at <= (SELECT t FROM p))
           AS open_p1_alerts,
       (SELECT count(*) FROM alerts WHERE status = 'open' AND severity = 'P2' AND triggered_at <= (SELECT t FROM p))
           AS open_p2_alerts,
       t AS snapshot_ts
FROM p""",
)
def _(v):
    return rounded(
        op.operational_snapshot(v.telemetry, v.runs, v.alerts, v.inference, v.training, AS_OF)
    )


@query(
    "dashboard_counters",
    """SELECT (SELECT count(*) FROM hotspots) AS active_hotspots,
       (SELECT count(*) FROM crews WHERE status = 'deployed') AS crews_deployed,
       (SELECT count(*) FROM crews) AS crews_total,
       (SELECT count(*) FROM zones WHERE damage_probability > 0.5) AS damage_zones_above_threshold,
       (SELECT count(*) FROM shelters WHERE occupancy >= capacity) AS shelters_at_capacity,
       (SELECT count(*) FROM hospitals WHERE alert_level <> 'normal') AS hospitals_on_alert""",
)
def _(v):
    return op.dashboard_counters(v.hotspots, v.crews, v.zones, v.shelters, v.hospitals)


@query(
    "table_counts",
    """SELECT 'hotspots' AS table_name, count(*) AS n FROM hotspots
       UNION ALL SELECT 'damage_zones', count(*) FROM zones
       UNION ALL SELECT 'actions', count(*) FROM actions
       UNION ALL SELECT 'drones', 0""",
)
def _(v):
    tables = {"hotspots": v.hotspots, "damage_zones": v.zones, "actions": v.actions, "drones": None}
    return op.table_counts(v.spark, tables)


@query(
    "histogram_quantile",
    """
WITH total AS (SELECT model_id, count(*) AS n FROM inference GROUP BY 1),
b AS (SELECT t.model_id, le, (SELECT count(*) FROM inference i WHERE i.model_id = t.model_id
             AND latency_ms <= le * 1000) AS cum, n
      FROM total t, (VALUES (0.05e0), (0.1e0), (0.2e0), (0.3e0), (0.4e0), (1e0)) AS x(le))
SELECT model_id, coalesce(min(le) FILTER (cum >= n * 0.5), max(le)) * 1000 AS value_ms FROM b GROUP BY 1""",
)
def _(v):
    buckets = op.latency_buckets(v.inference, [0.05, 0.1, 0.2, 0.3, 0.4, 1.0])
    return op.histogram_quantile(buckets, ["model_id"])


@query("util_by_timestamp", "SELECT ts, round(avg(utilization_pct), 6) AS util FROM telemetry GROUP BY ts")
def _(v):
    return rounded(op.util_by_timestamp(v.telemetry))


@query(
    "best_val_loss",
    """SELECT run_id, step, val_loss FROM training WHERE val_loss IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY val_loss, step) = 1""",
)
def _(v):
    return op.best_val_loss(v.training)


@query(
    "heatmap_pivot",
    "SELECT CAST(regexp_replace(node_id, '\\D', '', 'g') AS BIGINT) % 8 AS \"row\", "
    + ", ".join(
        f"arg_max(utilization_pct, (ts, utilization_pct)) FILTER (device_id = 'gpu-{i}') AS g{i}"
        for i in range(8)
    )
    + " FROM telemetry GROUP BY 1",
)
def _(v):
    index = F.regexp_replace("device_id", r"\D", "").cast("int")
    return op.heatmap_pivot(v.telemetry.withColumn("gpu_index", index))


@query("status_counts", "SELECT status, count(*) AS n FROM sync_log GROUP BY status")
def _(v):
    return op.status_counts(v.sync_log)


@query(
    "staleness",
    f"""
WITH s AS (
    SELECT 'operational_dashboard' AS table_name, max(ts) AS m, 300 AS l FROM telemetry
    UNION ALL SELECT 'model_performance', max(ts), 3600 FROM inference
    UNION ALL SELECT 'dataset_registry', max(detected_at), 7200 FROM quakes)
SELECT table_name, date_sub('second', m, TIMESTAMP '2024-01-31 00:00:00') AS age_s,
       date_sub('second', m, TIMESTAMP '2024-01-31 00:00:00') > l AS breach FROM s""",
)
def _(v):
    return op.staleness(
        {
            "operational_dashboard": (v.telemetry, "ts", 300),
            "model_performance": (v.inference, "ts", 3600),
            "dataset_registry": (v.quakes, "detected_at", 7200),
        },
        "2024-01-31 00:00:00",
    )


@query(
    "benchmark_regression",
    """
WITH s AS (SELECT model_id, benchmark_name, model_version, avg(score) AS score FROM evaluations GROUP BY 1, 2, 3)
SELECT model_id, benchmark_name, model_version, round(score, 6) AS score,
       round(score - lag(score) OVER (PARTITION BY model_id, benchmark_name ORDER BY model_version), 6) AS delta
FROM s""",
)
def _(v):
    return rounded(op.benchmark_regression(v.evaluations))


@query(
    "model_performance_gold",
    """
WITH serving AS (
    SELECT model_id, model_version, avg(CASE WHEN status = 'SUCCESS' THEN 0e0 ELSE 1e0 END) AS error_rate,
           count(*) / greatest(date_sub('second', min(ts), max(ts)), 1) AS throughput_rps,
           quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.95) AS p95,
           quantile_cont(latency_ms, 0.99) AS p99 FROM inference GROUP BY 1, 2),
scores AS (SELECT model_id, model_version, benchmark_name, avg(score) AS score, max(evaluated_at) AS evaluated_at
           FROM evaluations GROUP BY 1, 2, 3)
SELECT s.model_id, s.model_version, benchmark_name, round(score, 6) AS score, evaluated_at,
       round(error_rate, 6) AS error_rate, round(throughput_rps, 6) AS throughput_rps,
       round(p50, 6) AS p50_latency_ms, round(p95, 6) AS p95_latency_ms, round(p99, 6) AS p99_latency_ms
       , CAST(evaluated_at AS DATE) AS date, training_dataset_version, parameter_count
FROM scores s LEFT JOIN serving i ON s.model_id = i.model_id AND s.model_version = i.model_version
LEFT JOIN (SELECT model_id, max(version_id) AS training_dataset_version, max(max_steps)::BIGINT * 1000000 AS parameter_count
           FROM runs r LEFT JOIN version_runs u ON r.run_id = u.run_id GROUP BY 1) m ON s.model_id = m.model_id""",
)
def _(v):
    made = v.runs.join(v.version_runs.select("run_id", "version_id"), "run_id", "left").groupBy("model_id").agg(
        F.max("version_id").alias("training_dataset_version"),
        (F.max("max_steps").cast("bigint") * 1_000_000).alias("parameter_count"),
    )
    return rounded(op.model_performance_gold(v.evaluations, v.inference, made))
