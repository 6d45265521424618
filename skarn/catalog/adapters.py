"""Views over the given tables that carry the names and fields the operators expect.

The text is plain SQL read by both engines.  ``MS(x)`` stands for the epoch milliseconds of a
timestamp, the only expression the two spell differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {
    "telemetry": """
        SELECT concat('node-', user_id % 16) AS node_id, concat('gpu-', event_id % 8) AS device_id,
               ts, MS(ts) AS timestamp_ms, value / 5 AS utilization_pct,
               value / 8 AS memory_used_gb, 64e0 AS memory_total_gb,
               20 + value / 5 AS temperature_c, value AS power_draw_w,
               CASE WHEN event_id % 7 = 0 THEN -1e0 ELSE value / 10 END AS hbm_bandwidth_gbps,
               CASE WHEN event_id % 5 = 0 THEN -1e0 ELSE value / 20 END AS pcie_bandwidth_gbps
        FROM {events}""",
    "telemetry_dense": """
        SELECT concat('node-', user_id % 2) AS node_id, concat('gpu-', event_id % 2) AS device_id,
               ts, MS(ts) AS timestamp_ms, value / 5 AS utilization_pct,
               value / 8 AS memory_used_gb, 64e0 AS memory_total_gb,
               20 + value / 5 AS temperature_c, value AS power_draw_w,
               CASE WHEN event_id % 7 = 0 THEN -1e0 ELSE value / 10 END AS hbm_bandwidth_gbps,
               CASE WHEN event_id % 5 = 0 THEN -1e0 ELSE value / 20 END AS pcie_bandwidth_gbps
        FROM {events}""",
    "alerts": """
        SELECT concat('a-', event_id) AS alert_id, concat('High load on user ', user_id) AS title,
               concat('P', event_id % 4 + 1) AS severity,
               CASE event_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'acknowledged'
                    ELSE 'resolved' END AS status,
               'monitor' AS source_system, ts AS triggered_at,
               concat('node-', user_id % 16) AS node_id,
               concat('ns-', user_id % 3) AS k8s_namespace,
               concat('pod-', user_id % 55) AS k8s_pod_name
        FROM {events} WHERE event_type = 'error'""",
    "inference": """
        SELECT concat('r-', event_id) AS request_id, concat('model-', user_id % 10) AS model_id,
               concat('v', user_id % 3) AS model_version, ts, MS(ts) AS timestamp_ms,
               user_id % 200 AS prompt_tokens, event_id % 300 AS completion_tokens,
               CAST(floor(value * 10) AS BIGINT) AS latency_ms,
               CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END AS status,
               concat('u-', user_id) AS user_id, concat('replica-', event_id % 6) AS replica_id
        FROM {events} WHERE event_type <> 'signup'""",
    "training": """
        SELECT concat('run-', user_id % 20) AS run_id, event_id AS step, ts, MS(ts) AS timestamp_ms,
               value / 100 AS train_loss,
               CASE WHEN event_type = 'view' THEN value / 90 END AS val_loss,
               value * 10 AS tokens_per_sec
        FROM {events}""",
    "runs": """
        SELECT concat('run-', p_partkey) AS run_id, concat('model-', p_partkey % 10) AS model_id,
               concat('node-', p_partkey % 16) AS node_id, p_size * 1000 AS max_steps,
               CASE WHEN p_size < 25 THEN 'running' ELSE 'finished' END AS status
        FROM {part}""",
    "scrapes": """
        SELECT concat('host-', o_custkey % 50) AS host, o_orderdate AS ts, o_orderkey AS seq,
               floor(o_totalprice / 20000) AS success_total, floor(o_totalprice / 90000) AS failure_total,
               floor(o_totalprice * 3) AS prompt_tokens_total,
               floor(o_totalprice * 5) AS generation_tokens_total,
               o_totalprice / 1000 AS latency_p50_ms
        FROM {orders}""",
    "corpus": """
        SELECT concat('d-', doc_id) AS document_id, doc_id, text AS raw_text, source,
               lang AS language, concat('f-', doc_id % 37) AS file_path,
               1704067200000 + doc_id * 60000 AS ingested_ms
        FROM {documents}""",
    "k8s": """
        SELECT concat('ns-', user_id % 3) AS namespace, concat('pod-', user_id % 40) AS pod_name,
               CASE event_id % 4 WHEN 0 THEN 'Running' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Failed'
                    ELSE 'Succeeded' END AS phase,
               concat('Reason', event_id % 5) AS reason, concat('event ', event_id) AS message,
               MS(ts) AS timestamp_ms, event_id
        FROM {events} WHERE event_type = 'view'""",
    "nodes": """
        SELECT concat('node-', n_nationkey) AS node_id, n_name AS hostname,
               n_nationkey % 8 + 1 AS gpu_count, r_name AS zone,
               CASE WHEN n_nationkey % 5 = 0 THEN 'degraded' ELSE 'healthy' END AS health
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "devices": """
        SELECT concat('gpu-', s_suppkey) AS device_id, concat('node-', s_suppkey % 16) AS node_id
        FROM {supplier}""",
    "incidents": """
        SELECT concat('i-', o_orderkey) AS incident_id, concat('a-', o_orderkey) AS alert_id,
               concat('node-', o_custkey % 16) AS node_id,
               1704067200000 + o_orderkey * 170000 AS opened_ms
        FROM {orders}""",
    "quakes": """
        SELECT concat('eq-', event_id) AS id, 5 + value / 200 AS magnitude,
               5e0 + user_id % 20 AS depth, 34 + (user_id % 50) / 1e2 AS lat,
               -118 - (event_id % 50) / 1e2 AS lng, ts AS detected_at
        FROM {events} WHERE event_type = 'signup'""",
    "hotspots": """
        SELECT concat('h-', event_id) AS id, 34 + (user_id % 50) / 1e2 AS lat,
               -118 - (event_id % 50) / 1e2 AS lng, value AS frp,
               CASE event_id % 5 WHEN 0 THEN 'l' WHEN 1 THEN 'N' WHEN 2 THEN 'h' WHEN 3 THEN '72'
                    ELSE 'bad' END AS confidence,
               ts AS detected_at
        FROM {events} WHERE event_type = 'click'""",
    "wind": """
        SELECT 34 + s_suppkey % 50 / 1e2 AS lat, -118 - s_nationkey / 1e2 AS lng,
               max(s_acctbal) / 1000 AS speed_ms, max(s_suppkey) % 360 * 1e0 AS direction_deg
        FROM {supplier} GROUP BY 34 + s_suppkey % 50 / 1e2, -118 - s_nationkey / 1e2""",
    "zones": """
        SELECT concat('zone-', event_id) AS id, concat('eq-', user_id) AS event_id,
               34 + (user_id % 50) / 1e2 AS lat, -118 - (event_id % 50) / 1e2 AS lng,
               CASE WHEN value > 200 THEN 1e0 ELSE value / 200 END AS damage_probability,
               CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'none' END
                    AS liquefaction_class
        FROM {events} WHERE event_type = 'signup'""",
    "ember": """
        SELECT concat('ember-', event_id) AS id, 34 + (user_id % 50) / 1e2 AS lat,
               -118 - (event_id % 50) / 1e2 AS lng, event_id AS seq,
               CASE WHEN value > 100 THEN 1e0 ELSE value / 100 END AS probability,
               concat('h-', user_id) AS hotspot_id
        FROM {events} WHERE event_type = 'view'""",
    "crews": """
        SELECT s_suppkey AS id, concat('crew-', s_suppkey) AS crew_identifier,
               34 + s_suppkey % 37 / 80e0 AS lat, -118 - s_suppkey % 41 / 90e0 AS lng,
               CASE s_suppkey % 3 WHEN 0 THEN 'standby' WHEN 1 THEN 'available'
                    ELSE 'deployed' END AS status,
               4 + s_suppkey % 5 AS capacity,
               CASE WHEN s_suppkey % 4 = 0 THEN concat('ember-', s_suppkey * 50) END AS assigned_zone_id
        FROM {supplier}""",
    "shelters": """
        SELECT concat('shelter-', c_custkey) AS id, c_name AS name,
               c_custkey % 300 AS occupancy, 250 AS capacity,
               concat('zone-', c_custkey * 6) AS damage_zone_id
        FROM {customer}""",
    "hospitals": """
        SELECT concat('hospital-', c_custkey) AS id, c_name AS name,
               c_custkey % 90 AS current_capacity,
               CASE c_custkey % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'elevated'
                    ELSE 'critical' END AS alert_level,
               concat('zone-', c_custkey * 4 + 1) AS damage_zone_id
        FROM {customer}""",
    "routes": """
        SELECT concat('route-', p_partkey) AS id,
               CASE WHEN p_size > 25 THEN 'open' ELSE 'closed' END AS status,
               concat('zone-', p_partkey * 5) AS origin_zone_id,
               concat('zone-', p_partkey * 3 + 1) AS destination_zone_id
        FROM {part}""",
    "actions": """
        SELECT concat('act-', event_id) AS id,
               CASE event_id % 4 WHEN 0 THEN 'dispatch' WHEN 1 THEN 'alert' WHEN 2 THEN 'evacuate'
                    ELSE 'reposition' END AS action_type,
               concat('res-', user_id % 30) AS resource_id, concat('zone-', user_id) AS zone_id,
               CASE WHEN value > 100 THEN 1e0 ELSE value / 100 END AS confidence,
               CASE event_id % 3 WHEN 0 THEN 'immediate' WHEN 1 THEN 'high'
                    ELSE 'medium' END AS time_sensitivity,
               CASE event_id % 5 WHEN 0 THEN 'approved' WHEN 1 THEN 'dismissed'
                    ELSE 'pending' END AS status,
               ts AS created_at
        FROM {events} WHERE event_type = 'purchase'""",
    "evaluations": """
        SELECT concat('e-', o_orderkey) AS eval_id, concat('model-', o_custkey % 10) AS model_id,
               concat('v', o_custkey % 3) AS model_version, o_orderstatus AS benchmark_name,
               o_totalprice / 500000 AS score, o_orderdate AS evaluated_at
        FROM {orders}""",
    "entity_rows": """
        SELECT o_orderkey AS row_id, o_custkey % 150 AS user_id,
               1704067200000 + (o_orderkey % 43200) * 60000 AS event_ms
        FROM {orders}""",
    "user_features": """
        SELECT user_id, MS(ts) AS feature_ms, value, event_type, event_id FROM {events}""",
    "topic_log": """
        SELECT event_id % 12 AS partition, event_id AS "offset", MS(ts) AS timestamp_ms
        FROM {events}""",
    "registry": """
        SELECT concat('ver-', n_nationkey) AS version_id,
               CASE WHEN n_regionkey < 3 THEN 'bronze.raw_text_corpus'
                    ELSE 'silver.training_corpus_clean' END AS table_name,
               n_nationkey * 3 AS snapshot_version,
               1704067200000 + n_nationkey * 7200000 AS created_ms
        FROM {nation}""",
    "version_runs": """
        SELECT concat('ver-', p_partkey % 25) AS version_id, concat('run-', p_partkey) AS run_id,
               p_partkey AS seq
        FROM {part}""",
    "sync_log": """
        SELECT concat('feed-', user_id % 6) AS pipeline, ts AS finished_at,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, event_id
        FROM {events}""",
    "event_log": """
        SELECT event_id AS id, ts AS created_at, event_type AS source, props AS message
        FROM {events}""",
}

_NAMES = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")
_SOURCES = re.compile(r"\{(\w+)\}")


def _spell_ms(text: str, spark: bool) -> str:
    if spark:
        spelled = r"timestampdiff(MILLISECOND, CAST('1970-01-01' AS TIMESTAMP_NTZ), \1)"
        return re.sub(r"MS\((\w+)\)", spelled, text).replace('"offset"', "`offset`")
    return re.sub(r"MS\((\w+)\)", r"(epoch_us(\1) // 1000)", text)


class Views:
    """Tables and adapter views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        return self.apply(name, {t: self.table(t) for t in _SOURCES.findall(VIEWS[name])})

    def apply(self, name: str, sources: dict[str, DataFrame]) -> DataFrame:
        """A view's text over given source frames (a stream may stand in for a table)."""
        return self.spark.sql(_spell_ms(VIEWS[name], spark=True), **sources)


def with_views(sql: str) -> str:
    """DuckDB text with the adapter views it mentions put in front as CTEs."""
    names = dict.fromkeys(_NAMES.findall(sql))
    ctes = []
    for name in names:
        body = _SOURCES.sub(r"\1", _spell_ms(VIEWS[name], spark=False))
        ctes.append(f"{name} AS ({body})")
    if not ctes:
        return sql
    head = "WITH " + ",\n".join(ctes)
    stripped = sql.lstrip()
    if stripped.startswith("WITH RECURSIVE "):
        return head.replace("WITH", "WITH RECURSIVE", 1) + ",\n" + stripped[15:]
    if stripped.startswith("WITH "):
        return head + ",\n" + stripped[5:]
    return head + "\n" + sql
