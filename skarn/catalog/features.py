"""Queries of feature views, snapshots, alert context and request expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.catalog.book import query
from skarn.catalog.corpus import GATED, PII, SCORED
from skarn.catalog.joins import ALERT_TELEMETRY
from skarn.catalog.telemetry import AS_OF, rounded
from skarn.operators import joins as jn, registry as rg
from skarn.plans import features as plan

T = f"TIMESTAMP '{AS_OF}'"
NODE_HEALTH = f"""
SELECT node_id, avg_utilization_1h, max_temperature_1h, p95_memory_1h, uptime_pct_30d,
       coalesce(alert_count_24h, 0) AS alert_count_24h, coalesce(incident_count_7d, 0) AS incident_count_7d
FROM (SELECT node_id, round(avg(utilization_pct), 6) AS avg_utilization_1h, round(max(temperature_c), 6) AS max_temperature_1h,
             round(quantile_cont(memory_used_gb, 0.95), 6) AS p95_memory_1h
      FROM telemetry WHERE ts > {T} - INTERVAL 1 HOUR AND ts <= {T} GROUP BY 1)
FULL JOIN (SELECT node_id, round(count(DISTINCT date_trunc('hour', ts)) * 100.0 / 720, 6) AS uptime_pct_30d
      FROM telemetry WHERE ts > {T} - INTERVAL 30 DAY AND ts <= {T} GROUP BY 1) USING (node_id)
FULL JOIN (SELECT node_id, count(*) AS alert_count_24h FROM alerts WHERE triggered_at > {T} - INTERVAL 1 DAY
      AND triggered_at <= {T} GROUP BY 1) USING (node_id)
FULL JOIN (SELECT node_id, count(*) AS incident_count_7d FROM incidents WHERE opened_ms > epoch_ms({T}) - 604800000
      AND opened_ms <= epoch_ms({T}) GROUP BY 1) USING (node_id)
"""


def node_health(v):
    return plan.node_health_features(v.telemetry, v.alerts, v.incidents, AS_OF)


@query("node_health_features", NODE_HEALTH)
def _(v):
    return rounded(node_health(v))


@query(
    "model_perf_features",
    f"""SELECT model_id, round(avg(latency_ms), 6) AS avg_latency_1h, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_1h,
               round(avg((status <> 'SUCCESS')::INT), 6) AS error_rate_1h, round(count(*) / 3600e0, 6) AS throughput_1h,
               count(DISTINCT replica_id) AS active_replicas
        FROM inference WHERE ts > {T} - INTERVAL 1 HOUR AND ts <= {T} GROUP BY 1""",
)
def _(v):
    return rounded(plan.model_perf_features(v.inference, AS_OF))


@query(
    "training_run_features",
    """WITH p AS (SELECT run_id, arg_max(train_loss, step) AS loss, max(step) AS step,
                 CAST(sum(floor(tokens_per_sec)) AS BIGINT) AS tokens FROM training GROUP BY 1),
       u AS (SELECT node_id, avg(utilization_pct) AS util FROM telemetry GROUP BY 1)
       SELECT p.run_id, round(loss, 6) AS latest_loss, round(exp(loss), 6) AS latest_perplexity, tokens AS tokens_trained,
              round(least(100, step * 100.0 / max_steps), 6) AS estimated_completion_pct, round(util, 6) AS gpu_utilization_avg
       FROM p LEFT JOIN runs r ON p.run_id = r.run_id LEFT JOIN u ON r.node_id = u.node_id""",
)
def _(v):
    return rounded(plan.training_run_features(v.training, v.telemetry, v.runs))


@query(
    "historical_features",
    """SELECT e.row_id, e.user_id, e.event_ms, CASE WHEN e.event_ms - c.feature_ms < 7200000 THEN c.value END AS clicks__value,
              CASE WHEN e.event_ms - b.feature_ms < 86400000 THEN b.value END AS buys__value,
              CASE WHEN e.event_ms - b.feature_ms < 86400000 THEN b.event_id END AS buys__event_id
       FROM entity_rows e
       ASOF LEFT JOIN (SELECT * FROM user_features WHERE event_type = 'click') c
            ON e.user_id = c.user_id AND e.event_ms >= c.feature_ms
       ASOF LEFT JOIN (SELECT * FROM user_features WHERE event_type = 'purchase') b
            ON e.user_id = b.user_id AND e.event_ms >= b.feature_ms""",
)
def _(v):
    of = lambda kind: v.user_features.filter(F.col("event_type") == kind)
    views = [
        plan.FeatureView("clicks", of("click"), ["user_id"], "feature_ms", 7200, ["value"]),
        plan.FeatureView("buys", of("purchase"), ["user_id"], "feature_ms", 86_400, ["value", "event_id"]),
    ]
    return plan.historical_features(v.entity_rows, "event_ms", views, full_names=True)


@query(
    "materialize_features",
    f"""SELECT node_id, device_id, ts, utilization_pct FROM telemetry WHERE ts <= {T} - INTERVAL 2 HOUR
        QUALIFY row_number() OVER (PARTITION BY node_id, device_id ORDER BY ts DESC) = 1
        AND ts > {T} - INTERVAL 26 HOUR""",
)
def _(v):
    keys, last_run = ["node_id", "device_id"], "2024-01-20 00:00:00"
    view = plan.FeatureView("gpu", v.telemetry, keys, "ts", 86_400, ["utilization_pct"])
    before = v.telemetry.filter(F.col("ts") <= F.lit("2024-01-19 22:00:00").cast("timestamp_ntz"))
    previous = jn.latest_rows(before.select(*keys, "ts", "utilization_pct"), keys, "ts")
    return plan.materialize_features(previous, view, last_run, AS_OF)


def lost_node_alerts(v):
    """Alerts of which some do not name their node."""
    number = F.regexp_extract("alert_id", r"\d+", 0).cast("bigint")
    return v.alerts.withColumn("node_id", F.when(number % 6 != 0, F.col("node_id")))


WIDE = f"""
WITH al AS (SELECT * REPLACE (CASE WHEN CAST(substr(alert_id, 3) AS BIGINT) % 6 <> 0 THEN node_id END AS node_id) FROM alerts),
inc AS (SELECT alert_id, arg_min(node_id, incident_id) AS linked FROM incidents GROUP BY 1),
dev AS (SELECT node_id, list(device_id ORDER BY device_id) AS devices FROM (SELECT * FROM devices
        QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY device_id) <= 8) GROUP BY 1),
ev AS (SELECT pod_name, string_agg(reason || ': ' || message, '; ' ORDER BY timestamp_ms DESC, event_id DESC) AS events
       FROM (SELECT * FROM k8s QUALIFY row_number() OVER (PARTITION BY pod_name ORDER BY timestamp_ms DESC, event_id DESC) <= 5)
       GROUP BY 1),
feat AS (SELECT node_id, round(avg_utilization_1h, 2) AS util, alert_count_24h AS n FROM ({NODE_HEALTH})),
w AS (SELECT al.*, coalesce(al.node_id, linked) AS n_id, n.hostname, n.gpu_count, n.node_id AS known, devices, events, util, feat.n
      FROM al LEFT JOIN inc ON al.alert_id = inc.alert_id LEFT JOIN nodes n ON n.node_id = coalesce(al.node_id, linked)
      LEFT JOIN dev ON dev.node_id = coalesce(al.node_id, linked) LEFT JOIN feat ON feat.node_id = coalesce(al.node_id, linked)
      LEFT JOIN ev ON ev.pod_name = al.k8s_pod_name)
"""
CONTEXT = f"""{WIDE}
SELECT alert_id, context, CAST(floor(len(string_split_regex(context, '\\s+')) * 1.3e0) AS INTEGER) AS context_tokens,
       entities, missing
FROM (SELECT alert_id, '[SYSTEM CONTEXT]' || chr(10) || 'Alert: ' || title || ', Severity: ' || severity || ', Time: '
       || strftime(triggered_at, '%Y-%m-%d %H:%M:%S') || chr(10) || 'Affected Node: ' || coalesce(hostname, node_id, 'unknown')
       || ', GPU Count: ' || coalesce(gpu_count, len(devices), 0) || chr(10) || 'Current GPU Utilization: '
       || coalesce(CAST(util AS VARCHAR), 'N/A') || '%' || chr(10) || 'Recent Alerts on this Node: '
       || coalesce(CAST(n AS VARCHAR), 'N/A') || ' in last 24h' || chr(10) || 'Recent K8s Events: ' || coalesce(events, 'none')
       || chr(10) || '[END SYSTEM CONTEXT]' AS context,
       'Alert:' || alert_id || coalesce(',ComputeNode:' || known, '')
       || coalesce(list_reduce(list_transform(devices, lambda d: ',GPUDevice:' || d), lambda a, b: a || b), '') AS entities,
       concat_ws(',', CASE WHEN util IS NULL AND n IS NULL THEN 'gpu_features' END,
                 CASE WHEN events IS NULL THEN 'k8s_events' END) AS missing FROM w)
"""


def _context_parts(v):
    features = node_health(v).select(
        "node_id", F.round("avg_utilization_1h", 2).alias("avg_utilization_1h"), "alert_count_24h"
    )
    return lost_node_alerts(v), v.incidents, v.nodes, v.devices, features


@query("alert_context", CONTEXT)
def _(v):
    return plan.alert_context(*_context_parts(v), v.k8s)


@query(
    "alert_context_joins",
    f"""{WIDE} SELECT alert_id, n_id AS node, hostname, gpu_count, coalesce(len(devices), 0) AS n_devices, events,
        util AS avg_utilization_1h, n AS alert_count_24h FROM w""",
)
def _(v):
    wide = jn.alert_context_joins(*_context_parts(v), plan.recent_pod_events(v.k8s))
    return wide.select(
        "alert_id", F.col("_node").alias("node"), "hostname", "gpu_count",
        F.coalesce(F.size("devices"), F.lit(0)).alias("n_devices"), "events", "avg_utilization_1h", "alert_count_24h",
    )


@query(
    "context_string",
    """SELECT n_nationkey, '[SYSTEM CONTEXT]' || chr(10) || 'Alert: ' || n_name || ', Severity: P1, Time: ' || chr(10)
              || 'Affected Node: unknown, GPU Count: ' || n_regionkey || chr(10) || 'Current GPU Utilization: N/A%' || chr(10)
              || 'Recent Alerts on this Node: 7 in last 24h' || chr(10) || 'Recent K8s Events: none' || chr(10)
              || '[END SYSTEM CONTEXT]' AS context FROM nation""",
)
def _(v):
    from skarn.functions.fields import context_string

    none = F.lit(None).cast("string")
    block = context_string(
        F.col("n_name"), F.lit("P1"), none, none, F.col("n_regionkey"), none, F.lit(7), F.lit("")
    )
    return v.nation.select("n_nationkey", block.alias("context"))


ENRICHED = f"""
SELECT j.alert_id, a.severity, a.triggered_at, gpu_utilization_pct, gpu_device_id, hostname, gpu_count,
       coalesce(e.phase, 'Unknown') AS pod_phase
FROM ({ALERT_TELEMETRY}) j JOIN alerts a ON a.alert_id = j.alert_id LEFT JOIN nodes n ON n.node_id = j.node_id
LEFT JOIN (SELECT * FROM k8s QUALIFY row_number() OVER (PARTITION BY namespace, pod_name
           ORDER BY timestamp_ms DESC, event_id DESC) = 1) e
ON a.k8s_namespace = e.namespace AND a.k8s_pod_name = e.pod_name
"""


@query("alert_enriched", ENRICHED)
def _(v):
    from skarn.plans.alerts import alert_enriched

    enriched = alert_enriched(v.alerts, v.telemetry, v.nodes, v.k8s)
    return enriched.select(
        "alert_id", "severity", "triggered_at", "gpu_utilization_pct", "gpu_device_id", "hostname", "gpu_count", "pod_phase"
    )


@query(
    "inference_expand",
    """WITH s AS (SELECT host, ts, max(success_total) AS s, max(failure_total) AS f, max(prompt_tokens_total) AS p,
                  max(generation_tokens_total) AS g, max(latency_p50_ms) AS l FROM scrapes GROUP BY 1, 2),
       d AS (SELECT host, epoch_us(ts) // 1000 AS timestamp_ms, CAST(floor(l) AS BIGINT) AS latency_ms,
                    CAST(greatest(0, s - coalesce(lag(s) OVER w, 0)) AS BIGINT) AS ds, CAST(greatest(0, f - coalesce(lag(f) OVER w, 0)) AS BIGINT) AS df,
                    greatest(0, p - coalesce(lag(p) OVER w, 0)) AS dp, greatest(0, g - coalesce(lag(g) OVER w, 0)) AS dg
             FROM s WINDOW w AS (PARTITION BY host ORDER BY ts)),
       k AS (SELECT host, timestamp_ms, latency_ms, 'SUCCESS' AS status, NULL AS error_code, ds AS n,
                    CAST(floor(dp / greatest(1, ds)) AS INTEGER) AS prompt_tokens, CAST(floor(dg / greatest(1, ds)) AS INTEGER) AS completion_tokens FROM d
             UNION ALL SELECT host, timestamp_ms, latency_ms, 'ERROR', 'SCRAPE_INFERRED_FAILURE', df, 0, 0 FROM d)
       SELECT concat_ws(':', host, timestamp_ms, status, i) AS request_id, host, timestamp_ms, status, error_code,
              prompt_tokens, completion_tokens, latency_ms, sha256('scraper') AS user_id
       FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM k WHERE n > 0)""",
)
def _(v):
    return plan.inference_expand(v.scrapes)


@query(
    "mark_used",
    """SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY seq) AS position, run_id FROM version_runs""",
)
def _(v):
    return rg.usage_positions(v.version_runs, "seq")
