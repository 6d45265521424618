"""Queries of joins: point in time, enrichment, spatial, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.catalog.book import query
from skarn.catalog.telemetry import AS_OF, rounded
from skarn.operators import joins as op, telemetry as tel

HOUR_MS = 3_600_000


@query(
    "pit_join",
    f"""SELECT e.row_id, e.user_id, e.event_ms, CASE WHEN e.event_ms - f.feature_ms < {HOUR_MS} THEN f.value END AS value,
               CASE WHEN e.event_ms - f.feature_ms < {HOUR_MS} THEN f.event_type END AS event_type
        FROM entity_rows e ASOF LEFT JOIN user_features f ON e.user_id = f.user_id AND e.event_ms >= f.feature_ms""",
)
def _(v):
    return op.pit_join(
        v.entity_rows, v.user_features, ["user_id"], "event_ms", "feature_ms", 3600,
        cols=["value", "event_type"], created="event_id",
    )


@query(
    "latest_join",
    """SELECT e.row_id, e.user_id, e.event_ms, f.event_id, f.event_type, f.value FROM entity_rows e LEFT JOIN
       (SELECT * FROM user_features QUALIFY row_number() OVER (PARTITION BY user_id
        ORDER BY feature_ms DESC, event_id DESC) = 1) f ON e.user_id = f.user_id""",
)
def _(v):
    features = v.user_features.select("user_id", "feature_ms", "event_id", "event_type", "value")
    return op.latest_join(v.entity_rows, features, ["user_id"], "feature_ms")


# Two one-sided joins, each against the last row of a (node, instant).
ALERT_TELEMETRY = """
WITH t AS (SELECT node_id, ts, max(device_id) AS device_id FROM telemetry GROUP BY 1, 2),
tt AS (SELECT t.*, m.utilization_pct, m.temperature_c, m.power_draw_w FROM t JOIN telemetry m
       ON t.node_id = m.node_id AND t.ts = m.ts AND t.device_id = m.device_id),
b AS (SELECT a.*, p.ts AS bts, p.utilization_pct AS bu, p.temperature_c AS bt, p.power_draw_w AS bp, p.device_id AS bd
      FROM alerts a ASOF LEFT JOIN tt p ON a.node_id = p.node_id AND a.triggered_at >= p.ts),
f AS (SELECT b.*, n.ts AS nts, n.utilization_pct AS nu, n.temperature_c AS nt, n.power_draw_w AS np, n.device_id AS nd
      FROM b ASOF LEFT JOIN tt n ON b.node_id = n.node_id AND b.triggered_at <= n.ts)
SELECT alert_id, node_id, triggered_at,
       CASE WHEN triggered_at - bts < INTERVAL 1 HOUR THEN bu WHEN nts - triggered_at < INTERVAL 1 HOUR THEN nu END AS gpu_utilization_pct,
       CASE WHEN triggered_at - bts < INTERVAL 1 HOUR THEN bt WHEN nts - triggered_at < INTERVAL 1 HOUR THEN nt END AS gpu_temperature_c,
       CASE WHEN triggered_at - bts < INTERVAL 1 HOUR THEN bp WHEN nts - triggered_at < INTERVAL 1 HOUR THEN np END AS gpu_power_draw_w,
       CASE WHEN triggered_at - bts < INTERVAL 1 HOUR THEN bd WHEN nts - triggered_at < INTERVAL 1 HOUR THEN nd END AS gpu_device_id
FROM f
"""


def _quiet_telemetry(v):
    """Telemetry without the alerting events themselves, so that the alert has to look around."""
    return v.telemetry.join(
        v.alerts.select("node_id", F.col("triggered_at").alias("ts")), ["node_id", "ts"], "left_anti"
    )


@query(
    "alert_telemetry_join",
    ALERT_TELEMETRY.replace("FROM telemetry GROUP", "FROM telemetry WHERE (node_id, ts) NOT IN (SELECT (node_id, triggered_at) FROM alerts) GROUP"),
)
def _(v):
    joined = op.alert_telemetry_join(v.alerts, _quiet_telemetry(v))
    return joined.select(
        "alert_id", "node_id", "triggered_at", "gpu_utilization_pct", "gpu_temperature_c",
        "gpu_power_draw_w", "gpu_device_id",
    )


@query(
    "k8s_enrich",
    """SELECT alert_id, k8s_pod_name, coalesce(e.phase, 'Unknown') AS pod_phase, k8s_namespace AS namespace
       FROM alerts a LEFT JOIN (SELECT * FROM k8s QUALIFY row_number() OVER
            (PARTITION BY namespace, pod_name ORDER BY timestamp_ms DESC, event_id DESC) = 1) e
       ON a.k8s_namespace = e.namespace AND a.k8s_pod_name = e.pod_name""",
)
def _(v):
    return op.k8s_enrich(v.alerts, v.k8s).select("alert_id", "k8s_pod_name", "pod_phase", "namespace")


@query(
    "node_enrich",
    "SELECT alert_id, a.node_id, hostname, gpu_count FROM alerts a LEFT JOIN nodes n ON a.node_id = n.node_id",
)
def _(v):
    return op.node_enrich(v.alerts, v.nodes).select("alert_id", "node_id", "hostname", "gpu_count")


FACILITY = """
SELECT 'alert' AS action_type, f.id AS resource_id, z.id AS zone_id, damage_probability AS confidence,
       'high' AS time_sensitivity
FROM (SELECT id, damage_zone_id FROM shelters UNION ALL SELECT id, damage_zone_id FROM hospitals) f
JOIN zones z ON z.id = f.damage_zone_id WHERE damage_probability > 0.7
"""
ROUTE = """
SELECT 'alert' AS action_type, r.id AS resource_id, z.id AS zone_id, damage_probability AS confidence,
       'high' AS time_sensitivity
FROM routes r JOIN zones z ON z.id = r.origin_zone_id OR z.id = r.destination_zone_id WHERE damage_probability > 0.7
"""
IN_ZONE = """
SELECT crew_identifier AS crew_id, z.id AS zone_id FROM crews c
JOIN (SELECT * FROM zones WHERE damage_probability > 0.7) z
ON floor(c.lat / 0.01) = floor(z.lat / 0.01) AND floor(c.lng / 0.01) = floor(z.lng / 0.01)
QUALIFY row_number() OVER (PARTITION BY crew_identifier ORDER BY damage_probability DESC, z.id) = 1
"""


def km(lat1, lng1, lat2, lng2):
    a = (
        f"(sin(radians({lat2} - {lat1}) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* sin(radians({lng2} - {lng1}) / 2) ** 2)"
    )
    return f"6371e0 * 2 * atan2(sqrt({a}), sqrt(1 - {a}))"


@query("zone_facility_alerts", FACILITY)
def _(v):
    return op.zone_facility_alerts(v.zones, [v.shelters, v.hospitals])


@query("zone_route_alerts", ROUTE)
def _(v):
    return op.zone_route_alerts(v.zones, v.routes)


@query("crew_in_zone", IN_ZONE)
def _(v):
    return op.crew_in_zone(v.crews, v.zones)


@query(
    "nearest_crew",
    f"""SELECT z.id AS zone_id, crew_identifier AS crew_id, round({km('z.lat', 'z.lng', 'c.lat', 'c.lng')}, 6) AS km
        FROM zones z, crews c WHERE c.status IN ('available', 'standby')
        QUALIFY row_number() OVER (PARTITION BY z.id ORDER BY round({km('z.lat', 'z.lng', 'c.lat', 'c.lng')}, 9), crew_identifier) = 1""",
)
def _(v):
    return rounded(op.nearest_crew(v.zones, v.crews))


def soil_polygons(v):
    """One rectangle per nation with the region as soil class."""
    lat = 33.9 + F.col("n_nationkey") % 5 * 0.13
    lng = -118.6 + F.floor(F.col("n_nationkey") / 5) * 0.17
    corner = lambda y, x: F.struct(x.alias("lng"), y.alias("lat"))
    ring = F.array(
        corner(lat, lng), corner(lat, lng + 0.2), corner(lat + 0.15, lng + 0.2), corner(lat + 0.15, lng), corner(lat, lng)
    )
    kinds = F.array(*[F.lit(k) for k in ("Low", "Very_High", "HIGH", "moderate", "none")])
    return v.nation.select(
        F.col("n_nationkey").alias("ord"), F.get(kinds, F.col("n_regionkey")).alias("class"), ring.alias("ring")
    )


SOIL = """
SELECT n_nationkey AS ord, ['low', 'very_high', 'high', 'moderate', 'none'][n_regionkey + 1] AS class,
       33.9e0 + n_nationkey % 5 * 0.13e0 AS y0, -118.6e0 + floor(n_nationkey / 5) * 0.17e0 AS x0 FROM nation
"""


@query(
    "liquefaction_lookup",
    f"""SELECT z.id, coalesce(arg_min(s.class, s.ord), 'low') AS liquefaction_class
        FROM quakes z LEFT JOIN ({SOIL}) s ON z.lat >= y0 AND z.lat < y0 + 0.15 AND z.lng >= x0 AND z.lng < x0 + 0.2
        GROUP BY z.id""",
)
def _(v):
    return op.liquefaction_lookup(v.quakes, soil_polygons(v)).select("id", "liquefaction_class")


@query(
    "recent_action_antijoin",
    """SELECT id, action_type, resource_id FROM actions a WHERE NOT EXISTS (
           SELECT 1 FROM actions r WHERE r.action_type = a.action_type AND r.resource_id = a.resource_id
           AND r.created_at < a.created_at AND r.created_at > a.created_at - INTERVAL 12 HOUR)""",
)
def _(v):
    return op.recent_action_antijoin(v.actions, v.actions, 12 * 3600).select("id", "action_type", "resource_id")


@query("replay_reset", "SELECT id, event_id, damage_probability FROM zones WHERE event_id <> 'eq-7'")
def _(v):
    events = v.zones.select(F.col("event_id").alias("id"))
    return op.replay_reset(v.zones, events, "eq-7").select("id", "event_id", "damage_probability")


@query(
    "batch_feature_get",
    """SELECT e.user_id, n, total FROM entity_rows e LEFT JOIN
       (SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM user_features
        WHERE event_type = 'click' GROUP BY 1) f ON e.user_id = f.user_id""",
)
def _(v):
    clicks = v.user_features.filter("event_type = 'click'")
    view = clicks.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return op.batch_feature_get(v.entity_rows.select("user_id"), view, "user_id")


@query(
    "lineage_forward",
    """WITH d AS (SELECT document_id FROM corpus WHERE file_path = 'f-5'),
       g AS (SELECT version_id FROM registry WHERE table_name = 'bronze.raw_text_corpus'),
       u AS (SELECT DISTINCT version_id, run_id FROM version_runs WHERE version_id IN (SELECT version_id FROM g))
       SELECT 'document' AS kind, 'f-5' AS source, document_id AS target FROM d
       UNION ALL SELECT 'table', document_id, 'bronze.raw_text_corpus' FROM d
       UNION ALL SELECT 'version', 'bronze.raw_text_corpus', version_id FROM g
       UNION ALL SELECT 'run', version_id, run_id FROM u
       UNION ALL SELECT DISTINCT 'model', run_id, model_id FROM runs WHERE run_id IN (SELECT run_id FROM u)""",
)
def _(v):
    return op.lineage_forward(v.corpus, v.registry, v.version_runs, v.runs, "f-5", "bronze.raw_text_corpus")


@query(
    "version_offsets",
    """SELECT version_id, partition, coalesce(arg_min("offset", (timestamp_ms, "offset")) FILTER (timestamp_ms >= created_ms), -1) AS "offset"
       FROM registry, topic_log GROUP BY 1, 2""",
)
def _(v):
    return op.version_offsets(v.registry, v.topic_log)


@query(
    "lineage_backward",
    """WITH u AS (SELECT run_id, min(version_id) AS version_id FROM version_runs GROUP BY 1),
       m AS (SELECT r.model_id, r.run_id, g.* FROM runs r JOIN u ON r.run_id = u.run_id JOIN registry g ON g.version_id = u.version_id)
       SELECT DISTINCT model_id, run_id, version_id, snapshot_version, file_path FROM m LEFT JOIN corpus c
       ON c.ingested_ms BETWEEN created_ms - 21600000 AND created_ms + 21600000""",
)
def _(v):
    return op.lineage_backward(v.runs.select("model_id", "run_id"), v.version_runs, v.registry, v.corpus, 6)


@query(
    "offsets_at_time",
    """SELECT partition, coalesce(min("offset") FILTER (timestamp_ms >= 1706600000000), -1) AS "offset"
       FROM topic_log GROUP BY partition""",
)
def _(v):
    return op.offsets_at_time(v.topic_log, 1706600000000)


@query(
    "hotspot_wind",
    """SELECT h.id, coalesce(w.speed_ms, 5.0e0) AS speed_ms, coalesce(w.direction_deg, 270.0e0) AS direction_deg
       FROM hotspots h LEFT JOIN (SELECT round(lat, 4) AS y, round(lng, 4) AS x,
            max(speed_ms) AS speed_ms, arg_max(direction_deg, speed_ms) AS direction_deg FROM wind GROUP BY 1, 2) w
       ON round(h.lat, 4) = y AND round(h.lng, 4) = x""",
)
def _(v):
    return op.hotspot_wind(v.hotspots, v.wind).select("id", "speed_ms", "direction_deg")
