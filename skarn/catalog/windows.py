"""Queries of ordered rules, top lists and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.catalog.book import query
from skarn.catalog.joins import FACILITY, ROUTE
from skarn.catalog.telemetry import rounded
from skarn.operators import joins as jn, telemetry as tel, windows as op

FROM, TO = "2024-01-05 00:00:00", "2024-01-19 23:59:59"


@query(
    "latest_per_key",
    f"""SELECT node_id, device_id, ts, utilization_pct, temperature_c FROM telemetry
        WHERE ts BETWEEN TIMESTAMP '{FROM}' AND TIMESTAMP '{TO}'
        QUALIFY row_number() OVER (PARTITION BY node_id, device_id ORDER BY ts DESC, utilization_pct DESC) = 1""",
)
def _(v):
    return op.latest_per_key(
        v.telemetry, ["node_id", "device_id"], ["utilization_pct", "temperature_c", "absent"], "ts", FROM, TO
    )


@query(
    "counter_deltas",
    """WITH s AS (SELECT host, ts, max(success_total) AS s, max(failure_total) AS f FROM scrapes GROUP BY 1, 2)
       SELECT host, ts, CAST(greatest(0, s - coalesce(lag(s) OVER w, 0)) AS BIGINT) AS success_total_delta,
              CAST(greatest(0, f - coalesce(lag(f) OVER w, 0)) AS BIGINT) AS failure_total_delta
       FROM s WINDOW w AS (PARTITION BY host ORDER BY ts)""",
)
def _(v):
    scrapes = v.scrapes.select("host", "ts", F.col("success_total").cast("double"), F.col("failure_total").cast("double"))
    deltas = op.counter_deltas(scrapes, ["host"], "ts", ["success_total", "failure_total"])
    whole = {c: F.col(c).cast("bigint") for c in ("success_total_delta", "failure_total_delta")}
    return deltas.withColumns(whole).select("host", "ts", *whole)


LAST = "(SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM training) AS t"


@query(
    "rolling_loss",
    f"SELECT run_id, CASE WHEN count(*) >= 5 THEN round(avg(train_loss), 6) END AS avg_loss FROM {LAST} WHERE r <= 100 GROUP BY 1",
)
def _(v):
    return rounded(op.rolling_loss(v.training))


@query(
    "loss_trend",
    f"""WITH s AS (SELECT run_id, CASE WHEN count(*) >= 10 THEN regr_slope(train_loss, -r) END AS slope
                  FROM {LAST} WHERE r <= 50 GROUP BY 1)
        SELECT run_id, round(slope, 6) AS slope, CASE WHEN slope < -0.001 THEN 'improving'
               WHEN slope > 0.001 THEN 'diverging' WHEN slope IS NOT NULL THEN 'stalling' END AS trend FROM s""",
)
def _(v):
    return rounded(op.loss_trend(v.training))


@query(
    "step_rate",
    f"""WITH e AS (SELECT run_id, count(*) AS n, min(step) AS a, max(step) AS b, arg_min(timestamp_ms, step) AS ta,
                   arg_max(timestamp_ms, step) AS tb, avg(tokens_per_sec) AS tok FROM {LAST} WHERE r <= 10 GROUP BY 1),
        q AS (SELECT *, CASE WHEN n >= 10 AND tb > ta AND tok > 0 THEN (b - a) / ((tb - ta) / 1000e0) END AS rate FROM e)
        SELECT q.run_id, round(rate, 6) AS steps_per_s, round(tok, 6) AS tokens_per_s, b AS step,
               CASE WHEN rate > 0 AND max_steps > b THEN round((max_steps - b) / rate, 4) END AS eta_s
        FROM q LEFT JOIN runs ON q.run_id = runs.run_id""",
)
def _(v):
    rates = op.step_rate(v.training, v.runs)
    return rounded(rates.withColumn("eta_s", F.round("eta_s", 4)))


@query(
    "row_count_bound",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM telemetry GROUP BY 1),
       b AS (SELECT *, avg(n) OVER w - 2 * stddev_samp(n) OVER w AS low, avg(n) OVER w + 2 * stddev_samp(n) OVER w AS high
             FROM d WINDOW w AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
       SELECT date, n, round(low, 6) AS low, round(high, 6) AS high, coalesce(n BETWEEN low AND high, true) AS ok FROM b""",
)
def _(v):
    return rounded(op.row_count_bound(v.telemetry, "ts", k=2.0))


@query(
    "action_dedup",
    # One step per kept action and key: the next one kept is the first a day or more later.
    """WITH RECURSIVE a AS (SELECT action_type, resource_id, created_at, min(id) AS id FROM actions GROUP BY 1, 2, 3),
       k AS (SELECT action_type, resource_id, min(created_at) AS created_at FROM a GROUP BY 1, 2
             UNION ALL
             SELECT k.action_type, k.resource_id, (SELECT min(a.created_at) FROM a WHERE a.action_type = k.action_type
                    AND a.resource_id = k.resource_id AND a.created_at >= k.created_at + INTERVAL 1 DAY)
             FROM k WHERE k.created_at IS NOT NULL)
       SELECT a.id FROM a JOIN k ON a.action_type = k.action_type AND a.resource_id = k.resource_id
              AND a.created_at = k.created_at""",
)
def _(v):
    return op.action_dedup(v.actions, ["action_type", "resource_id"], "created_at", seconds=86_400).select("id")


@query(
    "delivery_health",
    """WITH c AS (SELECT resource_id, created_at, count(*) AS n FROM actions GROUP BY 1, 2)
       SELECT resource_id, created_at, CAST(s AS BIGINT) AS failures FROM (
           SELECT *, sum(n) OVER (PARTITION BY resource_id ORDER BY created_at
                  RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS s FROM c) WHERE s > 3""",
)
def _(v):
    return op.delivery_health(v.actions, "resource_id", "created_at", seconds=86_400)


@query(
    "cell_ring_rank",
    """WITH e AS (SELECT event_id, avg(lat) AS y, min(lng) AS x FROM zones GROUP BY 1)
       SELECT z.id, z.event_id, row_number() OVER (PARTITION BY z.event_id
              ORDER BY round(sqrt((lat - y) ** 2 + (lng - x) ** 2), 9), z.id) AS ring_rank
       FROM zones z JOIN e ON z.event_id = e.event_id""",
)
def _(v):
    centres = v.zones.groupBy(F.col("event_id").alias("id")).agg(F.avg("lat").alias("lat"), F.min("lng").alias("lng"))
    return op.cell_ring_rank(v.zones, centres).select("id", "event_id", "ring_rank")


@query(
    "cells_latest_2000",
    """SELECT id, source, created_at FROM event_log
       QUALIFY row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id DESC) <= 2000""",
)
def _(v):
    return op.latest_n(v.event_log, ["source"], "created_at", "id", 2000).select("id", "source", "created_at")


@query("top_hotspots", "SELECT * FROM hotspots ORDER BY detected_at DESC, id DESC LIMIT 100")
def _(v):
    return op.newest(v.hotspots, "detected_at", "id", 100)


@query("top_seismic", "SELECT * FROM quakes ORDER BY detected_at DESC, id DESC LIMIT 50")
def _(v):
    return op.newest(v.quakes, "detected_at", "id", 50)


@query("top_damage", "SELECT * FROM zones ORDER BY damage_probability DESC, id LIMIT 500")
def _(v):
    return op.top_damage(v.zones)


@query("pending_actions", "SELECT id, action_type, confidence, created_at FROM actions WHERE status = 'pending'")
def _(v):
    return op.pending_actions(v.actions).select("id", "action_type", "confidence", "created_at")


@query(
    "action_priority",
    """SELECT id, CASE time_sensitivity WHEN 'immediate' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority,
              confidence FROM actions""",
)
def _(v):
    return op.action_priority(v.actions).select("id", "priority", "confidence")


@query("event_feed", "SELECT * FROM event_log ORDER BY created_at DESC, id DESC LIMIT 100")
def _(v):
    return op.newest(v.event_log, "created_at", "id", 100)


@query("sparkline_20", "SELECT ts, round(avg(utilization_pct), 6) AS util FROM telemetry GROUP BY ts ORDER BY ts DESC LIMIT 20")
def _(v):
    return rounded(op.sparkline(v.telemetry))


@query("table_page", "SELECT id, name, occupancy FROM shelters ORDER BY occupancy DESC, id LIMIT 25 OFFSET 50")
def _(v):
    return op.table_page(v.shelters, "occupancy", "id", desc=True, page=2).select("id", "name", "occupancy")


@query(
    "recent_fire_coords",
    "SELECT lat, lng FROM (SELECT lat, lng, max(seq) AS s FROM ember GROUP BY 1, 2 ORDER BY s DESC LIMIT 5)",
)
def _(v):
    return op.recent_fire_coords(v.ember)


@query(
    "top5_events",
    """SELECT namespace, pod_name, reason, message, timestamp_ms FROM k8s
       QUALIFY row_number() OVER (PARTITION BY namespace, pod_name ORDER BY timestamp_ms DESC, event_id DESC) <= 5""",
)
def _(v):
    return op.top_events(v.k8s).select("namespace", "pod_name", "reason", "message", "timestamp_ms")


@query(
    "sync_status",
    """SELECT pipeline, max(finished_at) FILTER (status = 'ok') AS last_success,
              arg_max(status, (finished_at, event_id)) AS status FROM sync_log GROUP BY pipeline""",
)
def _(v):
    return op.sync_status(v.sync_log)


@query(
    "merge_live_history",
    """SELECT run_id, step, train_loss / 2 AS train_loss FROM training WHERE tokens_per_sec > 300
       UNION ALL SELECT run_id, step, train_loss FROM training WHERE tokens_per_sec <= 300""",
)
def _(v):
    history = v.training.select("run_id", "step", "train_loss")
    live = v.training.filter("tokens_per_sec > 300").select("run_id", "step", (F.col("train_loss") / 2).alias("train_loss"))
    return op.merge_live_history(history, live, ["run_id", "step"])


@query(
    "unseen_events",
    "SELECT DISTINCT concat('e-', user_id) AS id FROM events WHERE concat('e-', user_id) NOT IN (SELECT concat('e-', o_custkey) FROM orders WHERE o_orderstatus = 'F')",
)
def _(v):
    new = v.events.select(F.concat(F.lit("e-"), "user_id").alias("id"), "ts")
    seen = v.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("e-"), "o_custkey").alias("id"))
    return op.unseen_events(new, seen).select("id")


@query(
    "action_union",
    f"""SELECT resource_id, zone_id, arg_min(action_type, k) AS action_type, arg_min(confidence, k) AS confidence,
               arg_min(time_sensitivity, k) AS time_sensitivity
        FROM (SELECT *, (CASE time_sensitivity WHEN 'immediate' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, -confidence, action_type) AS k
              FROM (SELECT * FROM ({FACILITY}) UNION ALL SELECT * FROM ({ROUTE})
                    UNION ALL SELECT action_type, resource_id, zone_id, confidence, time_sensitivity FROM actions))
        GROUP BY 1, 2""",
)
def _(v):
    return op.action_union(
        jn.zone_facility_alerts(v.zones, [v.shelters, v.hospitals]),
        jn.zone_route_alerts(v.zones, v.routes),
        v.actions.select("action_type", "resource_id", "zone_id", "confidence", "time_sensitivity"),
    )


@query(
    "lineage_edges",
    """SELECT concat('table-', s_nationkey) AS src, concat('feed-', s_suppkey) AS dst FROM supplier
       UNION ALL SELECT concat('raw-', s_suppkey % 9), concat('feed-', s_suppkey) FROM supplier
       UNION ALL SELECT concat('feed-', s_suppkey), concat('mart-', s_suppkey % 4) FROM supplier""",
)
def _(v):
    tagged = lambda tag, c: F.concat(F.lit(tag), c.cast("string"))
    feeds = v.supplier.select(
        tagged("feed-", F.col("s_suppkey")).alias("name"),
        F.array(tagged("table-", F.col("s_nationkey")), tagged("raw-", F.col("s_suppkey") % 9)).alias("sources"),
        F.array(tagged("mart-", F.col("s_suppkey") % 4)).alias("targets"),
    )
    return op.lineage_edges(feeds)


@query(
    "action_lifecycle",
    """SELECT resource_id AS id, arg_max(status, (created_at, id)) AS status,
              max(created_at) FILTER (status = 'approved') AS approved_at, min(created_at) AS created_at
       FROM actions GROUP BY resource_id""",
)
def _(v):
    changes = v.actions.select(
        F.col("resource_id").alias("id"), F.col("created_at").alias("at"), F.col("id").alias("seq"), "status"
    )
    return op.action_lifecycle(changes)


CREW_UPDATES = "SELECT user_id AS id, max(ts) AS at, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1"


@query(
    "crew_status_update",
    f"""SELECT c.id, coalesce(u.status, c.status) AS status FROM crews c LEFT JOIN ({CREW_UPDATES}) u ON c.id = u.id""",
)
def _(v):
    updates = v.events.groupBy(F.col("user_id").alias("id")).agg(
        F.max(F.struct("ts", "event_id", "event_type")).alias("u")
    ).select("id", F.col("u.ts").alias("at"), F.col("u.event_type").alias("status"))
    roster = v.crews.select("id", F.lit("1970-01-01").cast("timestamp_ntz").alias("at"), "status")
    known = updates.join(roster.select("id"), "id", "left_semi")
    return op.upsert_latest(roster, known, ["id"], "at").select("id", "status")


@query(
    "upsert_latest",
    """SELECT id, status, created_at FROM (SELECT resource_id AS id, status, created_at FROM actions)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1""",
)
def _(v):
    rows = v.actions.select(F.col("resource_id").alias("id"), "status", "created_at")
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    old, new = rows.filter(F.col("created_at") < middle), rows.filter(F.col("created_at") >= middle)
    return op.upsert_latest(old, new, ["id"], "created_at")
