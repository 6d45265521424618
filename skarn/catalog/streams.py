"""Queries that run a stream over the given tables to its end, and table writes read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.catalog.adapters import VIEWS, _SOURCES
from skarn.catalog.book import query
from skarn.catalog.corpus import ADMITTED, NORM, SCORED, _clean
from skarn.catalog.quality import AS_OF_MS, TELEMETRY_CHECKS, result_sql
from skarn.catalog.sources import telemetry_json
from skarn.catalog.telemetry import HOURLY, rounded
from skarn.functions.fields import ts_of_ms
from skarn.operators import corpus as cp, joins as jn, quality as ql, registry as rg
from skarn.session import scratch_dir, settle
from skarn.sources import schemas, tables as tb
from skarn.streaming import changes, jobs, state


def live(v, name: str) -> DataFrame:
    """An adapter view whose tables arrive as streams."""
    sources = {t: tb.parquet_stream(v.spark, v.path(t)) for t in _SOURCES.findall(VIEWS[name])}
    return v.apply(name, sources)


def finish(v, stream: DataFrame, purpose: str) -> DataFrame:
    """Append a stream to a scratch table until its input is used up, and read the table."""
    base = scratch_dir(v.spark, purpose)
    jobs.append_rows(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return v.spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("src_jsonl_stream", "SELECT event_id, user_id, event_type, value FROM events")
def _(v):
    folder = scratch_dir(v.spark, "jsonl")
    v.events.select("event_id", "user_id", "event_type", "value").repartition(4).write.json(folder)
    schema = "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE"
    return finish(v, tb.jsonl_stream(v.spark, folder, schema, max_files=2), "jsonl")


@query(
    "src_kafka_json",
    """SELECT event_id, concat('node-', user_id % 16) AS node_id, value AS utilization_pct,
              epoch_us(ts) // 1000 AS timestamp_ms FROM events""",
)
def _(v):
    folder = scratch_dir(v.spark, "topic")
    rows = telemetry_json(v).select("event_id", F.from_json("value", "node_id STRING, utilization_pct DOUBLE, timestamp_ms BIGINT").alias("r"))
    rows.select(F.to_json(F.struct("event_id", "r.*")).alias("value")).write.text(folder)
    schema = "event_id BIGINT, node_id STRING, utilization_pct DOUBLE, timestamp_ms BIGINT"
    return finish(v, tb.topic_stream(v.spark, "telemetry", schema, format="text", path=folder), "topic")


@query(
    "stream_ingest_bronze",
    "SELECT node_id, device_id, timestamp_ms, CAST(ts AS DATE) AS date FROM telemetry",
)
def _(v):
    bronze = tb.ingest_bronze(live(v, "telemetry"))
    base = scratch_dir(v.spark, "bronze")
    jobs.append_rows(bronze, f"{base}/out", f"{base}/checkpoint", ["date"]).awaitTermination()
    return v.spark.read.parquet(f"{base}/out").select("node_id", "device_id", "timestamp_ms", "date")


@query(
    "sink_dual",
    """SELECT event_id, event_type, CASE WHEN value > 50 THEN 'bad' ELSE 'ok' END AS side FROM events""",
)
def _(v):
    base = scratch_dir(v.spark, "dual")
    stream = tb.parquet_stream(v.spark, v.path("events")).select("event_id", "event_type", "value")
    tb.sink_dual(stream, F.col("value") > 50, f"{base}/ok", f"{base}/bad", f"{base}/checkpoint").awaitTermination()
    side = lambda name: v.spark.read.parquet(f"{base}/{name}").select("event_id", "event_type", F.lit(name).alias("side"))
    return side("ok").unionByName(side("bad"))


@query("stream_dedup_90d", f"SELECT DISTINCT sha256({NORM}) AS dedup_hash FROM corpus")
def _(v):
    from skarn.operators.corpus import with_hash

    docs = with_hash(live(v, "corpus")).withColumn("ingested_at", ts_of_ms(F.col("ingested_ms")))
    return finish(v, jobs.dedup(docs, "dedup_hash", "ingested_at").select("dedup_hash"), "dedup")


@query("stream_seen_events", "SELECT DISTINCT concat('eq-', user_id) AS id FROM events WHERE event_type = 'signup'")
def _(v):
    # Every poll repeats the events of the hour before: many rows per id.
    polls = live(v, "zones").select(F.col("event_id").alias("id"), ts_of_ms(F.lit(1704067200000)).alias("ts"))
    return finish(v, jobs.seen_events(polls, "id", "ts", "1 hour").select("id"), "seen")


STREAM_HOURLY = f"""
SELECT * EXCLUDE (date) REPLACE (p AS p95_utilization_pct) FROM ({HOURLY.format(where='')}) h
JOIN (SELECT node_id AS a, device_id AS b, date_trunc('hour', ts) AS c, round(quantile_disc(utilization_pct, 0.95), 6) AS p
      FROM telemetry_dense GROUP BY 1, 2, 3) ON a = node_id AND b = device_id AND c = hour
WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) FROM telemetry_dense) - INTERVAL 2 HOUR
"""


@query("stream_hourly_rollup", f"SELECT * EXCLUDE (a, b, c, p) FROM ({STREAM_HOURLY})")
def _(v):
    hours = finish(v, jobs.hourly_rollup(live(v, "telemetry_dense")), "rollup")
    return rounded(hours.withColumn("hour", F.col("hour").cast("timestamp_ntz")))


@query(
    "stream_action_dedup",
    """WITH RECURSIVE a AS (SELECT action_type, resource_id, created_at, min(id) AS id FROM actions GROUP BY 1, 2, 3),
       k AS (SELECT action_type, resource_id, min(created_at) AS created_at FROM a GROUP BY 1, 2
             UNION ALL
             SELECT k.action_type, k.resource_id, (SELECT min(a.created_at) FROM a WHERE a.action_type = k.action_type
                    AND a.resource_id = k.resource_id AND epoch_us(a.created_at) // 1000 >= epoch_us(k.created_at) // 1000 + 86400000)
             FROM k WHERE k.created_at IS NOT NULL)
       SELECT a.id FROM a JOIN k ON a.action_type = k.action_type AND a.resource_id = k.resource_id
              AND a.created_at = k.created_at""",
)
def _(v):
    kept = state.action_dedup(live(v, "actions"), ["action_type", "resource_id"], "created_at", seconds=86_400, lateness="0 seconds")
    with state.rocksdb(v.spark):
        return finish(v, kept, "actions").select("id")


# Alerts that still wait when the input ends are not out yet.
STREAM_JOIN = """
SELECT alert_id, node_id, gpu_utilization_pct, gpu_device_id FROM (
WITH t AS (SELECT node_id, timestamp_ms, max(device_id) AS device_id FROM telemetry
           WHERE (node_id, ts) NOT IN (SELECT (node_id, triggered_at) FROM alerts) GROUP BY 1, 2),
tt AS (SELECT t.*, m.utilization_pct FROM t JOIN telemetry m ON t.node_id = m.node_id AND t.timestamp_ms = m.timestamp_ms
       AND t.device_id = m.device_id),
b AS (SELECT a.alert_id, a.node_id, a.ms, p.timestamp_ms AS bms, p.utilization_pct AS bu, p.device_id AS bd
      FROM (SELECT *, epoch_us(triggered_at) // 1000 AS ms FROM alerts) a ASOF LEFT JOIN tt p
      ON a.node_id = p.node_id AND a.ms >= p.timestamp_ms),
f AS (SELECT b.*, n.timestamp_ms AS nms, n.utilization_pct AS nu, n.device_id AS nd
      FROM b ASOF LEFT JOIN tt n ON b.node_id = n.node_id AND b.ms <= n.timestamp_ms)
SELECT alert_id, node_id, CASE WHEN ms - bms < 3600000 THEN bu WHEN nms - ms < 3600000 THEN nu END AS gpu_utilization_pct,
       CASE WHEN ms - bms < 3600000 THEN bd WHEN nms - ms < 3600000 THEN nd END AS gpu_device_id
FROM f WHERE ms - bms < 3600000 OR nms IS NOT NULL
          OR ms + 3600000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events))
"""


def live_quiet_telemetry(v) -> DataFrame:
    """Telemetry stream without the alerting events themselves."""
    calm = tb.parquet_stream(v.spark, v.path("events")).filter("event_type <> 'error'")
    return v.apply("telemetry", {"events": calm})


@query("stream_alert_join", STREAM_JOIN)
def _(v):
    joined = state.alert_join(live(v, "alerts"), live_quiet_telemetry(v), lateness="0 seconds")
    with state.rocksdb(v.spark):
        rows = finish(v, joined, "alert-join")
    return rows.select("alert_id", "node_id", "gpu_utilization_pct", "gpu_device_id")


@query(
    "stream_alert_enrichment",
    f"""SELECT j.alert_id, j.node_id || ':' || j.alert_id AS key, gpu_utilization_pct, hostname, coalesce(e.phase, 'Unknown') AS pod_phase
        FROM ({STREAM_JOIN}) j JOIN alerts a ON a.alert_id = j.alert_id LEFT JOIN nodes n ON n.node_id = j.node_id
        LEFT JOIN (SELECT * FROM k8s QUALIFY row_number() OVER (PARTITION BY namespace, pod_name
                   ORDER BY timestamp_ms DESC, event_id DESC) = 1) e
        ON a.k8s_namespace = e.namespace AND a.k8s_pod_name = e.pod_name""",
)
def _(v):
    base = scratch_dir(v.spark, "alerts")
    pods = settle(jn.latest_pods(v.k8s), "pods")  # once, and not in every batch
    job = jobs.alert_job(
        live(v, "alerts"), live_quiet_telemetry(v), v.nodes, pods, f"{base}/out", f"{base}/checkpoint", "0 seconds", latest=True
    )
    job.awaitTermination()
    body = "alert_id STRING, gpu_utilization_pct DOUBLE, hostname STRING, pod_phase STRING"
    messages = v.spark.read.schema("key STRING, value STRING").parquet(f"{base}/out")
    return messages.select("key", F.from_json("value", body).alias("r")).select("key", "r.*")


@query(
    "stream_corpus",
    f"""SELECT 'clean' AS side, sha256({NORM}) AS dedup_hash FROM corpus WHERE language = 'en' GROUP BY 2
        UNION ALL SELECT 'rejected', sha256({NORM}) FROM corpus WHERE language <> 'en'
        UNION ALL SELECT 'metadata', sha256({NORM}) FROM corpus WHERE language = 'en' GROUP BY 2""",
)
def _(v):
    base = scratch_dir(v.spark, "corpus")
    docs = live(v, "corpus").withColumn("ingested_at", ts_of_ms(F.col("ingested_ms")))
    jobs.corpus_job(docs, base, f"{base}/checkpoint", language=F.col("language")).awaitTermination()
    side = lambda name: v.spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("side"), "dedup_hash")
    messages = v.spark.read.text(f"{base}/metadata").select(
        F.lit("metadata").alias("side"), F.get_json_object("value", "$.dedup_hash").alias("dedup_hash")
    )
    return side("clean").unionByName(side("rejected")).unionByName(messages)


@query(
    "stream_compact_latest",
    """SELECT id, status, created_at FROM (SELECT resource_id AS id, status, created_at FROM actions)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1""",
)
def _(v):
    base = scratch_dir(v.spark, "compact")
    rows = live(v, "actions").select(F.col("resource_id").alias("id"), "status", "created_at")
    jobs.compact_latest(rows, ["id"], "created_at", f"{base}/out", f"{base}/checkpoint", buckets=4).awaitTermination()
    return v.spark.read.parquet(f"{base}/out").drop("_bucket")


@query(
    "stream_change_view",
    """SELECT id, status, created_at FROM (SELECT resource_id AS id, status, created_at FROM actions)
       QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1""",
)
def _(v):
    base = scratch_dir(v.spark, "changes")
    rows = live(v, "actions").select(F.col("resource_id").alias("id"), "status", "created_at")
    for start in ("a", "b"):  # a query that starts over writes its changes beside the others
        changes.append_changes(rows, ["id"], "created_at", f"{base}/out", f"{base}/{start}").awaitTermination()
    changes.merge_changes(v.spark, f"{base}/out", ["id"], "created_at", fan=2)
    return changes.latest_view(v.spark, f"{base}/out", ["id"], "created_at")


@query(
    "stream_quality_monitor",
    result_sql("bronze.gpu_telemetry", "SELECT * FROM telemetry", TELEMETRY_CHECKS).replace("'2024-01-31 00:00:00' AS run_at", "'batch-0' AS run_at"),
)
def _(v):
    base = scratch_dir(v.spark, "monitor")
    suite = ql.gpu_telemetry_suite(AS_OF_MS)
    jobs.quality_monitor(
        live(v, "telemetry"), suite, "bronze.gpu_telemetry", f"{base}/out", f"{base}/checkpoint"
    ).awaitTermination()
    return v.spark.read.parquet(f"{base}/out").drop("batch")


@query("write_clustered", "SELECT node_id, device_id, ts, CAST(ts AS DATE) AS date FROM telemetry")
def _(v):
    path = scratch_dir(v.spark, "clustered")
    rows = v.telemetry.select("node_id", "device_id", "ts", F.to_date("ts").alias("date"))
    tb.write_clustered(rows, path, ["date"], ["node_id", "ts"])
    return v.spark.read.parquet(path)


@query("compact_table", "SELECT event_id, event_type, value FROM events")
def _(v):
    path = scratch_dir(v.spark, "compact-table")
    v.events.select("event_id", "event_type", "value").repartition(4).write.partitionBy("event_type").parquet(path)
    tb.compact_table(v.spark, path, "event_type in ('click', 'view')", 1)
    return v.spark.read.parquet(path)


@query(
    "evolve_schema",
    """SELECT event_id, value, CASE WHEN event_type = 'click' THEN -1 ELSE user_id END AS user_id FROM events""",
)
def _(v):
    base = scratch_dir(v.spark, "evolve")
    v.events.filter("event_type = 'click'").select("event_id", "value").write.parquet(f"{base}/old")
    v.events.filter("event_type <> 'click'").select("event_id", "value", "user_id").write.parquet(f"{base}/new")
    return tb.evolve_schema(v.spark, [f"{base}/old", f"{base}/new"], {"user_id": -1})


@query("export_csv", "SELECT CAST(event_id AS VARCHAR) AS event_id, props, event_type FROM events")
def _(v):
    path = scratch_dir(v.spark, "csv")
    tb.export_csv(v.events.select("event_id", "props", "event_type"), path)
    return v.spark.read.csv(path, header=True, escape='"')


@query(
    "remove_expired",
    "SELECT event_id, CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7",
)
def _(v):
    path = scratch_dir(v.spark, "expire")
    v.events.select("event_id", F.to_date("ts").alias("date")).write.partitionBy("date").parquet(path)
    tb.remove_expired(v.spark, path, "date", 7, "2024-01-31")
    return v.spark.read.parquet(path)


@query(
    "create_tables",
    """SELECT node_id, device_id, timestamp_ms, count(*) AS n FROM (SELECT node_id, device_id, timestamp_ms FROM telemetry) GROUP BY 1, 2, 3""",
)
def _(v):
    # Rows go into the declared table by its own schema and partitions and come back.
    base = scratch_dir(v.spark, "lake-tables")
    declared = next(t for t in schemas.TABLES if t.name == "bronze.gpu_telemetry")
    rows = tb.ingest_bronze(v.telemetry)
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in declared.schema if f.name not in rows.columns]
    fitted = rows.select("*", *missing).select(*[F.col(f.name).cast(f.dataType) for f in declared.schema])
    tb.write_clustered(fitted, f"{base}/bronze/gpu_telemetry", list(declared.partitions), ["node_id"])
    stored = v.spark.read.schema(declared.schema).parquet(f"{base}/bronze/gpu_telemetry")
    return stored.groupBy("node_id", "device_id", "timestamp_ms").agg(F.count("*").alias("n"))


@query(
    "event_log_append",
    """SELECT source, count(*) || ' events' AS message, max(created_at) AS created_at FROM event_log GROUP BY 1""",
)
def _(v):
    path = scratch_dir(v.spark, "log")
    sums = v.event_log.groupBy("source").agg(F.count("*").alias("n"), F.max("created_at").alias("at"))
    for r in sums.collect():  # a row per kind of event
        rg.log_event(v.spark, path, r["source"], f"{r['n']} events", r["at"])
    return v.spark.read.parquet(path).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "publish_version",
    f"""WITH a AS ({ADMITTED})
        SELECT 'gold.training_dataset_v3' AS table_name, 3 AS snapshot_version, source, CAST(sum(token_count_estimate) AS BIGINT) AS tokens,
               (SELECT count(*)::DOUBLE FROM a) AS documents, 'run-1,run-2' AS runs FROM a GROUP BY source""",
)
def _(v):
    base = scratch_dir(v.spark, "registry")
    version = rg.publish_version(cp.corpus_admit(_clean(v)), base, 3, "me", 8)
    for run in ("run-1", "run-2"):
        rg.mark_used(v.spark, base, version, run)
    got = rg.get_version(v.spark, base, version)
    stored = v.spark.read.parquet(f"{base}/versions").filter(F.col("version_id") == version)
    return stored.select(
        "table_name", "snapshot_version", F.explode("token_count_by_source").alias("source", "tokens"),
        F.col("quality_metrics")["documents"].alias("documents"), F.lit(",".join(got["used_in_run_ids"])).alias("runs"),
    )


@query(
    "lake_training_dataset",
    f"SELECT count(*) AS documents, CAST(sum(token_count_estimate) AS BIGINT) AS tokens FROM ({SCORED}) WHERE NOT pii_detected",
)
def _(v):

    base = scratch_dir(v.spark, "lake")
    rows = cp.score(cp.pii_flag(v.corpus)).filter(~F.col("pii_detected"))
    path = rg.write_version(rows.select("document_id", "source", "token_count_estimate", "quality_tier"), base, 1, ["source", "quality_tier"])
    saved = v.spark.read.parquet(path)
    return saved.agg(F.count("*").alias("documents"), F.sum("token_count_estimate").cast("bigint").alias("tokens"))
