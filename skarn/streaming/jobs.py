"""Streaming queries: de-duplication, rollup, corpus, alert enrichment, compacted views, monitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.functions.fields import event_key, sentinel_to_null
from skarn.operators import corpus as cp, joins as jn, quality as ql
from skarn.operators.telemetry import BANDWIDTHS
from skarn.operators.windows import upsert_latest
from skarn.sources.tables import path_exists, run_batches, sink_json
from skarn.streaming.state import alert_join, rocksdb


def watermark(stream: DataFrame, ts: str, delay: str = "30 seconds") -> DataFrame:
    """Bounded lateness; a zone-free time column becomes a timestamp, which watermarks need."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedup(stream: DataFrame, key: str, ts: str, ttl: str = "90 days") -> DataFrame:
    """First row per key within the TTL; repeats do not renew it."""
    return watermark(stream, ts, ttl).dropDuplicatesWithinWatermark([key])


def seen_events(stream: DataFrame, key: str, ts: str, lookback: str = "1 hour") -> DataFrame:
    """Polled events once per id, as far back as the feed repeats them."""
    return dedup(stream, key, ts, lookback)


def hourly_rollup(telemetry: DataFrame, lateness: str = "2 hours", accuracy: int = 10_000) -> DataFrame:
    """Hourly rows per node and device, emitted once the watermark has passed the hour.

    The percentile is the mergeable sketch, so state per window stays small.
    """
    clean = telemetry.withColumns({c: sentinel_to_null(F.col(c)) for c in BANDWIDTHS})
    hours = watermark(clean, "ts", lateness).groupBy(F.window("ts", "1 hour"), "node_id", "device_id")
    return hours.agg(
        F.avg("utilization_pct").alias("avg_utilization_pct"),
        F.max("utilization_pct").alias("max_utilization_pct"),
        F.percentile_approx("utilization_pct", 0.95, accuracy).alias("p95_utilization_pct"),
        F.avg("temperature_c").alias("avg_temperature_c"),
        F.max("temperature_c").alias("max_temperature_c"),
        F.avg("power_draw_w").alias("avg_power_draw_w"),
        F.max("power_draw_w").alias("max_power_draw_w"),
        F.avg("hbm_bandwidth_gbps").alias("avg_hbm_bandwidth_gbps"),
        F.avg("pcie_bandwidth_gbps").alias("avg_pcie_bandwidth_gbps"),
        F.count("*").alias("sample_count"),
    ).withColumn("hour", F.col("window.start")).drop("window")


def append_rows(stream: DataFrame, path: str, checkpoint: str, partitions: list[str] = (), **trigger) -> StreamingQuery:
    """Exactly-once append to a Parquet folder: the file sink's log ignores files of failed runs."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def corpus_job(
    docs: DataFrame, out: str, checkpoint: str, ts: str = "ingested_at", language: Column | None = None, **trigger
) -> StreamingQuery:
    """Documents to clean rows, rejected rows and metadata messages.

    Everything that reads the text is done before the shuffle to the state store, which then
    carries hash, scores and narrow columns.  Rejected documents skip de-duplication: their key is
    their own id.  Every batch owns its sub-folders, so a retry replaces them.
    """
    marked = cp.pii_flag(cp.score(cp.with_hash(cp.lang_gate(docs, language)))).drop("raw_text")
    own = F.concat(F.lit("rejected:"), F.col("document_id"))
    once = dedup(marked.withColumn("_key", F.when(F.col("rejected"), own).otherwise(F.col("dedup_hash"))), "_key", ts)
    judged = [c for c in marked.columns if c not in docs.columns and c not in ("language_detected", "rejected", "reason", "dedup_hash")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        accepted, rejected = cp.route(batch.drop("_key"))
        clean = accepted.drop("rejected", "reason")
        place = lambda name: f"{out}/{name}/batch={batch_id}"
        clean.write.mode("overwrite").parquet(place("clean"))
        rejected.drop(*judged).write.mode("overwrite").parquet(place("rejected"))
        sink_json(cp.corpus_metadata(clean)).write.mode("overwrite").text(place("metadata"))
        batch.unpersist()

    return run_batches(once, write, checkpoint, **trigger)


def alert_job(
    alerts: DataFrame, telemetry: DataFrame, nodes: DataFrame, events: DataFrame, out: str, checkpoint: str,
    lateness: str = "30 seconds", latest: bool = False, **trigger
) -> StreamingQuery:
    """Alerts joined with telemetry (state), nodes and pod events (tables), as keyed JSON messages.

    Every batch reads the tables anew; ``latest`` says that the events are one per pod already.
    """
    with_gpu = alert_join(alerts, telemetry, lateness=lateness)
    wide = jn.k8s_enrich(jn.node_enrich(with_gpu, nodes), events, latest)
    messages = sink_json(wide, event_key(F.col("node_id"), F.col("alert_id")))
    with rocksdb(alerts.sparkSession):
        return append_rows(messages, out, checkpoint, **trigger)


def compact_latest(
    stream: DataFrame, keys: list[str], version: str, path: str, checkpoint: str, buckets: int = 64, **trigger
) -> StreamingQuery:
    """Table with the latest row per key.

    Rows live in hash buckets of the key; a batch rewrites the buckets it touches and no others.
    The merge takes the highest version, so running a batch twice changes nothing, and a query that
    starts over on a table that is there merges into it.  A table of other columns or more buckets
    is another query's, which is an error.
    """
    spark = stream.sparkSession
    fields = stream.schema

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("_bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        if path_exists(spark, path):
            stored = spark.read.parquet(path)
            high = stored.agg(F.max("_bucket")).first()[0]
            if set(stored.columns) != set(rows.columns) or (high is not None and high >= buckets):
                raise ValueError(f"{path} holds another table")
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]  # at most `buckets`
            table = spark.read.schema(rows.schema).parquet(path)
            rows = upsert_latest(table.filter(F.col("_bucket").isin(touched)), rows, ["_bucket", *keys], version)
        else:
            rows = upsert_latest(rows.limit(0), rows, ["_bucket", *keys], version)
        (
            # Small buckets share a task, large ones are cut.
            rows.select(*fields.names, "_bucket").hint("rebalance", "_bucket")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("_bucket").parquet(path)
        )

    return run_batches(stream, write, checkpoint, **trigger)


def quality_monitor(
    stream: DataFrame, suite: list[ql.Expectation], name: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Suite results of every micro-batch, in the batch's own sub-folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        results = ql.validate(batch, suite, name, f"batch-{batch_id}")
        results.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_batches(stream, write, checkpoint, **trigger)
