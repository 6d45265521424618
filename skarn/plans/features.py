"""Feature views, historical features, materialised snapshots, alert context, request expansion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from skarn.functions.fields import context_string, mask_user_id, ms_of_ts, ts_of_ms
from skarn.functions.text import token_estimate
from skarn.operators import joins as jn
from skarn.operators.ordered import merge_by_key, ordinal, summarise, top_n
from skarn.operators.windows import counter_deltas, upsert_latest

HOUR, DAY = 3600, 86_400
# Fixed value: lag before an hour counts as complete.
LAG_SECONDS = 2 * HOUR


@dataclass
class FeatureView:
    """Feature rows with their keys, time column and lifetime."""

    name: str
    df: DataFrame
    keys: list[str]
    ts: str
    ttl_seconds: int | None
    cols: list[str] = field(default_factory=list)
    created: str | None = None


def _since(df: DataFrame, ts: str, as_of: str, seconds: int) -> Column:
    """Rows of the last ``seconds`` up to and including ``as_of``."""
    now = F.lit(as_of).cast(df.schema[ts].dataType)
    return (F.col(ts) > now - F.expr(f"INTERVAL {seconds} SECONDS")) & (F.col(ts) <= now)


def node_health_features(
    telemetry: DataFrame, alerts: DataFrame, incidents: DataFrame, as_of: str, **options
) -> DataFrame:
    """Per node: use and heat of the last hour, alerts of a day, incidents of a week, hours seen in 30 days."""
    hour = summarise(
        telemetry.filter(_since(telemetry, "ts", as_of, HOUR)),
        ["node_id"],
        [F.avg("utilization_pct").alias("avg_utilization_1h"), F.max("temperature_c").alias("max_temperature_1h")],
        {"p95_memory_1h": ("memory_used_gb", 0.95)},
        **options,
    )
    seen = telemetry.filter(_since(telemetry, "ts", as_of, 30 * DAY))
    hours = seen.groupBy("node_id").agg(
        (F.count_distinct(F.date_trunc("hour", F.col("ts"))) * 100.0 / 720).alias("uptime_pct_30d")
    )
    raised = alerts.filter(_since(alerts, "triggered_at", as_of, DAY)).groupBy("node_id").agg(
        F.count("*").alias("alert_count_24h")
    )
    opened = incidents.withColumn("_at", ts_of_ms(F.col("opened_ms")))
    broken = opened.filter(_since(opened, "_at", as_of, 7 * DAY)).groupBy("node_id").agg(
        F.count("*").alias("incident_count_7d")
    )
    return merge_by_key(["node_id"], hour, hours, raised, broken).fillna(
        0, ["alert_count_24h", "incident_count_7d"]
    )


def model_perf_features(inference: DataFrame, as_of: str, **options) -> DataFrame:
    """Per model over the last hour: latency, error rate, requests per second, replicas."""
    return summarise(
        inference.filter(_since(inference, "ts", as_of, HOUR)),
        ["model_id"],
        [
            F.avg("latency_ms").alias("avg_latency_1h"),
            F.avg(F.when(F.col("status") == "SUCCESS", 0.0).otherwise(1.0)).alias("error_rate_1h"),
            (F.count("*") / float(HOUR)).alias("throughput_1h"),
            F.count_distinct("replica_id").alias("active_replicas"),
        ],
        {"p99_latency_1h": ("latency_ms", 0.99)},
        **options,
    )


def training_run_features(training: DataFrame, telemetry: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: latest loss and perplexity, tokens, completion, utilisation of its node."""
    progress = training.groupBy("run_id").agg(
        F.max(F.struct("step", "train_loss")).alias("_l"),
        F.sum(F.floor("tokens_per_sec")).cast("bigint").alias("tokens_trained"),
    )
    use = telemetry.groupBy("node_id").agg(F.avg("utilization_pct").alias("gpu_utilization_avg"))
    known = runs.select("run_id", "node_id", "max_steps").join(use, "node_id", "left")
    done = F.least(F.lit(100.0), F.col("_l.step") * 100.0 / F.col("max_steps"))
    return progress.join(known, "run_id", "left").select(
        "run_id",
        F.col("_l.train_loss").alias("latest_loss"),
        F.exp("_l.train_loss").alias("latest_perplexity"),
        "tokens_trained",
        done.alias("estimated_completion_pct"),
        "gpu_utilization_avg",
    )


def historical_features(
    entities: DataFrame, ts: str, views: list[FeatureView], full_names: bool = False, **options
) -> DataFrame:
    """Entity rows with the point-in-time features of several views."""
    wide = entities
    for view in views:
        wide = jn.pit_join(
            wide, view.df, view.keys, ts, view.ts, view.ttl_seconds,
            cols=view.cols or None, prefix=view.name if full_names else None, created=view.created, **options,
        )
    return wide


def materialize_features(
    previous: DataFrame, view: FeatureView, last_run: str, as_of: str, lag_seconds: int = LAG_SECONDS
) -> DataFrame:
    """Next snapshot: rows that became complete since the last run over the previous snapshot.

    Only the span between the two runs (shifted by the lag) is read; keys whose newest row is
    older than the TTL at the span's end are dropped.
    """
    kind = view.df.schema[view.ts].dataType
    bound = lambda at: F.lit(at).cast(kind) - F.expr(f"INTERVAL {lag_seconds} SECONDS")
    span = view.df.filter((F.col(view.ts) > bound(last_run)) & (F.col(view.ts) <= bound(as_of)))
    cols = [*view.keys, view.ts, *(view.cols or [c for c in view.df.columns if c not in (*view.keys, view.ts)])]
    fresh = jn.latest_rows(span.select(*cols), view.keys, view.ts)
    merged = upsert_latest(previous.select(*cols), fresh.select(*cols), view.keys, view.ts)
    if view.ttl_seconds is None:
        return merged
    return merged.filter(F.col(view.ts) > bound(as_of) - F.expr(f"INTERVAL {view.ttl_seconds} SECONDS"))


def recent_pod_events(events: DataFrame, n: int = 5) -> DataFrame:
    """Newest events per pod as ``reason: message; ...``."""
    few = top_n(events, ["pod_name"], [F.col("timestamp_ms").desc(), F.col("event_id").desc()], n)
    line = F.concat("reason", F.lit(": "), "message")
    entry = F.struct((-F.col("timestamp_ms")).alias("t"), (-F.col("event_id")).alias("e"), line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["line"])
    return few.groupBy(F.col("pod_name").alias("k8s_pod_name")).agg(F.array_join(lines, "; ").alias("events"))


def alert_context(
    alerts: DataFrame,
    incidents: DataFrame,
    nodes: DataFrame,
    devices: DataFrame,
    features: DataFrame,
    events: DataFrame,
) -> DataFrame:
    """Context block, its token count, entities used and parts that are missing, per alert."""
    wide = jn.alert_context_joins(
        alerts, incidents, nodes, devices,
        features.select("node_id", "avg_utilization_1h", "alert_count_24h"), recent_pod_events(events),
    )
    hosted = F.coalesce("devices", F.array().cast("array<string>"))
    block = context_string(
        F.col("title"), F.col("severity"), F.date_format("triggered_at", "yyyy-MM-dd HH:mm:ss"),
        F.coalesce("hostname", "node_id"), F.coalesce("gpu_count", F.size(hosted)),
        F.col("avg_utilization_1h"), F.col("alert_count_24h"), F.col("events"),
    )
    entities = F.concat(
        F.array(F.concat(F.lit("Alert:"), "alert_id")),
        F.when(F.col("_known"), F.array(F.concat(F.lit("ComputeNode:"), "_node"))).otherwise(F.array().cast("array<string>")),
        F.transform(hosted, lambda d: F.concat(F.lit("GPUDevice:"), d)),
    )
    missing = F.filter(
        F.array(
            F.when(F.col("avg_utilization_1h").isNull() & F.col("alert_count_24h").isNull(), F.lit("gpu_features")),
            F.when(F.col("events").isNull(), F.lit("k8s_events")),
        ),
        lambda m: m.isNotNull(),
    )
    return wide.withColumn("context", block).select(
        "alert_id",
        "context",
        token_estimate(F.col("context")).alias("context_tokens"),
        F.array_join(entities, ",").alias("entities"),
        F.array_join(missing, ",").alias("missing"),
    )


# Fixed value: error code of failures seen only as a counter.
INFERRED_FAILURE = "SCRAPE_INFERRED_FAILURE"
_STEP = 10_000


def inference_expand(scrapes: DataFrame, user: str = "scraper", **options) -> DataFrame:
    """One row per request out of counter increases: successes and failures since the last scrape.

    Tokens are split evenly (integer part).  Rows are counted out in two steps, so that a large
    increase never becomes one large array.
    """
    counters = ["success_total", "failure_total", "prompt_tokens_total", "generation_tokens_total"]
    doubles = scrapes.withColumns({c: F.col(c).cast("double") for c in counters})
    deltas = counter_deltas(
        doubles.select("host", "ts", *counters, "latency_p50_ms"), ["host"], "ts", counters, **options
    )
    ok, failed = (F.col(f"{c}_delta").cast("bigint") for c in ("success_total", "failure_total"))
    each = lambda c: F.floor(F.col(f"{c}_delta") / F.greatest(F.lit(1), ok)).cast("int")
    kinds = F.array(
        F.struct(
            F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error_code"), ok.alias("n"),
            each("prompt_tokens_total").alias("prompt_tokens"),
            each("generation_tokens_total").alias("completion_tokens"),
        ),
        F.struct(
            F.lit("ERROR").alias("status"), F.lit(INFERRED_FAILURE).alias("error_code"), failed.alias("n"),
            F.lit(0).alias("prompt_tokens"), F.lit(0).alias("completion_tokens"),
        ),
    )
    batches = deltas.select(
        "host", ms_of_ts(F.col("ts")).alias("timestamp_ms"),
        F.floor("latency_p50_ms").cast("bigint").alias("latency_ms"), F.inline(kinds),
    ).filter(F.col("n") > 0)
    blocks = batches.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _STEP))))
    upto = F.least(F.col("n") - F.col("_b") * _STEP, F.lit(_STEP).cast("bigint"))
    rows = blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), upto)))
    request = F.concat_ws(":", "host", "timestamp_ms", "status", F.col("_b") * _STEP + F.col("_i"))
    return rows.select(
        request.alias("request_id"), "host", "timestamp_ms", "status", "error_code", "prompt_tokens",
        "completion_tokens", "latency_ms", mask_user_id(F.lit(user)).alias("user_id"),
    )
