"""Rollups, service levels, counters and dashboards over telemetry, logs and resources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from skarn.functions.fields import hour_of, sentinel_to_null, trunc_ts
from skarn.operators.ordered import merge_by_key, ordinal, summarise

# Service-level lines, health and share bounds.
LATENCY_SLO_MS, ERROR_SLO = 500, 0.01
BANDWIDTHS = ("hbm_bandwidth_gbps", "pcie_bandwidth_gbps")


def telemetry_hourly(telemetry: DataFrame, *, exact: bool = True, cell: int | None = None) -> DataFrame:
    """Per node, device and hour: averages, maxima, 95th percentile, sample count."""
    clean = telemetry.withColumns({c: sentinel_to_null(F.col(c)) for c in BANDWIDTHS})
    hourly = clean.withColumn("hour", trunc_ts(telemetry, "hour", "ts"))
    return summarise(
        hourly,
        ["node_id", "device_id", "hour"],
        [
            F.avg("utilization_pct").alias("avg_utilization_pct"),
            F.max("utilization_pct").alias("max_utilization_pct"),
            F.avg("temperature_c").alias("avg_temperature_c"),
            F.max("temperature_c").alias("max_temperature_c"),
            F.avg("power_draw_w").alias("avg_power_draw_w"),
            F.max("power_draw_w").alias("max_power_draw_w"),
            F.avg("hbm_bandwidth_gbps").alias("avg_hbm_bandwidth_gbps"),
            F.avg("pcie_bandwidth_gbps").alias("avg_pcie_bandwidth_gbps"),
            F.count("*").alias("sample_count"),
        ],
        {"p95_utilization_pct": ("utilization_pct", 0.95)},
        exact=exact,
        cell=cell,
    ).withColumn("date", F.to_date("hour"))


def telemetry_hourly_lagged(
    telemetry: DataFrame, as_of: str, lag_hours: int = 2, **options
) -> DataFrame:
    """The rollup of hours that started at least ``lag_hours`` before ``as_of``."""
    limit = F.lit(as_of).cast(telemetry.schema["ts"].dataType) - F.expr(f"INTERVAL {lag_hours} HOURS")
    closed = trunc_ts(telemetry, "hour", "ts") <= limit
    # The plain bound on ts is what a Parquet reader can skip row groups with.
    bound = F.col("ts") < limit + F.expr("INTERVAL 1 HOUR")
    return telemetry_hourly(telemetry.filter(closed & bound), **options)


def inference_sla(inference: DataFrame, bucket_seconds: int = 3600, **options) -> DataFrame:
    """Per model and time bucket: latency percentiles, error rate, requests per second."""
    bucketed = inference.withColumn("bucket", F.window("ts", f"{bucket_seconds} seconds")["start"])
    return summarise(
        bucketed,
        ["model_id", "bucket"],
        [
            F.avg(F.when(F.col("status") == "SUCCESS", 0.0).otherwise(1.0)).alias("error_rate"),
            (F.count("*") / F.lit(float(bucket_seconds))).alias("rps"),
        ],
        {"p50": ("latency_ms", 0.5), "p95": ("latency_ms", 0.95), "p99": ("latency_ms", 0.99)},
        **options,
    )


def sla_breaches(sla: DataFrame, ms: float = LATENCY_SLO_MS, error: float = ERROR_SLO) -> DataFrame:
    return sla.filter((F.col("p99") > ms) | (F.col("error_rate") > error))


def alert_counts(alerts: DataFrame, prefix: str = "alerts_") -> list[Column]:
    return [
        F.count_if(F.col("severity") == p).alias(f"{prefix}{p.lower()}") for p in ("P1", "P2", "P3", "P4")
    ]


def cluster_overview(
    nodes: DataFrame, runs: DataFrame, alerts: DataFrame, telemetry: DataFrame
) -> DataFrame:
    """One row: nodes, healthy nodes, running runs, open alerts per severity, utilisation."""
    return merge_by_key(
        [],
        nodes.agg(
            F.count("*").alias("nodes_total"),
            F.count_if(F.col("health") == "healthy").alias("nodes_healthy"),
        ),
        runs.agg(F.count_if(F.col("status") == "running").alias("active_runs")),
        alerts.filter(F.col("status") != "resolved").agg(*alert_counts(alerts)),
        telemetry.agg(F.avg("utilization_pct").alias("avg_utilization_pct")),
    )


def cluster_health(overview: DataFrame) -> DataFrame:
    health = (
        F.when(F.col("alerts_p1") > 0, "critical")
        .when(F.col("alerts_p2") > 0, "degraded")
        .otherwise("healthy")
    )
    return overview.select(health.alias("health"))


def operational_snapshot(
    telemetry: DataFrame,
    runs: DataFrame,
    alerts: DataFrame,
    inference: DataFrame,
    training: DataFrame,
    as_of: str,
    hot_c: float = 90.0,
) -> DataFrame:
    """Dashboard row at ``as_of``: devices, averages of the last hour, runs, alerts, traffic."""
    now = F.lit(as_of).cast(telemetry.schema["ts"].dataType)
    hour_ago, today = now - F.expr("INTERVAL 1 HOUR"), F.date_trunc("day", now).cast(telemetry.schema["ts"].dataType)
    past = telemetry.filter(F.col("ts") <= now)
    devices = past.groupBy("node_id", "device_id").agg(
        F.max(F.struct("ts", "temperature_c"))["temperature_c"].alias("t")
    )
    served = inference.filter((F.col("ts") > hour_ago) & (F.col("ts") <= now))
    today_only = (F.col("ts") >= today) & (F.col("ts") <= now)
    open_alerts = alerts.filter((F.col("status") == "open") & (F.col("triggered_at") <= now))
    return merge_by_key(
        [],
        devices.agg(
            F.count("*").alias("total_gpu_count"),
            F.count_if(F.col("t") < hot_c).alias("healthy_gpu_count"),
        ),
        past.filter(F.col("ts") > hour_ago).agg(
            F.avg("utilization_pct").alias("cluster_avg_utilization_pct"),
            F.avg("temperature_c").alias("cluster_avg_temperature_c"),
        ),
        runs.agg(F.count_if(F.col("status") == "running").alias("active_training_runs")),
        served.agg(
            F.count_distinct("model_id", "replica_id").alias("active_inference_replicas"),
            F.avg("latency_ms").alias("avg_inference_latency_ms_1h"),
        ),
        inference.filter(today_only).agg(F.count("*").alias("inference_requests_today")),
        training.filter(today_only).agg(
            F.sum(F.floor("tokens_per_sec")).cast("bigint").alias("tokens_trained_today")
        ),
        open_alerts.agg(
            F.count_if(F.col("severity") == "P1").alias("open_p1_alerts"),
            F.count_if(F.col("severity") == "P2").alias("open_p2_alerts"),
        ),
    ).withColumn("snapshot_ts", now)


def dashboard_counters(
    hotspots: DataFrame, crews: DataFrame, zones: DataFrame, shelters: DataFrame, hospitals: DataFrame
) -> DataFrame:
    return merge_by_key(
        [],
        hotspots.agg(F.count("*").alias("active_hotspots")),
        crews.agg(
            F.count_if(F.col("status") == "deployed").alias("crews_deployed"),
            F.count("*").alias("crews_total"),
        ),
        zones.agg(F.count_if(F.col("damage_probability") > 0.5).alias("damage_zones_above_threshold")),
        shelters.agg(F.count_if(F.col("occupancy") >= F.col("capacity")).alias("shelters_at_capacity")),
        hospitals.agg(F.count_if(F.col("alert_level") != "normal").alias("hospitals_on_alert")),
    )


def table_counts(spark, tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a table that is missing (None) counts 0."""
    counted = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        if df is not None
        else spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("bigint").alias("n"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def damage_summary(cells: DataFrame) -> DataFrame:
    """Per event: cells, cells above 0.05, cells above 0.70."""
    p = F.col("damage_probability")
    return cells.groupBy("event_id").agg(
        F.count("*").alias("cells_computed"),
        F.count_if(p > 0.05).alias("cells_above_floor"),
        F.count_if(p > 0.7).alias("cells_above_70"),
    )


def latency_buckets(inference: DataFrame, bounds_s: list[float]) -> DataFrame:
    """Cumulative request counts per model for upper bounds in seconds, +Inf included."""
    names = [f"b{i}" for i in range(len(bounds_s))]
    counts = inference.groupBy("model_id").agg(
        *[F.count_if(F.col("latency_ms") <= b * 1000).alias(n) for n, b in zip(names, bounds_s)],
        F.count("*").alias("total"),
    )
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(n).alias("cum")) for n, b in zip(names, bounds_s)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("cum")))
    return counts.select("model_id", F.inline(F.array(*pairs)))


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float = 0.5) -> DataFrame:
    """Upper bound (ms) of the first bucket reaching the quantile; last finite bound past it."""
    finite = ~F.isnan("le") & (F.col("le") < float("inf"))
    # One row per bound first: the array below then holds no more than the bounds in use.
    per_bound = buckets.groupBy(*keys, "le").agg(F.max("cum").alias("cum"))
    grouped = per_bound.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("le") == float("inf"), F.col("cum"))), F.max("cum")).alias("_total"),
        F.array_sort(F.collect_set(F.when(finite, F.struct("le", "cum")))).alias("_finite"),
    )
    reached = F.filter("_finite", lambda b: b["cum"] >= F.col("_total") * q)
    bound = F.coalesce(F.get(reached, F.lit(0))["le"], F.array_max("_finite")["le"])
    empty = (F.col("_total") == 0) | (F.size("_finite") == 0)
    return grouped.select(*keys, F.when(empty, 0.0).otherwise(bound * 1000.0).alias("value_ms"))


def tokens_by_source(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("token_count_estimate").cast("bigint").alias("tokens"))


def quality_metrics(docs: DataFrame) -> DataFrame:
    """Metric rows of a dataset version: documents, mean score, share of every tier."""
    share = lambda tier: F.avg(F.when(F.col("quality_tier") == tier, 1.0).otherwise(0.0))
    row = docs.agg(
        F.count("*").cast("double").alias("documents"),
        F.avg("quality_score").alias("mean_score"),
        *[share(t).alias(f"share_{t}") for t in ("high", "medium", "low")],
    )
    return row.unpivot([], row.columns, "metric", "value")


def util_by_timestamp(telemetry: DataFrame) -> DataFrame:
    return telemetry.groupBy("ts").agg(F.avg("utilization_pct").alias("util"))


def best_val_loss(training: DataFrame) -> DataFrame:
    """Per run the row of lowest validation loss, the earliest step on a tie."""
    best = F.min(F.struct("val_loss", "step"))
    return (
        training.filter(F.col("val_loss").isNotNull())
        .groupBy("run_id").agg(best.alias("b"))
        .select("run_id", "b.step", "b.val_loss")
    )


def heatmap_pivot(nodes: DataFrame, gpus: int = 8) -> DataFrame:
    """Grid of last values: row = digits of the node id mod ``gpus``, column = device index."""
    row = F.pmod(F.regexp_replace("node_id", r"\D", "").cast("bigint"), F.lit(gpus))
    cell = lambda i: F.max(F.when(F.col("gpu_index") == i, F.struct("ts", "utilization_pct")))
    return nodes.groupBy(row.alias("row")).agg(
        *[cell(i)["utilization_pct"].alias(f"g{i}") for i in range(gpus)]
    )


def status_counts(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("status").agg(F.count("*").alias("n"))


def staleness(tables: dict[str, tuple[DataFrame, str, int]], as_of: str) -> DataFrame:
    """Age of the newest row per table, ``{name: (df, ts column, limit in seconds)}``."""
    def age(name: str, df: DataFrame, ts: str, limit: int) -> DataFrame:
        newest = df.agg(F.max(ts).alias("newest"))
        now = F.lit(as_of).cast(newest.schema["newest"].dataType)
        seconds = F.timestamp_diff("SECOND", F.col("newest"), now)
        return newest.select(
            F.lit(name).alias("table_name"), seconds.alias("age_s"), (seconds > limit).alias("breach")
        )

    return reduce(DataFrame.unionByName, [age(n, *spec) for n, spec in tables.items()])


def benchmark_regression(evaluations: DataFrame) -> DataFrame:
    """Mean score per model, benchmark and version, with the change from the version before."""
    from pyspark.sql import Window as W

    scores = evaluations.groupBy("model_id", "benchmark_name", "model_version").agg(
        F.avg("score").alias("score")
    )
    before = W.partitionBy("model_id", "benchmark_name").orderBy("model_version")
    return scores.withColumn("delta", F.col("score") - F.lag("score").over(before))


def model_performance_gold(
    evaluations: DataFrame, inference: DataFrame, models: DataFrame | None = None, **options
) -> DataFrame:
    """Mean benchmark scores next to serving latency per model and version, with the day of evaluation.

    ``models`` (``model_id, training_dataset_version, parameter_count``, a row per model) adds what the
    model was made from.
    """
    span = F.greatest(
        F.timestamp_diff("SECOND", F.min("ts"), F.max("ts")).cast("double"), F.lit(1.0)
    )
    serving = summarise(
        inference,
        ["model_id", "model_version"],
        [
            F.avg(F.when(F.col("status") == "SUCCESS", 0.0).otherwise(1.0)).alias("error_rate"),
            (F.count("*") / span).alias("throughput_rps"),
        ],
        {
            "p50_latency_ms": ("latency_ms", 0.5),
            "p95_latency_ms": ("latency_ms", 0.95),
            "p99_latency_ms": ("latency_ms", 0.99),
        },
        **options,
    )
    scores = evaluations.groupBy("model_id", "model_version", "benchmark_name").agg(
        F.avg("score").alias("score"), F.max("evaluated_at").alias("evaluated_at")
    )
    gold = scores.join(serving, ["model_id", "model_version"], "left").withColumn("date", F.to_date("evaluated_at"))
    if models is None:
        return gold
    return gold.join(models.select("model_id", "training_dataset_version", "parameter_count"), "model_id", "left")
