"""Feeds and log payloads to typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from skarn.functions.fields import bytes_to_gb, firms_confidence, kmh_to_ms

# Payload defaults, required fields, card attributes.
TELEMETRY_DEFAULTS = {
    "node_id": "", "device_id": "", "utilization_pct": 0.0, "temperature_c": 0.0,
    "power_draw_w": 0.0, "timestamp_ms": 0,
}
K8S_DEFAULTS = {"namespace": "", "pod_name": "", "phase": "Unknown", "timestamp_ms": 0}
REQUIRED_TELEMETRY = {
    "node_id": "str", "device_id": "str", "timestamp_ms": "int", "utilization_pct": "float",
    "memory_total_gb": "float", "memory_used_gb": "float", "temperature_c": "float",
    "power_draw_w": "float", "hbm_bandwidth_gbps": "float", "pcie_bandwidth_gbps": "float",
}
CARD_FIELDS = {
    "utilization_pct": "GPU use (%)",
    "memory_total_b": "VRAM Total Memory (B)",
    "memory_used_b": "VRAM Total Used Memory (B)",
    "temperature_c": "Temperature (Sensor junction) (C)",
    "power_draw_w": "Average Graphics Package Power (W)",
}
DEFAULT_DEPTH_KM = 10.0
_TYPES = {str: "string", float: "double", int: "bigint"}


def _with_defaults(df: DataFrame, defaults: dict, value: str) -> DataFrame:
    """JSON object to typed columns; absent fields take defaults, other keys stay in ``extras``."""
    raw = F.from_json(value, "map<string,string>")
    named = df.withColumn("_m", raw).filter(F.col("_m").isNotNull())
    typed = {}
    for name, default in defaults.items():
        field = F.col("_m")[name]
        typed[name] = F.coalesce(
            field if isinstance(default, str) else field.try_cast(_TYPES[type(default)]), F.lit(default)
        )
    known = list(defaults)
    typed["extras"] = F.map_filter("_m", lambda k, _: ~k.isin(known))
    keep = [c for c in df.columns if c != value and c not in typed]
    return named.select(*keep, *[c.alias(n) for n, c in typed.items()])


def parse_telemetry(df: DataFrame, value: str = "value") -> DataFrame:
    return _with_defaults(df, TELEMETRY_DEFAULTS, value)


def parse_k8s_event(df: DataFrame, value: str = "value") -> DataFrame:
    return _with_defaults(df, K8S_DEFAULTS, value)


def dead_letter(df: DataFrame, schema: str, as_of_ms: int, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the others as ``error, timestamp_ms, raw_bytes_b64``."""
    fields = T.StructType.fromDDL(f"{schema}, _corrupt STRING")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = df.withColumn("_r", F.from_json(value, fields, options))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    keep = [c for c in df.columns if c != value]
    good = parsed.filter(~bad).select(*keep, "_r.*").drop("_corrupt")
    dlq = parsed.filter(bad).select(
        *keep,
        F.lit("schema mismatch").alias("error"),
        F.lit(as_of_ms).cast("bigint").alias("timestamp_ms"),
        F.base64(F.encode(value, "UTF-8")).alias("raw_bytes_b64"),
    )
    return good, dlq


def _json_kind(v: Column) -> Column:
    """Type name of a JSON value as a Python reader would see it."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", "NoneType")
        .when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(kind.startswith("ARRAY"), "list")
        .otherwise("dict")
    )


def validate_records(
    df: DataFrame, required: dict[str, str] = REQUIRED_TELEMETRY, value: str = "value"
) -> DataFrame:
    """Adds ``valid`` and ``reason``: the first required field that is missing or of another type."""
    doc = df.withColumn("_v", F.try_parse_json(value))
    reasons = []
    for name, kind in required.items():
        field = F.variant_get("_v", f"$.{name}", "variant")
        got = _json_kind(field)
        fits = got.isin("int", "bool") if kind == "int" else got == kind
        reasons.append(
            F.when(field.isNull(), f"{name}: missing field").when(
                ~fits, F.concat(F.lit(f"{name}: expected {kind}, got "), got)
            )
        )
    no_object = F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT")
    reason = F.when(no_object, "not a JSON object").otherwise(F.coalesce(*reasons))
    return doc.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_v")


def read_firms(spark, path: str, **options) -> DataFrame:
    """Hotspot CSV files, all columns as text."""
    return spark.read.csv(path, header=True, inferSchema=False, **options)


def parse_firms(rows: DataFrame, min_conf: float = 50.0) -> DataFrame:
    """Text rows to hotspots above the confidence; rows with malformed numbers are dropped."""
    frp = F.coalesce(F.nullif(F.col("frp"), F.lit("")), F.lit("0")).try_cast("double")
    typed = rows.select(
        *[c for c in rows.columns if c not in ("latitude", "longitude", "frp", "confidence")],
        F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lng"),
        frp.alias("frp"),
        firms_confidence(F.col("confidence")).alias("confidence"),
    )
    whole = F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("frp").isNotNull()
    return typed.filter((F.col("confidence") > min_conf) & whole)


_FEED = (
    "struct<features:array<struct<id:string,properties:struct<mag:double>,"
    "geometry:struct<coordinates:array<double>>>>>"
)


def parse_usgs(df: DataFrame, value: str = "value", complete: bool = True) -> DataFrame:
    """Feed documents to ``id, magnitude, depth, lat, lng``, one row per feature with an id.

    ``complete`` keeps features with a magnitude and two coordinates only.
    """
    feature = df.select(F.explode(F.from_json(value, _FEED)["features"]).alias("f"))
    at = F.col("f.geometry.coordinates")
    rows = feature.filter(F.coalesce("f.id", F.lit("")) != "").select(
        F.col("f.id").alias("id"),
        F.col("f.properties.mag").alias("magnitude"),
        F.when(F.size(at) > 2, F.get(at, F.lit(2))).otherwise(F.lit(DEFAULT_DEPTH_KM)).alias("depth"),
        F.get(at, F.lit(1)).alias("lat"),
        F.get(at, F.lit(0)).alias("lng"),
    )
    if not complete:
        return rows
    return rows.filter(F.col("magnitude").isNotNull() & F.col("lat").isNotNull())


def parse_wind(df: DataFrame, value: str = "value") -> DataFrame:
    """Hourly forecast documents to the first hour that has both speed and direction."""
    hourly = "struct<hourly:struct<windspeed_10m:array<double>,winddirection_10m:array<double>>>"
    doc = df.withColumn("_h", F.from_json(value, hourly)["hourly"])
    pairs = F.zip_with(
        "_h.windspeed_10m", "_h.winddirection_10m",
        lambda s, d: F.struct(s.alias("speed"), d.alias("deg")),
    )
    both = F.filter(pairs, lambda p: p["speed"].isNotNull() & p["deg"].isNotNull())
    found = doc.withColumn("_p", F.get(both, F.lit(0))).filter(F.col("_p").isNotNull())
    keep = [c for c in df.columns if c != value]
    return found.select(
        *keep, kmh_to_ms(F.col("_p.speed")).alias("speed_ms"), F.col("_p.deg").alias("direction_deg")
    )


def parse_rocm(df: DataFrame, value: str = "value") -> DataFrame:
    """Card documents (``card -> attributes``) to telemetry; entries that are no card are skipped."""
    cards = df.select(
        *[c for c in df.columns if c != value],
        F.explode(F.from_json(value, "map<string,string>")).alias("device_id", "_card"),
    ).withColumn("_m", F.from_json("_card", "map<string,string>"))
    number = {n: F.col("_m")[label].try_cast("double") for n, label in CARD_FIELDS.items()}
    whole = {n: F.col("_m")[CARD_FIELDS[n]].try_cast("bigint") for n in ("memory_total_b", "memory_used_b")}
    present = reduce(lambda a, b: a & b, [c.isNotNull() for c in {**number, **whole}.values()])
    return cards.filter(F.col("_card").startswith("{") & present).select(
        *[c for c in df.columns if c != value],
        "device_id",
        number["utilization_pct"].alias("utilization_pct"),
        bytes_to_gb(whole["memory_total_b"]).alias("memory_total_gb"),
        bytes_to_gb(whole["memory_used_b"]).alias("memory_used_gb"),
        number["temperature_c"].alias("temperature_c"),
        number["power_draw_w"].alias("power_draw_w"),
        F.lit(-1.0).alias("hbm_bandwidth_gbps"),
        F.lit(-1.0).alias("pcie_bandwidth_gbps"),
    )


def parse_exposition(df: DataFrame, value: str = "value") -> DataFrame:
    """Metric text lines to ``metric, labels, value``; comments and ``_created`` samples are left out."""
    line = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+([^\s]+)"
    keep = [c for c in df.columns if c != value]
    rows = df.filter(~F.col(value).startswith("#")).select(
        *keep,
        F.regexp_extract(value, line, 1).alias("metric"),
        F.regexp_extract(value, line, 2).alias("labels"),
        F.regexp_extract(value, line, 3).try_cast("double").alias("value"),
    )
    return rows.filter((F.col("metric") != "") & ~F.col("metric").endswith("_created") & F.col("value").isNotNull())


def counter_totals(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of all samples of a counter per scrape."""
    return samples.groupBy(*keys, "metric").agg(F.sum("value").alias("total"))
