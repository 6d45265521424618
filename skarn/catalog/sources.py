"""Queries of parsers, bronze rows, filters, field functions and row formats.

Payload text is built from the given tables; the SQL states the rows that must come out of it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.catalog.book import query
from skarn.catalog.telemetry import rounded
from skarn.functions import fields as fd, geo
from skarn.operators import joins as jn
from skarn.operators.telemetry import BANDWIDTHS
from skarn.sources import parsers as ps, tables as tb


def telemetry_json(v):
    """One JSON object per event; temperature is absent in some, a host key is extra in others."""
    t = v.events.select(
        "event_id",
        F.concat(F.lit("node-"), F.col("user_id") % 16).alias("node_id"),
        F.concat(F.lit("gpu-"), F.col("event_id") % 8).alias("device_id"),
        F.col("value").alias("utilization_pct"),
        F.when(F.col("event_id") % 5 != 0, F.col("value") / 2).alias("temperature_c"),
        F.when(F.col("event_id") % 7 == 0, "abc").otherwise(F.col("value").cast("string")).alias("power_draw_w"),
        fd.ms_of_ts(F.col("ts")).alias("timestamp_ms"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("rack"),
    )
    return t.select("event_id", F.to_json(F.struct(*t.columns[1:])).alias("value"))


@query(
    "parse_telemetry",
    """SELECT event_id, concat('node-', user_id % 16) AS node_id, concat('gpu-', event_id % 8) AS device_id,
              value AS utilization_pct, CASE WHEN event_id % 5 <> 0 THEN value / 2 ELSE 0 END AS temperature_c,
              CASE WHEN event_id % 7 = 0 THEN 0 ELSE value END AS power_draw_w, epoch_us(ts) // 1000 AS timestamp_ms,
              CASE WHEN event_id % 3 = 0 THEN event_type END AS rack FROM events""",
)
def _(v):
    return ps.parse_telemetry(telemetry_json(v)).withColumn("rack", F.col("extras")["rack"]).drop("extras")


@query(
    "parse_k8s_event",
    """SELECT event_id, concat('ns-', user_id % 3) AS namespace, '' AS pod_name,
              CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE event_type END AS phase,
              epoch_us(ts) // 1000 AS timestamp_ms FROM events""",
)
def _(v):
    doc = F.struct(
        F.concat(F.lit("ns-"), F.col("user_id") % 3).alias("namespace"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("phase"),
        fd.ms_of_ts(F.col("ts")).alias("timestamp_ms"),
    )
    return ps.parse_k8s_event(v.events.select("event_id", F.to_json(doc).alias("value"))).drop("extras")


@query(
    "ingest_bronze",
    """SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, CAST(NULL AS BIGINT) AS kafka_offset,
              CAST(NULL AS INTEGER) AS kafka_partition, CAST(ts AS DATE) AS date,
              TIMESTAMP '2024-02-01 00:00:00' AS ingestion_ts FROM events""",
)
def _(v):
    rows = v.events.select("event_id", fd.ms_of_ts(F.col("ts")).alias("timestamp_ms"))
    return tb.ingest_bronze(rows, F.lit("2024-02-01").cast("timestamp_ntz"))


def broken_json(v):
    """Objects with an integer id; some text is cut off, some ids are words."""
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind")))
    cut = F.substring(whole, 1, 12)
    word = F.concat(F.lit('{"id":"x'), F.col("event_id"), F.lit('","kind":"w"}'))
    value = F.when(F.col("event_id") % 10 == 3, cut).when(F.col("event_id") % 10 == 7, word).otherwise(whole)
    return v.events.select("event_id", value.alias("value"))


@query(
    "dead_letter",
    """SELECT event_id, 'schema mismatch' AS error, 1706745600000 AS timestamp_ms, base64(encode(
           CASE WHEN event_id % 10 = 3 THEN substr('{"id":' || event_id || ',"kind":"' || event_type || '"}', 1, 12)
                ELSE '{"id":"x' || event_id || '","kind":"w"}' END)) AS raw_bytes_b64
       FROM events WHERE event_id % 10 IN (3, 7)""",
)
def _(v):
    return ps.dead_letter(broken_json(v), "id BIGINT, kind STRING", 1706745600000)[1]


@query("dead_letter_good", "SELECT event_id, event_id AS id, event_type AS kind FROM events WHERE event_id % 10 NOT IN (3, 7)")
def _(v):
    return ps.dead_letter(broken_json(v), "id BIGINT, kind STRING", 1706745600000)[0]


@query(
    "validate_records",
    """SELECT event_id, reason IS NULL AS valid, reason FROM (SELECT event_id, CASE
           WHEN event_id % 6 = 0 THEN 'node_id: missing field'
           WHEN event_id % 6 = 1 THEN 'timestamp_ms: expected int, got str'
           WHEN event_id % 6 = 2 THEN 'utilization_pct: expected float, got int'
           WHEN event_id % 6 = 3 THEN 'utilization_pct: expected float, got NoneType' END AS reason FROM events)""",
)
def _(v):
    kind = F.col("event_id") % 6
    text = F.concat(
        F.lit("{"),
        F.when(kind == 0, "").otherwise('"node_id":"n",'),
        F.when(kind == 1, F.concat(F.lit('"timestamp_ms":"'), "event_id", F.lit('",'))).otherwise(
            F.concat(F.lit('"timestamp_ms":'), "event_id", F.lit(","))
        ),
        F.lit('"utilization_pct":'),
        F.when(kind == 2, "5").when(kind == 3, "null").otherwise(F.concat("user_id", F.lit(".25"))),
        F.lit("}"),
    )
    required = {"node_id": "str", "timestamp_ms": "int", "utilization_pct": "float"}
    checked = ps.validate_records(v.events.select("event_id", text.alias("value")), required)
    return checked.select("event_id", "valid", "reason")


CONFIDENCE = """CASE event_id % 5 WHEN 0 THEN 25e0 WHEN 1 THEN 50e0 WHEN 2 THEN 100e0 WHEN 3 THEN 72e0 ELSE 0e0 END"""


@query(
    "parse_firms_csv",
    f"""SELECT id, lat, lng, frp, confidence, acq_date FROM (SELECT concat('h-', event_id) AS id, 34 + (user_id % 50) / 1e2 AS lat,
              -118 - (event_id % 50) / 1e2 AS lng, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END AS frp,
              {CONFIDENCE} AS confidence, strftime(ts, '%Y-%m-%d') AS acq_date, event_id FROM events WHERE event_type = 'click')
        WHERE confidence > 50 AND event_id % 11 <> 0""",
)
def _(v):
    number = F.regexp_extract("id", r"\d+", 0).cast("bigint")
    rows = v.hotspots.select(
        "id",
        F.when(number % 11 == 0, "n/a").otherwise(F.col("lat").cast("string")).alias("latitude"),
        F.col("lng").cast("string").alias("longitude"),
        F.when(number % 4 == 0, "").otherwise(F.col("frp").cast("string")).alias("frp"),
        "confidence",
        F.date_format("detected_at", "yyyy-MM-dd").alias("acq_date"),
    )
    return ps.parse_firms(rows)


@query(
    "firms_confidence",
    f"SELECT concat('h-', event_id) AS id, {CONFIDENCE} AS confidence FROM events WHERE event_type = 'click'",
)
def _(v):
    return v.hotspots.select("id", fd.firms_confidence(F.col("confidence")).alias("confidence"))


def quake_feed(v):
    """A feed document per quake: the quake, one without id, one without magnitude."""
    feature = lambda key, mag, at: F.struct(
        key.alias("id"), F.struct(mag.alias("mag")).alias("properties"),
        F.struct(at.alias("coordinates")).alias("geometry"),
    )
    flat, deep = F.array("lng", "lat"), F.array("lng", "lat", "depth")
    at = F.when(F.col("depth") >= 20, flat).otherwise(deep)
    nothing = F.lit(None).cast("string")
    docs = F.array(
        feature(F.col("id"), F.col("magnitude"), at),
        feature(nothing, F.col("magnitude"), at),
        feature(F.concat("id", F.lit("-silent")), F.lit(None).cast("double"), at),
    )
    return v.quakes.select(F.to_json(F.struct(docs.alias("features"))).alias("value"))


@query(
    "parse_usgs",
    "SELECT id, magnitude, CASE WHEN depth >= 20 THEN 10 ELSE depth END AS depth, lat, lng FROM quakes",
)
def _(v):
    return ps.parse_usgs(quake_feed(v))


@query(
    "parse_wind",
    """SELECT s_suppkey, round(CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal ELSE s_acctbal + 1 END / 3.6e0, 6) AS speed_ms,
              CAST(s_nationkey AS DOUBLE) AS direction_deg FROM supplier WHERE s_suppkey % 7 <> 0""",
)
def _(v):
    none = F.lit(None).cast("double")
    odd, dry = F.col("s_suppkey") % 2, F.col("s_suppkey") % 7 == 0
    hourly = F.struct(
        F.array(none, F.when(~dry & (odd == 0), F.col("s_acctbal")), F.col("s_acctbal") + 1).alias("windspeed_10m"),
        F.array(F.lit(9.0), F.col("s_nationkey").cast("double"), F.when(~dry, F.col("s_nationkey").cast("double"))).alias(
            "winddirection_10m"
        ),
    )
    doc = F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"})
    return rounded(ps.parse_wind(v.supplier.select("s_suppkey", doc.alias("value"))))


@query(
    "parse_rocm",
    """SELECT event_id, 'card0' AS device_id, value AS utilization_pct, 64.0e0 AS memory_total_gb,
              round((user_id * 1000000) / 1e9, 6) AS memory_used_gb, value / 4 AS temperature_c, value * 2 AS power_draw_w,
              -1e0 AS hbm_bandwidth_gbps, -1e0 AS pcie_bandwidth_gbps FROM events""",
)
def _(v):
    text = lambda c: c.cast("string")
    card = F.struct(
        text(F.col("value")).alias("GPU use (%)"),
        F.lit("64000000000").alias("VRAM Total Memory (B)"),
        text(F.col("user_id") * 1_000_000).alias("VRAM Total Used Memory (B)"),
        text(F.col("value") / 4).alias("Temperature (Sensor junction) (C)"),
        text(F.col("value") * 2).alias("Average Graphics Package Power (W)"),
    )
    half = F.struct(text(F.col("value")).alias("GPU use (%)"))
    doc = F.to_json(F.struct(card.alias("card0"), half.alias("card1"), F.lit("driver 6.1").alias("system")))
    return rounded(ps.parse_rocm(v.events.select("event_id", doc.alias("value"))))


@query(
    "parse_exposition",
    """SELECT o_orderkey, 'requests_total' AS metric, floor(o_totalprice) + o_custkey AS total FROM orders
       UNION ALL SELECT o_orderkey, 'tokens_total', floor(o_totalprice) * 2 FROM orders""",
)
def _(v):
    price = F.floor("o_totalprice")
    lines = F.array(
        F.lit("# HELP requests_total Requests"),
        F.concat(F.lit('requests_total{code="200"} '), price),
        F.concat(F.lit('requests_total{code="500"} '), F.col("o_custkey"), F.lit(" 1395066363000")),
        F.lit("requests_created 1.7e9"),
        F.concat(F.lit("tokens_total "), price * 2, F.lit(".0")),
    )
    samples = ps.parse_exposition(v.orders.select("o_orderkey", F.explode(lines).alias("value")))
    return ps.counter_totals(samples, ["o_orderkey"])


@query("expire_partitions", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 7")
def _(v):
    dated = v.events.withColumn("date", F.to_date("ts"))
    return tb.expire_partitions(dated, "date", 7, "2024-01-31").select("event_id")


@query(
    "sink_json",
    """SELECT '{"id":' || id || ',"crew_identifier":"' || crew_identifier || '","status":"' || status || '"}' AS value
       FROM crews""",
)
def _(v):
    return tb.sink_json(v.crews.select("id", "crew_identifier", "status"))


@query(
    "to_geojson",
    """SELECT '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || n_regionkey || ',' || n_nationkey
              || ']},"properties":{"n_name":"' || n_name || '"}}' AS feature FROM nation""",
)
def _(v):
    return tb.to_geojson(v.nation, "n_nationkey", "n_regionkey", ["n_name"])


@query(
    "event_envelope",
    """SELECT 'crew_update' AS type, '{"id":' || id || ',"status":"' || status || '"}' AS data,
              TIMESTAMP '2024-02-01 00:00:00' AS timestamp FROM crews""",
)
def _(v):
    return tb.event_envelope(v.crews.select("id", "status"), "crew_update", F.lit("2024-02-01").cast("timestamp_ntz"))


@query(
    "time_range_filter",
    """SELECT node_id, device_id, ts FROM telemetry WHERE node_id = 'node-3'
       AND ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-17 06:00:00'""",
)
def _(v):
    rows = tb.preset_range(v.telemetry, "ts", "7d", "2024-01-17 06:00:00", entity=("node_id", "node-3"))
    return rows.select("node_id", "device_id", "ts")


@query("mask_user_id", "SELECT request_id, sha256(user_id) AS user_id FROM inference")
def _(v):
    return v.inference.select("request_id", fd.mask_user_id(F.col("user_id")).alias("user_id"))


@query("high_damage", "SELECT * FROM zones WHERE damage_probability > 0.7")
def _(v):
    return jn.high_damage(v.zones)


@query(
    "sentinel_to_null",
    """SELECT node_id, ts, CASE WHEN hbm_bandwidth_gbps <> -1 THEN hbm_bandwidth_gbps END AS hbm_bandwidth_gbps,
              CASE WHEN pcie_bandwidth_gbps <> -1 THEN pcie_bandwidth_gbps END AS pcie_bandwidth_gbps FROM telemetry""",
)
def _(v):
    clean = {c: fd.sentinel_to_null(F.col(c)) for c in BANDWIDTHS}
    return v.telemetry.withColumns(clean).select("node_id", "ts", *BANDWIDTHS)


@query(
    "map_layers",
    """SELECT id, CASE WHEN status IN ('deployed', 'unavailable') THEN status ELSE 'other' END AS layer FROM crews""",
)
def _(v):
    layer = F.when(F.col("status").isin("deployed", "unavailable"), F.col("status")).otherwise("other")
    return v.crews.select("id", layer.alias("layer"))


@query(
    "gmpe_pga",
    """SELECT id, round(exp(-1.715 + 0.5 * magnitude - 1.344 * ln(greatest(sqrt(depth ** 2 + 400), 0.1))), 9) AS pga
       FROM quakes""",
)
def _(v):
    pga = geo.gmpe_pga(F.col("magnitude"), F.col("depth"), F.lit(20.0))
    return v.quakes.select("id", F.round(pga, 9).alias("pga"))


@query(
    "damage_probability",
    """SELECT id, round(greatest(0, least(1, 1 / (1 + exp(-(damage_probability - 0.3) / 0.1))
           * CASE liquefaction_class WHEN 'high' THEN 1.5e0 ELSE 1e0 END)), 9) AS p FROM zones""",
)
def _(v):
    p = geo.damage_probability(F.col("damage_probability"), F.col("liquefaction_class"))
    return v.zones.select("id", F.round(p, 9).alias("p"))


@query(
    "planar_km",
    "SELECT id, round(sqrt(((lat - 34.2) * 111) ** 2 + ((lng + 118.5) * 111 * cos(radians(34.2))) ** 2), 6) AS km FROM quakes",
)
def _(v):
    km = geo.planar_km(F.col("lat") - 34.2, F.col("lng") + 118.5, F.lit(34.2))
    return v.quakes.select("id", F.round(km, 6).alias("km"))


@query(
    "haversine_km",
    """SELECT id, round(2 * 6371 * asin(sqrt(sin(radians(34.2 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(34.2))
              * sin(radians(-118.5 - lng) / 2) ** 2)), 6) AS km FROM quakes""",
)
def _(v):
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(34.2), F.lit(-118.5))
    return v.quakes.select("id", F.round(km, 6).alias("km"))


@query(
    "cell_id",
    "SELECT id, CAST(floor(lat / 0.25) AS BIGINT) AS cell, round(floor(lat / 0.25) * 0.25, 4) AS origin FROM quakes",
)
def _(v):
    cell = geo.cell_index(F.col("lat"), 0.25)
    return v.quakes.select("id", cell.alias("cell"), geo.cell_origin(cell, 0.25).alias("origin"))


@query(
    "wind_vector",
    """SELECT lat, lng, round(-sin(radians(direction_deg)) * speed_ms, 6) AS east,
              round(-cos(radians(direction_deg)) * speed_ms, 6) AS north FROM wind""",
)
def _(v):
    s, d = F.col("speed_ms"), F.col("direction_deg")
    return rounded(v.wind.select("lat", "lng", geo.wind_east(s, d).alias("east"), geo.wind_north(s, d).alias("north")))


@query("polygon_centroid", """
WITH r AS (SELECT n_nationkey AS id, 33.9e0 + n_nationkey % 5 * 0.13e0 AS y, -118.6e0 + floor(n_nationkey / 5) * 0.17e0 AS x FROM nation)
SELECT id, round((y + y + y + 0.15 + y + 0.15 + y) / 5, 6) AS lat, round((x + x + 0.2 + x + 0.2 + x + x) / 5, 6) AS lng FROM r""")
def _(v):
    from skarn.catalog.joins import soil_polygons

    centre = soil_polygons(v).select(F.col("ord").alias("id"), geo.polygon_centroid(F.col("ring")).alias("c"))
    return rounded(centre.select("id", "c.*"))


@query(
    "unit_conversions",
    "SELECT s_suppkey, round(s_acctbal / 3.6e0, 6) AS ms, round(s_acctbal * 1e6 / 1e9, 6) AS gb FROM supplier",
)
def _(v):
    bal = F.col("s_acctbal")
    return rounded(v.supplier.select("s_suppkey", fd.kmh_to_ms(bal).alias("ms"), fd.bytes_to_gb(bal * 1e6).alias("gb")))


@query(
    "epoch_parts",
    """SELECT event_id, date_trunc('millisecond', ts) AS at, CAST(ts AS DATE) AS date, date_trunc('hour', ts) AS hour FROM events""",
)
def _(v):
    at = fd.ts_of_ms(fd.ms_of_ts(F.col("ts")))
    return v.events.select("event_id", at.alias("at"), F.to_date(at).alias("date"), fd.hour_of(at).alias("hour"))


@query(
    "json_codec",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract(props, '$.k') || '}' AS text FROM events",
)
def _(v):
    held = fd.json_in(F.col("props"), "k BIGINT")
    return v.events.select("event_id", held["k"].alias("k"), fd.json_out(held).alias("text"))


@query(
    "json_array_append",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '["run-' || p_size || '"]'
              ELSE '["run-0","run-' || p_size || '"]' END AS ids FROM part""",
)
def _(v):
    held = F.when(F.col("p_partkey") % 2 == 0, "[]").otherwise('["run-0"]')
    ids = fd.json_array_append(held, F.concat(F.lit("run-"), "p_size"))
    return v.part.select("p_partkey", ids.alias("ids"))


@query(
    "event_key",
    """SELECT event_id, concat('n', user_id, ':', event_type, ':x') AS key, concat('n', user_id) AS first,
              concat(event_type, ':x') AS second FROM events""",
)
def _(v):
    key = fd.event_key(F.concat(F.lit("n"), "user_id"), F.concat("event_type", F.lit(":x")))
    return v.events.select("event_id", key.alias("key"), fd.key_parts(key).alias("p")).select("event_id", "key", "p.*")


@query(
    "rationale_text",
    """SELECT id, 'Deploy ' || id || ' to high-damage zone (prob ' || CAST(round_even(damage_probability * 100, 0) AS INTEGER) || '%)'
              AS rationale FROM zones""",
)
def _(v):
    return v.zones.select("id", fd.rationale_text(F.col("id"), "damage", F.col("damage_probability")).alias("rationale"))


@query(
    "freshness_class",
    """SELECT event_id, CASE WHEN s < 60 THEN 'green' WHEN s <= 180 THEN 'amber' ELSE 'red' END AS class
       FROM (SELECT event_id, date_sub('second', ts, TIMESTAMP '2024-01-30 23:57:30') AS s FROM events)""",
)
def _(v):
    age = F.timestamp_diff("SECOND", F.col("ts"), F.lit("2024-01-30 23:57:30").cast("timestamp_ntz"))
    return v.events.select("event_id", fd.freshness_class(age).alias("class"))
