"""Point-in-time joins, enrichment, spatial and lineage joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from skarn.functions.geo import HIGH_DAMAGE, cell_index, decimals, haversine_km, inside_edges
from skarn.operators.ordered import asof_last, join_keys, merge_by_key, ordinal, top_n

# Defaults of the feeds.
DEFAULT_WIND = {"speed_ms": 5.0, "direction_deg": 270.0}


def _units_per_second(df: DataFrame, col: str) -> int:
    """Numeric time columns are epoch milliseconds, timestamps count microseconds."""
    return 1000 if isinstance(df.schema[col].dataType, T.LongType) else 1_000_000


def pit_join(
    entities: DataFrame,
    features: DataFrame,
    keys: list[str],
    ts: str,
    feature_ts: str,
    ttl_seconds: int | None = None,
    *,
    cols: list[str] | None = None,
    prefix: str | None = None,
    created: str | None = None,
    cell: int | None = None,
) -> DataFrame:
    """Entity rows with the latest feature row at or before their time, within the TTL.

    ``prefix`` names the columns ``prefix__col``; ``created`` breaks ties of feature time.
    """
    cols = cols or [c for c in features.columns if c not in {*keys, feature_ts, created}]
    hit = asof_last(
        entities, features, keys, ts, feature_ts, cols, "_hit", tie=created, cell=cell
    )
    if ttl_seconds is not None:
        unit = _units_per_second(features, feature_ts)
        hit = hit.withColumn("_hit_ts", F.col("_hit.ts"))
        age = ordinal(hit, ts) - ordinal(hit, "_hit_ts")
        hit = hit.withColumn("_hit", F.when(age < ttl_seconds * unit, F.col("_hit"))).drop("_hit_ts")
    named = [F.col(f"_hit.{c}").alias(f"{prefix}__{c}" if prefix else c) for c in cols]
    return hit.select(*entities.columns, *named)


def latest_rows(df: DataFrame, keys: list[str], ts: str, created: str | None = None) -> DataFrame:
    """One row per key: the latest, ties broken by ``created``, then by the remaining columns."""
    rest = [c for c in df.columns if c not in {*keys, ts, created}]
    order = [ts, *([created] if created else []), *rest]
    return df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("r")).select(*keys, "r.*")


def latest_join(
    entities: DataFrame, features: DataFrame, keys: list[str], feature_ts: str
) -> DataFrame:
    """Latest feature row per key, whatever the entity's time."""
    latest = latest_rows(features, keys, feature_ts).drop(feature_ts)
    return entities.join(latest, keys, "left")


def alert_telemetry_join(
    alerts: DataFrame,
    telemetry: DataFrame,
    key: str = "node_id",
    alert_ts: str = "triggered_at",
    telemetry_ts: str = "ts",
    max_gap_seconds: int = 3600,
    cell: int | None = None,
) -> DataFrame:
    """Alerts with the node's latest telemetry, else the first that follows; both within the gap."""
    fields = {
        "utilization_pct": "gpu_utilization_pct",
        "temperature_c": "gpu_temperature_c",
        "power_draw_w": "gpu_power_draw_w",
        "device_id": "gpu_device_id",
    }
    near = alerts
    for out, forward in (("_back", False), ("_next", True)):
        near = asof_last(
            near, telemetry, [key], alert_ts, telemetry_ts, list(fields), out,
            forward=forward, tie="device_id", cell=cell,
        )
    unit = _units_per_second(telemetry, telemetry_ts)
    near = near.withColumns({"_bt": F.col("_back.ts"), "_nt": F.col("_next.ts")})
    at = ordinal(near, alert_ts)
    fresh = F.when(at - ordinal(near, "_bt") < max_gap_seconds * unit, F.col("_back"))
    soon = F.when(ordinal(near, "_nt") - at < max_gap_seconds * unit, F.col("_next"))
    hit = near.withColumn("_hit", F.coalesce(fresh, soon))
    return hit.select(*alerts.columns, *[F.col(f"_hit.{c}").alias(n) for c, n in fields.items()])


def latest_pods(events: DataFrame) -> DataFrame:
    """The latest event of every pod; of events at one instant the one of the highest id."""
    last = F.max(F.struct("timestamp_ms", "event_id", "phase")).alias("last")
    return events.groupBy("namespace", "pod_name").agg(last).select("namespace", "pod_name", "last.*")


def k8s_enrich(alerts: DataFrame, events: DataFrame, latest: bool = False) -> DataFrame:
    """Phase of the alert's pod from its latest event, ``Unknown`` where there is none.

    With ``latest`` the events are those of ``latest_pods`` already, one per pod.
    """
    phases = (events if latest else latest_pods(events)).select(
        F.col("namespace").alias("k8s_namespace"), F.col("pod_name").alias("k8s_pod_name"), F.col("phase").alias("_phase")
    )
    return (
        alerts.join(phases, ["k8s_namespace", "k8s_pod_name"], "left")
        .withColumn("pod_phase", F.coalesce("_phase", F.lit("Unknown")))
        .withColumn("namespace", F.coalesce("k8s_namespace", F.lit("")))
        .drop("_phase")
    )


def node_enrich(alerts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Alerts with hostname and device count of their node; a miss leaves them null."""
    return alerts.join(nodes.select("node_id", "hostname", "gpu_count"), "node_id", "left")


def high_damage(zones: DataFrame, p: float = HIGH_DAMAGE) -> DataFrame:
    return zones.filter(F.col("damage_probability") > p)


def alert_action(resource: str, zone: Column, confidence: Column) -> list[Column]:
    return [
        F.lit("alert").alias("action_type"),
        F.col(resource).alias("resource_id"),
        zone.alias("zone_id"),
        confidence.alias("confidence"),
        F.lit("high").alias("time_sensitivity"),
    ]


def zone_facility_alerts(
    zones: DataFrame, facilities: list[DataFrame], p: float = HIGH_DAMAGE
) -> DataFrame:
    """Alert actions of all facilities lying in a zone of high damage."""
    hot = high_damage(zones, p).select(F.col("id").alias("damage_zone_id"), "damage_probability")
    every = reduce(DataFrame.unionByName, [f.select("id", "damage_zone_id") for f in facilities])
    hit = every.join(hot, "damage_zone_id")
    return hit.select(*alert_action("id", F.col("damage_zone_id"), F.col("damage_probability")))


def zone_route_alerts(zones: DataFrame, routes: DataFrame, p: float = HIGH_DAMAGE) -> DataFrame:
    """Alert actions of routes that start or end in a zone of high damage.

    Both ends become rows of one equi-join, in place of a join on a disjunction.
    """
    hot = high_damage(zones, p).select(F.col("id").alias("zone"), "damage_probability")
    ends = routes.select(
        "id", F.explode(F.array_distinct(F.array("origin_zone_id", "destination_zone_id"))).alias("zone")
    )
    return ends.join(hot, "zone").select(
        *alert_action("id", F.col("zone"), F.col("damage_probability"))
    )


# Cells of the nearest search: cubes around the unit sphere, halved level by level down to 49 m.
_FINEST = 18
# Wide cubes hold many points: down to this level (25 km, 10,000s of cubes at most) their points are dealt in so many shares.
_WIDE, _SHARES = 9, 8
_SPHERE = ("x", "y", "z")


def _on_sphere(lat: Column, lng: Column) -> dict[str, Column]:
    """Position on the unit sphere, where neither the poles nor the date line are special."""
    phi, lam = F.radians(lat), F.radians(lng)
    return {"x": F.cos(phi) * F.cos(lam), "y": F.cos(phi) * F.sin(lam), "z": F.sin(phi)}


def _cube(v: Column, lvl: Column) -> Column:
    """Number of the cube of a level along one axis."""
    across = F.expr("shiftleft(1L, lvl)") if lvl is None else F.lit(1 << lvl).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(across - 1, F.floor((v + 1) / 2 * across).cast("bigint")))


def _node(x: Column, y: Column, z: Column) -> Column:
    return F.call_function("shiftleft", x, F.lit(40)) + F.call_function("shiftleft", y, F.lit(20)) + z


def _every_level(df: DataFrame) -> DataFrame:
    """Rows with a finest ``cell`` once per level, with the ``node`` that holds it there."""
    axis = lambda at: F.call_function("shiftright", F.col("cell"), F.lit(at)).bitwiseAND(F.lit((1 << 20) - 1).cast("bigint"))
    up = lambda c: F.call_function("shiftright", c, F.lit(_FINEST) - F.col("lvl"))
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(_FINEST))).alias("lvl"))
    return rows.withColumn("node", _node(*[up(axis(at)) for at in (40, 20, 0)])).drop("cell")


def _placed(df: DataFrame) -> DataFrame:
    """Adds the position on the sphere and the finest ``cell``."""
    put = df.withColumns(_on_sphere(F.col("lat"), F.col("lng")))
    return put.withColumn("cell", _node(*[_cube(F.col(c), _FINEST) for c in _SPHERE]))


def nearest(points: DataFrame, targets: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` nearest targets of every point: ``id, target_id, km``.

    Both frames have ``id, lat, lng``.  The targets of every cube of every level are counted, and
    the box they lie in is kept: a tree of counts.  A point goes down to the smallest cube around it
    with ``k`` targets, and the far corner of their box bounds the distance of its k-th nearest one.
    Cubes at least twice as wide as that bound are the search level: the ball of the bound touches
    two of them along each axis at most, so a point meets the targets of eight cubes at most, by an
    equi-join, and keeps those inside the ball.  With fewer than ``k`` targets in all, the one cube of
    level 0 holds these few.  Points without a position are left out.  Points at one position are
    searched for once.
    """
    asking = points.select("id", F.concat(F.col("lat").cast("string"), F.lit(" "), F.col("lng").cast("string")).alias("_at"), "lat", "lng")
    places = asking.filter(F.col("_at").isNotNull()).groupBy("_at").agg(F.first("lat").alias("lat"), F.first("lng").alias("lng"))
    found = _nearest_of_places(places.withColumnRenamed("_at", "id"), targets, k)
    return asking.select("id", "_at").join(found.withColumnRenamed("id", "_at"), "_at").drop("_at")


def _nearest_of_places(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``nearest`` of points at different positions."""
    at = _placed(points.select("id", "lat", "lng"))
    spots = targets.select(F.col("id").alias("target_id"), "lat", "lng")
    # Of targets at one position no more than k can be among the nearest: those of lowest id.
    spots = _placed(top_n(spots, ["lat", "lng"], [F.col("target_id")], k)).filter(F.col("cell").isNotNull())
    box = [f(f"{e}{c}").alias(f"{e}{c}") for c in _SPHERE for f, e in ((F.min, "l"), (F.max, "h"))]
    ends = [F.col(c).alias(f"{e}{c}") for c in _SPHERE for e in ("l", "h")]
    cells = spots.select("cell", *ends).groupBy("cell").agg(F.count("*").alias("n"), *box)
    tree = _every_level(cells).groupBy("lvl", "node").agg(F.sum("n").alias("n"), *box).filter(F.col("n") >= k)

    # The deepest node of each occupied cell.  The result leaves under two columns made from the cell, so
    # the join below shuffles it anew and Spark can split a cell that holds many points.
    corners = [f"{e}{c}" for c in _SPHERE for e in ("l", "h")]
    deepest = F.max_by(F.struct(*corners), "lvl").alias("box")
    half = lambda c: [F.call_function("shiftright", c, F.lit(20)).alias("_a"), c.bitwiseAND(F.lit((1 << 20) - 1).cast("bigint")).alias("_b")]
    found = _every_level(at.select("cell").distinct().withColumn("own", F.col("cell"))).join(tree, ["lvl", "node"])
    found = found.groupBy("own").agg(deepest).select(*half(F.col("own")), "box.*")
    far = [F.greatest(F.abs(F.col(c) - F.col(f"l{c}")), F.abs(F.col(c) - F.col(f"h{c}"))) for c in _SPHERE]
    # The margin is over the rounding of a position and over the width of a tie.
    bound = F.coalesce(F.sqrt(far[0] * far[0] + far[1] * far[1] + far[2] * far[2]) * (1 + 1e-9) + 1e-11, F.lit(2.5))
    level = F.greatest(F.lit(0), F.least(F.lit(_FINEST), F.floor(-F.log2("d")))).cast("int")
    balls = at.filter(F.col("cell").isNotNull()).select("*", *half(F.col("cell"))).join(found, ["_a", "_b"], "left")
    balls = balls.select("id", "lat", "lng", *_SPHERE, bound.alias("d")).withColumn("lvl", level)
    for c in _SPHERE:
        touched = F.sequence(_cube(F.col(c) - F.col("d"), None), _cube(F.col(c) + F.col("d"), None))
        balls = balls.withColumn(f"n{c}", F.explode(touched))
    asked = balls.select("id", "lat", "lng", *_SPHERE, "d", "lvl", _node(F.col("nx"), F.col("ny"), F.col("nz")).alias("node"))
    asked = asked.withColumn("share", F.when(F.col("lvl") <= _WIDE, F.pmod(F.xxhash64("id"), F.lit(_SHARES))).otherwise(0).cast("int"))
    held = _every_level(spots.select("cell", "target_id", *[F.col(c).alias(f"t{c}") for c in ("lat", "lng", *_SPHERE)]))
    held = held.withColumn("share", F.explode(F.sequence(F.lit(0), F.when(F.col("lvl") <= _WIDE, _SHARES - 1).otherwise(0))))
    off = [F.col(c) - F.col(f"t{c}") for c in _SPHERE]
    inside = off[0] * off[0] + off[1] * off[1] + off[2] * off[2] <= F.col("d") * F.col("d")
    pairs = asked.join(held, ["lvl", "node", "share"]).filter(inside).select(
        "id", "target_id",
        haversine_km(F.col("lat"), F.col("lng"), F.col("tlat"), F.col("tlng")).alias("km"),
    )
    # Distances equal to a micrometre are ties, settled by the target's id.
    near = decimals(F.col("km"), 9).alias("near")
    if k == 1:
        best = F.min(F.struct(near, "target_id", "km")).alias("b")
        return pairs.groupBy("id").agg(best).select("id", "b.target_id", "b.km")
    return top_n(pairs, ["id"], [decimals(F.col("km"), 9), F.col("target_id")], k)


def nearest_crew(zones: DataFrame, crews: DataFrame, statuses=("available", "standby")) -> DataFrame:
    free = crews.filter(F.col("status").isin(*statuses))
    free = free.select(F.col("crew_identifier").alias("id"), "lat", "lng")
    return nearest(zones.select("id", "lat", "lng"), free).select(
        F.col("id").alias("zone_id"), F.col("target_id").alias("crew_id"), "km"
    )


def crew_in_zone(
    crews: DataFrame, zones: DataFrame, res: float = 0.01, p: float = HIGH_DAMAGE
) -> DataFrame:
    """Crews standing in a cell of high damage, each with the worst zone of that cell."""
    cell = lambda: (cell_index(F.col("lat"), res).alias("cy"), cell_index(F.col("lng"), res).alias("cx"))
    worst = (
        high_damage(zones, p)
        .select(*cell(), F.struct((-F.col("damage_probability")).alias("p"), F.col("id").alias("id")).alias("z"))
        .groupBy("cy", "cx").agg(F.min("z").alias("z"))
    )
    placed = crews.select(F.col("crew_identifier").alias("crew_id"), *cell())
    return placed.join(worst, ["cy", "cx"]).select("crew_id", F.col("z.id").alias("zone_id"))


# Degrees by which a cell counts as wider than it is, over the rounding of its borders.
_BORDER = 1e-9


def polygon_cells(polygons: DataFrame, res: float) -> DataFrame:
    """``_cy, _cx, _held``: per grid cell the polygons that have a part of it, by ``ord``.

    A polygon that holds a cell wholly is marked so.  Of others the cell keeps the edges that decide
    about its points: those that span its latitudes and do not end to the west of it.  A point's test
    with them is the same sum as with the whole ring.
    """
    lats, lngs = F.transform("ring", lambda v: v["lat"]), F.transform("ring", lambda v: v["lng"])
    span = lambda of: F.explode(F.sequence(cell_index(F.array_min(of), res), cell_index(F.array_max(of), res)))
    shifted = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    edge = lambda a, b: F.struct(a["lat"].alias("ay"), a["lng"].alias("ax"), b["lat"].alias("by"), b["lng"].alias("bx"))
    cut = polygons.select(
        F.col("ord").alias("_ord"), F.lower("class").alias("_class"), F.zip_with("ring", shifted, edge).alias("_edges"),
        lngs.alias("_lngs"), span(lats).alias("_cy"),
    ).withColumn("_cx", span(F.col("_lngs"))).drop("_lngs")
    low = {c: F.col(c) * F.lit(res) - _BORDER for c in ("_cy", "_cx")}
    high = {c: (F.col(c) + 1) * F.lit(res) + _BORDER for c in ("_cy", "_cx")}
    spans = lambda e: (F.least(e["ay"], e["by"]) <= high["_cy"]) & (F.greatest(e["ay"], e["by"]) >= low["_cy"])
    near = F.filter("_edges", lambda e: spans(e) & (F.greatest(e["ax"], e["bx"]) >= low["_cx"]))
    cut = cut.withColumn("_edges", near)
    whole = ~F.exists("_edges", lambda e: F.least(e["ax"], e["bx"]) <= high["_cx"])
    middle = [(F.col(c) + 0.5) * F.lit(res) for c in ("_cy", "_cx")]
    cut = cut.withColumn("_whole", whole).filter(~F.col("_whole") | inside_edges(*middle, F.col("_edges")))
    kept = F.when(~F.col("_whole"), F.col("_edges")).alias("edges")
    entry = F.struct(F.col("_ord").alias("ord"), F.col("_class").alias("class"), F.col("_whole").alias("whole"), kept)
    return cut.groupBy("_cy", "_cx").agg(F.sort_array(F.collect_list(entry)).alias("_held"))


def liquefaction_lookup(points: DataFrame, polygons: DataFrame, default: str = "low", res: float = 0.1) -> DataFrame:
    """Points with the class of the first polygon holding them, lower-cased, else ``default``.

    ``polygons``: ``ord, class, ring array<struct<lng,lat>>``, ``ord`` unique.  Polygons are cut into
    grid cells once (``polygon_cells``).  A point meets the one row of its cell, most of them without a
    test, so no point is multiplied or grouped again.  The cells leave their aggregate under keys of
    another form, so that Spark can split a cell that holds many points.
    """
    index = polygon_cells(polygons, res).select(F.bitwise_not("_cy").alias("_not_cy"), F.bitwise_not("_cx").alias("_not_cx"), "_held")
    cells = {"_not_cy": F.bitwise_not(cell_index(F.col("lat"), res)), "_not_cx": F.bitwise_not(cell_index(F.col("lng"), res))}
    holds = lambda e: e["whole"] | inside_edges(F.col("lat"), F.col("lng"), e["edges"])
    found = F.get(F.filter("_held", holds), F.lit(0))["class"]
    met = points.withColumns(cells).join(index, ["_not_cy", "_not_cx"], "left")
    return met.select(*points.columns, F.coalesce(found, F.lit(default)).alias("liquefaction_class"))


def recent_action_antijoin(
    actions: DataFrame, recent: DataFrame, seconds: int = 10, cell: int | None = None
) -> DataFrame:
    """Actions whose (type, resource) does not occur in ``recent`` during the seconds before."""
    keys = ["action_type", "resource_id"]
    hit = asof_last(
        actions, recent, keys, "created_at", "created_at", [], "_hit", strict=True, cell=cell
    ).withColumn("_hit_ts", F.col("_hit.ts"))
    unit = _units_per_second(recent, "created_at")
    age = ordinal(hit, "created_at") - ordinal(hit, "_hit_ts")
    return hit.filter(age.isNull() | (age >= seconds * unit)).select(*actions.columns)


def replay_reset(zones: DataFrame, events: DataFrame, event_key: str) -> DataFrame:
    """Zones without those that belong to the event of a replay."""
    replayed = events.filter(F.col("id") == event_key).select(F.col("id").alias("event_id"))
    return zones.join(replayed, "event_id", "left_anti")


def alert_context_joins(
    alerts: DataFrame,
    incidents: DataFrame,
    nodes: DataFrame,
    devices: DataFrame,
    features: DataFrame,
    events: DataFrame,
    max_devices: int = 8,
) -> DataFrame:
    """Alerts with node (own or through their first incident), devices, features and pod events.

    ``max_devices`` is the number of devices of a node that its context names.
    """
    linked = incidents.groupBy("alert_id").agg(
        F.min(F.struct("incident_id", "node_id"))["node_id"].alias("_linked")
    )
    hosted = (
        top_n(devices, ["node_id"], [F.col("device_id")], max_devices)
        .groupBy("node_id").agg(F.array_sort(F.collect_list("device_id")).alias("devices"))
    )
    node = nodes.select("node_id", "hostname", "gpu_count").withColumn("_known", F.lit(True))
    per_node = merge_by_key(["node_id"], node, hosted, features).withColumnRenamed("node_id", "_node")
    return (
        alerts.join(linked, "alert_id", "left")
        .withColumn("_node", F.coalesce("node_id", "_linked"))
        .drop("_linked")
        .join(per_node, "_node", "left")
        .join(events, "k8s_pod_name", "left")
    )


def batch_feature_get(ids: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """Requested ids, in their number, with the feature row of each; a miss has none."""
    return ids.join(view, key, "left")


def lineage_forward(
    docs: DataFrame, registry: DataFrame, usage: DataFrame, runs: DataFrame, file_path: str, table: str
) -> DataFrame:
    """Edges from a file over its documents and the table's versions to runs and models.

    ``kind, source, target``: file to document, document to table, table to version, version to run,
    run to model.  Every id has its own row, and a table's documents are not paired with its versions,
    so the result grows with the graph and not with its paths.
    """
    edge = lambda kind, source, target: [F.lit(kind).alias("kind"), source.alias("source"), target.alias("target")]
    held = docs.filter(F.col("file_path") == file_path)
    versions = registry.filter(F.col("table_name") == table).select("version_id")
    used = usage.select("version_id", "run_id").join(versions, "version_id", "left_semi").distinct()
    made = runs.select("run_id", "model_id").join(used.select("run_id"), "run_id", "left_semi").distinct()
    parts = [
        held.select(*edge("document", F.col("file_path"), F.col("document_id"))),
        held.select(*edge("table", F.col("document_id"), F.lit(table))),
        versions.select(*edge("version", F.lit(table), F.col("version_id"))),
        used.select(*edge("run", F.col("version_id"), F.col("run_id"))),
        made.select(*edge("model", F.col("run_id"), F.col("model_id"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def lineage_backward(
    models: DataFrame, usage: DataFrame, registry: DataFrame, docs: DataFrame, hours: int = 24
) -> DataFrame:
    """From a model over its run and dataset version to the files ingested around its creation.

    Files are first reduced to (file, hour); hour buckets make the time range an equi-join, and
    the first and last time inside an hour decide its two edge buckets exactly.
    """
    hour_ms, reach = 3_600_000, hours * 3_600_000
    bucket = lambda ms: F.floor(ms / hour_ms).cast("bigint")
    files = docs.groupBy("file_path", bucket(F.col("ingested_ms")).alias("_h")).agg(
        F.min("ingested_ms").alias("_lo"), F.max("ingested_ms").alias("_hi")
    )
    first = usage.join(registry, "version_id").groupBy("run_id").agg(
        F.min(F.struct("version_id", "snapshot_version", "created_ms")).alias("v")
    )
    used = models.join(first, "run_id").select("model_id", "run_id", "v.*")
    versions = used.select("version_id", "created_ms").distinct().withColumn(
        "_h",
        F.explode(F.sequence(bucket(F.col("created_ms") - reach), bucket(F.col("created_ms") + reach))),
    )
    inside = (F.col("_hi") >= F.col("created_ms") - reach) & (F.col("_lo") <= F.col("created_ms") + reach)
    around = versions.join(files, "_h").filter(inside).select("version_id", "file_path").distinct()
    return used.join(around, "version_id", "left").select(
        "model_id", "run_id", "version_id", "snapshot_version", "file_path"
    )


def version_offsets(registry: DataFrame, log: DataFrame) -> DataFrame:
    """``version_id, partition, offset``: per topic partition the first offset at or after a version's creation.

    -1 where nothing follows.  Offsets rise with time inside a partition, so this is a forward as-of
    join; the partitions of a topic, a handful of numbers, are the only rows that are collected.
    """
    partitions = [r[0] for r in log.select("partition").distinct().collect()]
    every = F.explode(F.array(*map(F.lit, partitions)).cast(f"array<{log.schema['partition'].dataType.simpleString()}>"))
    asked = registry.select("version_id", "created_ms", every.alias("partition"))
    first = log.groupBy("partition", "timestamp_ms").agg(F.min("offset").alias("offset"))
    found = asof_last(asked, first, ["partition"], "created_ms", "timestamp_ms", ["offset"], "_first", forward=True)
    return found.select("version_id", "partition", F.coalesce("_first.offset", F.lit(-1).cast("bigint")).alias("offset"))


def offsets_at_time(log: DataFrame, ts_ms: int) -> DataFrame:
    """Per partition the first offset at or after a time, -1 where there is none."""
    first = F.min(F.when(F.col("timestamp_ms") >= ts_ms, F.col("offset")))
    return log.groupBy("partition").agg(F.coalesce(first, F.lit(-1).cast("bigint")).alias("offset"))


def hotspot_wind(hotspots: DataFrame, wind: DataFrame, default: dict = DEFAULT_WIND) -> DataFrame:
    """Hotspots with the wind at their position rounded to 4 digits, else the default wind."""
    spot = lambda: (F.round("lat", 4).alias("_y"), F.round("lng", 4).alias("_x"))
    known = wind.groupBy(*spot()).agg(F.max(F.struct("speed_ms", "direction_deg")).alias("_w"))
    return (
        hotspots.select("*", *spot()).join(known, ["_y", "_x"], "left")
        .withColumn("speed_ms", F.coalesce("_w.speed_ms", F.lit(default["speed_ms"])))
        .withColumn("direction_deg", F.coalesce("_w.direction_deg", F.lit(default["direction_deg"])))
        .drop("_y", "_x", "_w")
    )
