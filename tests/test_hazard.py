"""Damage grid, ember particles and dispatch against small Python models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skarn.operators import joins as jn
from skarn.plans import assignment as at, hazard as hz

REPLAY = [("n94", 6.7, 17.0, 34.213, -118.537)]
EVENT = "id string, magnitude double, depth double, lat double, lng double"


def test_replay_grid(spark):
    cells = hz.damage_grid(spark.createDataFrame(REPLAY, EVENT))
    r = cells.agg(F.count("*").alias("n"), F.min("damage_probability").alias("lo"), F.max("damage_probability").alias("hi")).first()
    assert (r["n"], r["hi"]) == (10_201, 0.135) and r["lo"] > 0.05
    middle = cells.filter("cell = 5100").first()
    assert (middle["lat"], middle["lng"], middle["grid_cell_id"]) == (34.213, -118.537, "CELL_5100")


def test_grid_shuffles_events_only(spark):
    events = spark.createDataFrame(REPLAY * 100, EVENT)
    plan = hz.damage_cells(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan  # the event rows, before the cells
    whole = hz.damage_cells(events.limit(1)).filter("damage_probability > 0.1")
    assert hz.damage_cells(events.limit(1), above=0.1).exceptAll(whole).count() == 0 < whole.count()


def test_hotspot_zones_count_detections(spark):
    rows = spark.createDataFrame([("a", "34.001", "-118.001", "50.0", "h"), ("b", "34.002", "-118.002", "5.0", "h"), ("c", "34.2", "-118.0", "9.0", "h"),
                                  ("d", "34.2", "-118.0", "9.0", "l")], "id string, latitude string, longitude string, frp string, confidence string")
    got = {r["id"]: (r["particle_count"], r["probability"]) for r in hz.hotspot_zones(rows, "r").collect()}
    assert got == {"EMBER_r_34.0000_-118.0100": (2, 1.0), "EMBER_r_34.2000_-118.0000": (1, 0.5)}


ZONES = [("e1", 3, "z3", 34.0, -118.0, 0.95), ("e1", 5, "z5", 34.0, -118.001, 0.855), ("e1", 9, "z9", 34.5, -118.5, 0.75),
         ("e1", 11, "z11", 34.0, -118.0, 0.99), ("e1", 1, "z1", 34.0, -118.0, 0.5)]
CREWS = [("c1", 34.0, -118.0, "available"), ("c2", 34.1, -118.0, "available"), ("c3", 34.0, -118.0, "deployed"),
         ("c4", 34.5, -118.4, "standby")]
EMBER = [(1, "m1", 34.0, -118.0, 0.9), (2, "m2", 34.0, -118.0, 0.8), (3, "m3", 34.0, -118.0, 0.66)]


def test_dispatch(spark):
    zones = spark.createDataFrame(ZONES, "event_id string, cell int, id string, lat double, lng double, damage_probability double")
    crews = spark.createDataFrame(CREWS, "crew_identifier string, lat double, lng double, status string")
    ember = spark.createDataFrame(EMBER, "seq bigint, id string, lat double, lng double, probability double")
    events = spark.createDataFrame([("e1",), ("e2",)], "id string")
    got = {(r["event_id"], r["zone_id"]): r for r in hz.dispatch_actions(events, zones, ember, crews).collect()}
    # The first three cells take c1, c2, c4; nothing is left for the ember zones of e1.
    assert {k: r["resource_id"] for k, r in got.items()} == {
        ("e1", "z3"): "c1", ("e1", "z5"): "c2", ("e1", "z9"): "c4", ("e2", "m3"): "c1", ("e2", "m2"): "c2",
    }
    assert got["e1", "z3"]["rationale"] == "Deploy c1 to high-damage zone (prob 95%)"
    assert got["e2", "m3"]["rationale"] == "Deploy c1 to ember risk zone (density 66%)"
    assert (got["e1", "z5"]["confidence"], got["e2", "m2"]["time_sensitivity"]) == (0.86, "high")


@pytest.mark.parametrize("batch, offers", [(4096, 32), (3, 2), (5, 1), (40, 3)])
def test_assign_in_order(spark, batch, offers):
    rnd = random.Random(4)
    zones = [(f"z{i:02}", rnd.random(), rnd.random(), rnd.choice([0.7, 0.8, 0.9])) for i in range(25)]
    crews = [(f"c{i:02}", rnd.random(), rnd.random()) for i in range(18)]
    z = spark.createDataFrame(zones, "id string, lat double, lng double, probability double")
    c = spark.createDataFrame(crews, "id string, lat double, lng double")
    free, want = dict((k, (y, x)) for k, y, x in crews), {}
    for name, y, x, _ in sorted(zones, key=lambda z: (-z[3], z[0])):
        if free:
            want[name] = min(free, key=lambda k: haversine(y, x, *free[k]))
            del free[want[name]]
    assert {r["zone_id"]: r["crew_id"] for r in hz.assign_in_order(z, c, batch, offers).collect()} == want
    assert hz.assign_in_order(z.limit(0), c).count() == hz.assign_in_order(z, c.limit(0)).count() == 0


def serial(zones, crews):
    free, want = {k: (y, x) for k, y, x in crews if y is not None}, {}
    for name, y, x, _ in sorted((z for z in zones if z[1] is not None), key=lambda z: (-z[3], z[0])):
        if free:
            want[name] = min(free, key=lambda k: (round(haversine(y, x, *free[k]) * 6371, 6), k))
            del free[want[name]]
    return want


def assigned(spark, zones, crews, *how):
    z = spark.createDataFrame(zones, "id string, lat double, lng double, probability double")
    c = spark.createDataFrame(crews, "id string, lat double, lng double")
    return {r["zone_id"]: r["crew_id"] for r in hz.assign_in_order(z, c, *how).collect()}


def test_assignment_ends_without_positions(spark):
    zones = [("a", None, 1.0, 0.9), ("b", 0.0, None, 0.8), ("c", 0.0, 1.0, 0.7)]
    crews = [("x", None, None), ("y", 0.0, 1.1)]
    assert assigned(spark, zones, crews) == {"c": "y"}
    assert assigned(spark, zones[:2], crews) == assigned(spark, zones, crews[:1]) == {}


def test_zones_that_share_their_nearest_crew(spark, monkeypatch):
    # All zones at one place, more zones than crews: the order decides, in one task of a few rounds.
    zones = [(f"z{i:03}", 10.0, 20.0, 0.9 - i / 1000) for i in range(80)]
    crews = [(f"c{i:02}", 10.0, 20.0 + i / 50) for i in range(60)]
    rounds, plain = [], hz.settle
    monkeypatch.setattr(hz, "settle", lambda df, what: (rounds.append(what), plain(df, what))[1])
    assert assigned(spark, zones, crews, 4096, 32) == serial(zones, crews)
    assert rounds.count("held") <= 3
    # Cut along the order: a cut settles when those before it have.
    rounds.clear()
    assert assigned(spark, zones, crews, 20, 60) == serial(zones, crews)
    assert rounds.count("held") <= 8


def test_displacements_across_neighbourhoods(spark):
    rnd = random.Random(6)
    zones = [(f"z{i:02}", rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.random()) for i in range(50)]
    crews = [(f"c{i:02}", rnd.uniform(-3, 3), rnd.uniform(-3, 3)) for i in range(40)]
    for how in ((4096, 32), (6, 3)):
        assert assigned(spark, zones, crews, *how) == serial(zones, crews)


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))


def test_polygons(spark):
    ring = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    polys = spark.createDataFrame(
        [(2, "High", ring(0.0, 0.0, 2.0)), (1, "LOW", ring(1.0, 1.0, 2.0)), (3, "none", ring(5.0, 5.0, 0.3))],
        "ord int, class string, ring array<struct<lng double, lat double>>",
    )
    points = spark.createDataFrame([("a", 0.5, 0.5), ("b", 1.5, 1.5), ("c", 9.0, 9.0), ("d", 5.1, 5.1), ("e", 2.5, 2.5)], "id string, lat double, lng double")
    want = {"a": "high", "b": "low", "c": "moderate", "d": "none", "e": "low"}
    assert {r[0]: r["liquefaction_class"] for r in jn.liquefaction_lookup(points, polys, "moderate").collect()} == want


def test_polygons_against_whole_rings(spark):
    # Concave, touching and overlapping rings, points on borders and corners of cells and rings.
    rnd = random.Random(3)
    star = [(2 + r * math.cos(a), 2 + r * math.sin(a)) for k in range(16) for a, r in [(k * math.pi / 8, 1.7 if k % 2 else 0.6)]]
    comb = [(3.0, 0.0), (5.0, 0.0), (5.0, 3.0), (4.6, 3.0), (4.6, 0.5), (4.2, 0.5), (4.2, 3.0), (3.0, 3.0)]
    left, right = [(-2.0, -1.0), (-1.0, -1.0), (-1.0, 1.0), (-2.0, 1.0), (-2.0, -1.0)], [(-1.0, -1.0), (0.5, -1.0), (0.5, 1.0), (-1.0, 1.0)]
    tiny = [(1.01, 1.01), (1.03, 1.01), (1.02, 1.04)]
    rings = [star, comb, left, right, tiny, [(x + 0.05, y) for x, y in star]]
    polys = spark.createDataFrame([(i, f"C{i}", r) for i, r in enumerate(rings)], "ord int, class string, ring array<struct<lng double, lat double>>")
    spots = [(rnd.uniform(-2.5, 5.5), rnd.uniform(-1.5, 4.5)) for _ in range(3000)]
    spots += [(rnd.randrange(-25, 55) / 10, rnd.randrange(-15, 45) / 10) for _ in range(800)] + [p for r in rings for p in r]

    def inside(x, y, ring):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(spots)], "id int, lat double, lng double")
    for res in (0.1, 0.7):
        found = jn.liquefaction_lookup(points, polys, "none", res)
        got = {r["id"]: r["liquefaction_class"] for r in found.collect()}
        assert got == {i: next((f"c{k}" for k, r in enumerate(rings) if inside(x, y, r)), "none") for i, (x, y) in enumerate(spots)}
    assert found.count() == len(spots)
    plan = jn.liquefaction_lookup(points.repartition(3), polys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1  # of the cells, none of the points


def test_payload_parts_hold_all_records(spark):
    import json

    rows = spark.range(50).selectExpr("'e1' as event_id", "concat('z', id) as id")
    whole = hz.agent_payload({"damage_zones": rows}).collect()
    cut = hz.agent_payload({"damage_zones": rows}, limit=10).collect()
    assert len(whole) == 1 and len(cut) > 1
    ids = lambda rs: sorted(z["id"] for r in rs for z in json.loads(r["payload"])["damage_zones"])
    assert ids(whole) == ids(cut) and len(ids(cut)) == 50
    assert set(json.loads(whole[0]["payload"])) == set(hz.SECTIONS)
    small = spark.range(4).selectExpr("'e2' as event_id", "concat('y', id) as id")
    both = hz.agent_payload({"damage_zones": rows.union(small)}, limit=10).collect()
    assert sum(r["event_id"] == "e2" for r in both) == 1 and sum(r["event_id"] == "e1" for r in both) > 1


def test_seismic_actions_skip_seen(spark):
    feed = spark.createDataFrame([(
        '{"features":[{"id":"a","properties":{"mag":7.5},"geometry":{"coordinates":[-118.0,34.0,5.0]}},'
        '{"id":"b","properties":{"mag":7.5},"geometry":{"coordinates":[-118.0,34.0]}},'
        '{"id":"c","properties":{"mag":null},"geometry":{"coordinates":[-118.0,34.0]}},'
        '{"properties":{"mag":7.0},"geometry":{"coordinates":[-118.0,34.0]}}]}',)], "value string")
    crews = spark.createDataFrame(CREWS, "crew_identifier string, lat double, lng double, status string")
    ember = spark.createDataFrame(EMBER, "seq bigint, id string, lat double, lng double, probability double")
    seen = spark.createDataFrame([("b",)], "id string")
    cells, actions = hz.seismic_actions(feed, seen, None, ember, crews, res=0.05)
    assert {r[0] for r in cells.select("event_id").distinct().collect()} == {"a"}
    assert actions.filter("event_id = 'a'").count() == 3 == actions.count()
    assert actions.filter("confidence > 0.7 and time_sensitivity = 'immediate'").count() == 3


def test_seismic_actions_wait_ten_seconds(spark):
    feed = spark.createDataFrame([('{"features":[' + ",".join(
        f'{{"id":"{k}","properties":{{"mag":7.5}},"geometry":{{"coordinates":[-118.0,34.0,5.0]}}}}' for k in "ab") + "]}",)], "value string")
    crews = spark.createDataFrame(CREWS, "crew_identifier string, lat double, lng double, status string")
    ember = spark.createDataFrame(EMBER, "seq bigint, id string, lat double, lng double, probability double")
    seen = spark.createDataFrame([], "id string")
    log = spark.createDataFrame([("dispatch", "c1", 95_000), ("dispatch", "c2", 89_000)], "action_type string, resource_id string, created_at bigint")
    at = F.lit(100_000).cast("bigint")
    _, made = hz.seismic_actions(feed, seen, None, ember, crews, res=0.05, at=at, recent=log)
    got = sorted((r["event_id"], r["resource_id"], r["created_at"]) for r in made.collect())
    assert got == [("a", "c2", 100_000), ("a", "c4", 100_000)]  # c1 acted 5 seconds ago; b repeats a


def soil(spark):
    ring = lambda y, x, d: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    rows = [(0, "HIGH", ring(33.9, -118.4, 0.23)), (1, "very_high", ring(34.0, -118.3, 0.31)), (2, "odd", ring(34.4, -118.9, 0.1))]
    return spark.createDataFrame(rows, "ord int, class string, ring array<struct<lng:double,lat:double>>")


def test_folded_grid_equals_its_rows(spark):
    # Two epicentres, one of them crowded beyond one copy of its classes; one event lacks its depth.
    rnd = random.Random(3)
    rows = [(f"e{i}", 5 + rnd.random(), rnd.uniform(5, 20), 34.2, -118.5) for i in range(300)]
    rows += [("far", 6.2, 8.0, 34.05, -118.31), ("none", 6.0, None, 34.2, -118.5), ("lost", 6.0, 9.0, None, -118.5)]
    events, polygons = spark.createDataFrame(rows, EVENT), soil(spark)
    grid = hz.damage_grid(events, 0.02, polygons=polygons).cache()
    keys = ["event_id", "liquefaction_class"]
    sums = {tuple(r)[:5]: tuple(r)[5:] for r in hz.damage_by_class(events, polygons, 0.02).select(
        *keys, "cells", "cell_sum", "first_id", "probability_sum", "most", "lat_sum", "lng_sum").collect()}
    want = {tuple(r)[:5]: tuple(r)[5:] for r in grid.groupBy(*keys).agg(
        F.count("*"), F.sum("cell"), F.min("id"), F.sum("damage_probability"), F.max("damage_probability"), F.sum("lat"), F.sum("lng")).collect()}
    assert sums.keys() == want.keys() and len({k[1] for k in sums}) == 4
    assert all(a == b or a == pytest.approx(b, abs=1e-6) for k in sums for a, b in zip(sums[k], want[k]))
    first = hz.first_damaged(events, polygons, 3, 0.02)
    worst = hz.top_n(jn.high_damage(grid), ["event_id"], [F.col("cell")], 3)
    assert first.exceptAll(worst).isEmpty() and worst.exceptAll(first).isEmpty() and not first.isEmpty()
    counted = {r["event_id"]: tuple(r)[1:] for r in hz.damage_counts(events, 0.02).collect()}
    p = F.col("damage_probability")
    plain = hz.damage_cells(events, 0.02).groupBy("event_id").agg(F.count("*"), F.count_if(p > 0.05), F.count_if(p > 0.7))
    assert counted == {r[0]: tuple(r)[1:] for r in plain.collect()} and counted["none"] == (2601,) * 3


def test_folded_grid_looks_up_each_epicentre_once(spark):
    events = spark.createDataFrame([(f"e{i}", 6.0, 9.0, 34.2, -118.5) for i in range(600)], EVENT)
    runs = hz.soil_runs(events.withColumnRenamed("id", "event_id"), soil(spark), 0.02, 0.5)
    assert runs.count() == 600 * 3 + 600  # low, high, very_high, odd: a row an event and class
    assert runs.select("starts").distinct().count() == 4
    assert runs.agg(F.sum(F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a + 1), F.lit(0), lambda s, x: s + x))).first()[0] == 600 * 2601


def test_nearest_asks_once_per_position(spark):
    points = spark.range(2000).select("id", F.lit(34.0).alias("lat"), (F.col("id") % 2 / 10 - 118.0).alias("lng"))
    crews = spark.createDataFrame([(i, 34.0, -118.2 + i / 50) for i in range(9)], "id int, lat double, lng double")
    got = jn.nearest(points, crews, 2)
    assert got.count() == 4000 and got.select("km", "target_id").distinct().count() <= 4
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [_at" in plan


def test_assignment_meets_bounded_pairs(spark, monkeypatch):
    # One place, ten zones take part at a time, each with four offers: before, offers grew to all crews for all zones.
    zones = [(f"z{i:02}", 10.0, 20.0, 0.9 - i / 1000) for i in range(40)]
    crews = [(f"c{i:02}", 10.0, 20.0 + i / 50) for i in range(30)]
    pairs, plain = [], hz.settle

    def settle(df, what):
        kept = plain(df, what)
        if what in ("nearest", "offers"):
            pairs.append(kept.count())
        return kept

    monkeypatch.setattr(hz, "settle", settle)
    assert assigned(spark, zones, crews, 10, 4) == serial(zones, crews)
    assert max(pairs) <= 2 * 10 * 4


def in_order(zones, crews):
    """``serial`` with the ties of the SQL, crews listed at several places and zones of one id."""
    free, got = {}, []
    for name, y, x in crews:
        free.setdefault(name, []).append((y, x))
    for name, y, x, _ in sorted(zones, key=lambda z: (-z[3], *z[:3]))[: len(crews)]:
        if free:
            crew = min(free, key=lambda k: (min(round(haversine(y, x, *s) * 2 * 6371, 9) for s in free[k]), k))
            got.append((name, crew))
            del free[crew]
    return got


def test_assignment_of_a_crowded_part_is_one_round(spark, monkeypatch):
    # All zones lie away from the crews, so that they want the same ones: before, a round settled about as many zones as each had offers.
    rnd = random.Random(8)
    spots = [(rnd.randrange(30) / 80, 0.5 + rnd.randrange(5) / 100) for _ in range(1200)] + [(rnd.random() / 3, 0.6 + rnd.random() / 20) for _ in range(300)]
    zones = [(f"z{i:04}", y, x, rnd.choice([0.7, 0.8, 0.9])) for i, (y, x) in enumerate(spots)]
    crews = [(f"c{i:04}", i % 37 / 80, i % 41 / 90) for i in range(1100)] + [(f"d{i:03}", rnd.random() / 3, rnd.random() / 3) for i in range(400)]
    want = dict(in_order(zones, crews))
    rounds, plain = [], hz.settle
    monkeypatch.setattr(hz, "settle", lambda df, what: (rounds.append(what), plain(df, what))[1])
    assert assigned(spark, zones, crews) == want
    assert rounds.count("held") == 1


def test_assignment_around_the_globe(spark):
    # Parts of three zones, poles and date line, crews listed at two places, two zones of one id.
    rnd = random.Random(9)
    far = [(rnd.choice([-89.9, -40.0, 0.0, 51.5, 89.9]), rnd.choice([-179.99, -60.0, 0.1, 179.99])) for _ in range(24)]
    zones = [(f"z{i:02}", y, x, rnd.choice([0.7, 0.9])) for i, (y, x) in enumerate(far)] + [("z99", 0.0, 0.0, 0.95), ("z99", 1.0, 0.0, 0.95)]
    crews = [(f"c{i:02}", rnd.uniform(-1, 1), 10.0 + i) for i in range(20)] + [(f"c{i:02}", 60.0, 10.0 + i) for i in range(9)]
    want = in_order(zones, crews)
    z = spark.createDataFrame(zones, "id string, lat double, lng double, probability double")
    c = spark.createDataFrame(crews + [(None, 0.0, 0.0), ("nan", float("nan"), 0.0)], "id string, lat double, lng double")
    for how in ((3, 1), (100, 8)):
        assert sorted((r["zone_id"], r["crew_id"]) for r in hz.assign_in_order(z, c, *how).collect()) == sorted(want)


def test_free_crews_against_all_pairs():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(10)
    crews = [(f"c{rnd.randrange(180):03}", rnd.randrange(20) / 10, rnd.randrange(20) / 10) for _ in range(240)]
    ids, lat, lng = zip(*crews)
    free = at.FreeCrews(pa.chunked_array([ids[:100], ids[100:]]), np.array(lat), np.array(lng))
    left = {k: [c[1:] for c in crews if c[0] == k] for k in ids}
    while left:
        y, x = rnd.randrange(40) / 20, rnd.choice([rnd.random(), 1.0, 180.0])
        _, places = free.nearest(y, x, *at.on_sphere(np.array([y]), np.array([x]))[0].tolist())
        crew = min(map(free.first_of, places))
        want = min(left, key=lambda k: (min(at.near_km(y, x, *s) for s in left[k]), k))
        assert free.names[crew].as_py() == want
        free.take(crew)
        del left[want]
        if left and rnd.random() < 0.2:
            gone = rnd.choice(sorted(left))
            free.take(free.names.index(gone).as_py())
            del left[gone]
    assert not free.any() and free.nearest(0.0, 0.0, 1.0, 0.0, 0.0)[1] == []


def test_parts_and_reach():
    zones, crews = {(5, 5, 5): 4, (5, 5, 6): 3, (40, 40, 40): 9}, {(5, 5, 6): 2, (5, 5, 9): 2, (63, 0, 0): 7}
    assert at.split_cubes(zones, crews, 16, 16) == [sorted(zones)]
    assert at.split_cubes(zones, crews, 9, 16) == [[(5, 5, 5), (5, 5, 6)], [(40, 40, 40)]]
    assert len(at.split_cubes(zones, crews, 4, 16)) == 3 and at.split_cubes({}, crews, 1, 1) == []
    part = [(5, 5, 5), (5, 5, 6)]
    assert at.cubes_in_reach(part, crews, 2) == ([(5, 5, 6)], 2 * at.SIDE)
    cubes, reach = at.cubes_in_reach(part, crews, 3)
    assert cubes == [(5, 5, 6), (5, 5, 9)] and reach > 50 * at.SIDE
    assert at.cubes_in_reach(part, crews, 12) == (list(crews), math.inf)
