"""Cells of any width give what models give, with hot keys, ties and null keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skarn.operators import ordered as od, windows as wn

ROWS = 600


def skewed(seed, n=ROWS, times=200):
    """A third of the rows on one key and a third of the times on one instant."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}"
        at = 77 if rnd.random() < 0.35 else rnd.randrange(times)
        rows.append((i, key, at, rnd.randrange(50) / 4))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, key string, at bigint, v double")


def test_cells_rise_with_the_value(spark):
    df = spark.range(-300, 300).selectExpr("id", "id * id * id / 7.0D as v", "timestamp_millis(id * 9000000) as t")
    rows = df.select("id", od.cell_of(df, "id", 7).alias("a"), od.cell_of(df, "v").alias("b"), od.cell_of(df, "t").alias("c")).orderBy("id").collect()
    for x, y in zip(rows, rows[1:]):
        assert x["a"] <= y["a"] and x["b"] <= y["b"] and x["c"] <= y["c"]
    assert len({r["c"] for r in rows}) > 60


def test_building_a_plan_runs_no_job(spark):
    group = "plan-only"
    spark.sparkContext.setJobGroup(group, group)
    rows = frame(spark, skewed(11))
    od.asof_last(rows, rows, ["key"], "at", "at", ["id"])
    od.summarise(rows, ["key"], [], {"p": ("v", 0.5)})
    wn.counter_deltas(rows.drop("id"), ["key"], "at", ["v"])
    wn.delivery_health(rows, "key", "at")
    wn.action_dedup(rows, ["key"], "at")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("tests", "tests")
    assert list(jobs) == []


def test_asof_ties_and_null_keys(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", 5)], "id int, key string, at bigint")
    right = spark.createDataFrame([("a", 5, 7.0), ("a", 5, 9.0), (None, 5, 1.0), ("a", 4, 99.0)], "key string, at bigint, v double")
    for cell in (None, 1, 3):
        for parts in (1, 5):
            got = od.asof_last(left, right.repartition(parts), ["key"], "at", "at", ["v"], "m", cell=cell).collect()
            assert {r["id"]: r["m"] and r["m"]["v"] for r in got} == {1: 9.0, 2: None, 3: None}


def asof_model(left, right, forward, strict):
    by_key = defaultdict(list)
    for i, key, at, _ in right:
        by_key[key].append((at, i))
    out = {}
    for i, key, at, _ in left:
        if forward:
            hits = [(t, j) for t, j in by_key[key] if (t > at if strict else t >= at)]
            near = min((t for t, _ in hits), default=None)
        else:
            hits = [(t, j) for t, j in by_key[key] if (t < at if strict else t <= at)]
            near = max((t for t, _ in hits), default=None)
        out[i] = (near, max((j for t, j in hits if t == near), default=None))
    return out


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("cell", [None, 40, 7])
def test_asof(spark, forward, strict, cell):
    left, right = skewed(1), skewed(2, 300)
    got = od.asof_last(
        frame(spark, left), frame(spark, right), ["key"], "at", "at", ["id"], "m",
        forward=forward, strict=strict, tie="id", cell=cell,
    ).collect()
    want = asof_model(left, right, forward, strict)
    assert len(got) == len(left)
    for r in got:
        assert (r["m"] and r["m"]["ts"], r["m"] and r["m"]["id"]) == want[r["id"]], r


@pytest.mark.parametrize("cell", [None, 50, 9])
def test_running_total(spark, cell):
    rows = list({(k, at): (i, k, at, v) for i, k, at, v in skewed(3)}.values())
    got = od.running_total(frame(spark, rows), ["key"], "at", "v", "s", cell=cell)
    for r in got.collect():
        assert r["s"] == sum(v for _, k, at, v in rows if k == r["key"] and at <= r["at"])


@pytest.mark.parametrize("keys", [["key"], []])
def test_exact_percentiles(spark, keys):
    df = frame(spark, skewed(4))
    wanted = {"p10": ("v", 0.1), "p50": ("v", 0.5), "p95": ("v", 0.95), "at99": ("at", 0.99)}
    aggs = [F.count("*").alias("n")]
    plain = od.summarise(df, keys, aggs, wanted).collect()
    cut = od.summarise(df, keys, aggs, wanted, cell=200).collect()
    key = lambda r: r["key"] if keys else 0
    plain, cut = {key(r): r for r in plain}, {key(r): r for r in cut}
    assert plain.keys() == cut.keys()
    for k, r in plain.items():
        for c in ("n", *wanted):
            assert cut[k][c] == pytest.approx(r[c]), (k, c)


def greedy_model(rows, gap):
    kept, last = set(), {}
    for i, key, at, _ in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key not in last or at >= last[key] + gap:
            last[key] = at
            kept.add(i)
    return kept


@pytest.mark.parametrize("cell", [None, 60_000, 11_000])
def test_action_dedup(spark, cell):
    rows = [(i, k, at * 1000, v) for i, k, at, v in skewed(5)]
    got = wn.action_dedup(frame(spark, rows), ["key"], "at", seconds=9, cell=cell)
    assert {r["id"] for r in got.collect()} == greedy_model(rows, 9000)


@pytest.mark.parametrize(("cell", "fold", "spread"), [(None, 1, 1), (20, 3, 1), (7, 10_000, 1), (40, 16, 3)])
def test_action_dedup_of_long_runs(spark, cell, fold, spread):
    """Runs over the fold go by pieces, whatever their number of rows; the gap makes one run of a key or many."""
    rows = [(i, k, at * 1000 * spread, v) for i, k, at, v in skewed(8, times=900)]
    for seconds in (2, 9, 50):
        got = wn.action_dedup(frame(spark, rows), ["key"], "at", seconds=seconds, cell=cell, fold=fold)
        assert sorted(r["id"] for r in got.collect()) == sorted(greedy_model(rows, seconds * 1000))


def test_action_dedup_ids_and_null_keys(spark):
    """Ids that repeat over keys or are null, null keys: a row goes by its own key and time."""
    rows = [(1, "a", 0, 0.0), (1, "a", 5000, 1.0), (1, "b", 5000, 2.0), (None, "c", 0, 3.0), (None, "c", 1000, 4.0), (7, None, 0, 5.0), (8, None, 9000, 6.0), (9, None, 12000, 7.0)]
    for fold in (1, 100):
        got = wn.action_dedup(frame(spark, rows), ["key"], "at", fold=fold)
        assert sorted(r["v"] for r in got.collect()) == [0.0, 2.0, 3.0, 5.0, 7.0]
    assert wn.action_dedup(frame(spark, rows).limit(0), ["key"], "at").count() == 0


def test_action_dedup_without_times(spark):
    rows = spark.createDataFrame([(1, "a", 1000), (2, "a", None), (3, "a", 2000), (4, "a", None)], "id int, key string, at bigint")
    assert {r["id"] for r in wn.action_dedup(rows, ["key"], "at").collect()} == {1, 2, 4}


@pytest.mark.parametrize("cell", [None, 50_000])
def test_delivery_health(spark, cell):
    rows = [(i, k, at * 1000, v) for i, k, at, v in skewed(6)]
    got = wn.delivery_health(frame(spark, rows), "key", "at", n=5, seconds=4, cell=cell)
    want = {}
    for _, k, at, _ in rows:
        n = sum(1 for _, k2, t, _ in rows if k2 == k and at - 4000 <= t <= at)
        if n > 5:
            want[k, at] = n
    assert {(r["key"], r["at"]): r["failures"] for r in got.collect()} == want


@pytest.mark.parametrize("cell", [None, 50])
def test_counter_deltas(spark, cell):
    rows = skewed(7)
    got = wn.counter_deltas(frame(spark, rows).drop("id"), ["key"], "at", ["v"], cell=cell).collect()
    top = {}
    for _, k, at, v in rows:
        top[k, at] = max(v, top.get((k, at), 0.0))
    for r in got:
        before = [at for k, at in top if k == r["key"] and at < r["at"]]
        prior = top[r["key"], max(before)] if before else 0.0
        assert r["v_delta"] == max(0.0, top[r["key"], r["at"]] - prior)
    assert len(got) == len(top)


def test_top_n_limits_before_the_shuffle(spark):
    df = od.top_n(frame(spark, skewed(8)), ["key"], [F.col("at").desc(), F.col("id")], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.groupBy("key").count().agg(F.max("count")).first()[0] == 3


def test_shard_offsets_are_dense(spark):
    from skarn.operators.corpus import shard_assign

    docs = spark.range(500).selectExpr("concat('d', id) as document_id")
    plain = {r["document_id"]: tuple(r) for r in shard_assign(docs, 3).collect()}
    cut = {r["document_id"]: tuple(r) for r in shard_assign(docs, 3, cell=1 << 57).collect()}
    assert plain == cut
    for shard in range(3):
        offsets = sorted(r[2] for r in cut.values() if r[1] == shard)
        assert offsets == list(range(len(offsets)))


def test_a_burst_is_cut_by_number(spark):
    # One key with all its rows in one hour, two thirds of them in one minute, and one row a year before.
    rnd = random.Random(9)
    hour, year = 3_600_000, 365 * 86_400_000
    rows = [(i, "hot", year + (rnd.randrange(60_000) if i % 3 else rnd.randrange(hour)), 1.0) for i in range(20_000)]
    rows += [(-1, "hot", 0, 1.0)] + [(-2 - k, f"k{k}", year + k, 1.0) for k in range(300)]
    df = frame(spark, rows)
    where = od.cuts(df, ["key"], "at", 1000)
    placed = od.with_piece(df, where, ["key"], "at")
    sizes = {(r["key"], r["_piece"]): r["count"] for r in placed.groupBy("key", "_piece").count().collect()}
    hot = [n for (k, _), n in sizes.items() if k == "hot"]
    assert len(hot) == 21 and max(hot) < 2000
    assert len(where.collect()) == 1 and sum(sizes.values()) == len(rows)
    # A window of the pieces is dealt over the tasks, the same places come out at every evaluation.
    assert sorted(map(tuple, where.repartition(3).collect())) == sorted(map(tuple, od.cuts(df.repartition(7), ["key"], "at", 1000).collect()))
    exchange = od.asof_last(df, df, ["key"], "at", "at", ["id"], cell=1000)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k0#" in exchange and "_piece#" in exchange


def test_previous_row(spark):
    rows = list({(k, at): (i, k, at, v) for i, k, at, v in skewed(12)}.values()) + [(9999, None, 5, 0.0), (9998, None, 7, 0.0)]
    for cell in (None, 50, 3):
        got = od.previous_row(frame(spark, rows), ["key"], "at", ["id"], "before", cell=cell).collect()
        assert len(got) == len(rows)
        for r in got:
            earlier = [(at, i) for i, k, at, _ in rows if k == r["key"] and at < r["at"]]
            assert (r["before"] and r["before"]["id"]) == (max(earlier)[1] if earlier else None)


def test_largest_keys_are_cut_first(spark, monkeypatch):
    monkeypatch.setattr(od, "KEYS", 2)
    monkeypatch.setattr(od, "PIECES", 8)
    df = spark.range(1000).selectExpr("id", "cast(floor(sqrt(id)) as string) as key", "id as at", "1.0D as v")
    where = od.cuts(df, ["key"], "at", 5)
    assert {r["key"]: len(r["_starts"]) for r in where.collect()} == {"30": 7, "29": 7}
    got = od.running_total(df, ["key"], "at", "v", "s", cell=5).collect()
    assert all(r["s"] == sum(1 for i in range(1000) if int(i**0.5) == int(r["key"]) and i <= r["at"]) for r in got)


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("key", ["v", "key", "name"])
def test_deep_pages(spark, monkeypatch, desc, key):
    monkeypatch.setattr(wn, "DEEP", 50)
    rows = [(i, k, at, v) for i, k, at, v in skewed(13, 900)] + [(1000 + i, None, 0, None) for i in range(40)]
    df = frame(spark, rows).selectExpr("*", "concat('N', lpad(cast(at % 90 AS string), 2, '0')) AS name").repartition(6)
    number = key == "v"
    every = sorted(df.collect(), key=lambda r: r["id"])
    rank = lambda r: (r[key] is not None, r[key] or 0) if number else (r[key] or "").lower()
    every.sort(key=rank, reverse=desc)
    if desc:
        every = [r for k in sorted({rank(r) for r in every}, reverse=True) for r in sorted((x for x in every if rank(x) == k), key=lambda r: r["id"])]
    for page in (0, 2, 7, 30, 36, 37, 40):
        got = [r["id"] for r in wn.table_page(df, key, "id", desc, page, 25, cell=60).collect()]
        assert got == [r["id"] for r in every[25 * page : 25 * page + 25]], page


def test_a_deep_page_orders_its_pieces_only(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id * 7919 % 20011 AS double) AS v")
    page = wn.table_page(df, "v", "id", page=600, size=25, cell=200)
    where = od.cuts(df.selectExpr("0 AS _all", "v AS _at"), ["_all"], "_at", 200)
    assert len(where.first()["_starts"]) == 99
    assert [r["v"] for r in page.collect()] == sorted(r["v"] for r in df.collect())[15_000:15_025]
