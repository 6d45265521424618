"""Streams in several batches and over restarts."""

import random
from contextlib import contextmanager
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from skarn.operators import joins as jn, quality as ql, windows as wn
from skarn.sources import tables as tb
from skarn.streaming import changes, jobs, state

T0 = datetime(2024, 1, 1)


def files(spark, folder, schema, batches):
    """One JSON file per batch, named in order."""
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS").json(f"{folder}/{i:02}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(f"{folder}/*")


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "id bigint, v double"
    for round_ in range(3):
        rows = [(round_ * 10 + i, float(i)) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").json(src)
        stream = tb.jsonl_stream(spark, src, schema, max_files=1)
        jobs.append_rows(stream, out, check).awaitTermination()
    ids = [r["id"] for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == list(range(30))


def test_watermark_drops_late_rows(spark, tmp_path):
    tele = "node_id string, device_id string, ts timestamp, utilization_pct double, temperature_c double, power_draw_w double, hbm_bandwidth_gbps double, pcie_bandwidth_gbps double"
    row = lambda h, u: ("n", "g", T0 + timedelta(hours=h), u, 1.0, 1.0, -1.0, 2.0)
    stream = files(spark, str(tmp_path / "in"), tele, [
        [row(0.2, 10.0), row(0.3, 20.0)], [row(8, 5.0)], [row(8.5, 6.0)], [row(0.4, 99.0), row(14, 1.0)]])
    out = str(tmp_path / "out")
    jobs.append_rows(jobs.hourly_rollup(stream), out, str(tmp_path / "c")).awaitTermination()
    rows = {r["hour"]: r for r in spark.read.parquet(out).collect()}
    assert set(rows) == {T0, T0 + timedelta(hours=8)}
    assert rows[T0]["sample_count"] == 2 and rows[T0 + timedelta(hours=8)]["sample_count"] == 2 and rows[T0]["max_utilization_pct"] == 20.0
    assert rows[T0]["avg_hbm_bandwidth_gbps"] is None and rows[T0]["avg_pcie_bandwidth_gbps"] == 2.0


@contextmanager
def arrow_rows(spark, n):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("n, shuffled", [(1, True), (20, True), (10_000, True), (7, False)])
def test_action_gap_over_batches(spark, tmp_path, n, shuffled):
    rnd = random.Random(1)
    schema = "id string, k string, at timestamp"
    times = sorted(rnd.randrange(200) for _ in range(90))
    rows = [(f"a{i:03}", rnd.choice("xy"), T0 + timedelta(seconds=t)) for i, t in enumerate(times)]
    given = rnd.sample(rows, len(rows)) if shuffled else rows
    end = [("end", "z", T0 + timedelta(hours=9))]  # moves the watermark past all others
    stream = files(spark, str(tmp_path / "in"), schema, [given[:30], given[30:60] + [("none", "x", None)], given[60:], end])
    out = str(tmp_path / "out")
    with state.rocksdb(spark), arrow_rows(spark, n):
        jobs.append_rows(state.action_dedup(stream, ["k"], "at", lateness="1 hour"), out, str(tmp_path / "c")).awaitTermination()
    batch = wn.action_dedup(spark.createDataFrame(rows, schema), ["k"], "at")
    got = sorted(r["id"] for r in spark.read.parquet(out).collect())
    assert got == sorted([*(r["id"] for r in batch.collect()), "none"]) and 0 < len(got) < 90


@pytest.mark.parametrize("n", [1, 20, 10_000])
def test_alert_join_is_the_batch_join(spark, tmp_path, n):
    rnd = random.Random(2)
    at = lambda s: T0 + timedelta(seconds=s)
    alert = "alert_id string, node_id string, triggered_at timestamp"
    sample = "node_id string, device_id string, timestamp_ms bigint, utilization_pct double, temperature_c double, power_draw_w double"
    told = [(f"n{rnd.randrange(3)}", f"g{rnd.randrange(3)}", 1704067200000 + 1000 * rnd.randrange(20_000), rnd.random(), 1.0, 2.0) for _ in range(120)]
    told = list({r[:3]: r for r in told}.values())
    asked = [(f"a{i}", f"n{rnd.randrange(4)}", at(rnd.randrange(20_000))) for i in range(60)]
    end = [("n9", "g", 1704067200000 + 10**9, 0.0, 0.0, 0.0)]
    rnd.shuffle(told)
    alerts = files(spark, str(tmp_path / "a"), alert, [asked[:30], asked[30:]])
    telemetry = files(spark, str(tmp_path / "t"), sample, [told[:70], told[70:], end])
    out = str(tmp_path / "out")
    with state.rocksdb(spark), arrow_rows(spark, n):
        jobs.append_rows(state.alert_join(alerts, telemetry, lateness="10 hours"), out, str(tmp_path / "c")).awaitTermination()
    batch = jn.alert_telemetry_join(
        spark.createDataFrame(asked, alert), spark.createDataFrame(told, sample).withColumn("ts", F.timestamp_millis("timestamp_ms"))
    )
    fields = ["alert_id", "gpu_utilization_pct", "gpu_device_id"]
    got, want = ({tuple(r) for r in df.select(fields).collect()} for df in (spark.read.parquet(out), batch))
    assert got == want and len(want) == 60 and any(r[1] is None for r in want)


def test_alert_join_waits_for_telemetry(spark, tmp_path):
    alert = "alert_id string, node_id string, triggered_at timestamp"
    sample = "node_id string, device_id string, timestamp_ms bigint, utilization_pct double, temperature_c double, power_draw_w double"
    at = lambda m: T0 + timedelta(minutes=m)
    ms = lambda m: 1704067200000 + m * 60_000
    alerts = files(spark, str(tmp_path / "a"), alert, [
        [("early", "n1", at(0)), ("lonely", "n2", at(0))], [("later", "n1", at(20))], [("stale", "n1", at(300))], [("end", "n9", at(900))]])
    told = files(spark, str(tmp_path / "t"), sample, [
        [("n3", "g", ms(0), 1.0, 1.0, 1.0)], [("n1", "g0", ms(10), 9.0, 2.0, 3.0)], [("n3", "g", ms(301), 1.0, 1.0, 1.0)], [("n3", "g", ms(902), 1.0, 1.0, 1.0)]])
    out = str(tmp_path / "out")
    with state.rocksdb(spark):
        jobs.append_rows(state.alert_join(alerts, told), out, str(tmp_path / "c")).awaitTermination()
    got = {r["alert_id"]: r["gpu_utilization_pct"] for r in spark.read.parquet(out).collect()}
    assert got == {"early": 9.0, "later": 9.0, "lonely": None, "stale": None}


def test_compacted_table_over_batches(spark, tmp_path):
    schema = "id string, status string, at bigint"
    batches = [[("a", "new", 1), ("b", "new", 1)], [("a", "done", 5), ("c", "new", 2)], [("a", "late", 3), ("b", "done", 9)]]
    stream = files(spark, str(tmp_path / "in"), schema, batches)
    out = str(tmp_path / "out")
    jobs.compact_latest(stream, ["id"], "at", out, str(tmp_path / "c"), buckets=3).awaitTermination()
    assert {tuple(r)[:3] for r in spark.read.parquet(out).collect()} == {("a", "done", 5), ("b", "done", 9), ("c", "new", 2)}
    # A query that starts over, with a checkpoint of its own, loses nothing; one of another shape fails.
    more = files(spark, str(tmp_path / "in2"), schema, [[("d", "new", 4), ("b", "old", 2)]])
    jobs.compact_latest(more, ["id"], "at", out, str(tmp_path / "c2"), buckets=3).awaitTermination()
    assert {tuple(r)[:2] for r in spark.read.parquet(out).collect()} == {("a", "done"), ("b", "done"), ("c", "new"), ("d", "new")}
    other = files(spark, str(tmp_path / "in3"), "id string, at bigint", [[("e", 1)]])
    with pytest.raises(StreamingQueryException, match="another table"):
        jobs.compact_latest(other, ["id"], "at", out, str(tmp_path / "c3"), buckets=3).awaitTermination()


def test_change_view_over_batches_and_merges(spark, tmp_path):
    schema, out = "id string, status string, at bigint", str(tmp_path / "out")
    view = lambda: changes.latest_view(spark, out, ["id"], "at", schema)
    merge = lambda: changes.merge_changes(spark, out, ["id"], "at", fan=2)
    folders = lambda: [n for n in tb.complete_folders(spark, out) if n.startswith("changes-")]
    assert view().collect() == [] and merge() == 0

    batches = [[("a", "new", 1), ("b", "new", 1)], [("a", "done", 5), ("a", "old", 4)], [("a", "late", 3), ("b", "again", 1), (None, "x", 1)]]
    stream = files(spark, str(tmp_path / "in"), schema, batches)
    changes.append_changes(stream, ["id"], "at", out, str(tmp_path / "c")).awaitTermination()
    # A batch writes one row per key of its own; of one version the later batch counts.
    assert sorted(spark.read.parquet(f"{out}/{n}").count() for n in folders()) == [1, 2, 3]
    want = [(None, "x", 1), ("a", "done", 5), ("b", "again", 1)]
    key = lambda r: (r[0] is not None, r)
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, str(r)))
    assert got(view()) == sorted(want, key=key)

    # A reader from before a merge goes on; what was merged goes with the next merge.
    before = view()
    assert merge() == 1 and len(folders()) == 4
    assert got(before) == got(view()) == sorted(want, key=key)
    assert merge() == 0 and len(folders()) == 1
    # A batch that runs again after its folder went, and a folder that was not finished, change nothing.
    query = spark.read.json(f"{tmp_path}/c/metadata").first()["id"]
    again = spark.createDataFrame([("a", "new", 1, 0), ("b", "new", 1, 0)], f"{schema}, _batch bigint")
    again.write.parquet(f"{out}/changes-0-{query}-0")
    again.withColumn("at", F.lit(99).cast("bigint")).write.parquet(f"{out}/changes-0-half")
    (tmp_path / "out" / "changes-0-half" / "_SUCCESS").unlink()
    assert got(view()) == sorted(want, key=key)

    # A query that starts over adds to the table; many batches leave few folders; another shape fails.
    more = files(spark, str(tmp_path / "in2"), schema, [[("d", "new", i), ("b", "old", 0)] for i in range(3)])
    changes.append_changes(more, ["id"], "at", out, str(tmp_path / "c2")).awaitTermination()
    merge(), merge()
    assert len(folders()) <= 3
    assert got(view()) == sorted([*want, ("d", "new", 2)], key=key)
    other = files(spark, str(tmp_path / "in3"), "id string, at bigint", [[("e", 1)]])
    with pytest.raises(StreamingQueryException, match="another table"):
        changes.append_changes(other, ["id"], "at", out, str(tmp_path / "c3")).awaitTermination()


def test_dual_sink_retry_replaces_a_batch(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), "id bigint", [[(1,), (2,)], [(3,), (4,)]])
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    for run in ("c1", "c2"):  # a second checkpoint replays both batches
        tb.sink_dual(stream, F.col("id") % 2 == 0, ok, bad, str(tmp_path / run)).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(ok).collect()) == [1, 3]
    assert sorted(r["id"] for r in spark.read.parquet(bad).collect()) == [2, 4]


def test_quality_monitor_per_batch(spark, tmp_path):
    stream = files(spark, str(tmp_path / "in"), "a bigint", [[(1,), (None,)], [(2,)]])
    out = str(tmp_path / "out")
    jobs.quality_monitor(stream, [ql.not_null("a")], "s", out, str(tmp_path / "c")).awaitTermination()
    got = sorted((r["run_at"], r["success"]) for r in spark.read.parquet(out).collect())
    assert got == [("batch-0", False), ("batch-1", True)]


def test_seen_events_across_polls(spark, tmp_path):
    schema = "id string, ts timestamp"
    polls = [[("a", T0), ("b", T0)], [("a", T0), ("c", T0 + timedelta(minutes=5))], [("c", T0 + timedelta(minutes=5))]]
    stream = files(spark, str(tmp_path / "in"), schema, polls)
    out = str(tmp_path / "out")
    jobs.append_rows(jobs.seen_events(stream, "id", "ts"), out, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_corpus_job_keeps_rejected_copies(spark, tmp_path):
    schema = "document_id string, doc_id bigint, source string, raw_text string, language string, file_path string, ingested_ms bigint, ingested_at timestamp"
    doc = lambda i, text, lang: (f"d{i}", i, "s", text, lang, "f", i, T0)
    stream = files(spark, str(tmp_path / "in"), schema, [[doc(1, "Same text", "en"), doc(2, "texte", "fr")], [doc(3, "same  TEXT", "en"), doc(4, "texte", "fr")]])
    out = str(tmp_path / "out")
    jobs.corpus_job(stream, out, str(tmp_path / "c"), language=F.col("language")).awaitTermination()
    assert [r["document_id"] for r in spark.read.parquet(f"{out}/clean").collect()] == ["d1"]
    assert sorted(r["document_id"] for r in spark.read.parquet(f"{out}/rejected").collect()) == ["d2", "d4"]
    assert spark.read.text(f"{out}/metadata").count() == 1


class _Value:
    def __init__(self, calls):
        self.v, self.calls = None, calls

    def exists(self):
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.calls.append("value")
        self.v = v

    put = update

    def clear(self):
        self.v = None


class _Map(dict):
    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def getValue(self, key):
        self.calls.append("get")
        return self[key]

    def updateValue(self, key, value):
        self.calls.append("put")
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def containsKey(self, key):
        return key in self


class _Handle:
    """State of one key in memory, with its calls counted."""

    def __init__(self):
        self.calls, self.timers, self.maps = [], set(), []

    def getMapState(self, *_):
        self.maps.append(_Map(self.calls))
        return self.maps[-1]

    def getValueState(self, *_):
        return _Value(self.calls)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def to(self, processor, watermark):
        """Fires the timers that a watermark has passed."""
        class Now:
            getCurrentWatermarkInMs = staticmethod(lambda: watermark)

        out = []
        for at in sorted(t for t in self.timers if t <= watermark):
            self.timers.discard(at)
            class Fired:
                getExpiryTimeInMs = staticmethod(lambda at=at: at)
            out += list(processor.handleExpiredTimer(None, Now, Fired))
        return pd.concat(out) if out else pd.DataFrame()


def test_alert_state_calls_go_with_parts_not_rows():
    handle, processor = _Handle(), state.AlertGpuProcessor(3_600_000)
    processor.init(handle)
    minutes = range(0, 30 * 1440, 10)  # a month, a row every ten minutes
    rows = pd.DataFrame({"at_ms": [m * 60_000 for m in minutes], "is_alert": [i % 5 == 0 for i in range(len(minutes))]})
    rows["alert"] = [f"a{m}" if a else None for m, a in zip(minutes, rows["is_alert"])]
    for n, kind in zip(state.GPU.values(), (1.0, 2.0, 3.0, "g")):
        rows[n] = [None if a else kind for a in rows["is_alert"]]
    assert list(processor.handleInputRows(None, iter([rows[2000:], rows[:2000]]), None)) == []
    half = handle.to(processor, 15 * 86_400_000)
    assert handle.timers and min(handle.timers) > 15 * 86_400_000 and len(handle.timers) == 1
    rest = handle.to(processor, 60 * 86_400_000)
    done = pd.concat([half, rest])
    assert sorted(done["alert"]) == sorted(rows["alert"].dropna()) and (done["gpu_utilization_pct"] == 1.0).all()
    assert len(half) == 15 * 1440 // 50 + 1 and not handle.timers and not handle.maps[0]
    assert len(handle.calls) < len(rows) / 4  # before: several a row


def test_gap_state_calls_go_with_parts_not_rows():
    handle, processor = _Handle(), state.ActionGapProcessor(86_400_000, ["id"])
    processor.init(handle)
    rows = pd.DataFrame({"id": range(4320), "row_id": range(4320), "at_ms": [m * 600_000 for m in range(4320)]})
    list(processor.handleInputRows(None, iter([rows]), None))
    kept = handle.to(processor, 40 * 86_400_000)
    assert kept["id"].tolist() == list(range(0, 4320, 144)) and not handle.timers
    assert len(handle.calls) < len(rows) / 4  # before: several a row


def test_gap_state_calls_go_with_rows_not_time(monkeypatch):
    # Three years with a row every seven hours, in no order: nearly every row has a span of its own.
    monkeypatch.setattr(state, "RUN_ROWS", 1000, raising=False)
    monkeypatch.setattr(state, "PART_ROWS", 50, raising=False)
    handle, processor = _Handle(), state.ActionGapProcessor(86_400_000, ["id"])
    processor.init(handle)
    times = [i * 25_200_000 for i in range(3754)] * 2  # two rows an instant
    rows = pd.DataFrame({"id": range(len(times)), "row_id": range(len(times)), "at_ms": times}).sample(frac=1, random_state=3)
    list(processor.handleInputRows(None, (rows[i:i + 400] for i in range(0, 5000, 400)), None))
    list(processor.handleInputRows(None, iter([rows[5200:].astype({"at_ms": "float64"})]), None))
    kept = pd.concat([handle.to(processor, day * 86_400_000) for day in (100, 101, 500, 2000)])
    assert kept["id"].tolist() == list(range(0, 3754, 4))  # seven hours four times is the first that is over a day
    assert not handle.timers and not handle.maps[0]
    assert len(handle.calls) < len(rows) / 4  # before: two a row


def test_alert_state_calls_go_with_rows_not_time(monkeypatch):
    # Alerts of three years, each with samples before, at or after it, or none near; in no order and in several runs.
    monkeypatch.setattr(state, "RUN_ROWS", 900, raising=False)
    monkeypatch.setattr(state, "PART_ROWS", 40, raising=False)
    rnd, hour, rows, want = random.Random(4), 3_600_000, [], {}
    for i in range(3000):
        at = (i + 1) * 9 * hour
        rows.append((at, True, f"a{i}", None))
        near = rnd.choice([(), (-hour + 1,), (-hour,), (0, 0), (hour - 1,), (hour,), (-60_000, 5), (-2 * hour, 7)])
        fit = [d for d in near if -hour < d <= 0] or [d for d in near if 0 < d < hour]
        rows += [(at + d, False, None, f"g{i}-{n}") for n, d in enumerate(near)]
        want[f"a{i}"] = max((f"g{i}-{n}" for n, d in enumerate(near) if d in fit[:1]), default=None)
    given = pd.DataFrame(rows, columns=["at_ms", "is_alert", "alert", "gpu_device_id"]).sample(frac=1, random_state=5)
    for n in list(state.GPU.values())[:3]:
        given[n] = [None if a else 1.0 for a in given["is_alert"]]
        given[n] = given[n].astype("float64")
    handle, processor = _Handle(), state.AlertGpuProcessor(hour)
    processor.init(handle)
    list(processor.handleInputRows(None, (given[i:i + 500] for i in range(0, len(given), 500)), None))
    done = pd.concat([handle.to(processor, day * 86_400_000) for day in (100, 101, 500, 2000)])
    got = dict(zip(done["alert"], done["gpu_device_id"].astype(object).where(done["gpu_device_id"].notna(), None)))
    assert got == want and len(done) == 3000 and None in want.values()
    assert not handle.timers and not handle.maps[0]
    assert len(handle.calls) < len(rows) / 4  # before: one a row and more


def test_alert_enrichment_uses_the_spans(spark, tmp_path):
    # A day of alerts and samples every 20 seconds: rows enough that calls to the state for each would show.
    ids = spark.range(4320).withColumn("at", F.timestamp_seconds(1704067200 + F.col("id") * 20))
    alerts = ids.filter("id % 4 = 0").selectExpr("concat('a', id) alert_id", "'n1' node_id", "at triggered_at", "'s' k8s_namespace", "'p' k8s_pod_name")
    told = ids.filter("id % 4 <> 0").selectExpr("'n1' node_id", "'g' device_id", "unix_millis(at) timestamp_ms", "id * 1D utilization_pct", "1D temperature_c", "1D power_draw_w")
    for name, rows in (("a", alerts), ("t", told)):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    nodes = spark.createDataFrame([("n1", "host", 8)], "node_id string, hostname string, gpu_count int")
    pods = spark.createDataFrame([("s", "p", "Running", 1, 1)], "namespace string, pod_name string, phase string, timestamp_ms bigint, event_id bigint")
    stream = lambda name: tb.parquet_stream(spark, str(tmp_path / name))
    out = str(tmp_path / "out")
    job = jobs.alert_job(stream("a"), stream("t"), nodes, pods, out, str(tmp_path / "c"), "0 seconds")
    job.awaitTermination()
    body = F.from_json("value", "alert_id string, gpu_utilization_pct double, pod_phase string").alias("r")
    got = {r["alert_id"]: tuple(r)[1:] for r in spark.read.schema("key string, value string").parquet(out).select(body).select("r.*").collect()}
    assert got == {f"a{i}": (float(i - 1 if i else 1), "Running") for i in range(0, 4320, 4)}
    assert state.SPAN_MS >= 3_600_000


def test_state_partitions_go_with_the_cluster(spark, tmp_path):
    # Partitions of the state cost time in every batch, with rows or without; before there were as many as shuffles have.
    alerts, told = "alert_id string, node_id string, triggered_at timestamp", "node_id string, device_id string, timestamp_ms long, utilization_pct double, temperature_c double, power_draw_w double"
    ms = int(T0.timestamp() * 1000)
    asked = files(spark, str(tmp_path / "a"), alerts, [[(f"a{i}", f"n{i}", T0) for i in range(40)]])
    samples = files(spark, str(tmp_path / "t"), told, [[(f"n{i}", "g", ms + i, float(i), 1.0, 1.0) for i in range(40)]])
    nodes = spark.createDataFrame([], "node_id string, hostname string, gpu_count int")
    pods = spark.createDataFrame([("s", "p", "Running", 1, 1)], "namespace string, pod_name string, phase string, timestamp_ms bigint, event_id bigint")
    asked = asked.withColumns({"k8s_namespace": F.lit("s"), "k8s_pod_name": F.lit("p")})
    out, check, name = str(tmp_path / "out"), tmp_path / "c", "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "48")
        job = jobs.alert_job(asked, samples, nodes, pods, out, str(check), "0 seconds")
        job.awaitTermination()
        assert spark.conf.get(name) == "48"
        most = max(2 * spark.sparkContext.defaultParallelism, state.STORES)
        assert most < 48 and state.stores(spark) == most
        spark.conf.set(name, "4")
        assert state.stores(spark) == 4
    finally:
        spark.conf.set(name, before)
    assert len([d for d in (check / "state" / "0").iterdir() if d.name.isdigit()]) == most
    got = [r["key"] for r in spark.read.schema("key string, value string").parquet(out).collect()]
    assert sorted(got) == sorted(f"n{i}:a{i}" for i in range(40))


def test_pod_events_are_taken_once(spark):
    # Batches join the latest events themselves, a row per pod, and do not aggregate all events anew.
    kind = "namespace string, pod_name string, phase string, timestamp_ms bigint, event_id bigint"
    events = spark.createDataFrame(
        [("s", "p", "Running", 5, 1), ("s", "p", "Failed", 5, 2), ("s", "p", "Pending", 4, 9), ("s", None, "Failed", 1, 1), ("t", "p", None, 7, 3), ("t", "p", "Running", 6, 4)], kind
    )
    pods = jn.latest_pods(events)
    assert sorted(map(tuple, pods.select("namespace", "pod_name", "phase", "timestamp_ms", "event_id").collect()), key=str) == sorted(
        [("s", "p", "Failed", 5, 2), ("s", None, "Failed", 1, 1), ("t", "p", None, 7, 3)], key=str
    )
    asked = spark.createDataFrame([("a", "s", "p"), ("b", "t", "p"), ("c", "u", "p"), ("d", "s", None)], "alert_id string, k8s_namespace string, k8s_pod_name string")
    rows = lambda df: sorted(map(tuple, df.select("alert_id", "pod_phase", "namespace").collect()))
    small = spark.createDataFrame(pods.collect(), pods.schema)
    taken = jn.k8s_enrich(asked, small, latest=True)
    assert rows(taken) == rows(jn.k8s_enrich(asked, events)) == [("a", "Failed", "s"), ("b", "Unknown", "t"), ("c", "Unknown", "u"), ("d", "Unknown", "s")]
    assert "Aggregate" not in taken._jdf.queryExecution().optimizedPlan().toString()
