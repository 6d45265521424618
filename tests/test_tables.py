"""Tables, files, registry and plans."""

import csv
import glob
from datetime import datetime, timezone

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skarn.operators import joins as jn, ordered as od, quality as ql, registry as rg, windows as wn
from skarn.plans.corpus import corpus_clean, training_dataset
from skarn.sources import parsers as ps, schemas, tables as tb


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_create_tables(spark, tmp_path):
    names = schemas.create_tables(spark, str(tmp_path), versions=(1, 2))
    assert len(names) == 12 and names[-1] == "gold.training_dataset_v2"
    for table in schemas.TABLES:
        assert [f.name for f in spark.table(table.name).schema].sort() == [f.name for f in table.schema].sort()
        assert set(table.partitions) <= set(table.schema.names)
    assert schemas.create_tables(spark, str(tmp_path)) == names[:-1]
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_clustered_files_hold_narrow_ranges(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 2).alias("day"), (F.hash("id") % 1000).alias("k"))
    path = str(tmp_path / "t")
    tb.write_clustered(rows, path, ["day"], ["k"], files=8)
    for day in (0, 1):
        stats = []
        for f in glob.glob(f"{path}/day={day}/*.parquet"):
            column = pq.ParquetFile(f).metadata.row_group(0).column(0).statistics
            stats.append((column.min, column.max))
        stats.sort()
        assert len(stats) > 1 and all(a[1] <= b[0] for a, b in zip(stats, stats[1:]))


def test_compaction_keeps_other_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id", "id % 2 as p").repartition(5).write.partitionBy("p").parquet(path)
    tb.compact_table(spark, path, "p = 0", 1)
    assert len(glob.glob(f"{path}/p=0/*.parquet")) == 1 and len(glob.glob(f"{path}/p=1/*.parquet")) > 1
    assert spark.read.parquet(path).agg(F.sum("id")).first()[0] == 4950
    assert not glob.glob(f"{tmp_path}/*__*") and not glob.glob(f"{path}/.spark*")
    many = str(tmp_path / "many")
    spark.range(1000).selectExpr("id", "id % 10 as p").repartition(8).write.partitionBy("p").parquet(many)
    tb.compact_table(spark, many, "true", 4, keys=["id"])
    assert len(glob.glob(f"{many}/*/*.parquet")) <= 4 + 10 and spark.read.parquet(many).agg(F.sum("id")).first()[0] == 499_500
    with pytest.raises(ValueError):
        spark.range(5).write.parquet(str(tmp_path / "flat"))
        tb.compact_table(spark, str(tmp_path / "flat"), "id > 1", 1)


def test_expired_days_are_deleted(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40).selectExpr("id", "date_add(date'2024-01-01', cast(id % 20 as int)) as day").write.partitionBy("day").parquet(path)
    gone = tb.remove_expired(spark, path, "day", 5, "2024-01-20")
    assert gone[0] == "2024-01-01" and gone[-1] == "2024-01-14" and len(glob.glob(f"{path}/day=*")) == 6
    assert spark.read.parquet(path).count() == 12


def test_merge_by_key_keeps_rows_whole(spark):
    a = spark.createDataFrame([(1, 5, 0), (1, 2, 9)], "k int, x int, y int")
    b = spark.createDataFrame([(2, "z")], "k int, w string")
    got = {r["k"]: tuple(r) for r in od.merge_by_key(["k"], a, b).collect()}
    assert got == {1: (1, 5, 0, None), 2: (2, None, None, "z")}


def test_records_that_are_no_objects(spark):
    rows = spark.createDataFrame([("[1]",), ("5",), ("{",), ('{"a": 1}',)], "value string")
    got = [r["reason"] for r in ps.validate_records(rows, {"a": "int"}).collect()]
    assert got == ["not a JSON object"] * 3 + [None]


def test_csv_text(spark, tmp_path):
    rows = [("1", 'say "hi", you', None), ("2", "line\nbreak", "")]
    tb.export_csv(spark.createDataFrame(rows, "a string, b string, c string").coalesce(1), str(tmp_path / "c"))
    text = open(glob.glob(f"{tmp_path}/c/*.csv")[0], newline="").read()
    assert text.splitlines()[0] == '"a","b","c"' and '"say ""hi"", you"' in text
    assert list(csv.reader(text.splitlines(keepends=True)))[1:] == [["1", 'say "hi", you', ""], ["2", "line\nbreak", ""]]


def test_time_range_prunes_partitions(spark, tmp_path, views):
    path = str(tmp_path / "t")
    views.telemetry.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    table = spark.read.parquet(path)
    rows = tb.time_range(table, "ts", "2024-01-05 06:00:00", "2024-01-06 06:00:00", date="date")
    scan = next(line for line in plan_of(rows).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(date" in scan and "GreaterThanOrEqual(ts" in scan
    plain = views.telemetry.filter("ts between timestamp_ntz'2024-01-05 06:00:00' and timestamp_ntz'2024-01-06 06:00:00'")
    assert rows.count() == plain.count() > 0


def test_registry(spark, tmp_path):
    base = str(tmp_path / "r")
    when = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    one = rg.register_version(spark, base, "silver.clean", "me", {"web": 5}, {"mean": 0.5}, 3, when(1))
    two = rg.register_version(spark, base, "silver.clean", "me", {}, {}, 4, when(2))
    assert rg.get_version(spark, base, one)["used_in_run_ids"] == []
    for d, run in ((3, "run-1"), (4, "run-10"), (5, "run-1")):
        rg.mark_used(spark, base, one, run, when(d))
    got = rg.get_version(spark, base, one)
    assert (got["used_in_run_ids"], got["token_count_by_source"], got["snapshot_version"]) == (["run-1", "run-10", "run-1"], {"web": 5}, 3)
    assert rg.get_version(spark, base, two)["used_in_run_ids"] == []
    with pytest.raises(KeyError):
        rg.get_version(spark, base, "none")


def test_versions_are_immutable(spark, tmp_path, views):
    data = training_dataset(corpus_clean(views.corpus, F.col("language")), 4)
    path = rg.write_version(data, str(tmp_path), 1, ["source", "quality_tier"])
    assert spark.read.parquet(path).count() == data.count() > 0
    with pytest.raises(Exception, match="already exists"):
        rg.write_version(data, str(tmp_path), 1, ["source", "quality_tier"])


def test_event_log_and_sync(spark, tmp_path):
    path = str(tmp_path / "log")
    for d in (1, 2):
        rg.log_event(spark, path, "simulate", f"run {d}", datetime(2024, 1, d))
    log = spark.read.parquet(path)
    assert log.count() == 2
    feed = log.select(F.col("source").alias("pipeline"), F.col("created_at").alias("finished_at"),
                      F.lit("ok").alias("status"), F.lit(1).alias("event_id"))
    assert wn.sync_status(feed).first()["last_success"] == datetime(2024, 1, 2)


def test_run_suite_stores_results(spark, tmp_path):
    store = str(tmp_path / "q")
    df = spark.createDataFrame([(1, 5.0), (1, None), (None, 500.0)], "a int, b double")
    suite = [ql.not_null("a"), ql.unique("a"), ql.between("b", 0, 100), ql.row_count(1), ql.in_set("a", [1, 2])]
    ok, message, rows = ql.run_suite(df, suite, "s", "now", store)
    assert not ok and "3 of 5" in message
    ql.run_suite(df, suite, "s", "later", store)
    ql.run_suite(df, suite, "s", "later", store)
    saved = spark.read.parquet(store)
    assert saved.count() == 10
    got = {r["expectation"]: r for r in rows.collect()}
    assert (got["unique"]["unexpected_count"], got["between"]["unexpected_pct"], got["not_null"]["unexpected_pct"]) == (2, 50.0, 33.333333)
    empty = ql.validate(df.limit(0), suite, "s", "now").collect()
    assert {r["expectation"] for r in empty if not r["success"]} == {"row_count"}


def test_corpus_counts(views):
    docs = views.corpus
    clean = corpus_clean(docs, F.col("language"))
    assert docs.count() == 200 and clean.count() == 120


BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def test_no_cross_joins(views, spark):
    v = views
    frames = {
        "pit": jn.pit_join(v.entity_rows, v.user_features, ["user_id"], "event_ms", "feature_ms", 60),
        "routes": jn.zone_route_alerts(v.zones, v.routes),
        "crews": jn.crew_in_zone(v.crews, v.zones),
        "nearest": jn.nearest_crew(v.zones, v.crews),
        "backward": jn.lineage_backward(v.runs, v.version_runs, v.registry, v.corpus),
        "recent": jn.recent_action_antijoin(v.actions, v.actions),
    }
    for name, df in frames.items():
        assert not any(b in plan_of(df) for b in BAD), name


def test_corpus_plan(views):
    text = plan_of(corpus_clean(views.corpus, F.col("language")))
    assert "PushedFilters: [EqualNullSafe(lang,en)]" in text or "lang" in text.split("PushedFilters")[1][:60]
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "PythonUDF" not in text and "ArrowEvalPython" not in text
