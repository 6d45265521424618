"""Latest row per key over append-only change files, merged when read and by a job of their own.

A batch writes the latest rows of its own keys as one folder and reads nothing.  A reader takes the
latest row per key of all folders in one aggregate.  ``merge_changes``, run on a schedule, puts the
folders of a level together as one of the next, once there are ``fan``: a row is written again
once per level, and fewer than ``fan`` folders a level are left to read.

Folders are never changed.  A merged folder is followed by a list of those it stands for; until the
list is complete a reader takes both, which gives the same rows.  The folders of a list go with
the next merge, so whoever began to read before a merge has until the one after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.sources.tables import complete_folders, remove_folders, run_batches

#: Beginnings of the names of change folders (then level and name) and of lists (then name).
CHANGES, LIST = "changes", "replaced"


def append_changes(
    stream: DataFrame, keys: list[str], version: str, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write every batch as a change folder of its own; a retry replaces the folder of its batch.

    Names hold the id of the query, so a query that starts over adds to what is there.  A table of
    other columns is another query's, which is an error.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        query = spark.read.json(f"{checkpoint}/metadata").first()["id"]
        rows = batch.withColumn("_batch", F.lit(batch_id).cast("bigint"))
        live = _live(spark, path)
        if live and set(spark.read.parquet(f"{path}/{live[0]}").columns) != set(rows.columns):
            raise ValueError(f"{path} holds another table")
        _latest(rows, keys, version).write.mode("overwrite").parquet(f"{path}/{CHANGES}-0-{query}-{batch_id}")

    return run_batches(stream, write, checkpoint, **trigger)


def latest_view(spark: SparkSession, path: str, keys: list[str], version: str, schema=None) -> DataFrame:
    """The latest row per key of all changes so far.

    Of one version the later batch of a query counts, then the higher row.  ``schema`` is what a
    table without a change yet has.
    """
    live = _live(spark, path)
    if not live:
        return spark.createDataFrame([], schema)
    return _latest(_rows(spark, path, live), keys, version).drop("_batch")


def merge_changes(spark: SparkSession, path: str, keys: list[str], version: str, fan: int = 8) -> int:
    """Merge every level of ``fan`` folders or more into one folder of the next; returns the merges.

    One such job runs at a time; streams and readers go on meanwhile.
    """
    lists = [n for n in complete_folders(spark, path) if n.startswith(f"{LIST}-")]
    remove_folders(spark, [f"{path}/{n}" for n in _replaced(spark, path, lists)])
    remove_folders(spark, [f"{path}/{n}" for n in lists])
    level = merges = 0
    live = _live(spark, path)
    while any(_level(n) >= level for n in live):
        parts = [n for n in live if _level(n) == level]
        level += 1
        if len(parts) < fan:
            continue
        name = f"{CHANGES}-{level}-{uuid.uuid4().hex}"
        _latest(_rows(spark, path, parts), keys, version).write.parquet(f"{path}/{name}")
        told = spark.createDataFrame([(n,) for n in parts], "value string").coalesce(1)
        told.write.text(f"{path}/{LIST}-{name}")
        live = [n for n in live if n not in parts] + [name]
        merges += 1
    return merges


def _level(name: str) -> int:
    return int(name.split("-")[1])


def _live(spark: SparkSession, path: str) -> list[str]:
    """Complete change folders that no complete list names."""
    # Lists come before the folders they stand behind are looked at: a complete list has its folder.
    names = sorted(complete_folders(spark, path), reverse=True)
    replaced = _replaced(spark, path, [n for n in names if n.startswith(f"{LIST}-")])
    return [n for n in names if n.startswith(f"{CHANGES}-") and n not in replaced]


def _replaced(spark: SparkSession, path: str, lists: list[str]) -> set[str]:
    """Names in lists: the folders of the last merges."""
    return {r["value"] for r in spark.read.text([f"{path}/{n}" for n in lists]).collect()} if lists else set()


def _rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    first = spark.read.parquet(f"{path}/{names[0]}")
    return spark.read.schema(first.schema).parquet(*[f"{path}/{n}" for n in names])


def _latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, version, "_batch")]
    top = rows.groupBy(*keys).agg(F.max(F.struct(version, "_batch", *rest)).alias("_row"))
    return top.select(*[F.col(c if c in keys else f"_row.{c}").alias(c) for c in rows.columns])
