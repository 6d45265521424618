"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skarn.session import scratch_dir

#: Fixed value: a word is a run of characters other than blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written below ``spark.checkpoint.dir`` and read back.

    Cuts lineage and keeps work done once from being done twice; a lost executor costs a read.
    """
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of the batches that go to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limits for Arrow batches to those above: a batch of whole texts is large.

    Both sides hold a batch or two, outside the heap, for each task.
    """
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for name, most in limits.items():
        now = spark.conf.get(name).lower().removesuffix("b")
        if now.isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker holds as Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_slices(fn, *columns: pa.Array, rows: int = 512) -> pa.Array:
    """``fn`` of a few values of each column at a time; gives one column."""
    parts = [fn(*(c.slice(at, rows) for c in columns)) for at in range(0, max(1, len(columns[0])), rows)]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
