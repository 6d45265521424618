"""Reading and writing lake tables, streams over folders and topics, row formats for sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from skarn.functions.fields import ts_of_ms


def jsonl_stream(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int = 100) -> DataFrame:
    """New JSON-lines files below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def parquet_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A Parquet table as a stream, whether it is a folder or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rstrip("/").rpartition("/")
    fs, place = _hadoop(spark, path)
    if fs.getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def topic_stream(spark: SparkSession, topic: str, schema: str, *, format: str = "kafka", **options) -> DataFrame:
    """Values of a topic parsed from JSON, with the record's position where the source has one."""
    reader = spark.readStream.format(format)
    if format == "kafka":
        options = {"subscribe": topic, "startingOffsets": "earliest", **options}
    rows = reader.options(**options).load()
    return parse_topic(rows, schema)


def parse_topic(rows: DataFrame, schema: str) -> DataFrame:
    """``value`` as JSON record; ``partition`` and ``offset`` become ``kafka_*`` columns."""
    position = [F.col(c).alias(f"kafka_{c}") for c in ("partition", "offset") if c in rows.columns]
    return rows.select(F.from_json(F.col("value").cast("string"), schema).alias("r"), *position).select(
        "r.*", *position_names(position)
    )


def position_names(position: list[Column]) -> list[str]:
    return ["kafka_partition", "kafka_offset"][: len(position)]


def ingest_bronze(parsed: DataFrame, ingested_at: Column | None = None, ms: str = "timestamp_ms") -> DataFrame:
    """Adds ``ingestion_ts``, positions and the partition column ``date``."""
    out = parsed.withColumn("ingestion_ts", F.current_timestamp() if ingested_at is None else ingested_at)
    for name, kind in (("kafka_offset", "bigint"), ("kafka_partition", "int")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out.withColumn("date", F.to_date(ts_of_ms(F.col(ms))))


def write_clustered(
    df: DataFrame, path: str, partitions: list[str], keys: list[str], mode: str = "append", files: int | None = None
) -> None:
    """Partitioned write whose files hold narrow ranges of the clustering keys.

    Ranges go over partition columns and keys together, so a large partition is cut into
    several files and a small one does not get a file from every task.
    """
    order = [*partitions, *keys]
    (
        df.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
        .write.mode(mode).partitionBy(*partitions).parquet(path)
    )


def compact_table(
    spark: SparkSession, path: str, where: str, files: int, out: str | None = None, keys: list[str] = ()
) -> None:
    """Rewrite the partitions that match ``where`` into about ``files`` files, clustered by ``keys``.

    Ranges over partition columns and keys make about ``files`` files in all, and one more where a
    range crosses a partition's end.  Without ``out`` the partitions are replaced in place by a dynamic
    partition overwrite, which stages the new files and swaps folders when all are written: a failed
    run leaves the table as it was.
    """
    table = spark.read.parquet(path)
    parts = _partition_columns(path, table)
    if not parts:
        raise ValueError(f"{path} has no partition folders")
    order = [*parts, *keys]
    rows = table.filter(where).repartitionByRange(files, *order).sortWithinPartitions(*order)
    writer = rows.write.mode("overwrite").partitionBy(*parts)
    writer.parquet(out) if out else writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and the path in its terms."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, place = _hadoop(spark, path)
    return fs.exists(place)


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path whose writing has ended (``_SUCCESS``), last in order first."""
    fs, place = _hadoop(spark, path)
    if not fs.exists(place):
        return []
    names = sorted((f.getPath().getName() for f in fs.listStatus(place) if f.isDirectory()), reverse=True)
    return [n for n in names if path_exists(spark, f"{path.rstrip('/')}/{n}/_SUCCESS")]


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders; one that is gone already is no error."""
    for path in paths:
        fs, place = _hadoop(spark, path)
        fs.delete(place, True)


def _partition_columns(path: str, table: DataFrame) -> list[str]:
    """Names in ``name=value`` folders of one of the table's files."""
    folders = (_a_file(table) or "").rsplit(path.rstrip("/").rsplit("/", 1)[-1] + "/", 1)[-1].split("/")[:-1]
    return [f.split("=")[0] for f in folders if "=" in f]


def _a_file(table: DataFrame) -> str | None:
    """Path of one file that the table is read from."""
    row = table.select(F.input_file_name().alias("f")).first()
    return row["f"] if row else None


def expire_partitions(df: DataFrame, date_col: str, days: int, as_of: str) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; a filter on the partition column prunes folders."""
    return df.filter(F.col(date_col) >= F.date_sub(F.lit(as_of).cast("date"), days))


def remove_expired(spark: SparkSession, path: str, date_col: str, days: int, as_of: str) -> list[str]:
    """Delete the partition folders of days older than ``days`` before ``as_of``; returns the days.

    ``date_col`` is the table's first partition column.  Only folder names are read, one per day.
    """
    from datetime import date, timedelta

    oldest = date.fromisoformat(as_of) - timedelta(days=days)
    fs, place = _hadoop(spark, path)
    gone = []
    for folder in fs.listStatus(place):
        name, _, value = folder.getPath().getName().partition("=")
        if name == date_col and value[:1].isdigit() and date.fromisoformat(value) < oldest:
            fs.delete(folder.getPath(), True)
            gone.append(value)
    return sorted(gone)


def time_range(
    df: DataFrame, ts: str, start: str, end: str, *, entity: tuple[str, str] | None = None, date: str | None = None
) -> DataFrame:
    """Rows between two times, both included, of one entity if given.

    ``date`` names the partition column: bounds on it are added, so folders outside are not read.
    """
    kind = df.schema[ts].dataType
    rows = df.filter((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) <= F.lit(end).cast(kind)))
    if date:
        rows = rows.filter(F.col(date).between(F.lit(start[:10]).cast("date"), F.lit(end[:10]).cast("date")))
    return rows.filter(F.col(entity[0]) == entity[1]) if entity else rows


# Spans a dashboard offers.
PRESETS = {"1h": 3600, "6h": 21_600, "24h": 86_400, "7d": 604_800, "30d": 2_592_000}


def preset_range(df: DataFrame, ts: str, preset: str, as_of: str, **options) -> DataFrame:
    """Rows of the span before ``as_of``."""
    from datetime import datetime, timedelta

    start = datetime.fromisoformat(as_of) - timedelta(seconds=PRESETS[preset])
    return time_range(df, ts, start.isoformat(sep=" "), as_of, **options)


def evolve_schema(spark: SparkSession, paths: list[str], defaults: dict[str, object]) -> DataFrame:
    """Old and new files in one frame; fields that old files lack take their default."""
    merged = spark.read.option("mergeSchema", True).parquet(*paths)
    kinds = {f.name: f.dataType for f in merged.schema}
    return merged.withColumns(
        {c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in defaults.items() if c in kinds}
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled, nulls as empty text."""
    filled = df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    filled.write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def sink_json(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows as JSON text in ``value``, ready for a topic."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(value) if key is None else df.select(key.alias("key"), value)


def to_geojson(df: DataFrame, lat: str, lng: str, props: list[str]) -> DataFrame:
    """One GeoJSON point feature per row."""
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"),
        F.struct(*props).alias("properties"),
    )
    return df.select(F.to_json(feature).alias("feature"))


def event_envelope(df: DataFrame, kind: str, at: Column) -> DataFrame:
    return df.select(
        F.lit(kind).alias("type"), F.to_json(F.struct(*df.columns)).alias("data"), at.alias("timestamp")
    )


def sink_dual(
    stream: DataFrame, is_bad: Column, path_ok: str, path_bad: str, checkpoint: str, **trigger
):
    """One stream into two folders.  Each batch writes its own sub-folder, so a retry replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for rows, path in ((batch.filter(~is_bad), path_ok), (batch.filter(is_bad), path_bad)):
            rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return run_batches(stream, write, checkpoint, **trigger)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a ``foreachBatch`` query; without a trigger it takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
