"""Readers and writers."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import KEYS, TIE, TIME

RAW_TICK = "telemetry_timestamp timestamp, value float, aos_timestamp double, channel_id string"
SERIES = "telemetry_timestamp timestamp, value_normalized float, segment_id int, is_anomaly boolean"


def read_raw_channel(spark: SparkSession, path: str, channel_id: str, mission_id: str) -> DataFrame:
    """A channel's file, whose value column is named after the channel and whose time is `datetime`, in standard form; a column that is not numeric gives no rows."""
    df = spark.read.parquet(path)
    time = next(c for c in ("datetime", "telemetry_timestamp", "__index_level_0__") if c in df.columns)
    numeric = isinstance(df.schema[channel_id].dataType, T.NumericType)
    out = df.select(F.col(time).cast("timestamp").alias(TIME), F.col(channel_id).cast("float").alias("value") if numeric else F.lit(None).cast("float").alias("value"), F.lit(channel_id).alias("channel_id"), F.lit(mission_id).alias("mission_id"))
    return out if numeric else out.where(F.lit(False))


def wide_to_long(df: DataFrame, time: str, mission_id: str) -> DataFrame:
    """Numeric columns of a wide table as channels."""
    channels = [f.name for f in df.schema if f.name != time and isinstance(f.dataType, T.NumericType)]
    long = df.select(F.col(time).cast("timestamp").alias(TIME), *(F.col(c).cast("float").alias(c) for c in channels)).unpivot([TIME], channels, "channel_id", "value")
    return long.withColumn("mission_id", F.lit(mission_id))


def parse_stamp(column: Column) -> Column:
    """A time like 2000-01-01T00:00:00.123Z, without its fraction."""
    return F.try_to_timestamp(F.regexp_replace(column, r"\.\d+Z$", "Z"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, schema="ID string, Channel string, StartTime string, EndTime string")
    return rows.select(F.col("ID").alias("anomaly_id"), F.col("Channel").alias("channel_id"), parse_stamp(F.col("StartTime")).alias("start_time"), parse_stamp(F.col("EndTime")).alias("end_time"))


def read_ticks(spark: SparkSession, root: str, channels: list[str] | None = None) -> DataFrame:
    """The tick archive; channels are partitions, so others are not read. An archive that is not there is an error, and so is one without any of the channels asked for."""
    df = spark.read.schema(RAW_TICK).parquet(root)
    if channels is None:
        return df
    df = df.where(F.col("channel_id").isin(channels))
    if df.isEmpty():
        raise FileNotFoundError(f"none of {', '.join(channels)} in {root}")
    return df


def archived_channels(ticks: DataFrame, excluded: list[str], registry: DataFrame | None = None) -> DataFrame:
    found = ticks.select("channel_id").distinct().where(~F.col("channel_id").isin(excluded))
    return found if registry is None else found.join(registry, "channel_id", "left_semi")


def recent_shards(df: DataFrame, cutoff: str, pattern: str = r"(\d{8}T\d{6})") -> DataFrame:
    """Rows of files whose name has no time or one from the cutoff on."""
    stamp = F.try_to_timestamp(F.nullif(F.regexp_extract(F.col("_metadata.file_name"), pattern, 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss"))
    return df.where(F.coalesce(stamp >= F.lit(cutoff).cast("timestamp"), F.lit(True)))


def write_series(df: DataFrame, path: str, partition_rows: int = 2_000_000) -> None:
    """Sorted files by mission and channel. Channels present are replaced, others stay; a long channel is cut into several files by time instead of being one task."""
    day = F.date_trunc("month", TIME)
    out = df.repartition(*KEYS, day).sortWithinPartitions(*KEYS, TIME)
    out.write.partitionBy(*KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", partition_rows).parquet(path)


def read_series(spark: SparkSession, path: str, mission_id: str | None = None, channel_id: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    for column, value in (("mission_id", mission_id), ("channel_id", channel_id)):
        df = df if value is None else df.where(F.col(column) == value)
    return df


def _shared(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir, or one machine's warehouse where that is unset; a cluster then has no folder in common."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            return None
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return base.rstrip("/")


def settled(df: DataFrame, label: str) -> DataFrame:
    """df, written to a new folder in spark.checkpoint.dir and read from there, so that what follows need not make it again and reads only the columns it uses. Where that is unset, one machine writes to its warehouse, and a cluster, which has no folder in common, makes df again each time."""
    spark = df.sparkSession
    base = _shared(spark)
    if base is None:
        return df
    path = f"{base}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


@lru_cache(maxsize=1)
def _library() -> str:
    """A digest of the text of the library's batch part, as what it makes changes with it."""
    root = Path(__file__).parent.parent
    folders = ("functions", "operators", "plans", "sources")
    texts = (f"{p.relative_to(root)}\n{p.read_text()}" for folder in folders for p in sorted((root / folder).rglob("*.py")))
    return hashlib.sha256("\n".join(texts).encode()).hexdigest()


def input_fingerprint(spark: SparkSession, paths: list[str], *parameters) -> str:
    """A digest of the files below the paths (name, size, time of change), of parameters, and of the library: equal only where the same input goes the same way. It reads no file."""
    found = []
    for path in paths:
        store, folder = _store(spark, path)
        listed = store.listFiles(folder, True)
        while listed.hasNext():
            f = listed.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr((sorted(found), parameters, _library())).encode()).hexdigest()


def kept(spark: SparkSession, label: str, fingerprint: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of that label and fingerprint, made and written if it is not there yet. It counts as there once it has the writers' mark: it is written under another name and renamed, so neither a lost driver nor a second one leaves half of it. `forget` deletes old ones."""
    base = _shared(spark)
    if base is None:
        return make()
    path = f"{base}/kept/{label}-{fingerprint}"
    store, final = _store(spark, path)
    mark = _store(spark, f"{path}/_SUCCESS")[1]
    if not store.exists(mark):
        new = f"{base}/kept/new-{uuid.uuid4().hex}"
        make().write.parquet(new)
        store.delete(final, True)
        if not store.rename(_store(spark, new)[1], final) and not store.exists(mark):
            raise OSError(f"{new} cannot be renamed to {path}")
    return spark.read.parquet(path)


def forget(spark: SparkSession, seconds: float) -> int:
    """Delete kept tables that were written longer ago than so many seconds, and what lost drivers have left; how many there were."""
    base = _shared(spark)
    if base is None:
        return 0
    store, folder = _store(spark, f"{base}/kept")
    old = [f.getPath() for f in store.listStatus(folder) if f.getModificationTime() < (time.time() - seconds) * 1000] if store.exists(folder) else []
    return sum(bool(store.delete(path, True)) for path in old)


def write_profiles(df: DataFrame, path: str) -> None:
    """Reference profiles by mission and channel; those of the channels present are replaced, others stay."""
    df.repartition(*KEYS).write.partitionBy(*KEYS).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_profiles(spark: SparkSession, path: str, mission_id: str | None = None, channel_id: str | None = None) -> DataFrame:
    """Reference profiles; an error if the channel asked for has none."""
    df = read_series(spark, path, mission_id, channel_id)
    if channel_id is not None and df.isEmpty():
        raise FileNotFoundError(f"no reference profile of {mission_id}/{channel_id} in {path}")
    return df


def partition_statistics(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(F.unix_micros(TIME)).alias("first_us"), F.max(F.unix_micros(TIME)).alias("last_us"))


def footer_statistics(spark: SparkSession, path: str, column: str = "bucket_us", keys=KEYS) -> DataFrame:
    """(keys, n, first, last, schema) of a table that is partitioned by the keys: rows, and the ends of a column of whole numbers, from the footers of its files; no row is read, as the plan's PushedAggregation shows. (Files keep no such ends for times in Spark's default form, so an archive of times is scanned by `partition_statistics`.)"""
    # The reader that aggregates on footers, and keys as they are written.
    chosen = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
    before = {k: spark.conf.get(k) for k in chosen}
    try:
        for k, v in chosen.items():
            spark.conf.set(k, v)
        df = spark.read.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name not in keys)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(column).alias("first"), F.max(column).alias("last")).withColumn("schema", F.lit(kinds))


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(keys, n, fingerprint) of the rows' contents, whatever their order: two sums of row hashes, added up before the shuffle."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    half = lambda k: F.conv(F.substring(F.md5(text), k, 8), 16, 10).cast("bigint")
    found = df.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(9)).alias("b"))
    return found.select(*KEYS, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("fingerprint"))


def file_fingerprint(df: DataFrame) -> DataFrame:
    """(fingerprint) over names and sizes of the files that df reads."""
    files = df.select("_metadata.file_name", "_metadata.file_size").distinct()
    return files.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("file_name", "file_size")))), 256).alias("fingerprint"))


def run_summary(prepared: DataFrame) -> DataFrame:
    return prepared.groupBy("mission_id").agg(F.countDistinct("channel_id").alias("n_channels"), F.count("*").alias("n_rows"), F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "test").alias("test_rows"))


def channel_manifest(prepared: DataFrame) -> DataFrame:
    """Channels with training rows."""
    return prepared.groupBy(*KEYS).agg(F.count_if(F.col("split") == "train").alias("train_rows")).where("train_rows > 0")


__all__ = ["TIE"]
