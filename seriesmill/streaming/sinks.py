"""Sinks of streams that may get a micro-batch twice: what is written is named by query and batch, so a second delivery changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import TIME
from ..operators.reports import recent


def _folder(spark: SparkSession, path: str):
    """The folder as the store that it lies in has it."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def committed(spark: SparkSession, path: str) -> list[int]:
    """The batches that have been written whole, in order: those whose folder has the writers' mark."""
    store, folder = _folder(spark, path)
    if not store.exists(folder):
        return []
    names = [f.getPath().getName() for f in store.listStatus(folder)]
    found = [int(n.removeprefix("batch=")) for n in names if n.removeprefix("batch=").isdigit()]
    return sorted(b for b in found if store.exists(_folder(spark, f"{path}/batch={b}/_SUCCESS")[1]))


def _forget(spark: SparkSession, path: str, batches: list[int]) -> None:
    for b in batches:
        store, folder = _folder(spark, f"{path}/batch={b}")
        store.delete(folder, True)


def merge_recent(batch: DataFrame, batch_id: int, path: str, n: int = 200, order: str = "bucket_us") -> None:
    """The newest n rows of each series, of those before and a batch's, as a new version of the table at the path. A batch already written is left as it is. The version before stays for readers, older ones go; a version has n rows of each series at most, however long the stream."""
    spark = batch.sparkSession
    done = committed(spark, path)
    if batch_id in done or (done and batch_id < done[-1]):
        return
    before = batch if not done else spark.read.schema(batch.schema).parquet(f"{path}/batch={done[-1]}").unionByName(batch)
    recent(before, n, (order,)).drop("newest").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    _forget(spark, path, done[:-1])


def read_recent(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table of merge_recent; an error if there is none."""
    done = committed(spark, path)
    if not done:
        raise FileNotFoundError(f"no version in {path}")
    return spark.read.parquet(f"{path}/batch={done[-1]}")


def backlog(stream: DataFrame, path: str, checkpoint: str, n: int = 200, order: str = "bucket_us", **trigger):
    """Keep the newest n rows of each series of a stream as a table."""
    write = lambda batch, batch_id: merge_recent(batch, batch_id, path, n, order)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def capped(ticks: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The newest rows of each channel, as many as the cap, and (channel_id, dropped): how many older ones each channel has lost."""
    newest = Window.partitionBy("channel_id").orderBy(F.desc(TIME))
    kept = ticks.withColumn("__newest", F.row_number().over(newest)).where(F.col("__newest") <= cap).drop("__newest")
    lost = ticks.groupBy("channel_id").agg((F.count("*") - cap).alias("dropped")).where("dropped > 0")
    return kept, lost


def archive_batch(batch: DataFrame, batch_id: int, path: str, cap: int) -> None:
    """A batch's ticks as files by batch and channel, at most so many of a channel (the oldest are dropped, and told in the folder `dropped`), unless it is there already; a batch without ticks writes nothing."""
    if batch_id in committed(batch.sparkSession, f"{path}/ticks") or batch.isEmpty():
        return
    kept, lost = capped(batch, cap)
    lost.write.mode("overwrite").parquet(f"{path}/dropped/batch={batch_id}")
    kept.write.mode("overwrite").partitionBy("channel_id").parquet(f"{path}/ticks/batch={batch_id}")


def archive_capped(ticks: DataFrame, path: str, checkpoint: str, cap: int = 100_000, **trigger):
    """jobs.archive with a cap for each channel and micro-batch: what a long outage of the store has left to write cannot grow without bound."""
    write = lambda batch, batch_id: archive_batch(batch, batch_id, path, cap)
    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


__all__ = ["archive_batch", "archive_capped", "backlog", "capped", "committed", "merge_recent", "read_recent"]
