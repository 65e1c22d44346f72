"""Sampling, exploration and suitability profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blocks
from ..functions.quantiles import quantiles
from ..functions.series import KEYS, TIME, micros, series, whole
from ..sources.io import settled
from .resample import resample_to_grid

#: Names of columns, the likeliest first (fixed values).
TIME_NAMES, TYPE_NAMES, CHANNEL_NAMES = ("timestamp", "time", "datetime", "ts", "date"), ("anomaly_type", "type", "label"), ("channel", "chan", "channel_id", "name")


def first_channels(df: DataFrame, n: int, allowed: list[str] | None = None) -> DataFrame:
    found = df.select(*KEYS).distinct()
    return (found.where(F.col("channel_id").isin(allowed)) if allowed else found).orderBy(*KEYS).limit(n)


def head_sample(df: DataFrame, fraction: float, keys=KEYS) -> DataFrame:
    """The first rows of each series: so large a share of them, one at least."""
    n = F.greatest(F.lit(1), F.floor(F.count("*").over(whole(keys)) * F.lit(fraction)))
    return df.withColumn("n", n).withColumn("at", F.row_number().over(series(keys))).where("at <= n").drop("n", "at")


def labels_of(labels: DataFrame, channels: DataFrame) -> DataFrame:
    """The labels of the given channels; all of them where no channel column is found."""
    name = detect_column(labels, CHANNEL_NAMES)
    return labels if name is None else labels.join(channels.select(F.col("channel_id").alias(name)), name, "left_semi")


def detect_column(df: DataFrame, candidates: tuple[str, ...]) -> str | None:
    """The first column whose name is one of the candidates, whatever its case."""
    by_name = {c.lower(): c for c in reversed(df.columns)}
    return next((by_name[c] for c in candidates if c in by_name), None)


def detect_time_column(df: DataFrame) -> str | None:
    """The first column of a time type, else one with a usual name."""
    typed = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType | T.DateType)]
    return typed[0] if typed else detect_column(df, TIME_NAMES)


def sample_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.count("*").alias("n_rows"))


def mission_report(df: DataFrame) -> DataFrame:
    """One row for each mission: channels, rows, times, and the median step of its first channel, in seconds."""
    total = df.groupBy("mission_id").agg(F.countDistinct("channel_id").alias("n_channels"), F.array_join(F.sort_array(F.collect_set("channel_id")), ",").alias("channels"), F.count("*").alias("n_rows"), F.min(micros()).alias("first_us"), F.max(micros()).alias("last_us"), F.min("channel_id").alias("channel_id"))
    steps = df.join(total.select(*KEYS), [*KEYS], "left_semi")
    median = quantiles(blocks.stepped(steps, "step"), "step", {"median": 0.5}, ("mission_id",))
    return total.drop("channel_id").join(median.select("mission_id", (F.col("median") / 1e6).alias("median_step_s")), "mission_id", "left")


def channel_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(keys, column, n, nulls, least, most, mean, std) of numeric columns."""
    long = df.select(*KEYS, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([*KEYS], columns, "column", "x")
    return long.groupBy(*KEYS, "column").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def label_report(labels: DataFrame, kind: str) -> DataFrame:
    """(kind, n_segments, n_channels) for each type of label."""
    return labels.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n_segments"), F.countDistinct("channel_id").alias("n_channels"))


def suitability(df: DataFrame, value: str = "value", least_rows: int = 1000, flat: float = 0.99) -> DataFrame:
    """(keys, n, n_distinct, std, frac_zero, status): empty, constant, flat or ok, in that order; the first row's step counts as not zero."""
    v = F.col(value).cast("double")
    stepped = df.withColumn("zero", F.coalesce((v - F.lag(v).over(series()) == 0).cast("int"), F.lit(0)))
    found = stepped.groupBy(*KEYS).agg(F.count("*").alias("n"), F.countDistinct(v).alias("n_distinct"), F.stddev_samp(v).alias("std"), F.avg(F.col("zero").cast("double")).alias("frac_zero"))
    status = F.when(F.col("n") < least_rows, "empty").when(F.col("n_distinct") <= 1, "constant").when(F.col("frac_zero") >= flat, "flat").otherwise("ok")
    found = found.withColumn("status", status)
    return found.withColumn("std", F.when(F.col("status") != "empty", F.col("std"))).withColumn("frac_zero", F.when(~F.col("status").isin("empty", "constant"), F.col("frac_zero")))


def filter_channels(channels: DataFrame, manifest: DataFrame) -> DataFrame:
    """Channels that the manifest does not rule out; those that it does not name stay."""
    return channels.join(manifest.where("status != 'ok'"), [*KEYS], "left_anti")


def skip_reasons(manifest: DataFrame) -> DataFrame:
    return manifest.where("status != 'ok'").groupBy("status").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("channel_id")), ",").alias("channels"))


def feed_suitability(ticks: DataFrame, seconds: int, lag: int, value: str = "value") -> DataFrame:
    """(keys, n, span_h, median_step_s, largest_gap_s, least, most, std, flat_share, autocorrelation, verdict); the last but one is the correlation of the grid with its copy `lag` buckets before."""
    v = F.col(value).cast("double")
    raw = settled(blocks.stepped(ticks.select(*KEYS, TIME, "tick_id", value), "step").withColumn("step", F.col("step") / 1e6), "steps")
    median = quantiles(raw, "step", {"median_step_s": 0.5})
    raw = raw.groupBy(*KEYS).agg(F.count("*").alias("n"), ((F.max(micros()) - F.min(micros())) / 3.6e9).alias("span_h"), F.max("step").alias("largest_gap_s"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_samp(v).alias("std"))
    order = Window.partitionBy(*KEYS).orderBy("bucket_us")
    grid = resample_to_grid(ticks, seconds, value).withColumn("v", v)
    grid = grid.select(*KEYS, "v", F.lag("v", lag).over(order).alias("early"), (F.col("v") - F.lag("v").over(order) == 0).cast("int").alias("zero"))
    shares = grid.groupBy(*KEYS).agg(F.try_divide(F.sum("zero").cast("double"), (F.count("*") - 1).cast("double")).alias("flat_share"), F.corr("v", "early").alias("autocorrelation"))
    a = F.col("autocorrelation")
    verdict = F.when(F.col("n") < 50, "DEAD").when(a.isNull() | (a < 0.55), "WEAK").when(a > 0.8, "STRONG").otherwise("OK")
    found = raw.join(shares, [*KEYS]).join(median, [*KEYS], "left").withColumn("verdict", verdict)
    return found.select(*KEYS, "n", "span_h", "median_step_s", "largest_gap_s", "least", "most", "std", "flat_share", "autocorrelation", "verdict")


def verdict_counts(verdicts: DataFrame, subsystems: DataFrame) -> DataFrame:
    return verdicts.join(subsystems, [*KEYS]).groupBy("subsystem", "verdict").agg(F.count("*").alias("n"))


def ranked_verdicts(verdicts: DataFrame) -> DataFrame:
    """place: by verdict, then by falling autocorrelation."""
    rank = F.when(F.col("verdict") == "STRONG", 0).when(F.col("verdict") == "OK", 1).when(F.col("verdict") == "WEAK", 2).otherwise(3)
    return verdicts.withColumn("place", F.row_number().over(Window.partitionBy("mission_id").orderBy(rank, F.desc_nulls_last("autocorrelation"), "channel_id")))


__all__ = ["TIME", "TYPE_NAMES"]
