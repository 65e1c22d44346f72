"""Compositions over the driver's tables that the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.series import KEYS
from ..operators import drift, prepare, resample, runs, scoring
from ..sources import io, views

#: Parameters for the test tables.
MULTIPLIER, INPUTS, HORIZON, SPAN, WINDOW, Z, LEAST_RUN, DROP = 8.0, 10, 1, 5, 20, 3.0, 2, 0.13


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.detect_gaps(views.ticks(spark, sf_dir), MULTIPLIER)


def series(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Prepared rows with their position in the series, written once for all queries on the same files. The wide table has a row in some days only, so its blocks are longer."""
    days, tables = (90, ["lineitem", "events"]) if wide else (1, ["events"])

    def make() -> DataFrame:
        source = views.wide_ticks(spark, sf_dir) if wide else views.ticks(spark, sf_dir)
        return prepare.prepare(source, views.label_intervals(spark, sf_dir), MULTIPLIER, seconds=days * blocks.DAY)

    return io.kept(spark, "series", io.input_fingerprint(spark, [f"{sf_dir}/{t}.parquet" for t in tables], wide, MULTIPLIER, days), make)


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.valid_windows(series(spark, sf_dir), INPUTS, HORIZON)


def scored(spark: SparkSession, sf_dir: str, mode: str = "batch") -> DataFrame:
    """Scored windows, written once for all queries on the same files."""
    parameters = (MULTIPLIER, INPUTS, HORIZON, SPAN, WINDOW, Z, LEAST_RUN, mode)
    fingerprint = io.input_fingerprint(spark, [f"{sf_dir}/events.parquet"], *parameters)
    return io.kept(spark, "scored", fingerprint, lambda: scoring.score(scoring.predict_persistence(windows(spark, sf_dir)), SPAN, WINDOW, Z, LEAST_RUN, mode))


def anomaly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(channel_id, start, end, peak) of predicted runs."""
    marked = runs.mark_runs(scored(spark, sf_dir), "predicted", "run", KEYS, "position").where("predicted")
    found = marked.groupBy(*KEYS, "run").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end"), F.max("smoothed").alias("peak"))
    return found.select("channel_id", "start", "end", "peak")


def profiles(spark: SparkSession, sf_dir: str, rows: int = 500) -> tuple[DataFrame, DataFrame]:
    df = series(spark, sf_dir).drop("position")
    return drift.profile(df.where("split = 'train'"), rows, True), drift.profile(df.where("split = 'test'"), rows, False)


def grid_series(ticks: DataFrame, seconds: int, mask_seconds: int, multiplier: float = 3.0, fraction: float = 0.8) -> DataFrame:
    """Full preparation of ticks on a grid: resampled, outages marked, filled, segmented at gaps and outages, normalised, not labelled, split."""
    grid = resample.attach_mask(resample.resample_to_grid(ticks, seconds), resample.outage_mask(ticks, mask_seconds, False))
    rows = grid.withColumn("telemetry_timestamp", F.timestamp_micros("bucket_us")).withColumn("tick_id", F.lit(0).cast("bigint"))
    segments = prepare.split_at_outages(io.settled(prepare.detect_gaps(rows, multiplier), "grid"))
    return prepare.split_by_time(prepare.normalize(segments).withColumn("is_anomaly", F.lit(False)), fraction)
