"""The driver's tables as telemetry: ticks, labelled intervals, subsystems and a run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSION = "events"
#: Subsystem of each channel of the event ticks.
SUBSYSTEMS = {"click": "payload", "view": "payload", "purchase": "power", "signup": "thermal", "error": "thermal"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular ticks of a few channels: (mission_id, channel_id, telemetry_timestamp, value, tick_id)."""
    return table(spark, sf_dir, "events").select(
        F.lit(MISSION).alias("mission_id"),
        F.col("event_type").alias("channel_id"),
        F.col("ts").cast("timestamp").alias("telemetry_timestamp"),
        F.col("value").cast("float").alias("value"),
        F.col("event_id").alias("tick_id"),
    )


def wide_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short series: one channel for each supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("mission_id"),
        F.col("l_suppkey").cast("string").alias("channel_id"),
        F.col("l_shipdate").cast("timestamp").alias("telemetry_timestamp"),
        F.col("l_quantity").cast("float").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tick_id"),
    )


def label_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled intervals of two hours: (mission_id, anomaly_id, channel_id, start_time, end_time)."""
    start = F.col("ts").cast("timestamp")
    return (
        table(spark, sf_dir, "events")
        .where("user_id % 50 = 0")
        .select(F.lit(MISSION).alias("mission_id"), F.col("event_id").cast("string").alias("anomaly_id"), F.col("event_type").alias("channel_id"), start.alias("start_time"), (start + F.expr("INTERVAL 2 HOURS")).alias("end_time"))
    )


def subsystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mission_id, channel_id, subsystem) of the channels that have ticks."""
    name = F.create_map(*[F.lit(x) for pair in SUBSYSTEMS.items() for x in pair])[F.col("channel_id")]
    return ticks(spark, sf_dir).select("mission_id", "channel_id").distinct().select("mission_id", "channel_id", F.coalesce(name, F.lit("other")).alias("subsystem"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of scoring runs: (channel_id, run_name, run_id, started, status, score)."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("channel_id"),
        F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_name"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("started"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("double").alias("score"),
    )
