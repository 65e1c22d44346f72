"""Fixed grids and loss of signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.quantiles import quantiles
from ..functions.series import KEYS, TIME, micros, so_far
from ..sources.io import settled
from .runs import find_runs


def floor_to_grid(us: Column, seconds: int) -> Column:
    """The start of a time's grid bucket, in microseconds, counted from midnight UTC."""
    day, grid = 86_400_000_000, seconds * 1_000_000
    inside = F.pmod(us, F.lit(day))
    return (us - inside + inside - F.pmod(inside, F.lit(grid))).cast("bigint")


DAY_US = 86_400_000_000


def _days(us: Column) -> Column:
    return F.floor(us / F.lit(DAY_US))


def _spine(buckets: DataFrame, keys, seconds: int) -> DataFrame:
    """All buckets from the first to the last of each key, in blocks of a day, which are made one by one: no row holds more than a day's."""
    step = F.lit(seconds * 1_000_000).cast("bigint")
    ends = buckets.groupBy(*keys).agg(F.min("bucket_us").alias("a"), F.max("bucket_us").alias("b"))
    days = ends.select(*keys, "a", "b", F.explode(F.sequence(_days(F.col("a")), _days(F.col("b")))).alias(blocks.BLOCK))
    # A key may have very many days, and a task should not make all of them.
    days = days.repartition(*keys, blocks.BLOCK)
    start = F.col(blocks.BLOCK) * DAY_US
    return days.select(*keys, blocks.BLOCK, F.explode(F.sequence(F.greatest("a", start), F.least(F.col("b"), start + DAY_US - step), step)).alias("bucket_us"))


def resample_to_grid(ticks: DataFrame, seconds: int = 30, value: str = "value", keys=KEYS) -> DataFrame:
    """(keys, bucket_us, value): the mean of each bucket, empty ones filled from the one before. The grid must divide a day; days are tasks of their own, and one value is carried from each to those after it."""
    means = ticks.withColumn("bucket_us", floor_to_grid(micros(), seconds)).groupBy(*keys, "bucket_us").agg(F.avg(F.col(value).cast("double")).alias(value))
    ends = means.groupBy(*keys, _days(F.col("bucket_us")).alias(blocks.BLOCK)).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("bucket_us"))).alias("__last"))
    days = _spine(means, keys, seconds).select(*keys, blocks.BLOCK).distinct().join(ends, [*keys, blocks.BLOCK], "left")
    carry = days.select(*keys, blocks.BLOCK, F.last("__last", ignorenulls=True).over(blocks.earlier(keys)).alias("__carry"))
    full = _spine(means, keys, seconds).join(means, [*keys, "bucket_us"], "left").join(carry, [*keys, blocks.BLOCK])
    inside = so_far(blocks.within(keys, "bucket_us"))
    return full.select(*keys, "bucket_us", F.coalesce(F.last(value, ignorenulls=True).over(inside), "__carry").cast("float").alias(value))


def outage_mask(ticks: DataFrame, seconds: int = 30, expand: bool = True) -> DataFrame:
    """(mission_id, bucket_us, is_los): buckets between the first and last tick in which no channel of the mission has one; widened by a bucket on both sides if asked for. Days are tasks of their own."""
    heard = ticks.select("mission_id", floor_to_grid(micros(), seconds).alias("bucket_us")).distinct()
    mask = _spine(heard, ("mission_id",), seconds).join(heard.withColumn("heard", F.lit(True)), ["mission_id", "bucket_us"], "left")
    mask = mask.select("mission_id", blocks.BLOCK, "bucket_us", F.col("heard").isNull().alias("is_los"))
    if not expand:
        return mask.drop(blocks.BLOCK)
    # Each bucket with those beside it, the ones at the ends of a day in the next day too.
    days = F.array_distinct(F.array(*(_days(F.col("bucket_us") + F.lit(k * seconds * 1_000_000)) for k in (-1, 0, 1))))
    spread = mask.withColumn("__own", F.col(blocks.BLOCK)).withColumn(blocks.BLOCK, F.explode(days))
    order = blocks.within(("mission_id",), "bucket_us")
    wide = spread.withColumn("is_los", F.col("is_los") | F.lag("is_los", 1, False).over(order) | F.lead("is_los", 1, False).over(order))
    return wide.where(F.col(blocks.BLOCK) == F.col("__own")).select("mission_id", "bucket_us", "is_los")


def attach_mask(grid: DataFrame, mask: DataFrame) -> DataFrame:
    """is_los of each grid row by its bucket, false where the mask has none."""
    return grid.join(mask, ["mission_id", "bucket_us"], "left").withColumn("is_los", F.coalesce("is_los", F.lit(False)))


def outage_durations(mask: DataFrame, seconds: int = 30) -> DataFrame:
    """(mission_id, start, end, duration_s) of each stretch of lost buckets, in positions; one that is open at the end counts."""
    first = mask.groupBy("mission_id").agg(F.min("bucket_us").alias("first"))
    # Buckets have no gaps between them, so a bucket's time is its position.
    placed = mask.join(first, "mission_id").withColumn("position", ((F.col("bucket_us") - F.col("first")) / F.lit(seconds * 1_000_000)).cast("bigint"))
    runs = find_runs(placed, "is_los", ("mission_id",))
    return runs.withColumn("duration_s", (F.col("end") - F.col("start")) * seconds)


def outage_stats(ticks: DataFrame, seconds: int = 30, lookback_us: int | None = None, least: int = 3, missions: DataFrame | None = None) -> DataFrame:
    """(mission_id, median_s, p90_s, n_events) of outages, from the mask without widening, for each mission with ticks, or each of `missions`; null medians below `least` events, 0 events where there is no outage."""
    missions = (ticks if missions is None else missions).select("mission_id").where("mission_id IS NOT NULL").distinct()
    if lookback_us is not None:
        newest = ticks.groupBy("mission_id").agg(F.max(micros()).alias("newest"))
        ticks = ticks.join(newest, "mission_id").where(micros() >= F.col("newest") - lookback_us).drop("newest")
    events = settled(outage_durations(outage_mask(ticks, seconds, expand=False), seconds), "outages")
    counted = events.groupBy("mission_id").agg(F.count("*").alias("n_events"))
    found = missions.join(counted, "mission_id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("bigint")))
    found = found.join(quantiles(events, "duration_s", {"m": 0.5, "p": 0.9}, ("mission_id",)), "mission_id", "left")
    enough = F.col("n_events") >= least
    return found.select("mission_id", F.when(enough, F.col("m")).alias("median_s"), F.when(enough, F.col("p")).alias("p90_s"), "n_events")


def silences(ticks: DataFrame, seconds: float) -> DataFrame:
    """(mission_id, lost_us, recovered_us): stretches in which no channel of a mission has a tick for longer than so many seconds. Ticks are first reduced to the first and last of each hour and what lies between them is looked at hour by hour, so a mission's ticks are not sorted in one task."""
    hours = ticks.select("mission_id", micros().alias("us"), F.date_trunc("hour", TIME).alias("hour"))
    inside = Window.partitionBy("mission_id", "hour").orderBy("us")
    within = hours.withColumn("next_us", F.lead("us").over(inside))
    ends = hours.groupBy("mission_id", "hour").agg(F.min("us").alias("first"), F.max("us").alias("last"))
    across = ends.select("mission_id", F.col("last").alias("us"), F.lead("first").over(Window.partitionBy("mission_id").orderBy("hour")).alias("next_us"))
    both = within.select("mission_id", "us", "next_us").union(across)
    return both.where(F.col("next_us") - F.col("us") > int(seconds * 1e6)).select("mission_id", F.col("us").alias("lost_us"), F.col("next_us").alias("recovered_us"))
