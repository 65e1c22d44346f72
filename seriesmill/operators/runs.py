"""Runs of flags and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.series import KEYS, TIE, TIME, series, so_far


def with_position(df: DataFrame, keys=KEYS, *order: str) -> DataFrame:
    """position: the number of each row in its series, from 0; in order of time, if no other is given."""
    if not order:
        return blocks.numbered(df, keys)
    return df.withColumn("position", F.row_number().over(series(keys, *order)).cast("bigint") - 1)


def _placed(df: DataFrame, order: tuple[str, ...], rows: int, seconds: float) -> tuple[DataFrame, Column, tuple[str, ...]]:
    """The rows in blocks, by position or by time, with what names a row's place in its series and the order within blocks."""
    if order == ("position",):
        return df.withColumn(blocks.BLOCK, F.floor(F.col("position") / rows)), F.col("position"), order
    if order:
        raise ValueError("runs are in order of time or of position")
    return blocks.by_time(df, seconds), F.struct(TIME, TIE), (TIME, TIE)


def mark_runs(df: DataFrame, flags: dict[str, str] | str, run: str | None = None, keys=KEYS, *order: str, rows: int = blocks.ROWS, seconds: float = blocks.DAY) -> DataFrame:
    """The start of each stretch of rows with the same flag, for each flag in a column of its own: the position of its first row, or its time and tick where rows are in order of time.

    A block of rows is a task of its own. What is carried from one to those after it is a row: its last flag, and the place of the last change in it, if there is one.
    """
    flags = {flags: run} if isinstance(flags, str) else flags
    placed, place, inner = _placed(df, order, rows, seconds)
    window = blocks.within(keys, *inner)
    known = {name: F.coalesce(F.col(name), F.lit(False)) if dict(df.dtypes)[name] == "boolean" else F.col(name) for name in flags}
    changed = {name: F.when(F.lag(known[name]).over(window) != known[name], place) for name in flags}
    placed = placed.withColumns({f"__at_{name}": changed[name] for name in flags}).withColumn("__place", place)
    ends = placed.groupBy(*keys, blocks.BLOCK).agg(F.min("__place").alias("__start"), *(x for name in flags for x in (F.min_by(known[name], "__place").alias(f"__first_{name}"), F.max_by(known[name], "__place").alias(f"__last_{name}"), F.max(f"__at_{name}").alias(f"__change_{name}"))))
    order_of_blocks = blocks.sequence(keys)
    for name in flags:
        follows = F.lag(f"__last_{name}").over(order_of_blocks) == F.col(f"__first_{name}")
        # Where the last run of a block begins: at its last change, or with the block, or in a block before it.
        begins = F.coalesce(F.col(f"__change_{name}"), F.when(F.coalesce(follows, F.lit(False)), None).otherwise(F.col("__start")))
        ends = ends.withColumn(f"__begins_{name}", begins).withColumn(f"__follows_{name}", F.coalesce(follows, F.lit(False)))
    for name in flags:
        before = F.last(f"__begins_{name}", ignorenulls=True).over(blocks.earlier(keys))
        ends = ends.withColumn(f"__carry_{name}", F.when(F.col(f"__follows_{name}"), before).otherwise(F.col("__start")))
    joined = placed.join(ends.select(*keys, blocks.BLOCK, *(f"__carry_{name}" for name in flags)), [*keys, blocks.BLOCK])
    starts = {flags[name]: F.coalesce(F.max(f"__at_{name}").over(so_far(window)), F.col(f"__carry_{name}")) for name in flags}
    return joined.select(*df.columns, *(c.alias(name) for name, c in starts.items()))


def find_runs(df: DataFrame, flag: str, keys=KEYS, position: str = "position", rows: int = blocks.ROWS) -> DataFrame:
    """(keys, start, end) of contiguous true flags, in positions, the end exclusive."""
    at = df.select(*keys, F.col(position).alias("position"), F.coalesce(F.col(flag), F.lit(False)).alias(flag))
    marked = mark_runs(at, flag, "run", keys, "position", rows=rows).where(F.col(flag))
    return marked.groupBy(*keys, "run").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end")).drop("run")


def segment_extents(df: DataFrame, keys=KEYS, position: str = "position") -> DataFrame:
    """(keys, segment_id, start, end) of each segment."""
    return df.groupBy(*keys, "segment_id").agg(F.min(position).alias("start"), (F.max(position) + 1).alias("end"))


def flag_intervals(df: DataFrame, flag: str, detected: str | None = None, keys=KEYS, seconds: float = blocks.DAY) -> DataFrame:
    """(keys, start_time, end_time) of runs of a flag: the end is the time of the first row after the run, or of the last row where none follows. With `detected`, whether any row of the run has that flag."""
    hit = F.coalesce(detected, F.lit(False)) if detected else F.lit(False)
    rows = df.select(*keys, TIME, TIE, F.coalesce(F.col(flag), F.lit(False)).alias("__flag"), hit.alias("detected"))
    marked = mark_runs(rows, "__flag", "run", keys, seconds=seconds)
    found = marked.groupBy(*keys, "run", "__flag").agg(F.max(F.struct(TIME, TIE)).alias("last"), F.bool_or("detected").alias("detected"))
    # Runs of either flag follow each other, so where one ends the next begins.
    order = Window.partitionBy(*keys).orderBy("run")
    end = F.coalesce(F.lead("run").over(order)[TIME], F.col("last")[TIME])
    out = found.withColumn("end_time", end).where("__flag").select(*keys, F.col("run")[TIME].alias("start_time"), "end_time", "detected")
    return out if detected else out.drop("detected")


def merge_intervals(intervals: DataFrame, keys=KEYS, start: str = "start_time", end: str = "end_time") -> DataFrame:
    """Union of overlapping or touching half-open intervals of each key."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))
    marked = intervals.where(F.col(start) < F.col(end)).withColumn("new", new)
    islands = marked.withColumn("island", F.sum("new").over(so_far(order)))
    return islands.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def longest_above(df: DataFrame, value: str, level: float, keys=KEYS, seconds: float = blocks.DAY) -> DataFrame:
    """(keys, longest): most consecutive rows above a level, 0 if none is."""
    rows = df.select(*keys, TIME, TIE, F.coalesce(F.col(value) > level, F.lit(False)).alias("above"))
    runs = mark_runs(rows, "above", "run", keys, seconds=seconds).groupBy(*keys, "above", "run").count()
    return runs.groupBy(*keys).agg(F.max(F.when(F.col("above"), F.col("count")).otherwise(0)).alias("longest"))


def replay_passes(df: DataFrame, arrival: str, keys=KEYS) -> DataFrame:
    """A column `replay`: how often time has gone backwards so far, in order of arrival."""
    window = Window.partitionBy(*keys).orderBy(arrival)
    back = (F.lag(TIME).over(window) > F.col(TIME)).cast("int")
    return df.withColumn("back", F.coalesce(back, F.lit(0))).withColumn("replay", F.sum("back").over(so_far(window))).drop("back")


__all__ = ["TIE", "TIME", "find_runs", "flag_intervals", "longest_above", "mark_runs", "merge_intervals", "replay_passes", "segment_extents", "with_position"]
