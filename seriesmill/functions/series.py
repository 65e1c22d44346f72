"""Windows over one series, and small column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ("mission_id", "channel_id")
TIME, TIE = "telemetry_timestamp", "tick_id"


def series(keys=KEYS, *order) -> WindowSpec:
    """One partition for each series, in time order; ties in time are broken by the tick."""
    return Window.partitionBy(*keys).orderBy(*(order or (TIME, TIE)))


def so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, 0)


def whole(keys=KEYS) -> WindowSpec:
    return Window.partitionBy(*keys)


def micros(column: str = TIME) -> Column:
    return F.unix_micros(column)


def sent_if_small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """The table marked for sending to every task if it has at most so many rows, which are counted first; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f_score(precision: Column, recall: Column, beta: float) -> Column:
    square = beta * beta
    return ratio((F.lit(1.0) + square) * precision * recall, precision * square + recall)
