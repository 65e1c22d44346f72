"""Long series in blocks: what a window over a whole series gives, with a task for each block instead of one for each series.

Blocks are cut by time (`by_time`) where nothing is known of a row but its time, and by position (`by_position`) where a window looks back and ahead a bounded number of rows. From one time block to those after it only one row is carried: the table of carries has a row for each block, and its windows are the only ones that see a whole series. Rows without a key are left out by the joins with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.io import settled
from .series import KEYS, micros, sent_if_small, series, so_far

BLOCK, OWN = "__block", "__own"
#: Seconds of a block by time, and rows of one by position.
DAY, ROWS = 86_400, 100_000


def by_time(df: DataFrame, seconds: float = DAY) -> DataFrame:
    """A column of the block of each row; rows without a time come first, as in a sorted series."""
    return df.withColumn(BLOCK, F.coalesce(F.floor(micros() / F.lit(seconds * 1e6)), F.lit(-(2**62))))


def by_position(df: DataFrame, back: int, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """Each row in its block of so many positions, and copies of it in the blocks whose rows look back, or ahead, as far as to it; only in its own block is the column OWN true."""
    at = F.col("position")
    own = F.floor(at / rows)
    first = F.greatest(F.floor((at - ahead) / rows), F.lit(0))
    spread = df.withColumn(BLOCK, F.explode(F.sequence(first, F.floor((at + back) / rows))))
    return spread.withColumn(OWN, F.col(BLOCK) == own)


def within(keys=KEYS, *order) -> WindowSpec:
    """The rows of one block in order."""
    return series((*keys, BLOCK), *order)


def sequence(keys=KEYS) -> WindowSpec:
    """The blocks of a series, for tables with a row for each."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def earlier(keys=KEYS) -> WindowSpec:
    return sequence(keys).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, amount: Column, name: str, keys=KEYS, *order) -> DataFrame:
    """The running sum of whole numbers over each series of a table in blocks, as a column of that name."""
    ends = df.groupBy(*keys, BLOCK).agg(F.sum(amount).alias("__sum"))
    before = ends.select(*keys, BLOCK, F.coalesce(F.sum("__sum").over(earlier(keys)), F.lit(0)).alias("__before"))
    joined = df.withColumn(name, F.sum(amount).over(so_far(within(keys, *order)))).join(before, [*keys, BLOCK])
    kept = [c for c in df.columns if c != name]
    return joined.select(*kept, (F.col(name) + F.col("__before")).alias(name))


def stepped(df: DataFrame, name: str, keys=KEYS, seconds: float = DAY) -> DataFrame:
    """A column of that name: the microseconds since the row before in the series."""
    local = by_time(df, seconds).withColumn("__before_us", F.lag(micros()).over(within(keys)))
    ends = local.groupBy(*keys, BLOCK).agg(F.max(micros()).alias("__end_us"))
    carries = ends.select(*keys, BLOCK, F.lag("__end_us").over(sequence(keys)).alias("__last_us"))
    joined = local.join(carries, [*keys, BLOCK])
    return joined.select(*df.columns, (micros() - F.coalesce("__before_us", "__last_us")).alias(name))


def by_value(df: DataFrame, value: str, keys, parts: int = 64) -> DataFrame:
    """A column of the block of each row by its value: up to so many ranges of each key, of about as many rows each, whose ends are written once, so that a task that is run again deals rows out as before."""
    if parts < 2:
        return df.withColumn(BLOCK, F.lit(0).cast("bigint"))
    shares = [k / parts for k in range(1, parts)]
    ends = settled(df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares)).alias("__ends")), "ranges")
    placed = df.join(sent_if_small(ends), [*keys]).withColumn(BLOCK, F.size(F.filter("__ends", lambda e: e < F.col(value))).cast("bigint"))
    return placed.drop("__ends")


def numbered(df: DataFrame, keys=KEYS, seconds: float = DAY) -> DataFrame:
    """position: the number of each row in its series, from 0."""
    return running(by_time(df, seconds), F.lit(1), "position", keys).withColumn("position", F.col("position") - 1).drop(BLOCK)
