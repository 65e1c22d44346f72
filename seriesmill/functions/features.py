"""Feature definitions: a name and a column builder each, the same for batch and latest-point use."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .series import KEYS, TIE, TIME, micros, series

WINDOWS = (10, 50, 100)


def rolling(kind: str, n: int, value: str, keys=KEYS) -> Column:
    """Trailing mean, sample deviation, minimum or maximum over n rows; null until there are n."""
    window = series(keys)
    frame = window.rowsBetween(-(n - 1), 0)
    made = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[kind](F.col(value).cast("double")).over(frame)
    return F.when(F.row_number().over(window) >= n, made)


def rate_of_change(value: str, keys=KEYS) -> Column:
    """Change by second since the row before; null in the first row and where no time has passed."""
    window = series(keys)
    now = F.col(value).cast("double")
    seconds = (micros() - F.lag(micros()).over(window)) / 1e6
    return F.try_divide(now - F.lag(now).over(window), F.nullif(seconds, F.lit(0.0)))


def difference(value: str, keys=KEYS) -> Column:
    """Plain change since the row before, for series without times."""
    now = F.col(value).cast("double")
    return now - F.lag(now).over(series(keys))


def registry(windows=WINDOWS) -> dict[str, Callable[[str], Column]]:
    """Features by name, in a fixed order."""
    made = {f"rolling_{kind}_{n}": partial(rolling, kind, n) for n in windows for kind in ("mean", "std", "min", "max")}
    return made | {"rate_of_change": rate_of_change}


def names(windows=WINDOWS) -> list[str]:
    return [*registry(windows)]


def by_name(name: str, windows=WINDOWS) -> Callable[[str], Column]:
    try:
        return registry(windows)[name]
    except KeyError:
        raise KeyError(f"no feature {name!r}; there are {', '.join(names(windows))}") from None


def feature_frame(df: DataFrame, value: str = "value_normalized", windows=WINDOWS, keep_incomplete: bool = False) -> DataFrame:
    """Keys, time, the value and all features; rows in which a feature is null are left out unless asked for."""
    columns = [F.col(value).cast("double").alias(value), *(make(value).alias(name) for name, make in registry(windows).items())]
    out = df.select(*KEYS, TIME, TIE, *columns)
    return out if keep_incomplete else out.dropna(subset=[value, *names(windows)])


def latest_features(df: DataFrame, value: str = "value_normalized", windows=WINDOWS) -> DataFrame:
    """All features of the newest row of each series."""
    frame = feature_frame(df, value, windows, keep_incomplete=True)
    inner = [value, *names(windows)]
    return frame.groupBy(*KEYS).agg(F.max_by(F.struct(*inner), F.struct(TIME, TIE)).alias("f")).select(*KEYS, "f.*")


def blocked_features(df: DataFrame, value: str = "value_normalized", windows=WINDOWS, rows: int = 100_000) -> DataFrame:
    """feature_frame for skewed series: every task holds at most one block and its halo."""
    spread = blocks.by_position(blocks.numbered(df), max(windows), rows=rows)
    keys = (*KEYS, blocks.BLOCK)
    made = {f"rolling_{kind}_{n}": rolling(kind, n, value, keys) for n in windows for kind in ("mean", "std", "min", "max")}
    made["rate_of_change"] = rate_of_change(value, keys)
    full = spread.select(*KEYS, TIME, TIE, F.col(value).cast("double").alias(value), blocks.OWN, *(c.alias(name) for name, c in made.items()))
    return full.where(blocks.OWN).drop(blocks.OWN).dropna(subset=[value, *names(windows)])
