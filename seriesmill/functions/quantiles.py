"""Exact quantiles of long series: equal values are counted first, then the different ones are dealt by ranges, and a rank is looked up in the range that holds it. No task and no buffer holds a series' values, which an aggregate function would keep in one map for each key."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import settled
from . import blocks
from .series import KEYS

#: Different values of all keys that are not worth several ranges.
ONE_RANGE = 50_000


def quantiles(df: DataFrame, value: str, shares: Mapping[str, float], keys=KEYS, parts: int = 64) -> DataFrame:
    """(keys, a column of doubles for each name of shares): the value at share * (n - 1) of each key's n values in order, between two of them in proportion, as `percentile` gives it. Nulls do not count, and NaN is the largest value. Keys without values, or with a null among them, have no row."""
    counts = df.select(*keys, F.col(value).cast("double").alias("__value")).where("__value IS NOT NULL").groupBy(*keys, "__value").agg(F.count("*").alias("__count"))
    counts = settled(counts, "counts")
    if counts.count() <= ONE_RANGE:
        parts = 1
    total = counts.groupBy(*keys).agg(F.sum("__count").alias("__n"))
    ranked = blocks.running(blocks.by_value(counts, "__value", keys, parts), F.col("__count"), "__upto", keys, "__value").join(total, [*keys])
    at = {name: F.lit(float(share)) * (F.col("__n") - 1) for name, share in shares.items()}
    ends = {f"{name}{end}": rank(at[name]) for name in shares for end, rank in (("__low", F.floor), ("__high", F.ceil))}
    holds = {name: (F.col("__upto") - F.col("__count") <= rank) & (rank < F.col("__upto")) for name, rank in ends.items()}
    found = ranked.groupBy(*keys).agg(F.max("__n").alias("__n"), *(F.max(F.when(hold, F.col("__value"))).alias(name) for name, hold in holds.items()))
    out = []
    for name in shares:
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        out.append(F.when(low == high, low).otherwise((F.ceil(at[name]) - at[name]) * low + (at[name] - F.floor(at[name])) * high).alias(name))
    return found.select(*keys, *out)
