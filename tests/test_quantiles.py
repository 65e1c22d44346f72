"""Exact quantiles by ranges of values, and steps in blocks of time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import seriesmill.functions.quantiles as module
from seriesmill.functions import blocks
from seriesmill.functions.quantiles import quantiles
from seriesmill.functions.series import micros, series

from .test_operators import frame


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_ranks_with_ties_and_even_counts(spark, monkeypatch, parts):
    monkeypatch.setattr(module, "ONE_RANGE", 0 if parts > 1 else module.ONE_RANGE)
    rng = np.random.default_rng(parts)
    groups = {"a": rng.integers(0, 9, 1000).astype(float), "b": rng.standard_normal(777), "c": np.array([5.0]), "d": np.array([1.0, 2.0]), "e": np.repeat([3.0, -0.0, 0.0, 1e300], 250)}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("a", None), ("none", None), (None, 1.0)]
    shares = {"least": 0.0, "q10": 0.1, "middle": 0.5, "p99": 0.99, "most": 1.0}
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, ("k",), parts).collect()}
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        for name, share in shares.items():
            assert math.isclose(got[k][name], np.quantile(values, share), rel_tol=1e-12, abs_tol=1e-12), (k, name)


def test_nan_is_the_largest_and_no_rows_give_none(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan"))], "k string, v double")
    r = quantiles(df, "v", {"middle": 0.5, "most": 1.0}, ("k",)).first()
    assert r.middle == 2.0 and math.isnan(r.most)
    assert quantiles(df.limit(0), "v", {"middle": 0.5}, ("k",)).count() == 0


@pytest.mark.parametrize("seconds", [1, 13, 86_400])
def test_steps_in_blocks(spark, seconds):
    times = np.cumsum(np.random.default_rng(4).integers(0, 40, 300))
    df = frame(spark, [(int(t),) for t in times], "").union(frame(spark, [(5,), (9,)], "", "other"))
    want = df.withColumn("step", micros() - F.lag(micros()).over(series()))
    got = blocks.stepped(df, "step", seconds=seconds)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
