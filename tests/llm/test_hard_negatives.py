import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import hard_negatives
from seriesmill.llm.hard_negatives import mine, scores

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, id string"


def brute(rows, every, positives=5, negatives=5, low=80):
    least = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * x)) for x in v]
        if sum(x * x for x in w) < 2**62:
            raw = np.array(w, "<i4").tobytes()
            least[i] = min(least.get(i, (lab, raw, w)), (lab, raw, w))
    out = set()
    for a, (lab, _, v) in least.items():
        if a % every:
            continue
        all_ = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, _, w) in least.items() if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in all_ if x[2] == lab][:positives]:
            hard = [x for x in all_ if x[2] != lab and low * -ps <= 100 * -x[0] <= 100 * -ps][:negatives]
            out |= {(a, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(hard)}
    return out


def mined(spark, rows, every=3):
    df = spark.createDataFrame([(i, v, lab, 7, "x") for i, v, lab in rows], SCHEMA)
    return [tuple(r) for r in mine(df, F.col("id") % every == 0).collect()]


@pytest.mark.parametrize("span", [1, 300, 40_000, 2**30, 2**31 - 1])
@pytest.mark.parametrize("size", [1, 3, 64])
def test_packed_products_are_exact(span, size):
    rng = np.random.default_rng(span + size)
    span = min(span, int((2**62 / size) ** 0.5) - 1)
    a, b = rng.integers(-span, span + 1, (5, size)), rng.integers(-span, span + 1, (40, size))
    for x, y in ((a, b), (abs(a), b), (-abs(a), -abs(b)), (a * 0, b), (a, b * 0)):
        assert np.array_equal(np.stack([*scores(x, y)]), np.array([[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in y] for u in x]))


def test_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 11)
    rng = random.Random(4)
    some = [[rng.choice([-0.2, 0.0, 0.1, 0.4]) for _ in range(6)] for _ in range(30)]
    rows = [(k, rng.choice(some), rng.randrange(3)) for k in range(150)] + [(k, [0.5] * 6, 1 + k % 2) for k in range(200, 260)]
    rows += [(300, None, 1), (303, [0.1, None, 0.3, 0.0, 0.0, 0.0], 1), (306, [float("nan")] * 6, 1), (309, [float("inf")] + [0.0] * 5, 1), (312, [0.1] * 6, None), (None, [0.1] * 6, 1)]
    rows += [(3, some[0], 0), (3, some[0], 0), (3, some[1], 2), (315, [0.3] * 4, 1), (318, [0.4] * 4, 1), (321, [0.3] * 4, 2), (324, [], 1), (327, [], 2), (330, [], 1), (333, [1e300] * 6, 1), (336, [], 1)]
    got = mined(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 3)


def test_no_rows_and_no_anchors(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1), (2, [0.5], 1)]) == []
    assert mined(spark, [(3, [0.5], 1)]) == []
