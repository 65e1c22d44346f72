"""Operators on tiny frames with known results."""

import itertools
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.functions import features
from seriesmill.operators import drift, inject, prepare, profile, reports, resample, runs, scoring, sweep
from seriesmill.plans import queries
from seriesmill.sources import io

START = datetime(2000, 1, 1)


def frame(spark, rows, columns, channel="c"):
    """Rows of one channel: seconds since the start, then the columns."""
    data = [("m", channel, START + timedelta(seconds=r[0]), k, *r[1:]) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, f"mission_id string, channel_id string, telemetry_timestamp timestamp, tick_id long{columns and ', ' + columns}")


def positioned(spark, values, columns="smoothed double"):
    rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in enumerate(values)]
    return frame(spark, rows, columns).withColumn("position", F.col("tick_id"))


def listed(df, column, order="tick_id"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def test_nulls_are_filled_and_leading_ones_go(spark):
    df = frame(spark, [(0, None), (1, 1.0), (2, None), (3, 3.0)], "value float")
    assert listed(prepare.fill_nulls(df), "value") == [1.0, 1.0, 3.0]


def test_gap_of_twenty_minutes_makes_two_segments(spark):
    rows = [(90 * k, 0.0) for k in range(50)] + [(90 * 49 + 1200 + 90 * k, 0.0) for k in range(50)]
    out = prepare.detect_gaps(frame(spark, rows, "value float"))
    assert listed(out, "segment_id") == [0] * 50 + [1] * 50


@pytest.mark.parametrize("seconds", [7, 60, 10_000])
def test_blocks_of_any_length_prepare_alike(spark, seconds):
    times = np.cumsum([1 + (k * 7919) % 5 + 60 * (k % 37 == 36) for k in range(300)])
    values = [None if k < 11 or (k * 31) % 7 < 3 else float((k * 7919) % 101) for k in range(300)]
    df = frame(spark, [(int(t), v) for t, v in zip(times, values, strict=True)], "value float")
    kept, last = [], None
    for t, v in zip(times, values, strict=True):
        last = last if v is None else v
        if last is not None:
            kept.append((int(t), last))
    steps = np.diff([t for t, _ in kept])
    gaps = [False, *map(bool, steps > 3 * np.median(steps))]
    labels = spark.createDataFrame([], "mission_id string, channel_id string, start_time timestamp, end_time timestamp")
    cut = kept[0][0] + 0.8 * (kept[-1][0] - kept[0][0])
    got = prepare.prepare(df, labels, seconds=seconds).orderBy("tick_id").select("value", "is_gap", "segment_id", "position", "split").collect()
    want = [(v, g, n, k, "train" if t <= cut else "test") for k, ((t, v), g, n) in enumerate(zip(kept, gaps, np.cumsum(gaps).tolist(), strict=True))]
    assert [tuple(r) for r in got] == want
    assert listed(prepare.fill_nulls(df, seconds=seconds), "value") == [v for _, v in kept]
    lost = [bool((k // 9) % 2) for k in range(300)]
    outages = frame(spark, [(int(t), x, 0) for t, x in zip(times, lost, strict=True)], "is_los boolean, segment_id int")
    assert listed(prepare.split_at_outages(outages, seconds=seconds), "segment_id") == [k // 9 for k in range(300)]


@pytest.mark.parametrize("rows", [5, 17, 1000])
def test_blocks_of_any_length_score_alike(spark, rows):
    values = [((k * 7919) % 101) / 10 for k in range(240)]
    df = positioned(spark, [(v, k // 50, k % 60 == 0) for k, v in enumerate(values)], "value_normalized float, segment_id int, is_anomaly boolean")
    got = scoring.valid_windows(df, 10, 1, rows=rows).orderBy("tick_id").select("tick_id", "position", "window_label", F.round("previous", 3)).collect()
    whole = [k for k in range(240) if k % 50 >= 10]
    assert [tuple(r) for r in got] == [(k, n, any(j % 60 == 0 for j in range(k - 10, k + 1)), round(values[k - 1], 3)) for n, k in enumerate(whole)]
    errors = positioned(spark, values)
    want = [None if k == 0 else np.mean(values[max(0, k - 20) : k]) + 0.5 * np.std(values[max(0, k - 20) : k]) for k in range(240)]
    assert listed(scoring.dynamic_threshold(errors, 20, 0.5, rows=rows), "threshold")[1:] == pytest.approx(want[1:])
    above = [k % 23 < k // 23 for k in range(240)]
    flags = positioned(spark, [(float(a), 0.5, 1 + k % 6) for k, a in enumerate(above)], "smoothed double, threshold double, least int")
    length = {}
    for k in range(240):
        a, b = k, k
        while above[k] and a > 0 and above[a - 1]:
            a -= 1
        while above[k] and b < 239 and above[b + 1]:
            b += 1
        length[k] = b - a + 1 if above[k] else 0
    assert listed(scoring.flag_anomalies(flags, 5, rows=rows), "predicted") == [length[k] >= 5 for k in range(240)]
    assert listed(scoring.flag_anomalies(flags, F.col("least"), most_run=6, rows=rows), "predicted") == [above[k] and length[k] >= 1 + k % 6 for k in range(240)]


def test_constant_series_is_normalised_to_zero(spark):
    df = frame(spark, [(k, 5.0) for k in range(4)], "value float")
    assert listed(prepare.normalize(df), "value_normalized") == [0.0] * 4
    assert prepare.normalization_params(df).first()["std"] == 0.0


def test_labels_are_half_open_and_may_overlap_or_cross_days(spark):
    df = frame(spark, [(3600 * k, 0.0) for k in range(60)], "value float")
    at = lambda h: START + timedelta(hours=h)
    labels = spark.createDataFrame([("m", "c", at(10), at(14)), ("m", "c", at(12), at(15)), ("m", "c", at(20), at(50)), ("m", "d", at(0), at(9)), ("m", "c", at(55), at(55))], "mission_id string, channel_id string, start_time timestamp, end_time timestamp")
    got = listed(prepare.label_timesteps(df, labels), "is_anomaly")
    assert [k for k, x in enumerate(got) if x] == [*range(10, 15), *range(20, 50)]
    assert not any(listed(prepare.label_timesteps(df, labels.limit(0)), "is_anomaly"))


def test_split_keeps_the_cutoff_in_training(spark):
    df = frame(spark, [(k, 0.0) for k in range(11)], "value float")
    assert listed(prepare.split_by_time(df, 0.8), "split") == ["train"] * 9 + ["test"] * 2
    assert listed(prepare.split_by_time(df, 0.8, 3_000_000), "tick_id") == [*range(5, 11)]


def test_outages_split_segments(spark):
    df = frame(spark, [(k, x, 0) for k, x in enumerate([False, True, True, False])], "is_los boolean, segment_id int")
    assert listed(prepare.split_at_outages(df), "segment_id") == [0, 1, 1, 2]


def test_grid_is_filled_across_a_gap(spark):
    df = frame(spark, [(10, 5.0), (100, 9.0), (130, 1.0)], "value float")
    out = resample.resample_to_grid(df, 30)
    assert listed(out, "value", "bucket_us") == [5.0, 5.0, 5.0, 9.0, 1.0]


def test_outage_statistics(spark):
    silent = [(90, 150), (240, 300), (390, 450)]
    rows = [(t, 1.0) for t in range(0, 540, 5) if not any(a <= t < b for a, b in silent)]
    df = frame(spark, rows, "value float").union(frame(spark, rows, "value float", "d"))
    assert resample.outage_stats(df, 30).first().asDict() == {"mission_id": "m", "median_s": 60.0, "p90_s": 60.0, "n_events": 3}
    assert resample.outage_stats(df.where(F.col("telemetry_timestamp") < START + timedelta(seconds=160)), 30).first()["median_s"] is None
    widened = resample.outage_mask(df, 30, True)
    assert widened.where("is_los").count() == 12
    assert sorted(r.lost_us for r in resample.silences(df, 60).collect()) == [int((START + timedelta(seconds=s) - datetime(1970, 1, 1)).total_seconds() * 1e6) for s in (85, 235, 385)]


def test_outage_statistics_without_outages(spark, tmp_path):
    whole = frame(spark, [(t, 1.0) for t in range(0, 540, 5)], "value float")
    none = {"mission_id": "m", "median_s": None, "p90_s": None, "n_events": 0}
    assert [r.asDict() for r in resample.outage_stats(whole, 30).collect()] == [none]
    assert resample.outage_stats(whole.limit(0), 30).count() == 0
    events = spark.range(0, 2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    for name, rows in (("whole", events), ("empty", events.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/events.parquet")
        assert [tuple(r) for r in queries.QUERIES["los_statistics"](spark, f"{tmp_path}/{name}").collect()] == [(None, None, 0)]


def test_runs(spark):
    df = positioned(spark, [True, True, False, None, True], "flag boolean")
    assert sorted((r.start, r.end) for r in runs.find_runs(df, "flag").collect()) == [(0, 2), (4, 5)]
    assert runs.longest_above(positioned(spark, [1.0, 2.0, 0.0, 3.0]), "smoothed", 0.5).first()["longest"] == 2


def test_features_need_a_full_window_and_blocks_change_nothing(spark):
    df = frame(spark, [(k, float(k * k % 17)) for k in range(300)], "value_normalized float")
    plain = {r.tick_id: r for r in features.feature_frame(df).collect()}
    assert sorted(plain) == [*range(99, 300)]
    cut = features.blocked_features(df, rows=40 + 100).collect()
    assert {r.tick_id for r in cut} == set(plain)
    assert all(abs(r.rolling_std_50 - plain[r.tick_id].rolling_std_50) < 1e-9 and r.rolling_max_100 == plain[r.tick_id].rolling_max_100 for r in cut)
    with pytest.raises(KeyError):
        features.by_name("none")


def test_valid_windows_by_segment(spark):
    segments = [0] * 60 + [1] * 30 + [2] * 10
    df = frame(spark, [(k, 0.0, s, False) for k, s in enumerate(segments)], "value_normalized float, segment_id int, is_anomaly boolean")
    assert scoring.valid_windows(df, 10, 1).count() == 50 + 20 + 0


def test_smoothing_golden(spark):
    out = scoring.smooth_errors(positioned(spark, [1.0, 2.0, 3.0, 4.0, 5.0], "residual double"), 2)
    assert listed(out, "smoothed") == pytest.approx([1, 5 / 3, 23 / 9, 95 / 27, 365 / 81])


@pytest.mark.parametrize("span", [1, 2, 30, 100])
def test_smoothing_of_many_blocks(spark, span):
    values = [((k * 7919) % 101) / 10 for k in range(1500)]
    got, s, alpha = listed(scoring.smooth_errors(positioned(spark, values, "residual double"), span), "smoothed"), None, 2 / (span + 1)
    for x, y in zip(values, got, strict=True):
        s = x if s is None else alpha * x + (1 - alpha) * s
        assert y == pytest.approx(s, abs=1e-9)


def test_threshold_leaves_the_current_error_out(spark):
    df = positioned(spark, [0.0] * 15 + [100.0] + [0.0] * 4)
    got = listed(scoring.dynamic_threshold(df, 10, 3.0), "threshold")
    assert got[0] is None and got[15] < 1 and got[16] > 1
    assert listed(scoring.dynamic_threshold(df, 10, 3.0, "strict"), "threshold")[:10] == [None] * 10


@pytest.mark.parametrize(("peaks", "base", "kept"), [([10, 1, 0.95], 0.1, 3), ([10, 1.00, 0.97, 0.95], 0.90, 1)])
def test_pruning_golden(spark, peaks, base, kept):
    values = []
    for p in peaks:
        values += [(float(base), False), (float(p), True)]
    out = scoring.prune(positioned(spark, [*values, (float(base), False)], "smoothed double, predicted boolean"), 0.13)
    assert sum(listed(out, "pruned")) == kept


def test_metrics(spark):
    df = positioned(spark, [(True, True), (True, False), (False, False), (False, True), (True, False)], "window_label boolean, predicted boolean")
    point = scoring.point_metrics(df).first()
    assert (point.tp, point.fp, point.fn, point.precision) == (1, 1, 2, 0.5)
    segment = scoring.segment_metrics(df).first()
    assert (segment.seg_true, segment.hit_true, segment.seg_predicted, segment.hit_predicted) == (2, 1, 2, 1)
    empty = scoring.segment_metrics(df.withColumn("predicted", F.lit(False))).first()
    assert empty.seg_f05 == 0


def test_ridge_recovers_a_line(spark):
    values = [0.0]
    for k in range(200):
        values.append(0.5 * values[-1] + 1 + ((k * 37) % 11) / 100)
    df = frame(spark, [(k, v, 0, False) for k, v in enumerate(values)], "value_normalized double, segment_id int, is_anomaly boolean")
    pairs = scoring.window_pairs(df, 10, 1)
    model = scoring.fit_ar(pairs, 2, 0.0)
    errors = scoring.residuals(scoring.predict_ar(pairs, model)).select(F.max(F.abs("residual"))).first()[0]
    assert errors < 0.1 and len(model.first()["coefficients"]) == 2
    hook = scoring.predict_with(pairs.select("mission_id", "channel_id", "previous"), lambda b: b["previous"] * 2.0)
    assert hook.where("prediction != previous * 2").count() == 0


def test_wasserstein(spark):
    keys = "mission_id string, channel_id string, feature string, x double"
    a = spark.createDataFrame([("m", "c", "f", float(x)) for x in (0, 1, 2, 3)], keys)
    b = spark.createDataFrame([("m", "c", "f", float(x) + 2) for x in (0, 1, 2, 3)], keys)
    assert drift.wasserstein(a, b).first()["score"] == pytest.approx(2 / (1.25**0.5))
    assert drift.wasserstein(a, b.limit(0)).first()["score"] == 0


def test_rolling_drift_equals_numpy(spark):
    values = [None if k in (41, 42) else float(k * 7919 % 13) - 5 for k in range(500)]
    df = positioned(spark, values, "value_normalized double")
    known = {"value": [float(k * k % 11) - 4 for k in range(70)], "change": [float(k % 7) / 2 for k in range(50)]}
    reference = spark.createDataFrame([("m", "c", f, x) for f, xs in known.items() for x in xs], "mission_id string, channel_id string, feature string, x double")
    got = {(r.position, r.feature): r.score for r in drift.rolling_drift(df, reference, 32, 10, interval=2.0).collect()}
    x = np.array([np.nan if v is None else v for v in values])
    assert {p for p, _ in got} == set(range(31, 500, 10)) and len(got) == 2 * len(range(31, 500, 10))
    for (p, feature), score in got.items():
        now = x[p - 31 : p + 1]
        now = np.diff(now) / 2 if feature == "change" else now
        ref, now = np.sort(known[feature]), np.sort(now[~np.isnan(now)])
        at = np.unique(np.concatenate((ref, now)))
        gap = np.abs(np.searchsorted(ref, at, "right") / len(ref) - np.searchsorted(now, at, "right") / len(now))
        assert score == pytest.approx((gap[:-1] * np.diff(at)).sum() / ref.std(), abs=1e-9)
    alone = drift.rolling_drift(df, reference.where("feature = 'value'"), 32, 10).where("feature = 'change'")
    assert {r.score for r in alone.collect()} == {0.0}


def test_a_change_that_drifts_alerts(spark):
    scores = spark.createDataFrame([("m", "c", p, f, s) for p, v, c in ((255, 0.0, 0.2), (265, 0.0, 0.2), (275, 0.0, 0.0)) for f, s in (("value", v), ("change", c))], "mission_id string, channel_id string, position long, feature string, score double")
    out = drift.confirm(drift.rolling_snapshots(scores), 2).orderBy("position").collect()
    assert [(r.share, r.alert, r.confirmed) for r in out] == [(0.5, True, False), (0.5, True, True), (0.0, False, False)]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test tables")
def test_registered_rolling_drift_is_whole(spark):
    rows = queries.QUERIES["drf_rolling"](spark, "/root/testdata/sf0.01").collect()
    for channel in {r.channel_id for r in rows}:
        for feature in ("value", "change"):
            at = sorted(r.position for r in rows if (r.channel_id, r.feature) == (channel, feature))
            assert at == [*range(255, at[-1] + 1, 10)] and len(at) > 100


def test_faults(spark):
    df = positioned(spark, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2.0, 0.0, 0.0], "value_normalized float")
    faults = spark.createDataFrame([("m", "c", "spike", 1, 2, 3.0), ("m", "c", "drift", 3, 7, 4.0), ("m", "c", "flatline", 8, 10, None)], "mission_id string, channel_id string, type string, start long, end long, magnitude double")
    out = inject.apply_faults(df, faults)
    assert listed(out, "value_normalized") == [0, 4, 0, 0, 4, 4, 4, 2, 2, 2]
    assert listed(out, "is_anomaly") == [False, True, False, True, True, True, True, False, True, True]


def test_placed_faults_keep_the_rules(spark):
    rows = [(k, 0.0, int(k >= 1000), 100 <= k < 120) for k in range(2000)]
    df = frame(spark, rows, "value_normalized float, segment_id int, is_los boolean").withColumn("position", F.col("tick_id"))
    first = inject.place_faults(df, 8, 20, 50, seed=4).orderBy("start").collect()
    assert first == inject.place_faults(df.repartition(3), 8, 20, 50, seed=4).orderBy("start").collect()
    assert len(first) >= 4 and min(r.start for r in first) < 1200 <= max(r.start for r in first)
    for r, after in zip(first, [*first[1:], None], strict=True):
        assert r.end <= 1950 and not (r.start <= 1000 < r.end) and not (r.start < 120 and r.end > 100)
        assert after is None or after.start >= r.end + 20


def test_flatlines_start_where_values_vary(spark):
    rows = [(k, float(k * 7919 % 5) if k % 1000 < 500 else 1.0, int(k >= 1000), k % 1000 == 100) for k in range(2000)]
    df = frame(spark, rows, "value_normalized float, segment_id int, is_los boolean").withColumn("position", F.col("tick_id"))
    only = {"fault_type_weights": {"flatline": 1.0}}
    first = inject.place_faults(df, 12, 5, 50, seed=2, profile=only, before=50).collect()
    values = np.array([r[1] for r in rows])
    assert len(first) >= 4 and {r.type for r in first} == {"flatline"}
    for r in first:
        assert values[max(r.start // 1000 * 1000, r.start - 50) : r.start].var() >= 0.01 or r.start % 1000 == 1
        assert not r.start % 1000 <= 100 < r.end - r.start // 1000 * 1000
    flat = df.withColumn("value_normalized", F.lit(0.0))
    assert all(r.start in (1, 1001) for r in inject.place_faults(flat, 12, 5, 50, seed=2, profile=only, before=50).collect())


def test_sweep_thresholds_equal_the_plain_frame(spark):
    values = [abs((k * 7919) % 101) / 10 for k in range(300)]
    df = positioned(spark, values)
    plain = listed(scoring.dynamic_threshold(df, 20, 3.0), "threshold")
    for rows in (7, 64, 4096):
        got = listed(sweep.thresholds_by_row(df.withColumn("window", F.lit(20)).withColumn("z", F.lit(3.0)), ("mission_id", "channel_id"), rows=rows), "threshold")
        assert got[0] is None and got[1:] == pytest.approx(plain[1:], abs=1e-9)
    configs = sweep.clamp_configs(sweep.sample_configs(spark, 50)).collect()
    assert all(5 <= c.span < 100 and 50 <= c.window < 500 and 2.5 <= c.z <= 5 and 1 <= c.least_run < 10 for c in configs)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables")
def test_registered_sweep_is_whole(spark):
    configs, _, default = queries._sweep(spark, "/root/testdata/sf0.001")
    rows = {c.config: c.asDict() for c in configs.collect()}
    assert rows.pop(default) == {"config": default, **sweep.DEFAULT} and len(rows) == 50
    for name, (a, b) in sweep.BOUNDS.items():
        values = [c[name] for c in rows.values()]
        assert min(values) >= a and max(values) <= b and max(values) - min(values) > (b - a) / 2


def test_default_is_clamped_and_stays_when_as_good(spark):
    configs = sweep.with_default(sweep.sample_configs(spark, 2), 2, sweep.LIVE_BOUNDS)
    assert configs.where("config = 2").first().asDict() == {"config": 2, **sweep.DEFAULT, "window": 249}
    results = spark.createDataFrame([("m", s, c, o) for s, o2 in (("same", 0.5), ("worse", 0.4)) for c, o in ((0, 0.5), (1, 0.1), (2, o2))], "mission_id string, subsystem string, config int, objective double")
    assert {r.subsystem: r.config for r in sweep.best_configs(results, configs, 2).collect()} == {"same": 2, "worse": 0}


def test_profiles_and_columns(spark):
    df = frame(spark, [(k, 1.0) for k in range(20)], "value float")
    assert profile.suitability(df, least_rows=10).first()["status"] == "constant"
    assert profile.suitability(df).first()["status"] == "empty"
    assert profile.detect_time_column(df) == "telemetry_timestamp"
    assert profile.detect_column(df.withColumnRenamed("channel_id", "Channel"), profile.CHANNEL_NAMES) == "Channel"


def test_shapes_are_taken_against_nominal_rows(spark):
    nominal = [float(k % 2) * 2 + 10 for k in range(100)]  # mean 11, deviation 1
    runs_of = [[14.0] * 3, [11.5] * 20, [11.0 + 0.2 * k for k in range(20)], [11.0 + (3 if k % 2 else -3) for k in range(20)], [20.0]]
    values = [(v, False) for v in nominal]
    for run in runs_of:
        values += [(v, True) for v in run] + [(10.0, False), (12.0, False)]
    df = positioned(spark, values, "value_normalized double, is_anomaly boolean")
    shapes = inject.anomaly_shapes(df).orderBy("start").collect()
    assert [r["shape"] for r in shapes] == ["spike", "flatline", "drift_ramp", "level_shift", "spike"]
    assert shapes[0].level == pytest.approx(3) and shapes[1].magnitude == pytest.approx(0.5) and shapes[2].rise == pytest.approx(4)
    assert inject.anomaly_shapes(df, least=1000).count() == 0
    classes = spark.createDataFrame([("m", c, "smooth_ramp") for c in "cde"] + [("m", "x", "mixed")], "mission_id string, channel_id string, signal_class string")
    several = inject.anomaly_shapes(df)
    for c in "dex":
        several = several.union(inject.anomaly_shapes(df.withColumn("channel_id", F.lit(c))))
    got = {r.signal_class: r for r in inject.class_profiles(classes, several).collect()}
    assert len(got) == 5 and got["slow_lownoise"].n_channels == 0 and got["mixed"].drift == 0.45
    own = got["smooth_ramp"]
    assert (own.spike, own.flatline, own.drift) == (0.4, 0.32, 0.28) and own.n_channels == 3
    assert (own.spike_duration_high, own.drift_duration_low, own.drift_duration_high) == (20, 20, 100)
    assert own.magnitude_low == 3.0 and own.magnitude_high == 3.5
    assert {r.spike for r in inject.class_profiles(classes, several, detectable=True).collect()} == {0.4}


def test_smoothing_over_many_blocks_of_a_long_span(spark):
    values, s, alpha = [1000.0] + [0.0] * 30_000, None, 2 / 20_001
    got = listed(scoring.smooth_errors(positioned(spark, values, "residual double"), 20_000), "smoothed")
    for x, y in zip(values, got, strict=True):
        s = x if s is None else alpha * x + (1 - alpha) * s
        assert y == pytest.approx(s, rel=1e-9)
    with pytest.raises(Exception, match="most_span"):
        scoring.smooth_errors(positioned(spark, values[:3], "residual double"), F.lit(900)).collect()


def test_rising_edges(spark):
    df = positioned(spark, [(True, True), (True, True), (False, False), (True, False)], "predicted boolean, window_label boolean")
    assert [(r.position, r.truth_match) for r in reports.rising_edges(df).orderBy("position").collect()] == [(0, True), (3, False)]


def test_files(spark, tmp_path):
    rows = [(90 * k, float(k)) for k in range(40)]
    df = frame(spark, rows, "value_normalized float")
    io.write_series(df, f"file://{tmp_path}/s")
    io.write_series(df, f"file://{tmp_path}/s")
    io.write_series(frame(spark, rows[:3], "value_normalized float", "d"), f"file://{tmp_path}/s")
    back = io.read_series(spark, f"file://{tmp_path}/s", "m")
    assert back.groupBy("channel_id").count().orderBy("channel_id").collect() == [("c", 40), ("d", 3)]
    assert io.content_fingerprint(df, ["tick_id"]).first() == io.content_fingerprint(df.repartition(3), ["tick_id"]).first()
    io.write_profiles(df, f"file://{tmp_path}/p")
    assert io.read_profiles(spark, f"file://{tmp_path}/p", "m", "c").count() == 40
    with pytest.raises(FileNotFoundError):
        io.read_profiles(spark, f"file://{tmp_path}/p", "m", "d")
    with pytest.raises(ValueError, match="no channel"):
        prepare.resolve_channels(df, explicit=["x"], some=True)
    assert len(io.file_fingerprint(back).first()["fingerprint"]) == 64
    spark.createDataFrame([(START, 1.5, "x")], "datetime timestamp, ch double, txt string").write.parquet(f"file://{tmp_path}/raw")
    assert io.read_raw_channel(spark, f"file://{tmp_path}/raw", "ch", "m").first()["value"] == 1.5
    assert io.read_raw_channel(spark, f"file://{tmp_path}/raw", "txt", "m").count() == 0
    (tmp_path / "labels.csv").write_text("ID,Channel,StartTime,EndTime\na1,c,2000-01-01T00:15:00.123Z,2000-01-01T00:21:00Z\n")
    got = io.read_labels(spark, f"file://{tmp_path}/labels.csv").first()
    assert (got.start_time, got.end_time) == (START + timedelta(minutes=15), START + timedelta(minutes=21))


@pytest.mark.parametrize("rows", [1, 7, 4096])
def test_runs_in_blocks_equal_brute_force(spark, rows):
    rng = np.random.default_rng(rows)
    data = []
    for c, n, p in (("a", 60, 0.5), ("b", 40, 0.03), ("c", 25, 1.0), ("d", 25, 0.0), ("e", 1, 1.0)):
        at = np.cumsum(rng.integers(1, 5000, n))
        flags = np.cumsum(rng.random(n) < p) % 2 == 1 if 0 < p < 1 else np.full(n, p == 1.0)
        data += [("m", c, k, START + timedelta(seconds=int(at[k])), k, bool(f) if k % 11 else (None if not f else True), bool(rng.random() < 0.3), float(f)) for k, f in enumerate(flags)]
    df = spark.createDataFrame(data, "mission_id string, channel_id string, position long, telemetry_timestamp timestamp, tick_id long, flag boolean, hit boolean, x double")
    want, longest, spans = {}, {}, set()
    for c in "abcde":
        own = [r for r in data if r[1] == c]
        start = 0
        longest[c] = 0
        for k in range(1, len(own) + 1):
            if k == len(own) or bool(own[k][5]) != bool(own[start][5]):
                want |= {(c, j): start for j in range(start, k)}
                if own[start][5]:
                    longest[c] = max(longest[c], k - start)
                    spans.add((c, own[start][3], own[min(k, len(own) - 1)][3], any(r[6] for r in own[start:k])))
                start = k
    marked = runs.mark_runs(df, "flag", "run", runs_keys := ("mission_id", "channel_id"), "position", rows=rows)
    assert {(r.channel_id, r.position): r.run for r in marked.collect()} == want and marked.columns == [*df.columns, "run"]
    both = runs.mark_runs(df, {"flag": "a", "hit": "b"}, None, runs_keys, "position", rows=rows)
    alone = runs.mark_runs(df, "hit", "run", runs_keys, "position", rows=rows)
    assert {(r.channel_id, r.position): (r.a, r.b) for r in both.collect()} == {(r.channel_id, r.position): (want[r.channel_id, r.position], r.run) for r in alone.collect()}
    assert sorted((r.channel_id, r.start, r.end) for r in runs.find_runs(df, "flag", rows=rows).collect()) == sorted((c, s, max(j for (d, j), t in want.items() if d == c and t == s) + 1) for c, s in {(c, s) for (c, j), s in want.items() if bool(next(r for r in data if r[1] == c and r[2] == j)[5])})
    seconds = rows * 900.0
    assert {(r.channel_id, r.start_time, r.end_time, r.detected) for r in runs.flag_intervals(df, "flag", "hit", seconds=seconds).collect()} == spans
    assert {r.channel_id: r.longest for r in runs.longest_above(df, "x", 0.5, seconds=seconds).collect()} == {c: longest[c] if c not in "ab" else max(len(list(g)) if v else 0 for v, g in itertools.groupby(r[7] > 0.5 for r in data if r[1] == c)) for c in "abcde"}


def test_candidate_losses_equal_fitting_each(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)).round(2)
    y = x @ [0.1, 0, -0.3, 0.2, 0.6] + 1.5 + rng.normal(size=80) * 0.1
    rows = [("m", "a", x[k].tolist(), float(y[k]), "train" if k < 60 else "validation") for k in range(80)] + [("m", "b", x[k].tolist(), 2.0, "train") for k in range(5)]
    df = spark.createDataFrame(rows, "mission_id string, channel_id string, x array<double>, y double, part string")
    got = {(r.channel_id, r.order, r.ridge): (r.train_mse, r.validation_mse) for r in scoring.ar_losses(df, (1, 3, 5), (1e-3, 0.1, 10.0)).collect()}
    for order in (1, 3, 5):
        for ridge in (1e-3, 0.1, 10.0):
            a = np.column_stack([np.ones(80), x[:, ::-1][:, :order]])
            w = np.linalg.solve(a[:60].T @ a[:60] + np.diag([0.0] + [60 * ridge] * order), a[:60].T @ y[:60])
            square = (a @ w - y) ** 2
            assert got["a", order, ridge] == pytest.approx((square[:60].mean(), square[60:].mean()), abs=1e-9)
            assert got["b", order, ridge][0] == pytest.approx(0, abs=1e-9) and got["b", order, ridge][1] is None
    best = {r.channel_id: (r.order, r.ridge) for r in scoring.best_ar(scoring.ar_losses(df, (1, 3, 5), (1e-3, 0.1, 10.0)).where("channel_id = 'a'")).collect()}
    assert best["a"] == min((v[1], k[1], k[2]) for k, v in got.items() if k[0] == "a")[1:]


def test_sweep_labels_and_parts(spark):
    errors = spark.createDataFrame([("m", c, k, 0.5) for c in "abc" for k in range(10)], "mission_id string, channel_id string, position long, residual double")
    labels = spark.createDataFrame([("m", c, k, c == "a" and k < 2) for c in "abx" for k in range(10)], "mission_id string, channel_id string, position long, window_label boolean")
    both = sweep.labelled_errors(errors, labels)
    assert sorted({r.channel_id for r in both.collect()}) == ["a", "b"] and both.count() == 20
    with pytest.raises(Exception, match="do not fit the errors of m/a: 9 against 10"):
        sweep.labelled_errors(errors, labels.where("channel_id != 'a' or position > 0")).collect()
    subsystems = spark.createDataFrame([("m", "a", "s"), ("m", "b", "t")], "mission_id string, channel_id string, subsystem string")
    found = {r.subsystem: (r.n, r.labelled_first, r.labelled_rest, r.warning) for r in sweep.sweep_parts(both, subsystems).collect()}
    assert found == {"s": (10, 2, 0, "no labelled window in the rest"), "t": (10, 0, 0, "no labelled window to try on; no labelled window in the rest")}


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_restarts_of_a_replay(spark, rows):
    at = [0, 10, 20, 5, 15, 25, 25, 0, 30]
    data = [("m", c, k, START + timedelta(seconds=s if c == "a" else k), k % 2 == 0, float(k), 2.0 if k else None) for c in "ab" for k, s in enumerate(at)]
    df = spark.createDataFrame(data, "mission_id string, channel_id string, arrival long, telemetry_timestamp timestamp, window_label boolean, smoothed double, threshold double")
    got = {r.channel_id: (r.labelled_most, r.most, r.restarts) for r in reports.near_misses(df, "arrival", rows).collect()}
    assert got == {"a": (4.0, 4.0, 2), "b": (4.0, 4.0, 0)}
    assert reports.near_misses(df).columns == ["mission_id", "channel_id", "labelled_most", "most"]


def test_grids_and_masks_cross_days(spark):
    rng = np.random.default_rng(6)
    data, at = [], {c: np.cumsum(rng.choice([600, 3600, 50_000, 200_000], size=60)) for c in "ab"}
    data = [("m", c, START + timedelta(seconds=int(s)), k, float(k)) for c in "ab" for k, s in enumerate(at[c])]
    ticks = spark.createDataFrame(data, "mission_id string, channel_id string, telemetry_timestamp timestamp, tick_id long, value float")
    step, base = 3600, int((START - datetime(1970, 1, 1)).total_seconds())
    got = {(r.channel_id, r.bucket_us): r.value for r in resample.resample_to_grid(ticks, step).collect()}
    want = {}
    for c in "ab":
        by = {}
        for k, s in enumerate(at[c]):
            by.setdefault((base + int(s)) // step * step, []).append(float(k))
        value = None
        for t in range(min(by), max(by) + 1, step):
            value = np.float32(np.mean(by[t])) if t in by else value
            want[c, t * 1_000_000] = value
    assert got == want
    heard = {t for s in at.values() for t in ((base + s) // step * step).tolist()}
    every = range(min(heard), max(heard) + 1, step)
    lost = [t not in heard for t in every]
    for expand in (False, True):
        wide = [any(lost[max(0, k - expand) : k + 1 + expand]) for k in range(len(lost))]
        assert {r.bucket_us: r.is_los for r in resample.outage_mask(ticks, step, expand).collect()} == {t * 1_000_000: w for t, w in zip(every, wide, strict=True)}
    spans = [(k, len([*g])) for k, g in itertools.groupby(lost)]
    starts = np.cumsum([0, *(n for _, n in spans)])
    assert sorted((r.start, r.end) for r in resample.outage_durations(resample.outage_mask(ticks, step, False), step).collect()) == [(int(s), int(s) + n) for s, (k, n) in zip(starts, spans, strict=False) if k]


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_distance_by_ranges_of_values(spark, parts):
    rng = np.random.default_rng(parts)
    sides = {("a", "f"): (rng.normal(size=300).round(1), rng.normal(0.4, 1, 200).round(1)), ("a", "g"): (np.full(50, 2.0), np.full(9, 2.0)), ("b", "f"): (np.full(40, 1.0), rng.integers(0, 3, 77) * 1.0), ("b", "g"): (rng.normal(size=20), np.zeros(0))}
    make = lambda side: spark.createDataFrame([("m", c, f, float(x)) for (c, f), xs in sides.items() for x in xs[side]], "mission_id string, channel_id string, feature string, x double")
    got = {(r.channel_id, r.feature): r.score for r in drift.wasserstein(make(0), make(1), parts=parts).collect()}
    for key, (a, b) in sides.items():
        x = np.sort(np.concatenate((a, b)))
        gap = np.abs(np.searchsorted(np.sort(a), x[:-1], "right") / len(a) - np.searchsorted(np.sort(b), x[:-1], "right") / max(1, len(b)))
        assert got[key] == pytest.approx((gap * np.diff(x)).sum() / max(a.std(), 0.001) if len(b) else 0.0, abs=1e-9)
