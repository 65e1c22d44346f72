"""Streams against the batch forms of the same operators."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.operators import drift, resample, scoring
from seriesmill.streaming import jobs

START = datetime(2000, 1, 1)


def source(spark, tmp_path, rows, schema, name="in"):
    path = f"file://{tmp_path}/{name}"
    for k in range(0, len(rows), max(1, len(rows) // 3)):
        spark.createDataFrame(rows[k : k + max(1, len(rows) // 3)], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_grid_stream_closes_buckets_and_fills(spark, tmp_path):
    ticks = [("m", "c", START + timedelta(seconds=s), v) for s, v in ((10, 5.0), (100, 9.0), (130, 1.0), (400, 0.0))]
    stream = source(spark, tmp_path, ticks, "mission_id string, channel_id string, telemetry_timestamp timestamp, value float")
    means = jobs.run_to_table(jobs.bucket_means(stream, 30, "0 seconds"), f"file://{tmp_path}/means", f"file://{tmp_path}/c1")
    assert [r.value for r in means.orderBy("bucket_us").collect()] == [5.0, 9.0, 1.0]
    again = spark.readStream.schema(means.schema).parquet(f"file://{tmp_path}/means")
    filled = jobs.run_to_table(jobs.fill_grid(again, 30), f"file://{tmp_path}/filled", f"file://{tmp_path}/c2")
    assert [r.value for r in filled.orderBy("bucket_us").collect()] == [5.0, 5.0, 5.0, 9.0, 1.0]


def test_online_scores_equal_strict_batch(spark, tmp_path):
    values = [float((k * 7919) % 101) / 50 + (6 if 120 <= k < 124 else 0) for k in range(200)]
    rows = [("m", "c", k * 30_000_000, v) for k, v in enumerate(values)]
    stream = source(spark, tmp_path, rows, jobs.GRID)
    online = jobs.run_to_table(jobs.score_grid(stream, 10, 5, 20, 2.0, 2), f"file://{tmp_path}/out", f"file://{tmp_path}/c").orderBy("bucket_us").collect()
    data = [("m", "c", START + timedelta(seconds=30 * k), k, v, 0, False) for k, v in enumerate(values)]
    df = spark.createDataFrame(data, "mission_id string, channel_id string, telemetry_timestamp timestamp, tick_id long, value_normalized float, segment_id int, is_anomaly boolean")
    batch = scoring.score(scoring.predict_persistence(scoring.valid_windows(df, 10, 1)), 5, 20, 2.0, 2, "strict")
    batch = scoring.trailing_flag(batch.drop("predicted"), 2).orderBy("position").collect()
    late = [r for r in online if r.prediction is not None]
    assert len(late) == len(batch) == 190
    for a, b in zip(late, batch, strict=True):
        assert a.smoothed == pytest.approx(b.smoothed, abs=1e-5)
        assert (a.threshold is None) == (b.threshold is None) and (a.threshold is None or a.threshold == pytest.approx(b.threshold, abs=1e-5))
        assert a.predicted == b.predicted
    assert any(a.predicted for a in late)


def test_scores_start_anew_after_an_outage(spark, tmp_path):
    values = [float((k * 7919) % 101) / 50 + (9 if 60 <= k < 64 else 0) for k in range(160)]
    rows = [("m", "c", (k + (1000 if k >= 62 else 0)) * 30_000_000, v) for k, v in enumerate(values)]
    for recent in (0, 15, None):
        stream = source(spark, tmp_path, rows, jobs.GRID, f"in{recent}")
        history = spark.createDataFrame([("m", "c", k, 1.0) for k in range(-50, -10)] + [("m", "other", 0, 5.0)], jobs.GRID)
        state = jobs.primed_state(history, 10, 5, 20, 2.0, 2, recent).withColumn("last", F.lit(None).cast("bigint"))
        out = jobs.score_grid(stream, 10, 5, 20, 2.0, 2, state, 3600, recent)
        online = jobs.run_to_table(out, f"file://{tmp_path}/out{recent}", f"file://{tmp_path}/c{recent}").orderBy("bucket_us").collect()
        scorer = jobs.OnlineScorer(10, 5, 20, 2.0, 2)
        scorer.prime([1.0] * 40)
        want = [scorer.step(v) for v in values[:62]]
        scorer.prime(([1.0] * 40 + values[:62])[-(30 if recent is None else recent) :] if recent != 0 else [])
        want += [scorer.step(v) for v in values[62:]]
        assert [(r.prediction, r.smoothed, r.threshold, r.predicted) for r in online] == [pytest.approx(w, abs=1e-5) for w in want]
        assert (online[62].prediction is None) == (recent == 0) and (online[62].threshold is not None) == (recent is None)


def test_open_buckets_are_flushed_and_ticks_pass_raw(spark, tmp_path):
    schema = "mission_id string, channel_id string, telemetry_timestamp timestamp, value float"
    ticks = [("m", "c", START + timedelta(seconds=s), v) for s, v in ((10, 5.0), (100, 9.0), (130, 1.0), (140, 2.0))] + [("m", "d", START, 3.0)]
    stream = source(spark, tmp_path, ticks, schema)
    means = jobs.run_to_table(jobs.bucket_means(stream, 30, "0 seconds"), f"file://{tmp_path}/means", f"file://{tmp_path}/c1")
    left = jobs.flush_open(spark.createDataFrame(ticks, schema), means, 30)
    whole = sorted((r.channel_id, r.value) for r in means.union(left).collect())
    assert whole == [("c", 1.5), ("c", 5.0), ("c", 9.0), ("d", 3.0)]
    params = spark.createDataFrame([("m", "c", 1.0, 2.0)], "mission_id string, channel_id string, mean double, std double")
    raw = jobs.run_to_table(jobs.normalized_ticks(stream, params), f"file://{tmp_path}/raw", f"file://{tmp_path}/c2")
    assert sorted(r.value_normalized for r in raw.collect()) == [0.0, 0.5, 2.0, 4.0]


def test_drift_of_both_features_and_subsystems(spark, tmp_path):
    rows = [("m", c, k, float(k % 3) + (5.0 if c == "c" and k >= 40 else 0.0)) for k in range(80) for c in ("c", "d")]
    stream = source(spark, tmp_path, rows, jobs.GRID)
    known = spark.createDataFrame([("m", c, f, x) for c in ("c", "d") for f, xs in (("value", [0.0, 1.0, 2.0] * 20), ("change", [1.0, 1.0, -2.0] * 20)) for x in xs], "mission_id string, channel_id string, feature string, x double")
    snapshots = jobs.run_to_table(jobs.drift_snapshots(stream, known, 1.0, 30, 10, 0.3, 0.5, 2), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    found = {(r.channel_id, r.bucket_us): r for r in snapshots.collect()}
    assert sorted(k for c, k in found if c == "c") == [29, 39, 49, 59, 69, 79]
    assert [found["c", k].confirmed for k in (29, 39, 49, 59, 69, 79)] == [False, False, False, True, True, True]
    assert not any(found["d", k].alert for k in (29, 39, 49, 59, 69, 79))
    last = {f.feature: f for f in found["c", 79].features}
    assert last["value"].drifted and not last["change"].drifted and found["c", 79].share == 0.5
    again = spark.readStream.schema(snapshots.schema).parquet(f"file://{tmp_path}/out")
    subsystems = spark.createDataFrame([("m", "c", "s"), ("m", "d", "s")], "mission_id string, channel_id string, subsystem string")
    states = jobs.run_to_table(jobs.subsystem_drift(again, subsystems, 0.5), f"file://{tmp_path}/subs", f"file://{tmp_path}/c3").orderBy("bucket_us").collect()
    assert states[-1].bucket_us == 79 and states[-1].share == 0.5 and states[-1].alert and not states[0].alert


def test_live_flatlines_anchor_themselves(spark, tmp_path):
    rows = [("m", c, k * 10, float(k + (100 if c == "d" else 0))) for k in range(12) for c in ("c", "d")]
    stream = source(spark, tmp_path, rows, jobs.GRID)
    faults = spark.createDataFrame([("m", "c", "flatline", 25, 60, None), ("m", "d", "spike", 30, 40, 3.0), ("m", "c", "flatline", 80, 100, None)], "mission_id string, channel_id string, type string, from_us long, to_us long, magnitude double")
    out = jobs.run_to_table(jobs.inject_live_anchored(stream, faults), f"file://{tmp_path}/out", f"file://{tmp_path}/c").orderBy("channel_id", "bucket_us").collect()
    assert [(r.value, r.injected) for r in out if r.channel_id == "c"] == [(0.0, False), (1.0, False), (2.0, False), *[(3.0, True)] * 3, (6.0, False), (7.0, False), *[(8.0, True)] * 2, (10.0, False), (11.0, False)]
    assert [(r.value, r.injected) for r in out if r.channel_id == "d"][3:5] == [(106.0, True), (104.0, False)]


def test_staleness_events(spark, tmp_path):
    at = [0, 10, 200, 210, 7000, 7400]
    ticks = [("m", f"c{k % 2}", START + timedelta(seconds=s)) for k, s in enumerate(at)]
    stream = source(spark, tmp_path, ticks, "mission_id string, channel_id string, telemetry_timestamp timestamp")
    out = jobs.run_to_table(jobs.staleness(stream, 60, 5400), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    assert sorted((r.us // 1_000_000 - base, r.event) for r in out.collect()) == [(70, "lost"), (200, "recovered"), (270, "lost"), (5610, "fatal"), (7000, "recovered"), (7060, "lost"), (7400, "recovered")]


def test_updates_archive_and_faults(spark, tmp_path):
    rows = [("m", "c", START, "1.5", "x"), ("m", "c", START, None, "1"), ("m", "d", START, "bad", "1"), ("m", "d", START, "2", "7.5")]
    stream = jobs.parse_updates(source(spark, tmp_path, rows, "mission_id string, channel_id string, received timestamp, value string, aos string"))
    jobs.archive(stream, f"file://{tmp_path}/arch", f"file://{tmp_path}/c").awaitTermination()
    assert sorted((r.channel_id, r.value, r.aos_timestamp) for r in spark.read.parquet(f"file://{tmp_path}/arch").collect()) == [("c", 1.5, None), ("d", 2.0, 7.5)]
    grid = spark.createDataFrame([("m", "c", k * 10, -1.0) for k in range(4)], jobs.GRID)
    faults = spark.createDataFrame([("m", "c", "spike", 10, 20, 3.0, 0.0), ("m", "c", "flatline", 30, 40, 0.0, 9.0)], "mission_id string, channel_id string, type string, from_us long, to_us long, magnitude double, anchor double")
    assert [(r.value, r.injected) for r in jobs.inject_live(grid, faults).orderBy("bucket_us").collect()] == [(-1.0, False), (-4.0, True), (-1.0, False), (9.0, True)]


def test_drift_stream(spark, tmp_path):
    rows = [("m", c, k, 5.0 + (k % 3)) for k in range(80) for c in ("c", "without")]
    stream = source(spark, tmp_path, rows, jobs.GRID)
    reference = spark.createDataFrame([("m", "c", "value", float(k % 3)) for k in range(60)], "mission_id string, channel_id string, feature string, x double")
    out = jobs.run_to_table(jobs.drift_stream(stream, reference, 30, 10, 1.0, 3), f"file://{tmp_path}/out", f"file://{tmp_path}/c").orderBy("bucket_us").collect()
    assert [r.bucket_us for r in out] == [29, 39, 49, 59, 69, 79]
    assert all(r.alert for r in out) and [r.confirmed for r in out] == [False, False, True, True, True, True]
    assert out[0].score == pytest.approx(5 / (2 / 3) ** 0.5, rel=1e-6)


def plain_steps(values, inputs, span, window, z, least_run):
    """A scorer that takes one value at a time."""
    alpha, held, ring, smoothed, flags, out = 2 / (span + 1), [], [], None, 0, []
    for x in values:
        row = (None, None, None, False)
        if len(held) >= inputs:
            error = abs(held[-1] - x)
            smoothed = error if smoothed is None else alpha * error + (1 - alpha) * smoothed
            limit = None
            if len(ring) >= window:
                last = ring[-window:]
                mean = sum(last) / window
                limit = mean + z * (sum((y - mean) ** 2 for y in last) / window) ** 0.5
            flags = flags + 1 if limit is not None and smoothed > limit else 0
            ring.append(smoothed)
            row = (held[-1], smoothed, limit, flags >= least_run)
        held.append(x)
        out.append(row)
    return out


@pytest.mark.parametrize("span", [1, 2, 30])
def test_scores_of_any_pieces_equal_single_steps(span):
    rng = np.random.default_rng(span)
    values = np.round(rng.normal(size=700), 2)
    values[300:310] += 8
    want = plain_steps(values.tolist(), 5, span, 40, 2.0, 3)
    for size in (1, 7, 300, 700):
        scorer = jobs.OnlineScorer(5, span, 40, 2.0, 3)
        made = [np.concatenate(x) for x in zip(*(scorer.run(values[k : k + size]) for k in range(0, 700, size)), strict=True)]
        for row, w in zip(zip(*made, strict=True), want, strict=True):
            assert bool(row[3]) == w[3] and [None if np.isnan(x) else x for x in row[:3]] == [None if x is None else pytest.approx(x, abs=1e-9) for x in w[:3]]
    assert any(w[3] for w in want)
    one = jobs.OnlineScorer(5, span, 40, 2.0, 3)
    assert [one.step(v)[3] for v in values] == [w[3] for w in want]


def test_a_stream_goes_on_where_the_batch_ends(spark, tmp_path):
    channels, n, cut = [f"c{k}" for k in range(25)], 160, 97
    value = lambda c, k: float((k * 7919 + len(c) * 31 + int(c[1:]) * 101) % 97) / 50 + (6 if 100 <= k < 104 or (int(c[1:]) % 2 and 95 <= k < 98) else 0)
    data = [("m", c, START + timedelta(seconds=30 * k), k, value(c, k), 0, False) for c in channels for k in range(n)]
    df = spark.createDataFrame(data, "mission_id string, channel_id string, telemetry_timestamp timestamp, tick_id long, value_normalized double, segment_id int, is_anomaly boolean")
    batch = lambda d: scoring.score(scoring.predict_persistence(scoring.valid_windows(d, 10, 1)), 5, 20, 2.0, 3, "strict")
    series = df.withColumn("bucket_us", F.unix_micros("telemetry_timestamp"))
    for recent in (None, 0, 4):
        state = jobs.scoring_state(series.where(F.col("tick_id") < cut), batch(df.where(F.col("tick_id") < cut)), 10, 20, 3, recent)
        rows = [("m", c, int((START - datetime(1970, 1, 1)).total_seconds() + 30 * k) * 1_000_000, value(c, k)) for k in range(cut, n) for c in channels]
        stream = source(spark, tmp_path, rows, "mission_id string, channel_id string, bucket_us bigint, value double", f"in{recent}")
        online = jobs.run_to_table(jobs.score_grid(stream, 10, 5, 20, 2.0, 3, state, 3600, recent), f"file://{tmp_path}/out{recent}", f"file://{tmp_path}/cp{recent}")
        want = scoring.trailing_flag(batch(df).drop("predicted"), 3).where(F.col("tick_id") >= cut).select("channel_id", F.unix_micros("telemetry_timestamp").alias("bucket_us"), "prediction", "smoothed", "threshold", "predicted")
        key = lambda r: (r.channel_id, r.bucket_us)
        got, want = sorted(online.collect(), key=key), sorted(want.collect(), key=key)
        assert len(got) == len(want) == len(rows) and any(r.predicted for r in got)
        for a, b in zip(got, want, strict=True):
            assert key(a) == key(b) and a.predicted == b.predicted and [a.prediction, a.smoothed, a.threshold] == pytest.approx([b.prediction, b.smoothed, b.threshold], abs=1e-9)


def test_streamed_drift_equals_rolling_drift(spark, tmp_path):
    rng = np.random.default_rng(3)
    xs = {c: np.round(rng.normal(size=90), 1) + (np.arange(90) >= 50) * (c == "c") for c in ("c", "d", "without")}
    rows = [("m", c, k, float(x[k])) for k in range(90) for c, x in xs.items()]
    reference = spark.createDataFrame([("m", c, f, float(x)) for c in ("c", "d") for f in ("value", "change") for x in np.round(rng.normal(size=70), 1)], "mission_id string, channel_id string, feature string, x double")
    stream = source(spark, tmp_path, rows, "mission_id string, channel_id string, bucket_us bigint, value double")
    found = jobs.run_to_table(jobs.drift_snapshots(stream, reference, 2.0, 32, 5, 0.3, 0.5, 2), f"file://{tmp_path}/out", f"file://{tmp_path}/c")
    df = spark.createDataFrame([(m, c, k, x) for m, c, k, x in rows], "mission_id string, channel_id string, position long, value_normalized double")
    want = {(r.channel_id, r.position, r.feature): r.score for r in drift.rolling_drift(df, reference, 32, 5, interval=2.0).collect()}
    got = {(r.channel_id, r.bucket_us, f.feature): f.score for r in found.collect() for f in r.features}
    assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()} and len(got) == 3 * 12 * 2


def test_losses_are_told_while_the_feed_is_silent(spark, tmp_path):
    """By the watermark of another mission, in the same order as between ticks that come together."""
    schema = "mission_id string, channel_id string, telemetry_timestamp timestamp"
    path = f"file://{tmp_path}/in"
    batches = [[("m", 0), ("m", 10), ("n", 0)], [("n", 50), ("n", 100)], [("n", 5000)], [("n", 5500)], [("n", 5501)], [("m", 9)], [("m", 6000), ("n", 6001)]]
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/c"
    base, seen = int((START - datetime(1970, 1, 1)).total_seconds()), []
    for batch in batches:
        spark.createDataFrame([(m, "c", START + timedelta(seconds=s)) for m, s in batch], schema).coalesce(1).write.mode("append").parquet(path)
        table = jobs.run_to_table(jobs.staleness(spark.readStream.schema(schema).parquet(path), 60, 5400), out, checkpoint)
        seen.append(sorted((r.us // 1_000_000 - base, r.event) for r in table.where("mission_id = 'm'").collect()))
    assert seen[:5] == [[], [(70, "lost")], [(70, "lost")], [(70, "lost"), (5410, "fatal")], [(70, "lost"), (5410, "fatal")]]
    assert seen[5] == seen[4] and seen[6] == [(70, "lost"), (5410, "fatal"), (6000, "recovered")]


def test_losses_by_arrival_need_no_further_tick(spark, tmp_path):
    schema = "mission_id string, channel_id string, telemetry_timestamp timestamp"
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda s: spark.createDataFrame([("m", "c", START + timedelta(seconds=s))], schema).coalesce(1).write.mode("append").parquet(path)
    put(0)
    events = jobs.staleness(spark.readStream.schema(schema).parquet(path), 3, 6, clock="processing")
    query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        told = lambda: sorted((r.us, r.event) for r in spark.read.schema(events.schema).parquet(out).collect())
        base = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        for _ in range(60):
            time.sleep(1)
            if len(told()) == 2:
                break
        assert told() == [(base + 3_000_000, "lost"), (base + 6_000_000, "fatal")]
        put(100)
        for _ in range(60):
            time.sleep(1)
            if len(told()) >= 3:
                break
        assert told()[:3] == [(base + 3_000_000, "lost"), (base + 6_000_000, "fatal"), (base + 100_000_000, "recovered")]
    finally:
        query.stop()


def test_replayed_silences_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(8)
    at = np.cumsum(rng.choice([1, 5, 59, 60, 61, 300, 6000], size=150))
    ticks = [("m", f"c{k % 3}", START + timedelta(seconds=int(s))) for k, s in enumerate(at)]
    schema = "mission_id string, channel_id string, telemetry_timestamp timestamp"
    batch = resample.silences(spark.createDataFrame(ticks, schema), 60).collect()
    last = (START - datetime(1970, 1, 1)).total_seconds() * 1e6 + int(at[-1]) * 1e6
    for clock in ("event", "processing"):
        events, out = jobs.staleness(source(spark, tmp_path, ticks, schema, clock), 60, 5400, clock), f"file://{tmp_path}/out{clock}"
        found = lambda e: sorted(r.us for r in spark.read.schema(events.schema).parquet(out).where(F.col("event") == e).collect() if r.us <= last)  # noqa: E731, B023
        if clock == "event":
            jobs.run_to_table(events, out, f"file://{tmp_path}/c{clock}")
        else:
            query = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c{clock}").trigger(processingTime="1 second").start()
            for _ in range(60):
                time.sleep(1)
                if len(found("recovered")) >= len(batch):
                    break
            query.stop()
        assert found("lost") == sorted(r.lost_us + 60_000_000 for r in batch) and found("recovered") == sorted(r.recovered_us for r in batch)
        assert found("fatal") == sorted(r.lost_us + 5_400_000_000 for r in batch if r.recovered_us - r.lost_us > 5_400_000_000)
