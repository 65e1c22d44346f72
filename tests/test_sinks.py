"""Sinks that get batches twice, or break off between writing and marking."""

from datetime import datetime, timedelta

import pytest

from seriesmill.operators import reports
from seriesmill.streaming import sinks

SCHEMA = "mission_id string, channel_id string, bucket_us long, predicted boolean"


def state(spark, path):
    return sorted(tuple(r) for r in sinks.read_recent(spark, path).collect())


def test_backlog_of_a_stream_equals_the_batch(spark, tmp_path):
    rows = [("m", c, k * 10, k % 7 == 0) for k in range(60) for c in ("a", "b", "c") if c != "c" or k < 5]
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    path = f"file://{tmp_path}/out"
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    sinks.backlog(stream, path, f"file://{tmp_path}/c", 20).awaitTermination()
    want = reports.recent(spark.createDataFrame(rows, SCHEMA), 20, ("bucket_us",)).drop("newest")
    assert state(spark, path) == sorted(tuple(r) for r in want.collect())
    assert len(sinks.committed(spark, path)) == 2 and sinks.committed(spark, path)[-1] == len(range(0, len(rows), 30)) - 1


def test_a_batch_delivered_twice_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    batch = lambda a, b: spark.createDataFrame([("m", "a", k, False) for k in range(a, b)], SCHEMA)
    with pytest.raises(FileNotFoundError):
        sinks.read_recent(spark, path)
    sinks.merge_recent(batch(0, 5), 0, path, 6)
    sinks.merge_recent(batch(5, 9), 1, path, 6)
    one = state(spark, path)
    assert [r[2] for r in one] == [3, 4, 5, 6, 7, 8]
    for again in ((batch(5, 9), 1), (batch(50, 90), 1), (batch(0, 5), 0)):
        sinks.merge_recent(*again, path, 6)
        assert state(spark, path) == one
    # A version without its mark, of a writer that was lost, is written anew.
    (tmp_path / "t/batch=1/_SUCCESS").unlink()
    assert sinks.committed(spark, path) == [0]
    sinks.merge_recent(batch(5, 9), 1, path, 6)
    assert state(spark, path) == one
    sinks.merge_recent(batch(9, 9), 2, path, 6)
    assert state(spark, path) == one and sinks.committed(spark, path) == [1, 2]


def test_archive_drops_the_oldest_beyond_the_cap(spark, tmp_path):
    at = lambda s: datetime(2000, 1, 1) + timedelta(seconds=s)
    schema = "channel_id string, telemetry_timestamp timestamp, value float, aos_timestamp double"
    rows = [(c, at(k), float(k), None) for k in range(10) for c in ("a", "b") if c == "a" or k < 3]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    path = f"file://{tmp_path}/out"
    stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
    sinks.archive_capped(stream, path, f"file://{tmp_path}/c", 4).awaitTermination()
    from seriesmill.sources import io

    kept = lambda: sorted((r.channel_id, r.value) for r in io.read_ticks(spark, f"{path}/ticks").collect())
    want = [("a", 6.0), ("a", 7.0), ("a", 8.0), ("a", 9.0), ("b", 0.0), ("b", 1.0), ("b", 2.0)]
    assert kept() == want and [tuple(r)[:2] for r in spark.read.parquet(f"{path}/dropped").collect()] == [("a", 6)]
    sinks.archive_batch(spark.createDataFrame(rows, schema), 0, path, 4)
    sinks.archive_batch(spark.createDataFrame([], schema), 1, path, 4)
    assert kept() == want and sinks.committed(spark, f"{path}/ticks") == [0]
    assert sorted(r.channel_id for r in io.read_ticks(spark, f"{path}/ticks", ["b"]).collect()) == ["b"] * 3
    with pytest.raises(FileNotFoundError):
        io.read_ticks(spark, f"{path}/ticks", ["x"])


def test_recent_shards(spark, tmp_path):
    from seriesmill.sources import io

    for k, name in enumerate(("ticks-20000101T000000.parquet", "ticks-20000201T000000.parquet", "plain.parquet")):
        spark.createDataFrame([(k,)], "x int").coalesce(1).write.parquet(f"file://{tmp_path}/w{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{k}").glob("part-*.parquet")).rename(tmp_path / "in" / name)
    assert sorted(r.x for r in io.recent_shards(spark.read.parquet(f"file://{tmp_path}/in"), "2000-01-15").collect()) == [1, 2]
