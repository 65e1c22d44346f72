"""Tables that are kept by the fingerprint of what they are made from."""

import os
import time

from seriesmill.plans import telemetry as tm
from seriesmill.sources import io


def test_a_second_use_writes_nothing_and_a_changed_file_misses(spark, tmp_path):
    path, made = f"file://{tmp_path}/in", []
    spark.range(5).write.parquet(path)

    def table(*parameters):
        def make():
            made.append(parameters)
            return spark.read.parquet(path)

        return io.kept(spark, "t", io.input_fingerprint(spark, [path], *parameters), make)

    assert table(1).count() == table(1).count() == 5 and made == [(1,)]
    assert table(2).count() == 5 and made == [(1,), (2,)]
    spark.range(3).write.mode("append").parquet(path)
    assert table(1).count() == 8 and made == [(1,), (2,), (1,)]
    # Half a table, of a writer that was lost, is made anew.
    folder = io._shared(spark).removeprefix("file://") + "/kept"
    for name in os.listdir(folder):
        if name.startswith("t-"):
            os.unlink(f"{folder}/{name}/_SUCCESS")
    assert table(1).count() == 8 and len(made) == 4
    before = len(os.listdir(folder))
    assert io.forget(spark, 3600) == 0 and len(os.listdir(folder)) == before
    time.sleep(1.1)
    assert io.forget(spark, 1) == before and os.listdir(folder) == []
    assert table(1).count() == 8 and len(made) == 5


def test_series_of_two_queries_are_one_table(spark):
    folder = io._shared(spark).removeprefix("file://") + "/kept"
    names = lambda: sorted(n for n in os.listdir(folder)) if os.path.isdir(folder) else []
    first = tm.series(spark, "/root/testdata/sf0.001")
    one = names()
    second = tm.series(spark, "/root/testdata/sf0.001")
    assert names() == one and first.inputFiles() == second.inputFiles()
    assert tm.series(spark, "/root/testdata/sf0.001", wide=True).inputFiles() != first.inputFiles()


def test_footers_tell_what_a_scan_does_without_reading_rows(spark, tmp_path):
    from pyspark.sql import functions as F

    path = f"file://{tmp_path}/grid"
    rows = spark.range(1000).select(F.lit("m").alias("mission_id"), F.concat(F.lit("0"), F.col("id") % 3).alias("channel_id"), (F.col("id") * 7 - 500).alias("bucket_us"), F.col("id").cast("float").alias("value"))
    rows.repartition(4).write.partitionBy("mission_id", "channel_id").parquet(path)
    found = io.footer_statistics(spark, path)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(bucket_us), MAX(bucket_us)]" in plan and "PushedGroupBy: [mission_id, channel_id]" in plan
    scan = rows.groupBy("mission_id", "channel_id").agg(F.count("*"), F.min("bucket_us"), F.max("bucket_us"), F.lit("bucket_us bigint, value float"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != "avro,csv,json,kafka,orc,text"
