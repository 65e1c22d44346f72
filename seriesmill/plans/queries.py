"""Registered queries, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import features
from ..functions.series import KEYS
from ..operators import drift, inject, prepare, profile, reports, resample, runs, scoring, sweep
from ..sources import io, views
from ..streaming import jobs
from . import telemetry as tm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """The columns without the mission; numbers with a fraction to six places, times in microseconds."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            out.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            out.append(F.unix_micros(f.name).alias(f.name))
        elif f.name != "mission_id":
            out.append(F.col(f.name))
    return df.select(*out)


def register(sql: str | None = None):
    def add(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(function(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


ORDER = "PARTITION BY channel_id ORDER BY us, tick_id"
TICKS = "t AS (SELECT event_type AS channel_id, epoch_us(ts) AS us, value::FLOAT AS value, event_id AS tick_id FROM events)"
SEGMENTED = f"""{TICKS},
f AS (SELECT * FROM (SELECT channel_id, us, tick_id, last_value(value IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS value FROM t) WHERE value IS NOT NULL),
d AS (SELECT *, us - lag(us) OVER ({ORDER}) AS step FROM f),
m AS (SELECT channel_id, median(step) AS med FROM d GROUP BY 1),
g AS (SELECT channel_id, us, tick_id, value, coalesce(step > med * 8, false) AS is_gap FROM d JOIN m USING (channel_id)),
s AS (SELECT *, (sum(is_gap::INT) OVER ({ORDER} ROWS UNBOUNDED PRECEDING))::INT AS segment_id FROM g)"""
LABELS = "lab AS (SELECT event_type AS channel_id, epoch_us(ts) AS a, epoch_us(ts) + 7200000000 AS b FROM events WHERE user_id % 50 = 0)"
SERIES = f"""{SEGMENTED}, {LABELS},
pr AS (SELECT channel_id, avg(value::DOUBLE) AS mean, coalesce(stddev_samp(value::DOUBLE), 0) AS std FROM f GROUP BY 1),
n AS (SELECT s.*, (CASE WHEN std = 0 THEN 0 ELSE (value::DOUBLE - mean) / std END)::FLOAT AS vn FROM s JOIN pr USING (channel_id)),
l AS (SELECT n.*, EXISTS (SELECT 1 FROM lab WHERE lab.channel_id = n.channel_id AND n.us >= lab.a AND n.us < lab.b) AS is_anomaly FROM n),
x AS (SELECT *, CASE WHEN us <= min(us) OVER (PARTITION BY channel_id) + 0.8::DOUBLE * (max(us) OVER (PARTITION BY channel_id) - min(us) OVER (PARTITION BY channel_id)) THEN 'train' ELSE 'test' END AS split,
  row_number() OVER ({ORDER}) - 1 AS position FROM l)"""
WINDOWS = f"""{SERIES},
w0 AS (SELECT channel_id, us, tick_id, segment_id, vn::DOUBLE AS vn, lag(segment_id, 10) OVER ({ORDER}) AS first_segment, coalesce(bool_or(is_anomaly) OVER ({ORDER} ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), false) AS window_label, lag(vn::DOUBLE) OVER ({ORDER}) AS previous FROM x),
w AS (SELECT channel_id, us, tick_id, vn, window_label, previous, row_number() OVER ({ORDER}) - 1 AS position FROM w0 WHERE first_segment = segment_id)"""
POS = "PARTITION BY channel_id ORDER BY position"
SMOOTHED = f"""{WINDOWS},
e AS (SELECT *, previous - vn AS residual FROM w),
sm AS (SELECT channel_id, position, abs(residual) AS smoothed FROM e WHERE position = 0
  UNION ALL SELECT e.channel_id, e.position, abs(e.residual) / 3 + sm.smoothed * 2 / 3 FROM sm JOIN e ON e.channel_id = sm.channel_id AND e.position = sm.position + 1)"""
SCORED = f"""{SMOOTHED},
th AS (SELECT e.*, smoothed, avg(smoothed) OVER ({POS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) + 3 * stddev_pop(smoothed) OVER ({POS} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS threshold FROM e JOIN sm USING (channel_id, position)),
ab AS (SELECT *, coalesce(smoothed > threshold, false) AS above FROM th),
rn AS (SELECT *, row_number() OVER ({POS}) - row_number() OVER (PARTITION BY channel_id, above ORDER BY position) AS run FROM ab),
sc AS (SELECT * EXCLUDE (run), above AND count(*) OVER (PARTITION BY channel_id, above, run) >= 2 AS predicted FROM rn)"""


def runs_of(flag: str, table: str, name: str, keys: str = "channel_id") -> str:
    return f"""{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY position) - row_number() OVER (PARTITION BY {keys}, {flag} ORDER BY position) AS run FROM {table}),
{name} AS (SELECT {keys}, min(position) AS a, max(position) + 1 AS b FROM {name}0 WHERE {flag} GROUP BY {keys}, run)"""


def over(a: str, b: str) -> str:
    return f"coalesce({a}::DOUBLE / nullif({b}, 0), 0)"


def f_of(p: str, r: str, square: str) -> str:
    return f"coalesce((1 + {square}) * {p} * {r} / nullif({square} * {p} + {r}, 0), 0)"


POINTS = f"""pm0 AS (SELECT channel_id, count(*) FILTER (t1 AND p1) AS tp, count(*) FILTER (NOT t1 AND p1) AS fp, count(*) FILTER (t1 AND NOT p1) AS fn, count(*) FILTER (t1) AS n_true, count(*) FILTER (p1) AS n_predicted FROM judged GROUP BY 1),
pm1 AS (SELECT *, {over("tp", "n_predicted")} AS precision, {over("tp", "n_true")} AS recall FROM pm0),
pm AS (SELECT *, {f_of("precision", "recall", "1.0::DOUBLE")} AS f1, {f_of("precision", "recall", "0.25::DOUBLE")} AS f05 FROM pm1)"""
SEGMENTS = f"""{runs_of("t1", "judged", "tr")}, {runs_of("p1", "judged", "pd")},
sg0 AS (SELECT DISTINCT channel_id FROM judged),
sg1 AS (SELECT channel_id, (SELECT count(*) FROM tr WHERE tr.channel_id = c.channel_id) AS seg_true, (SELECT count(*) FROM tr WHERE tr.channel_id = c.channel_id AND EXISTS (SELECT 1 FROM pd WHERE pd.channel_id = tr.channel_id AND pd.a < tr.b AND pd.b > tr.a)) AS hit_true,
  (SELECT count(*) FROM pd WHERE pd.channel_id = c.channel_id) AS seg_predicted, (SELECT count(*) FROM pd WHERE pd.channel_id = c.channel_id AND EXISTS (SELECT 1 FROM tr WHERE pd.channel_id = tr.channel_id AND pd.a < tr.b AND pd.b > tr.a)) AS hit_predicted FROM sg0 c),
sg2 AS (SELECT *, {over("hit_true", "seg_true")} AS seg_recall, {over("hit_predicted", "seg_predicted")} AS seg_precision FROM sg1),
sg AS (SELECT *, {f_of("seg_precision", "seg_recall", "1.0::DOUBLE")} AS seg_f1, {f_of("seg_precision", "seg_recall", "0.25::DOUBLE")} AS seg_f05 FROM sg2)"""


# Sources, sinks, layout


@register("SELECT event_type AS channel_id, count(*) AS n, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1")
def src_partition_statistics(spark, sf_dir):
    return io.partition_statistics(views.ticks(spark, sf_dir))


@register("SELECT DISTINCT event_type AS channel_id FROM events WHERE event_type NOT IN ('error') AND event_type IN ('click', 'view', 'signup', 'error')")
def src_archived_channels(spark, sf_dir):
    registry = views.subsystems(spark, sf_dir).where(F.col("channel_id").isin("click", "view", "signup", "error")).select("channel_id")
    return io.archived_channels(views.ticks(spark, sf_dir), ["error"], registry)


@register("SELECT channel_id, count(*) AS n, round(sum(value), 3) AS total FROM (UNPIVOT (SELECT l_shipdate, l_quantity::FLOAT::DOUBLE AS l_quantity, l_extendedprice::FLOAT::DOUBLE AS l_extendedprice, l_discount::FLOAT::DOUBLE AS l_discount FROM lineitem) ON l_quantity, l_extendedprice, l_discount INTO NAME channel_id VALUE value) GROUP BY 1")
def src_wide_to_long(spark, sf_dir):
    wide = views.table(spark, sf_dir, "lineitem").select("l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    return io.wide_to_long(wide, "l_shipdate", "q").groupBy("channel_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 3).alias("total"))


@register("SELECT event_id::VARCHAR AS anomaly_id, event_type AS channel_id, epoch_us(date_trunc('second', ts)) AS start_time, epoch_us(date_trunc('second', ts)) + 7200000000 AS end_time FROM events WHERE user_id % 50 = 0")
def src_label_stamps(spark, sf_dir):
    text = F.concat(F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    start = io.parse_stamp(text)
    return views.label_intervals(spark, sf_dir).select("anomaly_id", "channel_id", start.alias("start_time"), (start + F.expr("INTERVAL 2 HOURS")).alias("end_time"))


@register(f"WITH {SERIES} SELECT count(DISTINCT channel_id) AS n_channels, count(*) AS n_rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'test') AS test_rows FROM x")
def snk_run_summary(spark, sf_dir):
    return io.run_summary(tm.series(spark, sf_dir))


@register(f"WITH {SERIES} SELECT channel_id, count(*) AS train_rows FROM x WHERE split = 'train' GROUP BY 1")
def snk_channel_manifest(spark, sf_dir):
    return io.channel_manifest(tm.series(spark, sf_dir))


@register(f"WITH {TICKS}, h AS (SELECT channel_id, md5(us::VARCHAR || '|' || tick_id::VARCHAR) AS h FROM t), k AS (SELECT channel_id, count(*) AS n, sum(('0x' || h[1:8])::BIGINT) AS a, sum(('0x' || h[9:16])::BIGINT) AS b FROM h GROUP BY 1) SELECT channel_id, n, sha256(n || ':' || a || ':' || b) AS fingerprint FROM k")
def src_content_fingerprint(spark, sf_dir):
    return io.content_fingerprint(views.ticks(spark, sf_dir).withColumn("us", F.unix_micros("telemetry_timestamp")), ["us", "tick_id"])


@register(f"WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY us DESC, tick_id DESC) AS r FROM x WHERE NOT is_anomaly) SELECT channel_id, us AS telemetry_timestamp, round(vn::DOUBLE, 6) AS value_normalized FROM k WHERE r <= 120")
def src_newest_nominal_rows(spark, sf_dir):
    return drift.newest_rows(tm.series(spark, sf_dir), 120, True).select("channel_id", "telemetry_timestamp", "value_normalized")


# Sampling, exploration, profiling


@register("SELECT channel_id FROM (SELECT DISTINCT l_suppkey::VARCHAR AS channel_id FROM lineitem) ORDER BY 1 LIMIT 5")
def smp_first_channels(spark, sf_dir):
    return profile.first_channels(views.wide_ticks(spark, sf_dir), 5).select("channel_id")


@register(f"WITH {TICKS}, k AS (SELECT *, row_number() OVER ({ORDER}) AS r, greatest(1, floor(count(*) OVER (PARTITION BY channel_id) * 0.1::DOUBLE)) AS n FROM t) SELECT channel_id, us AS telemetry_timestamp, tick_id FROM k WHERE r <= n")
def smp_head_sample(spark, sf_dir):
    return profile.head_sample(views.ticks(spark, sf_dir), 0.1).select("channel_id", "telemetry_timestamp", "tick_id")


@register("SELECT event_id::VARCHAR AS anomaly_id, event_type AS channel_id FROM events WHERE user_id % 50 = 0 AND event_type IN ('click', 'error')")
def smp_labels_of_channels(spark, sf_dir):
    kept = views.ticks(spark, sf_dir).where(F.col("channel_id").isin("click", "error")).select("channel_id").distinct()
    return profile.labels_of(views.label_intervals(spark, sf_dir), kept).select("anomaly_id", "channel_id")


@register("SELECT event_type AS channel_id, count(*) AS n_rows FROM events GROUP BY 1")
def smp_manifest(spark, sf_dir):
    return profile.sample_manifest(views.ticks(spark, sf_dir))


@register(f"WITH {TICKS}, st AS (SELECT median(step) / 1e6 AS median_step_s FROM (SELECT us - lag(us) OVER ({ORDER}) AS step FROM t WHERE channel_id = (SELECT min(channel_id) FROM t))) SELECT count(DISTINCT channel_id) AS n_channels, string_agg(DISTINCT channel_id, ',' ORDER BY channel_id) AS channels, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, round(any_value(median_step_s), 6) AS median_step_s FROM t, st")
def exp_mission_report(spark, sf_dir):
    return profile.mission_report(views.ticks(spark, sf_dir))


@register("SELECT event_type AS channel_id, 'value' AS column, count(*) AS n, count(*) FILTER (value IS NULL) AS nulls, round(min(value::FLOAT::DOUBLE), 6) AS least, round(max(value::FLOAT::DOUBLE), 6) AS most, round(avg(value::FLOAT::DOUBLE), 6) AS mean, round(stddev_samp(value::FLOAT::DOUBLE), 6) AS std FROM events GROUP BY 1")
def exp_channel_summary(spark, sf_dir):
    return profile.channel_summary(views.ticks(spark, sf_dir), ["value"])


@register("SELECT event_type AS kind, count(*) AS n_segments, count(DISTINCT event_type) AS n_channels FROM events WHERE user_id % 50 = 0 GROUP BY 1")
def exp_label_report(spark, sf_dir):
    return profile.label_report(views.label_intervals(spark, sf_dir), "channel_id")


SUITABILITY = """k AS (SELECT l_suppkey::VARCHAR AS channel_id, l_quantity::FLOAT::DOUBLE AS v, coalesce((l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) = 0)::INT, 0) AS zero FROM lineitem),
a AS (SELECT channel_id, count(*) AS n, count(DISTINCT v) AS n_distinct, stddev_samp(v) AS std, avg(zero::DOUBLE) AS frac_zero FROM k GROUP BY 1),
b AS (SELECT *, CASE WHEN n < 600 THEN 'empty' WHEN n_distinct <= 1 THEN 'constant' WHEN frac_zero >= 0.022 THEN 'flat' ELSE 'ok' END AS status FROM a)"""


def _suitability(spark, sf_dir):
    return profile.suitability(views.wide_ticks(spark, sf_dir), least_rows=600, flat=0.022)


@register(f"WITH {SUITABILITY} SELECT channel_id, n, n_distinct, CASE WHEN status <> 'empty' THEN round(std, 6) END AS std, CASE WHEN status NOT IN ('empty', 'constant') THEN round(frac_zero, 6) END AS frac_zero, status FROM b")
def prf_suitability(spark, sf_dir):
    return _suitability(spark, sf_dir)


@register(f"WITH {SUITABILITY} SELECT channel_id FROM b WHERE status = 'ok'")
def prf_filter_channels(spark, sf_dir):
    return profile.filter_channels(views.wide_ticks(spark, sf_dir).select(*KEYS).distinct(), _suitability(spark, sf_dir))


@register(f"WITH {SUITABILITY} SELECT status, count(*) AS n, string_agg(channel_id, ',' ORDER BY channel_id) AS channels FROM b WHERE status <> 'ok' GROUP BY 1")
def prf_skip_reasons(spark, sf_dir):
    return profile.skip_reasons(_suitability(spark, sf_dir))


GRID = f"""{TICKS}, gm AS (SELECT channel_id, us - us % 3600000000 AS bucket_us, avg(value::DOUBLE) AS v FROM t GROUP BY 1, 2),
sp AS (SELECT channel_id, unnest(range(min(bucket_us), max(bucket_us) + 1, 3600000000)) AS bucket_us FROM gm GROUP BY 1),
gr AS (SELECT channel_id, bucket_us, (last_value(v IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY bucket_us ROWS UNBOUNDED PRECEDING))::FLOAT AS value FROM sp LEFT JOIN gm USING (channel_id, bucket_us))"""
FEED = f"""{GRID}, fr AS (SELECT channel_id, count(*) AS n, (max(us) - min(us)) / 3.6e9 AS span_h, median(step) AS median_step_s, max(step) AS largest_gap_s, min(value::DOUBLE) AS least, max(value::DOUBLE) AS most, stddev_samp(value::DOUBLE) AS std FROM (SELECT *, (us - lag(us) OVER ({ORDER})) / 1e6 AS step FROM t) GROUP BY 1),
gl AS (SELECT channel_id, value::DOUBLE AS v, lag(value::DOUBLE, 24) OVER (PARTITION BY channel_id ORDER BY bucket_us) AS early, (value = lag(value) OVER (PARTITION BY channel_id ORDER BY bucket_us))::INT AS zero FROM gr),
sh AS (SELECT channel_id, sum(zero)::DOUBLE / (count(*) - 1) AS flat_share, corr(v, early) AS autocorrelation FROM gl GROUP BY 1),
fv AS (SELECT *, CASE WHEN n < 50 THEN 'DEAD' WHEN autocorrelation IS NULL OR autocorrelation < 0.55 THEN 'WEAK' WHEN autocorrelation > 0.8 THEN 'STRONG' ELSE 'OK' END AS verdict FROM fr JOIN sh USING (channel_id))"""
SUBSYSTEMS = "sub AS (SELECT channel_id, CASE channel_id WHEN 'click' THEN 'payload' WHEN 'view' THEN 'payload' WHEN 'purchase' THEN 'power' WHEN 'signup' THEN 'thermal' WHEN 'error' THEN 'thermal' ELSE 'other' END AS subsystem FROM (SELECT DISTINCT event_type AS channel_id FROM events))"


def _feed(spark, sf_dir):
    return profile.feed_suitability(views.ticks(spark, sf_dir), 3600, 24)


@register(f"WITH {FEED} SELECT channel_id, n, round(span_h, 6) AS span_h, round(median_step_s, 6) AS median_step_s, round(largest_gap_s, 6) AS largest_gap_s, round(least, 6) AS least, round(most, 6) AS most, round(std, 6) AS std, round(flat_share, 6) AS flat_share, round(autocorrelation, 6) AS autocorrelation, verdict FROM fv")
def prf_feed_suitability(spark, sf_dir):
    return _feed(spark, sf_dir)


@register(f"WITH {FEED}, {SUBSYSTEMS} SELECT subsystem, verdict, count(*) AS n FROM fv JOIN sub USING (channel_id) GROUP BY 1, 2")
def prf_verdict_counts(spark, sf_dir):
    return profile.verdict_counts(_feed(spark, sf_dir), views.subsystems(spark, sf_dir))


@register(f"WITH {FEED} SELECT channel_id, verdict, row_number() OVER (ORDER BY CASE verdict WHEN 'STRONG' THEN 0 WHEN 'OK' THEN 1 WHEN 'WEAK' THEN 2 ELSE 3 END, autocorrelation DESC NULLS LAST, channel_id)::INT AS place FROM fv")
def prf_ranked_verdicts(spark, sf_dir):
    return profile.ranked_verdicts(_feed(spark, sf_dir)).select("channel_id", "verdict", "place")


# Preparation


@register(f"WITH {TICKS}, o AS (SELECT channel_id, us, tick_id, CASE WHEN tick_id % 3 > 0 THEN value END AS value FROM t), k AS (SELECT channel_id, us, tick_id, last_value(value IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS value FROM o) SELECT channel_id, us AS telemetry_timestamp, tick_id, round(value::DOUBLE, 6) AS value FROM k WHERE value IS NOT NULL")
def pre_fill_nulls(spark, sf_dir):
    holes = views.ticks(spark, sf_dir).withColumn("value", F.when(F.col("tick_id") % 3 > 0, F.col("value")))
    return prepare.fill_nulls(holes)


@register(f"WITH {SEGMENTED} SELECT channel_id, segment_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (is_gap) AS gaps FROM s GROUP BY 1, 2")
def gap_segments(spark, sf_dir):
    return tm.segmented(spark, sf_dir).groupBy("channel_id", "segment_id").agg(F.count("*").alias("n"), F.min(F.unix_micros("telemetry_timestamp")).alias("first_us"), F.max(F.unix_micros("telemetry_timestamp")).alias("last_us"), F.count_if("is_gap").alias("gaps"))


@register(f"WITH {SERIES} SELECT channel_id, round(mean, 6) AS mean, round(std, 6) AS std FROM pr")
def pre_normalization_params(spark, sf_dir):
    return prepare.normalization_params(prepare.fill_nulls(views.ticks(spark, sf_dir)))


@register(f"WITH {SERIES} SELECT channel_id, us AS telemetry_timestamp, segment_id, round(vn::DOUBLE, 5) AS value_normalized, is_anomaly, split, position FROM x")
def pre_prepared_series(spark, sf_dir):
    return tm.series(spark, sf_dir).select("channel_id", "telemetry_timestamp", "segment_id", F.round(F.col("value_normalized").cast("double"), 5).alias("value_normalized"), "is_anomaly", "split", "position")


@register("""WITH t AS (SELECT l_suppkey::VARCHAR AS channel_id, epoch_us(l_shipdate) AS us, l_quantity::FLOAT::DOUBLE AS v, l_orderkey * 10 + l_linenumber AS tick_id FROM lineitem),
d AS (SELECT *, us - lag(us) OVER (PARTITION BY channel_id ORDER BY us, tick_id) AS step FROM t), m AS (SELECT channel_id, median(step) AS med FROM d GROUP BY 1),
g AS (SELECT d.*, coalesce(step > med * 8, false)::INT AS gap, min(us) OVER (PARTITION BY channel_id) AS mn, max(us) OVER (PARTITION BY channel_id) AS mx FROM d JOIN m USING (channel_id))
SELECT channel_id, sum(gap) + 1 AS segments, count(*) FILTER (us <= mn + 0.8::DOUBLE * (mx - mn)) AS train_rows, count(*) AS n FROM g GROUP BY 1""")
def pre_many_series(spark, sf_dir):
    out = tm.series(spark, sf_dir, wide=True)
    return out.groupBy("channel_id").agg((F.max("segment_id") + 1).cast("bigint").alias("segments"), F.count_if(F.col("split") == "train").alias("train_rows"), F.count("*").alias("n"))


@register(f"WITH {SERIES}, c AS (SELECT *, min(us) OVER (PARTITION BY channel_id) + 0.8::DOUBLE * (max(us) OVER (PARTITION BY channel_id) - min(us) OVER (PARTITION BY channel_id)) AS cut FROM x) SELECT channel_id, split, count(*) AS n, min(us) AS first_us FROM c WHERE split = 'test' OR us >= cut - 864000000000 GROUP BY 1, 2")
def pre_split_lookback(spark, sf_dir):
    out = prepare.split_by_time(views.ticks(spark, sf_dir), 0.8, 10 * 86_400_000_000)
    return out.groupBy("channel_id", "split").agg(F.count("*").alias("n"), F.min(F.unix_micros("telemetry_timestamp")).alias("first_us"))


@register("SELECT DISTINCT event_type AS channel_id FROM events WHERE event_type IN ('click', 'view', 'purchase') AND event_type IN ('click', 'view')")
def pre_resolve_channels(spark, sf_dir):
    return prepare.resolve_channels(views.ticks(spark, sf_dir), ["click", "view", "purchase"], None, views.subsystems(spark, sf_dir), "payload")


@register(f"WITH {SUBSYSTEMS} SELECT channel_id, CASE WHEN channel_id IN ('click', 'view') THEN 'first' ELSE subsystem END AS subsystem FROM sub")
def pre_subsystem_map(spark, sf_dir):
    every = views.subsystems(spark, sf_dir).select("channel_id", "subsystem")
    primary = every.withColumn("subsystem", F.when(F.col("subsystem") == "payload", " first ").otherwise(" "))
    return prepare.subsystem_map(primary, every)


FIRST = "fa AS (SELECT *, greatest(coalesce(min(position) FILTER (is_anomaly) OVER (PARTITION BY channel_id) - 15, 0), 0) AS st FROM x)"


@register(f"WITH {SERIES}, {FIRST} SELECT channel_id, us AS telemetry_timestamp, position, is_anomaly FROM fa WHERE position >= st AND position < st + 40")
def pre_anomaly_slice(spark, sf_dir):
    return prepare.anomaly_slice(tm.series(spark, sf_dir), 15, 40).select("channel_id", "telemetry_timestamp", "position", "is_anomaly")


@register(f"WITH {SERIES}, a AS (SELECT channel_id, min(position) AS first_anomaly FROM x WHERE is_anomaly GROUP BY 1), b AS (SELECT channel_id, first_anomaly, min(position) FILTER (NOT is_anomaly) AS ends, max(position) + 1 AS last FROM x JOIN a USING (channel_id) WHERE position >= first_anomaly GROUP BY 1, 2) SELECT channel_id, first_anomaly, coalesce(ends, last) - first_anomaly AS first_run, first_anomaly >= 30 AS enough FROM (SELECT DISTINCT channel_id FROM x) LEFT JOIN b USING (channel_id)")
def pre_warmup_headroom(spark, sf_dir):
    return prepare.warmup_headroom(tm.series(spark, sf_dir), 10, 20)


# Resampling and loss of signal


@register(f"WITH {GRID} SELECT channel_id, bucket_us, round(value::DOUBLE, 5) AS value FROM gr")
def res_hourly_grid(spark, sf_dir):
    return resample.resample_to_grid(views.ticks(spark, sf_dir), 3600).select("channel_id", "bucket_us", F.round(F.col("value").cast("double"), 5).alias("value"))


@register("SELECT event_id, epoch_us(ts) - epoch_us(ts) % 30000000 AS bucket_us FROM events")
def res_floor_to_grid(spark, sf_dir):
    return views.ticks(spark, sf_dir).select(F.col("tick_id").alias("event_id"), resample.floor_to_grid(F.unix_micros("telemetry_timestamp"), 30).alias("bucket_us"))


MASK = f"""{TICKS}, hb AS (SELECT DISTINCT us - us % 300000000 AS bucket_us FROM t), ms AS (SELECT unnest(range(min(bucket_us), max(bucket_us) + 1, 300000000)) AS bucket_us FROM hb),
mk AS (SELECT bucket_us, bucket_us NOT IN (SELECT bucket_us FROM hb) AS is_los, row_number() OVER (ORDER BY bucket_us) - 1 AS position FROM ms)"""


@register(f"WITH {MASK} SELECT bucket_us, is_los OR lag(is_los, 1, false) OVER (ORDER BY bucket_us) OR lead(is_los, 1, false) OVER (ORDER BY bucket_us) AS is_los FROM mk")
def los_mask(spark, sf_dir):
    return resample.outage_mask(views.ticks(spark, sf_dir), 300, True)


LOST = f"""{MASK}, lr AS (SELECT *, position - row_number() OVER (PARTITION BY is_los ORDER BY position) AS run FROM mk), ld AS (SELECT min(position) AS start, max(position) + 1 AS "end", count(*) * 300 AS duration_s FROM lr WHERE is_los GROUP BY run)"""


@register(f"WITH {LOST} SELECT * FROM ld")
def los_durations(spark, sf_dir):
    return resample.outage_durations(resample.outage_mask(views.ticks(spark, sf_dir), 300, False), 300)


@register(f"WITH {LOST} SELECT quantile_cont(duration_s, 0.5)::DOUBLE AS median_s, quantile_cont(duration_s, 0.9)::DOUBLE AS p90_s, count(*) AS n_events FROM ld")
def los_statistics(spark, sf_dir):
    # One row even of no ticks, as an aggregate over all gives it.
    mission = spark.range(1).select(F.lit(views.MISSION).alias("mission_id"))
    return resample.outage_stats(views.ticks(spark, sf_dir), 300, missions=mission)


@register(f"WITH {TICKS}, k AS (SELECT us AS lost_us, lead(us) OVER (ORDER BY us) AS recovered_us FROM t) SELECT * FROM k WHERE recovered_us - lost_us > 1200000000")
def str_silences(spark, sf_dir):
    return resample.silences(views.ticks(spark, sf_dir), 1200)


@register(f"""WITH {MASK}, b AS (SELECT event_type AS channel_id, epoch_us(ts) - epoch_us(ts) % 3600000000 AS bucket_us FROM events), h AS (SELECT channel_id, unnest(range(min(bucket_us), max(bucket_us) + 1, 3600000000)) AS bucket_us FROM b GROUP BY 1),
hl AS (SELECT channel_id, bucket_us, coalesce(is_los, false) AS is_los FROM h LEFT JOIN mk USING (bucket_us)), c AS (SELECT *, (is_los <> lag(is_los, 1, false) OVER (PARTITION BY channel_id ORDER BY bucket_us))::INT AS ch FROM hl)
SELECT channel_id, bucket_us, is_los, (sum(ch) OVER (PARTITION BY channel_id ORDER BY bucket_us ROWS UNBOUNDED PRECEDING))::INT AS segment_id FROM c""")
def pre_split_at_outages(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir)
    grid = resample.attach_mask(resample.resample_to_grid(ticks, 3600), resample.outage_mask(ticks, 300, False))
    grid = grid.select(*KEYS, F.timestamp_micros("bucket_us").alias("telemetry_timestamp"), "bucket_us", F.lit(0).alias("tick_id"), "is_los", F.lit(0).alias("segment_id"))
    return prepare.split_at_outages(grid).select("channel_id", "bucket_us", "is_los", "segment_id")


GRID_SERIES = f"""{GRID}, {MASK[len(TICKS) + 2 :]}, hl AS (SELECT channel_id, bucket_us, value, coalesce(is_los, false) AS is_los FROM gr LEFT JOIN mk USING (bucket_us)),
hc AS (SELECT *, (is_los <> lag(is_los, 1, false) OVER (PARTITION BY channel_id ORDER BY bucket_us))::INT AS ch FROM hl), hs AS (SELECT *, sum(ch) OVER (PARTITION BY channel_id ORDER BY bucket_us ROWS UNBOUNDED PRECEDING) AS segment_id, avg(value::DOUBLE) OVER (PARTITION BY channel_id) AS mean, stddev_samp(value::DOUBLE) OVER (PARTITION BY channel_id) AS std, min(bucket_us) OVER (PARTITION BY channel_id) AS mn, max(bucket_us) OVER (PARTITION BY channel_id) AS mx FROM hc)"""


@register(f"WITH {GRID_SERIES} SELECT channel_id, CASE WHEN bucket_us <= mn + 0.8::DOUBLE * (mx - mn) THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT segment_id) AS segments, round(sum(((value::DOUBLE - mean) / std)::FLOAT::DOUBLE), 3) AS total FROM hs GROUP BY 1, 2")
def pre_grid_series(spark, sf_dir):
    out = tm.grid_series(views.ticks(spark, sf_dir), 3600, 300)
    return out.groupBy("channel_id", "split").agg(F.count("*").alias("n"), F.countDistinct("segment_id").alias("segments"), F.round(F.sum(F.col("value_normalized").cast("double")), 3).alias("total"))


# Features


def _features_sql() -> str:
    parts = []
    for n in features.WINDOWS:
        for kind, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
            parts.append(f"CASE WHEN position >= {n - 1} THEN {f}(vn::DOUBLE) OVER ({ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS rolling_{kind}_{n}")
    parts.append(f"(vn::DOUBLE - lag(vn::DOUBLE) OVER ({ORDER})) / nullif((us - lag(us) OVER ({ORDER})) / 1e6, 0) AS rate_of_change")
    return f"{SERIES}, ft AS (SELECT channel_id, us, tick_id, vn::DOUBLE AS value_normalized, {', '.join(parts)} FROM x)"


FEATURES = _features_sql()
ROUNDED = ", ".join(f"round({n}, 5) AS {n}" for n in ["value_normalized", *features.names()])


def _five(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(F.col(n).cast("double"), 5).alias(n) for n in ["value_normalized", *features.names()]))


@register(f"WITH {FEATURES} SELECT channel_id, us AS telemetry_timestamp, {ROUNDED} FROM ft WHERE rolling_mean_100 IS NOT NULL AND rate_of_change IS NOT NULL")
def fea_frame(spark, sf_dir):
    return _five(features.feature_frame(tm.series(spark, sf_dir)), "channel_id", "telemetry_timestamp")


@register(f"WITH {FEATURES} SELECT channel_id, us AS telemetry_timestamp, {ROUNDED} FROM ft WHERE rolling_mean_100 IS NOT NULL AND rate_of_change IS NOT NULL")
def fea_frame_blocked(spark, sf_dir):
    return _five(features.blocked_features(tm.series(spark, sf_dir).drop("position"), rows=500), "channel_id", "telemetry_timestamp")


@register(f"WITH {FEATURES}, k AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY us DESC, tick_id DESC) AS r FROM ft) SELECT channel_id, {ROUNDED} FROM k WHERE r = 1")
def fea_latest(spark, sf_dir):
    return _five(features.latest_features(tm.series(spark, sf_dir)), "channel_id")


# Windows, forecasts, scoring


@register(f"WITH {WINDOWS} SELECT channel_id, us AS telemetry_timestamp, position, window_label, round(previous, 5) AS previous FROM w")
def win_valid(spark, sf_dir):
    return tm.windows(spark, sf_dir).select("channel_id", "telemetry_timestamp", "position", "window_label", F.round("previous", 5).alias("previous"))


@register(f"WITH {WINDOWS} SELECT channel_id, count(*) AS n FROM w WHERE NOT window_label GROUP BY 1")
def win_nominal_count(spark, sf_dir):
    return scoring.valid_windows(tm.series(spark, sf_dir), 10, 1, skip_anomalous=True).groupBy("channel_id").agg(F.count("*").alias("n"))


@register(f"WITH {SERIES}, k AS (SELECT channel_id, us, segment_id, lag(segment_id, 10) OVER ({ORDER}) AS fs, list(vn::DOUBLE) OVER ({ORDER} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS x, vn::DOUBLE AS y FROM x) SELECT channel_id, us AS telemetry_timestamp, round(list_sum(x), 5) AS sum_x, len(x)::INT AS n_x, round(y, 5) AS y FROM k WHERE fs = segment_id")
def win_pairs(spark, sf_dir):
    pairs = scoring.window_pairs(tm.series(spark, sf_dir), 10, 1)
    return pairs.select("channel_id", "telemetry_timestamp", F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 5).alias("sum_x"), F.size("x").alias("n_x"), F.round("y", 5).alias("y"))


VALIDATION = f"{WINDOWS}, va AS (SELECT *, CASE WHEN position >= count(*) OVER (PARTITION BY channel_id) - greatest(1, floor(count(*) OVER (PARTITION BY channel_id) * 0.1::DOUBLE)) THEN 'validation' ELSE 'train' END AS part, count(*) OVER (PARTITION BY channel_id) AS nw FROM w)"


@register(f"WITH {VALIDATION} SELECT channel_id, part, count(*) AS n FROM va WHERE nw >= 2 GROUP BY 1, 2")
def win_validation_split(spark, sf_dir):
    return scoring.validation_split(tm.windows(spark, sf_dir)).groupBy("channel_id", "part").agg(F.count("*").alias("n"))


AR1 = f"{WINDOWS}, ar AS (SELECT channel_id, coalesce(regr_slope(vn, previous), 0) AS slope, coalesce(regr_intercept(vn, previous), avg(vn)) AS intercept FROM w GROUP BY 1)"


@register(f"WITH {AR1} SELECT channel_id, round(slope, 5) AS slope, round(intercept, 5) AS intercept FROM ar")
def fct_ar1(spark, sf_dir):
    return scoring.fit_ar1(tm.windows(spark, sf_dir)).select("channel_id", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"))


@register(f"WITH {AR1} SELECT channel_id, us AS telemetry_timestamp, round(slope * previous + intercept, 4) AS prediction FROM w JOIN ar USING (channel_id)")
def fct_predictions(spark, sf_dir):
    windows = tm.windows(spark, sf_dir)
    return scoring.predict_ar1(windows, scoring.fit_ar1(windows)).select("channel_id", "telemetry_timestamp", F.round("prediction", 4).alias("prediction"))


@register()
def fct_ar_ridge(spark, sf_dir):
    return scoring.fit_ar(scoring.window_pairs(tm.series(spark, sf_dir), 10, 1), 3)


@register(f"WITH {VALIDATION}, ar AS (SELECT channel_id, regr_slope(vn, previous) AS slope, regr_intercept(vn, previous) AS intercept FROM va WHERE part = 'train' GROUP BY 1), c AS (SELECT channel_id, 'persistence' AS model, part, pow(previous - vn, 2) AS q FROM va WHERE nw >= 2 UNION ALL SELECT channel_id, 'ar1', part, pow(slope * previous + intercept - vn, 2) FROM va JOIN ar USING (channel_id) WHERE nw >= 2), lo AS (SELECT channel_id, model, avg(q) FILTER (part = 'train') AS train_mse, avg(q) FILTER (part = 'validation') AS validation_mse FROM c GROUP BY 1, 2) SELECT channel_id, model, round(train_mse, 5) AS train_mse, round(validation_mse, 5) AS validation_mse FROM lo QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY validation_mse, model) = 1")
def fct_model_selection(spark, sf_dir):
    windows = scoring.validation_split(tm.windows(spark, sf_dir))
    ar1 = scoring.predict_ar1(windows, scoring.fit_ar1(windows.where("part = 'train'")))
    best = scoring.select_model(windows, {"persistence": scoring.predict_persistence(windows), "ar1": ar1})
    return best.select("channel_id", "model", F.round("train_mse", 5).alias("train_mse"), F.round("validation_mse", 5).alias("validation_mse"))


ORDERS, RIDGES = (1, 2), (1e-4, 1e-2, 0.1, 1.0, 10.0, 100.0)
#: Ridge regressions on one and two lags in closed form, from centred sums.
CANDIDATES = f"""{VALIDATION}, p2 AS (SELECT channel_id, us, tick_id, lag(vn::DOUBLE, 2) OVER ({ORDER}) AS before FROM x), vb AS (SELECT va.*, before FROM va JOIN p2 USING (channel_id, us, tick_id) WHERE nw >= 2),
cs AS (SELECT channel_id, count(*) AS n, avg(previous) AS mx, avg(before) AS mz, avg(vn) AS my, var_pop(previous) AS xx, var_pop(before) AS zz, covar_pop(previous, before) AS xz, covar_pop(previous, vn) AS xy, covar_pop(before, vn) AS zy FROM vb WHERE part = 'train' GROUP BY 1),
cw AS (SELECT channel_id, 1 AS "order", ridge, xy / (xx + ridge) AS b1, 0.0::DOUBLE AS b2, mx, mz, my FROM cs, (SELECT unnest({[*RIDGES]}::DOUBLE[]) AS ridge)
  UNION ALL SELECT channel_id, 2, ridge, ((zz + ridge) * xy - xz * zy) / ((xx + ridge) * (zz + ridge) - xz * xz), ((xx + ridge) * zy - xz * xy) / ((xx + ridge) * (zz + ridge) - xz * xz), mx, mz, my FROM cs, (SELECT unnest({[*RIDGES]}::DOUBLE[]) AS ridge)),
cl AS (SELECT channel_id, "order", ridge, avg(q) FILTER (part = 'train') AS train_mse, avg(q) FILTER (part = 'validation') AS validation_mse FROM (SELECT channel_id, "order", ridge, part, pow(my + b1 * (previous - mx) + b2 * (before - mz) - vn, 2) AS q FROM vb JOIN cw USING (channel_id)) GROUP BY 1, 2, 3)"""


def _candidates(spark, sf_dir):
    windows = scoring.validation_split(scoring.window_pairs(tm.series(spark, sf_dir), tm.INPUTS, tm.HORIZON))
    return scoring.ar_losses(windows, ORDERS, RIDGES)


@register(f'WITH {CANDIDATES} SELECT channel_id, "order"::INT AS "order", ridge, round(train_mse, 6) AS train_mse, round(validation_mse, 6) AS validation_mse FROM cl')
def fct_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("channel_id", "order", "ridge", F.round("train_mse", 6).alias("train_mse"), F.round("validation_mse", 6).alias("validation_mse"))


@register(f'WITH {CANDIDATES} SELECT channel_id, "order"::INT AS "order", ridge FROM cl QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY validation_mse, "order", ridge DESC) = 1')
def fct_best_candidate(spark, sf_dir):
    return scoring.best_ar(_candidates(spark, sf_dir)).select("channel_id", "order", "ridge")


@register(f"WITH RECURSIVE {SMOOTHED} SELECT channel_id, position, round(smoothed, 5) AS smoothed FROM sm")
def sco_smoothed(spark, sf_dir):
    out = scoring.smooth_errors(scoring.residuals(scoring.predict_persistence(tm.windows(spark, sf_dir))), tm.SPAN)
    return out.select("channel_id", "position", F.round("smoothed", 5).alias("smoothed"))


@register(f"WITH RECURSIVE {SCORED} SELECT channel_id, us AS telemetry_timestamp, position, round(threshold, 4) AS threshold, above, predicted, window_label FROM sc")
def sco_flags(spark, sf_dir):
    return tm.scored(spark, sf_dir).select("channel_id", "telemetry_timestamp", "position", F.round("threshold", 4).alias("threshold"), "above", "predicted", "window_label")


@register(f"WITH RECURSIVE {SCORED}, k AS (SELECT *, position >= 20 AND above AS a FROM sc) SELECT channel_id, position, position >= 1 AND a AND coalesce(lag(a) OVER ({POS}), false) AS predicted FROM k")
def sco_trailing_flags(spark, sf_dir):
    return scoring.trailing_flag(tm.scored(spark, sf_dir, "strict").drop("predicted"), 2).select("channel_id", "position", "predicted")


PRUNED = f"""{SCORED}, pg AS (SELECT *, row_number() OVER ({POS}) - row_number() OVER (PARTITION BY channel_id, predicted ORDER BY position) AS run FROM sc),
pk AS (SELECT channel_id, run, max(smoothed) AS peak, min(position) AS start FROM pg WHERE predicted GROUP BY 1, 2), bs AS (SELECT channel_id, coalesce(max(smoothed) FILTER (NOT predicted), 0) AS base FROM pg GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY peak DESC, start) AS rank, coalesce(lead(peak) OVER (PARTITION BY channel_id ORDER BY peak DESC, start), base) AS nxt FROM pk JOIN bs USING (channel_id)),
la AS (SELECT *, coalesce(max(rank) FILTER ((peak - nxt) / nullif(peak, 0) >= 0.13) OVER (PARTITION BY channel_id), 0) AS last FROM rk),
pu AS (SELECT pg.* EXCLUDE (run), predicted AND NOT EXISTS (SELECT 1 FROM la WHERE la.channel_id = pg.channel_id AND la.run = pg.run AND la.rank > la.last AND la.peak > 0) AS pruned FROM pg)"""


@register(f"WITH RECURSIVE {PRUNED} SELECT channel_id, position, predicted, pruned FROM pu WHERE predicted")
def sco_pruned(spark, sf_dir):
    return scoring.prune(tm.scored(spark, sf_dir), tm.DROP).where("predicted").select("channel_id", "position", "predicted", "pruned")


NUMBERS = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f05, 6) AS f05"
SEGMENT_NUMBERS = "seg_true, hit_true, seg_predicted, hit_predicted, round(seg_recall, 6) AS seg_recall, round(seg_precision, 6) AS seg_precision, round(seg_f1, 6) AS seg_f1, round(seg_f05, 6) AS seg_f05"


@register(f"WITH RECURSIVE {SCORED}, judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM sc), {POINTS} SELECT channel_id, tp, fp, fn, n_true, n_predicted, {NUMBERS} FROM pm")
def sco_point_metrics(spark, sf_dir):
    return scoring.point_metrics(tm.scored(spark, sf_dir)).drop("n")


@register(f"WITH RECURSIVE {SCORED}, judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM sc), {SEGMENTS} SELECT channel_id, {SEGMENT_NUMBERS} FROM sg")
def sco_segment_metrics(spark, sf_dir):
    return scoring.segment_metrics(tm.scored(spark, sf_dir))


@register(f"WITH RECURSIVE {SCORED}, judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM (SELECT *, floor(count(*) OVER (PARTITION BY channel_id) * 0.6::DOUBLE) AS cut FROM sc) WHERE position >= cut), {POINTS} SELECT channel_id, tp, fp, fn, n_true, n_predicted, {NUMBERS} FROM pm")
def sco_late_metrics(spark, sf_dir):
    return scoring.point_metrics(scoring.evaluation_slice(tm.scored(spark, sf_dir), "rest")).drop("n")


def again(sql: str, names: str, mark: str) -> str:
    """The SQL with the given names marked, to be used a second time."""
    return re.sub(rf"\b({names})\b", rf"\1{mark}", sql)


BOTH = f"""judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM pu), {POINTS}, {SEGMENTS}, judged_p AS (SELECT channel_id, position, window_label AS t1, pruned AS p1 FROM pu),
{again(POINTS, "judged|pm0|pm1|pm", "_p")}, {again(SEGMENTS, "judged|tr0|tr|pd0|pd|sg0|sg1|sg2|sg", "_p")}"""


@register(f"WITH RECURSIVE {PRUNED}, {BOTH} SELECT pm.channel_id, pm.tp, pm.fp, pm.fn, pm.n_true, pm.n_predicted, (SELECT count(*) FROM pu WHERE pu.channel_id = pm.channel_id) AS n, {re.sub(r'round[(]', 'round(pm.', NUMBERS)}, {SEGMENT_NUMBERS.replace('seg_true, hit_true, seg_predicted, hit_predicted', 'sg.seg_true, sg.hit_true, sg.seg_predicted, sg.hit_predicted').replace('round(seg', 'round(sg.seg')}, round(pm_p.precision, 6) AS pruned_precision, round(pm_p.recall, 6) AS pruned_recall, round(sg_p.seg_f05, 6) AS pruned_seg_f05, round(sg_p.seg_precision, 6) AS pruned_seg_precision FROM pm JOIN sg USING (channel_id) JOIN pm_p USING (channel_id) JOIN sg_p USING (channel_id)")
def sco_channel_report(spark, sf_dir):
    return scoring.channel_report(tm.scored(spark, sf_dir), tm.DROP)


@register(f"WITH {WINDOWS} SELECT channel_id, CASE WHEN channel_id = 'error' THEN 'skipped' WHEN channel_id = 'view' THEN 'error' ELSE 'ok' END AS status FROM (SELECT DISTINCT channel_id FROM w)")
def sco_status(spark, sf_dir):
    windows = tm.windows(spark, sf_dir)
    models = scoring.fit_ar1(windows.where("channel_id != 'error'"))
    return scoring.channel_status(windows, models, models.where("channel_id != 'view'").select(*KEYS)).select("channel_id", "status")


@register(f"WITH RECURSIVE {SCORED} SELECT channel_id, position, round(threshold, 4) AS threshold, predicted FROM sc")
def sco_all_channels(spark, sf_dir):
    windows, subs = tm.windows(spark, sf_dir), views.subsystems(spark, sf_dir)
    tuned = subs.where("subsystem = 'payload'").select("mission_id", "subsystem").distinct().select("*", F.lit(tm.SPAN).alias("span"), F.lit(tm.WINDOW).alias("window"), F.lit(tm.Z).alias("z"), F.lit(tm.LEAST_RUN).alias("least_run"))
    default = {"span": tm.SPAN, "window": tm.WINDOW, "z": tm.Z, "least_run": tm.LEAST_RUN}
    parameters = sweep.tuned_parameters(windows, subs, tuned, default)
    out = sweep.score_with_parameters(scoring.residuals(scoring.predict_persistence(windows)), parameters)
    return out.select("channel_id", "position", F.round("threshold", 4).alias("threshold"), "predicted")


# Runs and intervals


@register(f"WITH {SERIES}, {runs_of('is_anomaly', 'x', 'r')} SELECT channel_id, a AS start, b AS \"end\" FROM r")
def seq_runs(spark, sf_dir):
    return runs.find_runs(tm.series(spark, sf_dir), "is_anomaly")


@register(f"WITH {SERIES} SELECT channel_id, segment_id, min(position) AS start, max(position) + 1 AS \"end\" FROM x GROUP BY 1, 2")
def seq_segment_extents(spark, sf_dir):
    return runs.segment_extents(tm.series(spark, sf_dir))


@register(f"WITH RECURSIVE {SCORED}, k AS (SELECT *, coalesce(lead(us) OVER ({ORDER}), us) AS nxt, row_number() OVER ({ORDER}) - row_number() OVER (PARTITION BY channel_id, window_label ORDER BY us, tick_id) AS run FROM sc) SELECT channel_id, min(us) AS start_time, max(nxt) AS end_time, bool_or(predicted) AS detected FROM k WHERE window_label GROUP BY channel_id, run")
def seq_flag_intervals(spark, sf_dir):
    return runs.flag_intervals(tm.scored(spark, sf_dir), "window_label", "predicted")


@register(f"WITH {LABELS}, k AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY channel_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS nw FROM lab), i AS (SELECT *, sum(nw) OVER (PARTITION BY channel_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM k) SELECT channel_id, min(a) AS start_time, max(b) AS end_time FROM i GROUP BY channel_id, island")
def seq_merged_intervals(spark, sf_dir):
    return runs.merge_intervals(views.label_intervals(spark, sf_dir))


@register(f"WITH {SERIES}, k AS (SELECT *, vn > 0.5 AS above FROM x), {runs_of('above', 'k', 'r')} SELECT channel_id, max(b - a) AS longest FROM r GROUP BY 1")
def seq_longest_above(spark, sf_dir):
    return runs.longest_above(tm.series(spark, sf_dir), "value_normalized", 0.5)


@register("WITH k AS (SELECT event_type AS channel_id, epoch_us(ts) AS us, event_id, coalesce(lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY user_id, event_id) > epoch_us(ts), false)::INT AS back, user_id FROM events) SELECT channel_id, event_id AS tick_id, sum(back) OVER (PARTITION BY channel_id ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS replay FROM k")
def seq_replay_passes(spark, sf_dir):
    order = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("tick_id"), F.struct("user_id", "event_id").alias("arrival"))
    return runs.replay_passes(views.ticks(spark, sf_dir).join(order, "tick_id"), "arrival", ("channel_id",)).select("channel_id", "tick_id", "replay")


# Faults


def _faults(spark, sf_dir) -> DataFrame:
    """A fault table by rule, from positions of the series."""
    kind = F.element_at(F.array(*map(F.lit, inject.FAULTS)), (F.col("position") / 200 % 3).cast("int") + 1)
    at = tm.series(spark, sf_dir).where("position % 200 = 100")
    return at.select(*KEYS, kind.alias("type"), F.col("position").alias("start"), (F.col("position") + 7).alias("end"), F.when(kind != "flatline", F.lit(4.0)).alias("magnitude"))


INJECTED = f"""{SERIES}, fx AS (SELECT *, coalesce(avg(vn::DOUBLE) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS bf, coalesce(lag(vn::DOUBLE) OVER ({ORDER}), vn::DOUBLE) AS held FROM x),
ff AS (SELECT channel_id, position AS st, (position // 200) % 3 AS kind, CASE WHEN vn::DOUBLE >= bf THEN 4.0 ELSE -4.0 END AS signed, held FROM fx WHERE position % 200 = 100),
fi AS (SELECT x.channel_id, x.position, x.us, ff.kind IS NOT NULL AS is_anomaly, CASE kind WHEN 0 THEN vn::DOUBLE + signed WHEN 1 THEN vn::DOUBLE + CASE WHEN x.position - st < 3 THEN 4.0 * (x.position - st) / 2 ELSE 4.0 END WHEN 2 THEN ff.held ELSE vn::DOUBLE END::FLOAT AS vi FROM x LEFT JOIN ff ON ff.channel_id = x.channel_id AND x.position >= st AND x.position < st + 7)"""


@register(f"WITH {INJECTED} SELECT channel_id, position, is_anomaly, round(vi::DOUBLE, 4) AS value_normalized FROM fi")
def inj_applied(spark, sf_dir):
    out = inject.apply_faults(tm.series(spark, sf_dir), _faults(spark, sf_dir))
    return out.select("channel_id", "position", "is_anomaly", F.round(F.col("value_normalized").cast("double"), 4).alias("value_normalized"))


@register()
def inj_placed(spark, sf_dir):
    return inject.place_faults(tm.series(spark, sf_dir), 6, 20, 10, seed=1)


@register(f"WITH {SERIES} SELECT channel_id, count(*) AS n_faults, min(position) AS first_start FROM x WHERE position % 200 = 100 GROUP BY 1")
def inj_manifest(spark, sf_dir):
    return inject.fault_manifest(_faults(spark, sf_dir)).select("channel_id", "n_faults", F.element_at("faults", 1)["start"].alias("first_start"))


@register("SELECT event_type AS channel_id, (count(*) FILTER (user_id % 50 = 0) >= 0)::INT AS n_errors, CASE WHEN count(*) % 2 = 0 THEN 'unknown fault' ELSE 'spike_duration_range not in order' END AS error FROM events GROUP BY 1")
def inj_profile_validation(spark, sf_dir):
    even = F.col("n") % 2 == 0
    rows = views.ticks(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n"))
    weights = F.when(even, F.create_map(F.lit("spike"), F.lit(1.0), F.lit("melt"), F.lit(1.0)))
    columns = [F.lit(None).cast("string").alias("signal_class"), weights.alias("fault_type_weights"), F.when(~even, F.array(F.lit(5), F.lit(2))).alias("spike_duration_range")]
    profiles = rows.select(*KEYS, *columns, *(F.lit(None).cast("array<int>").alias(f"{k}_duration_range") for k in ("drift", "flatline")), F.lit(None).cast("array<double>").alias("magnitude_sigma_range"))
    return inject.validate_profiles(profiles).select("channel_id", F.size("errors").alias("n_errors"), F.element_at("errors", 1).alias("error"))


SHAPES = f"""{SERIES}, {runs_of("is_anomaly", "x", "r")}, no AS (SELECT channel_id, avg(vn::DOUBLE) AS usual, coalesce(nullif(stddev_pop(vn::DOUBLE), 0), 1) AS dev FROM x WHERE NOT is_anomaly GROUP BY 1 HAVING count(*) >= 50),
sq AS (SELECT r.channel_id, r.a AS start, position::DOUBLE AS p, vn::DOUBLE AS v, usual, dev FROM r JOIN x ON x.channel_id = r.channel_id AND position >= a AND position < b JOIN no ON no.channel_id = r.channel_id),
sr AS (SELECT channel_id, start, count(*) AS n, (avg(v) - any_value(usual)) / any_value(dev) AS level, stddev_pop(v) / any_value(dev) AS spread, CASE WHEN count(*) > 1 THEN regr_slope(v, p) * count(*) / any_value(dev) ELSE 0 END AS rise, median(abs(v - usual)) / any_value(dev) AS magnitude FROM sq GROUP BY 1, 2),
ss AS (SELECT *, CASE WHEN n < 2 OR n < 10 AND abs(level) > 1.5 THEN 'spike' WHEN spread < 0.25 AND abs(level) > 0.3 THEN 'flatline' WHEN abs(rise) > 0.8 AND spread < greatest(abs(rise), 0.3) THEN 'drift_ramp' ELSE 'level_shift' END AS shape FROM sr)"""


@register(f"WITH {SHAPES} SELECT channel_id, start, n, round(level, 5) AS level, round(spread, 5) AS spread, round(rise, 4) AS rise, round(magnitude, 5) AS magnitude, shape FROM ss")
def inj_shapes(spark, sf_dir):
    out = inject.anomaly_shapes(tm.series(spark, sf_dir))
    return out.select("channel_id", "start", "n", *(F.round(c, 5).alias(c) for c in ("level", "spread", "magnitude")), F.round("rise", 4).alias("rise"), "shape")


CHARACTER = f"""{SERIES}, nm AS (SELECT channel_id, vn::DOUBLE AS v, lag(vn::DOUBLE) OVER (PARTITION BY channel_id ORDER BY position) AS p FROM x WHERE NOT is_anomaly),
ch AS (SELECT channel_id, count(*) FILTER (abs(v - p) < 0.02)::DOUBLE / nullif(count(v - p), 0) AS flat, stddev_pop(v - p) AS noise, corr(v, p) AS autocorrelation, max(v) - min(v) AS range FROM nm GROUP BY 1 HAVING count(*) >= 50),
cl AS (SELECT *, CASE WHEN flat > 0.25 AND range > 1.5 THEN 'periodic_flatlines' WHEN autocorrelation > 0.97 AND noise < 0.04 AND range < 2 THEN 'slow_lownoise' WHEN autocorrelation > 0.92 AND noise < 0.1 THEN 'smooth_ramp' WHEN range < 3 AND flat < 0.2 THEN 'bounded_oscillatory' ELSE 'mixed' END AS signal_class FROM ch)"""


def _classes(spark, sf_dir):
    return inject.signal_classes(inject.channel_characteristics(tm.series(spark, sf_dir)))


@register(f"WITH {CHARACTER} SELECT channel_id, round(flat, 5) AS flat, round(noise, 5) AS noise, round(autocorrelation, 5) AS autocorrelation, round(range, 4) AS range, signal_class FROM cl")
def inj_characteristics(spark, sf_dir):
    return _classes(spark, sf_dir).select("channel_id", *(F.round(c, 5).alias(c) for c in ("flat", "noise", "autocorrelation")), F.round("range", 4).alias("range"), "signal_class")


RUN_PROFILES = f"""{CHARACTER}, {SHAPES.removeprefix(SERIES + ", ")},
rp AS (SELECT channel_id, count(*) AS n_runs, {", ".join(f"round(quantile_cont({c}, 0.{p}), 5)::DOUBLE AS {name}_p{p}0" for name, c in (("duration", "n::DOUBLE"), ("magnitude", "magnitude")) for p in (1, 5, 9))}, {", ".join(f"round(avg((shape = '{x}')::INT::DOUBLE), 6) AS share_{x}" for x in ("spike", "flatline", "drift_ramp", "level_shift"))} FROM ss GROUP BY 1)"""


@register(f"WITH {RUN_PROFILES} SELECT cl.channel_id, round(flat, 5) AS flat, round(noise, 5) AS noise, round(autocorrelation, 5) AS autocorrelation, round(range, 4) AS range, rp.* EXCLUDE (channel_id) FROM cl JOIN rp USING (channel_id)")
def inj_channel_profiles(spark, sf_dir):
    out = inject.channel_profiles(tm.series(spark, sf_dir))
    five = [c for c in out.columns if c in ("flat", "noise", "autocorrelation") or "_p" in c]
    return out.withColumns({c: F.round(c, 5) for c in five}).withColumn("range", F.round("range", 4))


CLASSES = f"""{CHARACTER}, {SHAPES.removeprefix(SERIES + ", ")},
ea AS (SELECT channel_id, median(magnitude) AS mag, median(n) AS dur, avg((shape = 'spike')::INT::DOUBLE) AS sp, avg((shape = 'flatline')::INT::DOUBLE) AS fl, avg((shape = 'drift_ramp')::INT::DOUBLE) AS dr, avg((shape = 'level_shift')::INT::DOUBLE) AS lv FROM ss GROUP BY 1),
cg AS (SELECT signal_class, count(*) AS n_channels, quantile_cont(mag, 0.1) AS m10, quantile_cont(mag, 0.9) AS m90, quantile_cont(dur, 0.1) AS d10, quantile_cont(dur, 0.9) AS d90, round(avg(sp), 2) AS ws, round(avg(fl) + avg(lv) * 0.6::DOUBLE, 2) AS wf, round(avg(dr) + avg(lv) * 0.4::DOUBLE, 2) AS wd FROM cl JOIN ea USING (channel_id) GROUP BY 1),
ow AS (SELECT *, greatest(0.3::DOUBLE, round(m10, 2)) AS lo, greatest(3, least(20, floor(d10)))::DOUBLE AS sh, greatest(100, least(2000, floor(d90)))::DOUBLE AS lg FROM cg),
df(signal_class, s, d, f, ml, mh, sl, sh2, dl, dh, fl2, fh) AS (VALUES ('periodic_flatlines', 0.2, 0.15, 0.65, 0.5, 2.5, 1, 5, 10, 200, 20, 400), ('smooth_ramp', 0.15, 0.55, 0.3, 0.4, 2, 1, 5, 20, 500, 20, 300), ('slow_lownoise', 0.1, 0.45, 0.45, 0.4, 2, 1, 4, 30, 600, 30, 600), ('bounded_oscillatory', 0.3, 0.4, 0.3, 0.3, 1.5, 1, 6, 15, 300, 15, 200), ('mixed', 0.1, 0.45, 0.45, 0.4, 2, 1, 4, 30, 600, 30, 600))"""


def _own(column: str, own: str, default: str) -> str:
    return f"(CASE WHEN n_channels >= 3 THEN {own} ELSE {default} END)::DOUBLE AS {column}"


@register(
    f"WITH {CLASSES} SELECT signal_class, coalesce(n_channels, 0) AS n_channels, {_own('spike', 'round(ws / (ws + wd + wf), 3)', 's')}, {_own('drift', 'round(wd / (ws + wd + wf), 3)', 'd')}, {_own('flatline', 'round(wf / (ws + wd + wf), 3)', 'f')}, {_own('magnitude_low', 'lo', 'ml')}, {_own('magnitude_high', 'least(6, round(greatest(m90, lo + 0.5), 2))', 'mh')}, "
    f"{_own('spike_duration_low', '1', 'sl')}, {_own('spike_duration_high', 'greatest(2, sh)', 'sh2')}, {_own('drift_duration_low', 'sh', 'dl')}, {_own('drift_duration_high', 'lg', 'dh')}, {_own('flatline_duration_low', 'sh', 'fl2')}, {_own('flatline_duration_high', 'lg', 'fh')} FROM df LEFT JOIN ow USING (signal_class)"
)
def inj_class_profiles(spark, sf_dir):
    return inject.class_profiles(_classes(spark, sf_dir), inject.anomaly_shapes(tm.series(spark, sf_dir)))


# Sweeps


def _sweep(spark, sf_dir, n=50):
    """Configurations sampled in the bounds, then the clamped default as the last, and their trials."""
    configs = sweep.with_default(sweep.sample_configs(spark, n, seed=3), n)
    errors = scoring.residuals(scoring.predict_persistence(tm.windows(spark, sf_dir)))
    return configs, sweep.trials(errors, configs, views.subsystems(spark, sf_dir)), n


@register()
def swp_trials(spark, sf_dir):
    return _sweep(spark, sf_dir)[1]


LISTED = [(0, 7, 60, 2.5, 1), (1, 30, 250, 3.0, 3), (2, 90, 480, 4.0, 2)]


def _listed_sql() -> str:
    parts, judged = [], []
    for k, span, window, z, least in LISTED:
        a = f"(2.0::DOUBLE / {span + 1})"
        frame = f"({POS} ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING)"
        parts.append(f"s{k} AS (SELECT channel_id, position, abs(residual) AS smoothed FROM lf WHERE position = 0 UNION ALL SELECT lf.channel_id, lf.position, abs(residual) * {a} + s.smoothed * (1 - {a}) FROM s{k} s JOIN lf ON lf.channel_id = s.channel_id AND lf.position = s.position + 1)")
        parts.append(f"a{k} AS (SELECT channel_id, position, window_label, coalesce(smoothed > avg(smoothed) OVER {frame} + {z}::DOUBLE * stddev_pop(smoothed) OVER {frame}, false) AS above FROM lf JOIN s{k} USING (channel_id, position))")
        parts.append(f"r{k} AS (SELECT *, row_number() OVER ({POS}) - row_number() OVER (PARTITION BY channel_id, above ORDER BY position) AS run FROM a{k})")
        judged.append(f"SELECT channel_id || ':{k}' AS channel_id, position, window_label AS t1, above AND count(*) OVER (PARTITION BY channel_id, above, run) >= {least} AS p1 FROM r{k}")
    first = f"{WINDOWS}, lf AS (SELECT channel_id, position, window_label, previous - vn AS residual FROM w QUALIFY position < floor(count(*) OVER (PARTITION BY channel_id) * 0.6::DOUBLE))"
    each = "ea AS (SELECT pm.channel_id[:-3] AS channel_id, pm.channel_id[-1:]::INT AS config, f05, seg_f05, coalesce(fp::DOUBLE / nullif(n - n_true, 0), 0) AS false_rate FROM pm JOIN sg USING (channel_id) JOIN (SELECT channel_id, count(*) AS n FROM judged GROUP BY 1) USING (channel_id))"
    return f"WITH RECURSIVE {first}, {', '.join(parts)}, judged AS ({' UNION ALL '.join(judged)}), {POINTS}, {SEGMENTS}, {SUBSYSTEMS}, {each} SELECT subsystem, config, round(avg(f05), 6) AS f05, round(avg(seg_f05), 6) AS seg_f05, round(avg(false_rate), 6) AS false_rate, round(avg(seg_f05) - avg(false_rate) * 5, 6) AS objective FROM ea JOIN sub USING (channel_id) GROUP BY 1, 2"


@register(_listed_sql())
def swp_listed_trials(spark, sf_dir):
    """Trials of three listed configurations over all series."""
    configs = spark.createDataFrame(LISTED, "config int, span int, window int, z double, least_run int")
    errors = scoring.residuals(scoring.predict_persistence(tm.windows(spark, sf_dir)))
    found = sweep.trials(errors, configs, views.subsystems(spark, sf_dir))
    return found.select("subsystem", "config", *(F.round(c, 6).alias(c) for c in ("f05", "seg_f05", "false_rate", "objective")))


@register(f"""WITH {WINDOWS}, {SUBSYSTEMS}, pa AS (SELECT *, position < floor(count(*) OVER (PARTITION BY channel_id) * 0.6::DOUBLE) AS first FROM w),
pb AS (SELECT subsystem, count(*) AS n, count(*) FILTER (first AND window_label) AS labelled_first, count(*) FILTER (NOT first AND window_label) AS labelled_rest FROM pa JOIN sub USING (channel_id) GROUP BY 1)
SELECT *, nullif(concat_ws('; ', CASE WHEN labelled_first = 0 THEN 'no labelled window to try on' END, CASE WHEN labelled_rest = 0 THEN 'no labelled window in the rest' END), '') AS warning FROM pb""")
def swp_parts(spark, sf_dir):
    return sweep.sweep_parts(tm.windows(spark, sf_dir), views.subsystems(spark, sf_dir))


@register()
def swp_best(spark, sf_dir):
    configs, results, default = _sweep(spark, sf_dir)
    return sweep.best_configs(results, configs, default)


@register(f"WITH {SUBSYSTEMS} SELECT channel_id, subsystem, CASE WHEN subsystem = 'payload' THEN 12 ELSE 30 END AS span, CASE WHEN subsystem = 'payload' THEN 60 ELSE 250 END AS \"window\", CASE WHEN subsystem = 'payload' THEN 2.5 ELSE 3.0 END::DOUBLE AS z, CASE WHEN subsystem = 'payload' THEN 2 ELSE 3 END AS least_run FROM sub")
def swp_tuned_parameters(spark, sf_dir):
    subs = views.subsystems(spark, sf_dir)
    tuned = subs.where("subsystem = 'payload'").select("mission_id", "subsystem").distinct().select("*", F.lit(12).alias("span"), F.lit(60).alias("window"), F.lit(2.5).alias("z"), F.lit(2).alias("least_run"), F.lit(9).alias("unknown"))
    return sweep.tuned_parameters(views.ticks(spark, sf_dir), subs, tuned)


# Drift


DRIFT = f"""{SERIES}, rf AS (SELECT channel_id, vn::DOUBLE AS x FROM x WHERE split = 'train' AND NOT is_anomaly), cf AS (SELECT channel_id, vn::DOUBLE AS x FROM x WHERE split = 'test'),
ct AS (SELECT channel_id, x, sum(r)::DOUBLE AS r, sum(c)::DOUBLE AS c FROM (SELECT channel_id, x, 1 AS r, 0 AS c FROM rf UNION ALL SELECT channel_id, x, 0, 1 FROM cf) GROUP BY 1, 2),
gp AS (SELECT channel_id, abs(sum(r) OVER (PARTITION BY channel_id ORDER BY x) / sum(r) OVER (PARTITION BY channel_id) - sum(c) OVER (PARTITION BY channel_id ORDER BY x) / sum(c) OVER (PARTITION BY channel_id)) * (lead(x) OVER (PARTITION BY channel_id ORDER BY x) - x) AS area FROM ct),
dr AS (SELECT channel_id, 'value_normalized' AS feature, sum(area) / greatest((SELECT stddev_pop(x) FROM rf WHERE rf.channel_id = gp.channel_id), 0.001) AS score FROM gp GROUP BY 1)"""


def _drift(spark, sf_dir):
    df = tm.series(spark, sf_dir)
    long = lambda d: drift.long_form(d.withColumn("value_normalized", F.col("value_normalized").cast("double")), ["value_normalized"])
    return drift.wasserstein(long(df.where("split = 'train' and not is_anomaly")), long(df.where("split = 'test'"))).withColumn("drifted", F.col("score") >= 0.05)


@register(f"WITH {DRIFT} SELECT channel_id, feature, round(score, 5) AS score, score >= 0.05 AS drifted FROM dr")
def drf_wasserstein(spark, sf_dir):
    return _drift(spark, sf_dir).withColumn("score", F.round("score", 5))


@register(f"WITH {DRIFT} SELECT channel_id, count(*) FILTER (score >= 0.05) AS n_drifted, avg((score >= 0.05)::INT::DOUBLE) AS share, avg((score >= 0.05)::INT) > 0.3 AS alert FROM dr GROUP BY 1")
def drf_alerts(spark, sf_dir):
    return drift.drift_alerts(_drift(spark, sf_dir))


PROFILE = f"""{FEATURES.replace("FROM x)", "FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY us, tick_id) - 1 AS position FROM (SELECT * EXCLUDE (position) FROM x WHERE split = 'train' AND NOT is_anomaly QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY us DESC, tick_id DESC) <= 600)))")},
rp AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY md5(us::VARCHAR), tick_id) AS rank FROM ft WHERE rolling_mean_100 IS NOT NULL AND rate_of_change IS NOT NULL)"""


@register(f"WITH {PROFILE} SELECT channel_id, us AS telemetry_timestamp, {ROUNDED} FROM rp WHERE rank <= 500")
def drf_reference_profile(spark, sf_dir):
    return _five(tm.profiles(spark, sf_dir)[0], "channel_id", "telemetry_timestamp")


_PROFILES = PROFILE.removeprefix(SERIES + ", ")
_LISTED_FEATURES = ["value_normalized", *features.names()]
_LONG = f"unnest([{', '.join(f"'{n}'" for n in _LISTED_FEATURES)}]) AS feature, unnest([{', '.join(_LISTED_FEATURES)}]) AS v"
#: The profiles of both splits, and the distance of their distributions for each feature.
SWEPT = f"""{SERIES}, {_PROFILES.replace("ft AS", "fa AS").replace("FROM ft", "FROM fa").replace("rp AS", "ra AS")},
{_PROFILES.replace("ft AS", "fb AS").replace("FROM ft", "FROM fb").replace("rp AS", "rb AS").replace("split = 'train' AND NOT is_anomaly", "split = 'test'")},
ul AS (SELECT channel_id, {_LONG}, 1 AS r, 0 AS c FROM ra WHERE rank <= 500 UNION ALL SELECT channel_id, {_LONG}, 0, 1 FROM rb WHERE rank <= 500),
uc AS (SELECT channel_id, feature, v, sum(r)::DOUBLE AS r, sum(c)::DOUBLE AS c FROM ul GROUP BY 1, 2, 3),
ug AS (SELECT channel_id, feature, abs(sum(r) OVER o / sum(r) OVER e - sum(c) OVER o / sum(c) OVER e) * (lead(v) OVER o - v) AS area FROM uc WINDOW o AS (PARTITION BY channel_id, feature ORDER BY v), e AS (PARTITION BY channel_id, feature)),
us AS (SELECT channel_id, feature, sum(area) / any_value(spread) AS score FROM ug JOIN (SELECT channel_id, feature, greatest(stddev_pop(v), 0.001) AS spread FROM ul WHERE r = 1 GROUP BY 1, 2) USING (channel_id, feature) GROUP BY 1, 2),
ua AS (SELECT channel_id, count(*) FILTER (score >= 0.1) AS n_drifted, avg((score >= 0.1)::INT::DOUBLE) AS share FROM us GROUP BY 1),
uk AS (SELECT channel_id, max(r) = 1 AND max(c) = 1 AS ok FROM ul GROUP BY 1)"""


@register(f"WITH {SWEPT}, uf AS (SELECT channel_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN ok THEN n_drifted END AS n_drifted, CASE WHEN ok THEN round(share, 6) END AS share, CASE WHEN ok THEN share > 0.3 END AS alert FROM uk LEFT JOIN ua USING (channel_id)) SELECT *, (SELECT count(*) FILTER (alert) FROM uf) AS drifted_total FROM uf")
def drf_mission_sweep(spark, sf_dir):
    return drift.mission_sweep(*tm.profiles(spark, sf_dir))


@register(f"WITH {SERIES} SELECT channel_id, 'value_normalized' AS feature, count(*) AS n, 0::BIGINT AS missing, round(avg(vn::DOUBLE), 5) AS mean, round(stddev_samp(vn::DOUBLE), 5) AS std, round(min(vn::DOUBLE), 5) AS least, round(quantile_cont(vn::DOUBLE, 0.25), 5) AS q25, round(median(vn::DOUBLE), 5) AS median, round(quantile_cont(vn::DOUBLE, 0.75), 5) AS q75, round(max(vn::DOUBLE), 5) AS most FROM x GROUP BY 1")
def drf_quality(spark, sf_dir):
    df = tm.series(spark, sf_dir).withColumn("value_normalized", F.col("value_normalized").cast("double"))
    out = drift.quality_summary(df, ["value_normalized"])
    return out.select("channel_id", "feature", "n", "missing", *(F.round(c, 5).alias(c) for c in ("mean", "std", "least", "q25", "median", "q75", "most")))


def _rolling(spark, sf_dir):
    """Evaluations every ten rows of both features, against nominal rows of the train split in the same units."""
    df = tm.series(spark, sf_dir)
    reference = drift.long_form(drift.rolling_features(df.where("split = 'train' and not is_anomaly")), ["value", "change"])
    return drift.rolling_snapshots(drift.rolling_drift(df, reference), 0.12)


#: Both distribution functions of every evaluation, one row for each value in either.
ROLLING = f"""{SERIES}, rb AS (SELECT channel_id, position, vn::DOUBLE AS value, vn::DOUBLE - lag(vn::DOUBLE) OVER ({POS}) AS change FROM x),
rl AS (SELECT channel_id, position, 'value' AS feature, value AS v FROM rb UNION ALL SELECT channel_id, position, 'change', change FROM rb WHERE change IS NOT NULL),
r0 AS (SELECT channel_id, vn::DOUBLE AS value, vn::DOUBLE - lag(vn::DOUBLE) OVER ({POS}) AS change FROM x WHERE split = 'train' AND NOT is_anomaly),
rr AS (SELECT channel_id, 'value' AS feature, value AS v FROM r0 UNION ALL SELECT channel_id, 'change', change FROM r0 WHERE change IS NOT NULL),
ev AS (SELECT channel_id, position AS pos FROM rb WHERE position >= 255 AND (position - 255) % 10 = 0),
un AS (SELECT ev.channel_id, pos, feature, v, 0 AS r, 1 AS c FROM ev JOIN rl ON rl.channel_id = ev.channel_id AND rl.position <= pos AND rl.position > pos - CASE feature WHEN 'value' THEN 256 ELSE 255 END UNION ALL SELECT ev.channel_id, pos, feature, v, 1, 0 FROM ev JOIN rr USING (channel_id)),
uc AS (SELECT channel_id, pos, feature, v, sum(r)::DOUBLE AS r, sum(c)::DOUBLE AS c FROM un GROUP BY 1, 2, 3, 4),
ug AS (SELECT channel_id, pos, feature, abs(sum(r) OVER o / sum(r) OVER e - sum(c) OVER o / sum(c) OVER e) * (lead(v) OVER o - v) AS area FROM uc WINDOW o AS (PARTITION BY channel_id, pos, feature ORDER BY v), e AS (PARTITION BY channel_id, pos, feature)),
us AS (SELECT channel_id, pos AS position, feature, sum(area) / any_value(spread) AS score FROM ug JOIN (SELECT channel_id, feature, greatest(stddev_pop(v), 0.001) AS spread FROM rr GROUP BY 1, 2) USING (channel_id, feature) GROUP BY 1, 2, 3),
sn AS (SELECT channel_id, position, avg((score >= 0.12)::INT::DOUBLE) AS share FROM us GROUP BY 1, 2)"""


@register(f"WITH {ROLLING}, cf AS (SELECT *, share >= 0.3 AS alert, count(*) FILTER (share >= 0.3) OVER ({POS} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AS confirmed FROM sn) SELECT channel_id, position, feature, round(score, 6) AS score, score >= 0.12 AS drifted, share, alert, confirmed FROM us JOIN cf USING (channel_id, position)")
def drf_rolling(spark, sf_dir):
    found = drift.confirm(_rolling(spark, sf_dir), 2)
    return found.select(*KEYS, "position", F.inline("features"), "share", "alert", "confirmed")


@register(f"WITH {ROLLING}, {SUBSYSTEMS}, nw AS (SELECT channel_id, arg_max(share >= 0.3, position) AS drifted FROM sn GROUP BY 1) SELECT subsystem, round(avg(drifted::INT::DOUBLE), 6) AS share, avg(drifted::INT::DOUBLE) >= 0.3 AS alert FROM nw JOIN sub USING (channel_id) GROUP BY 1")
def drf_subsystem_alerts(spark, sf_dir):
    return drift.subsystem_alerts(drift.confirm(_rolling(spark, sf_dir), 1), views.subsystems(spark, sf_dir))


ALERTS = f"{SERIES}, al AS (SELECT channel_id, position, vn > 1 AS alert FROM x), cf AS (SELECT *, coalesce(bool_and(alert) OVER ({POS} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), false) AND position >= 1 AS confirmed FROM al)"


@register(f"WITH {ALERTS} SELECT channel_id, position, confirmed FROM cf")
def drf_confirmation(spark, sf_dir):
    return drift.confirm(tm.series(spark, sf_dir).withColumn("alert", F.col("value_normalized") > 1), 2).select("channel_id", "position", "confirmed")


@register(f"WITH {ALERTS}, k AS (SELECT *, coalesce(max(position) FILTER (NOT confirmed) OVER (PARTITION BY channel_id), -1) AS calm FROM cf) SELECT channel_id, arg_max(confirmed, position) AS drifted, min(position) FILTER (position > calm) AS since FROM k GROUP BY 1")
def drf_drifted_since(spark, sf_dir):
    return drift.drifted_since(drift.confirm(tm.series(spark, sf_dir).withColumn("alert", F.col("value_normalized") > 1), 2))


@register(f"WITH {ALERTS} SELECT channel_id, position, alert AND confirmed AS shown FROM cf")
def drf_shown_features(spark, sf_dir):
    df = drift.confirm(tm.series(spark, sf_dir).withColumn("alert", F.col("value_normalized") > 1), 2)
    df = df.withColumn("features", F.array(F.struct(F.lit("value").alias("feature"), F.col("alert").alias("drifted"))))
    return drift.shown_features(df).select("channel_id", "position", F.element_at("features", 1)["drifted"].alias("shown"))


# Alerts, reports, catalogue


@register(f"WITH {SERIES} SELECT channel_id, us AS telemetry_timestamp, tick_id, round(CASE WHEN std = 0 THEN 0 ELSE (value::DOUBLE - mean) / std END::FLOAT::DOUBLE, 5) AS value_normalized FROM t JOIN pr USING (channel_id)")
def str_raw_ticks(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir)
    raw = jobs.normalized_ticks(ticks, prepare.normalization_params(prepare.fill_nulls(ticks)))
    return raw.select("channel_id", "telemetry_timestamp", "tick_id", F.round(F.col("value_normalized").cast("double"), 5).alias("value_normalized"))


@register(f"WITH {TICKS}, k AS (SELECT channel_id, us - us % 3600000000 AS bucket_us, avg(value::DOUBLE)::FLOAT AS v FROM t GROUP BY 1, 2) SELECT channel_id, bucket_us, round(v::DOUBLE, 5) AS value FROM k QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY bucket_us DESC) = 1")
def str_flushed_buckets(spark, sf_dir):
    """What is left open when a stream ends: its means are those of all buckets that a later one has closed."""
    ticks = views.ticks(spark, sf_dir)
    bucket = resample.floor_to_grid(F.unix_micros("telemetry_timestamp"), 3600)
    means = ticks.groupBy(*KEYS, bucket.alias("bucket_us")).agg(F.avg("value").alias("value"))
    newest = means.groupBy(*KEYS).agg(F.max("bucket_us").alias("newest"))
    closed = means.join(newest, [*KEYS]).where("bucket_us < newest").drop("newest")
    return jobs.flush_open(ticks, closed, 3600).select("channel_id", "bucket_us", F.round(F.col("value").cast("double"), 5).alias("value"))


EDGES = f"{SCORED}, eg AS (SELECT *, lag(predicted, 1, false) OVER ({POS}) AS before, max(position) OVER (PARTITION BY channel_id) - position AS later FROM sc), ed AS (SELECT * FROM eg WHERE predicted AND NOT before)"


@register(f"WITH RECURSIVE {EDGES} SELECT channel_id, us AS telemetry_timestamp, position, window_label AS truth_match FROM ed")
def str_rising_edges(spark, sf_dir):
    return reports.rising_edges(tm.scored(spark, sf_dir)).select("channel_id", "telemetry_timestamp", "position", "truth_match")


@register(f"WITH RECURSIVE {EDGES} SELECT channel_id, us AS telemetry_timestamp FROM ed ORDER BY us DESC, channel_id LIMIT 50")
def str_latest_alerts(spark, sf_dir):
    return reports.latest_alerts(tm.scored(spark, sf_dir)).select("channel_id", "telemetry_timestamp")


@register(f"WITH RECURSIVE {EDGES} SELECT channel_id, position FROM ed WHERE later < 200")
def str_visible_alerts(spark, sf_dir):
    return reports.visible_alerts(tm.scored(spark, sf_dir)).select("channel_id", "position")


@register(f"WITH RECURSIVE {SCORED} SELECT channel_id, position, predicted FROM sc QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY position DESC) <= 200")
def str_backlog(spark, sf_dir):
    return reports.recent(tm.scored(spark, sf_dir)).select("channel_id", "position", "predicted")


ROLLUP = f"""{SCORED}, {SUBSYSTEMS}, bd AS (SELECT channel_id, bool_or(predicted) AS anomalous, max(us) AS last_us FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY channel_id ORDER BY position DESC) <= 200) GROUP BY 1),
ru AS (SELECT channel_id, subsystem, coalesce(anomalous, false) AS anomalous, channel_id = 'view' AS drifted, last_us FROM sub LEFT JOIN bd USING (channel_id))"""


def _rollup(spark, sf_dir):
    drifted = views.subsystems(spark, sf_dir).select(*KEYS, (F.col("channel_id") == "view").alias("drifted"))
    return reports.subsystem_rollup(tm.scored(spark, sf_dir), drifted, views.subsystems(spark, sf_dir))


@register(f"WITH RECURSIVE {ROLLUP} SELECT * FROM ru")
def str_subsystem_rollup(spark, sf_dir):
    return _rollup(spark, sf_dir)


@register(f"WITH RECURSIVE {ROLLUP} SELECT subsystem, string_agg(channel_id || ':' || CASE WHEN anomalous THEN 'anomaly' WHEN drifted THEN 'drift' WHEN last_us IS NOT NULL THEN 'nominal' ELSE 'waiting' END, ',' ORDER BY channel_id) AS channels, coalesce(string_agg(channel_id, ',' ORDER BY channel_id) FILTER (anomalous), '') AS anomalous, coalesce(string_agg(channel_id, ',' ORDER BY channel_id) FILTER (drifted), '') AS drifted, NOT bool_or(anomalous OR drifted) AS nominal FROM ru GROUP BY 1")
def str_subsystem_cards(spark, sf_dir):
    return reports.subsystem_cards(_rollup(spark, sf_dir))


@register("SELECT event_type AS channel_id, count(*) AS n_labels FROM events WHERE user_id % 50 = 0 GROUP BY 1")
def rpt_labels_per_channel(spark, sf_dir):
    return reports.labels_per_channel(views.label_intervals(spark, sf_dir))


@register("SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey::VARCHAR ELSE 'run-' || o_custkey END AS run_key, o_orderkey AS run_id, epoch_us(o_orderdate) AS started, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY CASE WHEN o_custkey % 7 <> 0 THEN o_custkey::VARCHAR ELSE 'run-' || o_custkey END ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def rpt_latest_runs(spark, sf_dir):
    return reports.latest_runs(views.run_log(spark, sf_dir), where="status = 'F'").select("run_key", "run_id", "started", "status")


DIAGNOSED = f"{SCORED}, judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM sc), {POINTS}, {SEGMENTS}, dg AS (SELECT channel_id, CASE WHEN n_true IS NULL THEN 'not_scored' WHEN n_true = 0 THEN 'outside_eval_window' WHEN seg_f05 > 0 THEN 'detected' ELSE 'missed' END AS bucket FROM (SELECT DISTINCT channel_id FROM t) LEFT JOIN pm USING (channel_id) LEFT JOIN sg USING (channel_id))"


def _diagnoses(spark, sf_dir):
    scored = tm.scored(spark, sf_dir)
    metrics = scoring.point_metrics(scored).join(scoring.segment_metrics(scored), [*KEYS])
    return reports.diagnose(views.ticks(spark, sf_dir), reports.labels_per_channel(views.label_intervals(spark, sf_dir)), metrics)


@register(f"WITH RECURSIVE {DIAGNOSED} SELECT * FROM dg")
def rpt_diagnoses(spark, sf_dir):
    return _diagnoses(spark, sf_dir)


@register(f"WITH RECURSIVE {DIAGNOSED} SELECT bucket, count(channel_id) AS n FROM (VALUES ('no_anomalies'), ('not_scored'), ('outside_eval_window'), ('detected'), ('missed')) b(bucket) LEFT JOIN dg USING (bucket) GROUP BY 1")
def rpt_diagnosis_summary(spark, sf_dir):
    return reports.diagnosis_summary(_diagnoses(spark, sf_dir))


RATIOS = f"{SCORED}, rt AS (SELECT *, smoothed / threshold AS r FROM sc WHERE threshold > 0)"


@register(
    f"WITH RECURSIVE {SCORED}, k AS (SELECT channel_id, count(*) FILTER (window_label) AS n_labelled, median(smoothed) FILTER (NOT window_label AND threshold IS NOT NULL) AS ne, median(smoothed) FILTER (window_label AND threshold IS NOT NULL) AS le, median(threshold) FILTER (window_label AND threshold IS NOT NULL) AS lt, coalesce(avg((smoothed > threshold)::INT::DOUBLE) FILTER (window_label AND threshold IS NOT NULL), 0) AS sa FROM sc GROUP BY 1) "
    "SELECT channel_id, n_labelled, round(ne, 5) AS nominal_error, round(le, 5) AS labelled_error, round(le / nullif(ne, 0), 4) AS spike_ratio, round(lt, 4) AS labelled_threshold, round(sa, 5) AS share_above, CASE WHEN n_labelled = 0 THEN 'no labelled windows' WHEN sa > 0.05 THEN 'crosses the threshold' WHEN le / nullif(ne, 0) >= 2 THEN 'rises below the threshold' ELSE 'barely rises' END AS verdict FROM k"
)
def rpt_error_against_threshold(spark, sf_dir):
    out = reports.error_against_threshold(tm.scored(spark, sf_dir))
    return out.select("channel_id", "n_labelled", *(F.round(c, 5).alias(c) for c in ("nominal_error", "labelled_error", "share_above")), *(F.round(c, 4).alias(c) for c in ("spike_ratio", "labelled_threshold")), "verdict")


@register(f"WITH RECURSIVE {SCORED}, judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM sc), {SEGMENTS}, k AS (SELECT channel_id, count(*) AS n, count(*) FILTER (window_label) AS labelled, count(*) FILTER (predicted) AS n_predicted, count(threshold) AS warm FROM sc GROUP BY 1) SELECT channel_id, n, labelled, n_predicted, warm, round(seg_recall, 6) AS seg_recall, round(seg_precision, 6) AS seg_precision FROM k JOIN sg USING (channel_id)")
def rpt_stream_tally(spark, sf_dir):
    return reports.stream_tally(tm.scored(spark, sf_dir))


@register(f"WITH {TICKS}, k AS (SELECT * FROM (SELECT *, (us - lag(us) OVER ({ORDER})) / 1e6 AS gap FROM t) WHERE gap IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY gap, tick_id) - 1 AS place, count(*) OVER (PARTITION BY channel_id) AS n FROM k) SELECT channel_id, count(*) AS n, round(max(gap) FILTER (place = least(n * 50 // 100, n - 1)), 6) AS p50, round(max(gap) FILTER (place = least(n * 90 // 100, n - 1)), 6) AS p90, round(max(gap) FILTER (place = least(n * 99 // 100, n - 1)), 6) AS p99, count(*) FILTER (gap > 3600) AS abnormal, round((max(us) FILTER (gap > 3600) - min(us) FILTER (gap > 3600)) / 1e6 / nullif(count(*) FILTER (gap > 3600) - 1, 0), 6) AS cadence_s FROM r GROUP BY 1")
def rpt_arrival_gaps(spark, sf_dir):
    return reports.arrival_gaps(views.ticks(spark, sf_dir), 3600)


@register(f"WITH RECURSIVE {SCORED} SELECT channel_id, round(min(threshold), 4) AS threshold_min, round(median(threshold), 4) AS threshold_median, round(max(threshold), 4) AS threshold_max, round(median(smoothed), 5) AS error_median, round(quantile_cont(smoothed, 0.99), 5) AS error_p99, round(max(smoothed), 5) AS error_max FROM sc WHERE threshold IS NOT NULL AND NOT window_label GROUP BY 1")
def rpt_warm_statistics(spark, sf_dir):
    out = reports.warm_statistics(tm.scored(spark, sf_dir))
    return out.select("channel_id", *(F.round(c, 4 if c.startswith("threshold") else 5).alias(c) for c in out.columns[2:]))


@register(f"WITH RECURSIVE {RATIOS}, rs AS (SELECT channel_id, count(*) FILTER (back) AS restarts FROM (SELECT channel_id, lag(us) OVER (PARTITION BY channel_id ORDER BY tick_id) > us AS back FROM sc) GROUP BY 1) SELECT channel_id, round(max(r) FILTER (window_label), 4) AS labelled_most, round(max(r), 4) AS most, any_value(restarts) AS restarts FROM rt JOIN rs USING (channel_id) GROUP BY 1")
def rpt_near_misses(spark, sf_dir):
    return reports.near_misses(tm.scored(spark, sf_dir), "tick_id").select("channel_id", F.round("labelled_most", 4).alias("labelled_most"), F.round("most", 4).alias("most"), "restarts")


SENSITIVE = f"""{SMOOTHED}, ze AS (SELECT e.channel_id || ':' || z AS channel_id, e.channel_id AS c, z, position, window_label, smoothed, avg(smoothed) OVER fr + z * stddev_pop(smoothed) OVER fr AS threshold FROM e JOIN sm USING (channel_id, position) CROSS JOIN (VALUES (3.0::DOUBLE), (2.0), (1.0), (0.75)) v(z) WINDOW fr AS (PARTITION BY e.channel_id, z ORDER BY position ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
za AS (SELECT *, coalesce(smoothed > threshold, false) AS above FROM ze), zr AS (SELECT *, row_number() OVER ({POS}) - row_number() OVER (PARTITION BY channel_id, above ORDER BY position) AS run FROM za),
zf AS (SELECT *, above AND count(*) OVER (PARTITION BY channel_id, above, run) >= 2 AS predicted FROM zr), judged AS (SELECT channel_id, position, window_label AS t1, predicted AS p1 FROM zf), {SEGMENTS}"""


@register(f"WITH RECURSIVE {SENSITIVE} SELECT any_value(c) AS channel_id, any_value(z) AS z, round(arg_max(threshold, struct_pack(smoothed, position)) FILTER (window_label), 4) AS peak_threshold, count(*) FILTER (window_label AND predicted) AS inside, count(*) FILTER (predicted) AS total, round(any_value(seg_recall), 6) AS seg_recall FROM zf JOIN sg USING (channel_id) GROUP BY zf.channel_id")
def rpt_sensitivity(spark, sf_dir):
    smoothed = scoring.smooth_errors(scoring.residuals(scoring.predict_persistence(tm.windows(spark, sf_dir))), tm.SPAN)
    found = reports.sensitivity(smoothed, tm.WINDOW, [3.0, 2.0, 1.0, 0.75], tm.LEAST_RUN)
    return found.withColumn("peak_threshold", F.round("peak_threshold", 4))


@register(f"WITH RECURSIVE {SCORED}, k AS (SELECT *, position - min(position) FILTER (window_label) OVER (PARTITION BY channel_id) AS \"offset\", count(*) FILTER (window_label AND smoothed > threshold) OVER (PARTITION BY channel_id) AS labelled_above FROM sc) SELECT channel_id, position, \"offset\", above, labelled_above FROM k WHERE \"offset\" >= -2 AND \"offset\" < 12")
def rpt_around_first_anomaly(spark, sf_dir):
    return reports.around_first_anomaly(tm.scored(spark, sf_dir)).select("channel_id", "position", "offset", "above", "labelled_above")


VERSIONS = "vs AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey::VARCHAR END AS channel_id, o_orderkey AS version, o_orderstatus AS status FROM orders), cp AS (SELECT channel_id, max(version) AS champion FROM vs WHERE channel_id IS NOT NULL AND status = 'F' GROUP BY 1)"


def _champions(spark, sf_dir):
    return reports.promote(views.run_log(spark, sf_dir).where("channel_id is not null and status = 'F'").select("channel_id", F.col("run_id").alias("version")))


@register(f"WITH {VERSIONS} SELECT * FROM cp")
def cat_champions(spark, sf_dir):
    return _champions(spark, sf_dir)


@register(f"WITH {VERSIONS} SELECT DISTINCT vs.channel_id, champion IS NOT NULL AS servable FROM vs LEFT JOIN cp USING (channel_id) WHERE vs.channel_id IS NOT NULL")
def cat_servable(spark, sf_dir):
    candidates = views.run_log(spark, sf_dir).select("channel_id").where("channel_id is not null").distinct()
    yes, no = reports.servable(candidates, _champions(spark, sf_dir))
    return yes.withColumn("servable", F.lit(True)).union(no.withColumn("servable", F.lit(False)))


@register(f"WITH {VERSIONS} SELECT channel_id, champion FROM cp WHERE channel_id NOT IN (SELECT channel_id FROM vs WHERE status = 'P' AND channel_id IS NOT NULL)")
def cat_demoted(spark, sf_dir):
    gone = views.run_log(spark, sf_dir).where("status = 'P'").select("channel_id").distinct()
    return reports.demote(_champions(spark, sf_dir), gone)


@register(f"WITH {SUBSYSTEMS} SELECT count(*) AS n_resolved, count(*) FILTER (channel_id <> 'view') AS n_loaded, string_agg(channel_id, ',') FILTER (channel_id = 'view') AS missing, false AS ok FROM sub")
def cat_serving_completeness(spark, sf_dir):
    resolved = views.subsystems(spark, sf_dir)
    return reports.serving_completeness(resolved, resolved.where("channel_id != 'view'"))


@register(f"WITH {SERIES}, a AS (SELECT channel_id, round(avg(value::DOUBLE), 5) AS level FROM x WHERE is_anomaly AND channel_id <> 'view' GROUP BY 1), b AS (SELECT channel_id, round(avg(value::DOUBLE), 5) AS level FROM x GROUP BY 1) SELECT channel_id, coalesce(a.level, b.level) AS level FROM b LEFT JOIN a USING (channel_id)")
def cat_fallback(spark, sf_dir):
    df = tm.series(spark, sf_dir)
    mean = F.round(F.avg(F.col("value").cast("double")), 5).alias("level")
    return reports.with_fallback(df, df.where("is_anomaly and channel_id != 'view'").groupBy(*KEYS).agg(mean), df.groupBy(*KEYS).agg(mean), "level")


@register(f"WITH RECURSIVE {SCORED}, {runs_of('predicted', 'sc', 'r')} SELECT channel_id, a AS start, b AS \"end\", round(max(smoothed), 5) AS peak FROM r JOIN sc USING (channel_id) WHERE position >= a AND position < b GROUP BY ALL")
def anomaly_runs(spark, sf_dir):
    return tm.anomaly_runs(spark, sf_dir).withColumn("peak", F.round("peak", 5))
