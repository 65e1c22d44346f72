"""Reports, alerts, catalogue joins and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.quantiles import quantiles
from ..functions.series import KEYS, TIE, TIME, micros, ratio, series, so_far, whole
from .scoring import flag_anomalies, segment_metrics

#: Diagnoses in the order in which they are shown.
BUCKETS = ["no_anomalies", "not_scored", "outside_eval_window", "detected", "missed"]


def labels_per_channel(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*KEYS).agg(F.count("*").alias("n_labels"))


def latest_runs(runs: DataFrame, key: str = "channel_id", name: str = "run_name", started: str = "started", tie: str = "run_id", where=None) -> DataFrame:
    """The newest run of each channel, or of each run name where the channel is missing, of those that pass the filter."""
    kept = runs if where is None else runs.where(where)
    order = Window.partitionBy("run_key").orderBy(F.desc(started), F.desc(tie))
    return kept.withColumn("run_key", F.coalesce(key, name)).withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def diagnose(channels: DataFrame, label_counts: DataFrame, metrics: DataFrame) -> DataFrame:
    """(keys, bucket): why a channel was or was not detected, from its number of labels, its true segments and its segment score."""
    joined = channels.select(*KEYS).distinct().join(label_counts, [*KEYS], "left").join(metrics.select(*KEYS, "n_true", "seg_f05"), [*KEYS], "left")
    bucket = F.when(F.coalesce("n_labels", F.lit(0)) == 0, BUCKETS[0]).when(F.col("n_true").isNull(), BUCKETS[1]).when(F.col("n_true") == 0, BUCKETS[2]).when(F.col("seg_f05") > 0, BUCKETS[3]).otherwise(BUCKETS[4])
    return joined.select(*KEYS, bucket.alias("bucket"))


def diagnosis_summary(diagnoses: DataFrame) -> DataFrame:
    """(bucket, n) with all buckets, those without channels too."""
    every = diagnoses.sparkSession.createDataFrame([(b,) for b in BUCKETS], "bucket string")
    return every.join(diagnoses.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left").fillna(0, ["n"])


def _long(df: DataFrame, columns) -> DataFrame:
    """(keys, kind, x): a row for each of some columns, given by name."""
    return df.select(*KEYS, *(c.cast("double").alias(name) for name, c in columns.items())).unpivot([*KEYS], [*columns], "kind", "x")


def _by_kind(df: DataFrame, columns) -> DataFrame:
    """(keys, columns): for each name the value of (kind, column)."""
    return df.groupBy(*KEYS).agg(*(F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name) for name, (kind, c) in columns.items()))


def error_against_threshold(scored: DataFrame) -> DataFrame:
    """(keys, n_labelled, nominal_error, labelled_error, spike_ratio, labelled_threshold, share_above, verdict): labelled windows; medians of the smoothed error on other and on labelled windows that have a threshold, and how much larger the latter is; the median threshold of the labelled ones, and the share of them above it."""
    known, label = F.col("threshold").isNotNull(), F.col("window_label")
    error = F.col("smoothed")
    of = {"nominal_error": F.when(known & ~label, error), "labelled_error": F.when(known & label, error), "labelled_threshold": F.when(label, F.col("threshold"))}
    medians = _by_kind(quantiles(_long(scored, of), "x", {"median": 0.5}, (*KEYS, "kind")), {name: (name, "median") for name in of})
    found = scored.groupBy(*KEYS).agg(
        F.count_if(label).alias("n_labelled"),
        F.coalesce(F.avg(F.when(known & label, (error > F.col("threshold")).cast("double"))), F.lit(0.0)).alias("share_above"),
    )
    found = found.join(medians, [*KEYS], "left").withColumn("spike_ratio", F.try_divide("labelled_error", "nominal_error"))
    verdict = F.when(F.col("n_labelled") == 0, "no labelled windows").when(F.col("share_above") > 0.05, "crosses the threshold").when(F.col("spike_ratio") >= 2.0, "rises below the threshold").otherwise("barely rises")
    return found.select(*KEYS, "n_labelled", "nominal_error", "labelled_error", "spike_ratio", "labelled_threshold", "share_above", verdict.alias("verdict"))


def stream_tally(scored: DataFrame) -> DataFrame:
    """(keys, n, labelled, predicted, warm, seg_recall, seg_precision)."""
    counts = scored.groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if("window_label").alias("labelled"), F.count_if("predicted").alias("n_predicted"), F.count("threshold").alias("warm"))
    return counts.join(segment_metrics(scored).select(*KEYS, "seg_recall", "seg_precision"), [*KEYS])


def arrival_gaps(ticks: DataFrame, limit_s: float) -> DataFrame:
    """(keys, n, p50, p90, p99, abnormal, cadence_s): gaps between arrivals in seconds; percentiles are the value at rank int(p / 100 * n), cadence is the mean time between gaps over the limit."""
    gaps = ticks.withColumn("gap", (micros() - F.lag(micros()).over(series())) / 1e6).where("gap is not null")
    ranked = gaps.withColumn("at", F.row_number().over(Window.partitionBy(*KEYS).orderBy("gap", TIE)) - 1).withColumn("n", F.count("*").over(whole()))
    long = F.col("gap") > limit_s
    percentiles = [F.max(F.when(F.col("at") == F.least(F.floor(F.col("n") * F.lit(p) / 100), F.col("n") - 1), F.col("gap"))).alias(f"p{p}") for p in (50, 90, 99)]
    cadence = F.try_divide((F.max(F.when(long, micros())) - F.min(F.when(long, micros()))) / 1e6, (F.count_if(long) - 1).cast("double"))
    return ranked.groupBy(*KEYS).agg(F.count("*").alias("n"), *percentiles, F.count_if(long).alias("abnormal"), cadence.alias("cadence_s"))


def warm_statistics(scored: DataFrame) -> DataFrame:
    """(keys, threshold_min, threshold_median, threshold_max, error_median, error_p99, error_max) of warm windows without labels."""
    warm = scored.where("threshold is not null and not window_label")
    t, e = F.col("threshold"), F.col("smoothed")
    found = quantiles(_long(warm, {"threshold": t, "error": e}), "x", {"median": 0.5, "p99": 0.99}, (*KEYS, "kind"))
    middle = _by_kind(found, {"threshold_median": ("threshold", "median"), "error_median": ("error", "median"), "error_p99": ("error", "p99")})
    ends = warm.groupBy(*KEYS).agg(F.min(t).alias("threshold_min"), F.max(t).alias("threshold_max"), F.max(e).alias("error_max"))
    return ends.join(middle, [*KEYS], "left").select(*KEYS, "threshold_min", "threshold_median", "threshold_max", "error_median", "error_p99", "error_max")


def near_misses(scored: DataFrame, arrival: str | None = None, rows: int = blocks.ROWS) -> DataFrame:
    """(keys, labelled_most, most): the largest error over threshold at labelled windows and anywhere. With the number of a row's arrival, also `restarts`: how often time has gone backwards, as a replay that begins again makes it; counted in blocks of so many numbers, each of which tells the next one its last time."""
    r = F.when(F.col("threshold") > 0, F.col("smoothed") / F.col("threshold"))
    found = scored.groupBy(*KEYS).agg(F.max(F.when(F.col("window_label"), r)).alias("labelled_most"), F.max(r).alias("most"))
    if arrival is None:
        return found.where("most is not null")
    placed = scored.select(*KEYS, arrival, TIME, F.floor(F.col(arrival) / rows).alias(blocks.BLOCK))
    back = F.lag(TIME).over(blocks.within(KEYS, arrival)) > F.col(TIME)
    ends = placed.withColumn("back", back).groupBy(*KEYS, blocks.BLOCK).agg(F.count_if("back").alias("back"), F.min_by(TIME, arrival).alias("first"), F.max_by(TIME, arrival).alias("last"))
    across = F.coalesce((F.lag("last").over(blocks.sequence()) > F.col("first")).cast("int"), F.lit(0))
    restarts = ends.withColumn("back", F.col("back") + across).groupBy(*KEYS).agg(F.sum("back").alias("restarts"))
    return found.join(restarts, [*KEYS], "left").where("most is not null")


def sensitivity(smoothed: DataFrame, window: int, zs: list[float], least_run: int) -> DataFrame:
    """(keys, z, peak_threshold, inside, seg_recall, total): for each z, the threshold at the labelled window with the largest error, flags inside labels, segment recall and flags in all."""
    keys = (*KEYS, "z")
    frame = series(KEYS, "position").rowsBetween(-window, -1)
    base = smoothed.withColumn("m", F.avg("smoothed").over(frame)).withColumn("s", F.stddev_pop("smoothed").over(frame))
    spread = base.withColumn("z", F.explode(F.array(*map(F.lit, zs)))).withColumn("threshold", F.col("m") + F.col("z") * F.col("s"))
    flagged = flag_anomalies(spread, least_run, keys)
    found = flagged.groupBy(*keys).agg(F.max_by(F.when(F.col("window_label"), F.col("threshold")), F.when(F.col("window_label"), F.struct("smoothed", "position"))).alias("peak_threshold"), F.count_if(F.col("window_label") & F.col("predicted")).alias("inside"), F.count_if("predicted").alias("total"))
    return found.join(segment_metrics(flagged, keys=keys).select(*keys, "seg_recall"), [*keys])


def around_first_anomaly(scored: DataFrame, before: int = 2, after: int = 12) -> DataFrame:
    """The windows about the first labelled one of each series, with offset, and how many labelled windows are above in all."""
    first = F.min(F.when(F.col("window_label"), F.col("position"))).over(whole())
    above = F.count_if(F.col("window_label") & (F.col("smoothed") > F.col("threshold"))).over(whole())
    marked = scored.withColumn("offset", F.col("position") - first).withColumn("labelled_above", above)
    return marked.where((F.col("offset") >= -before) & (F.col("offset") < after))


def recent(df: DataFrame, n: int = 200, order=("position",)) -> DataFrame:
    """The last rows of each series."""
    newest = Window.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= n)


def rising_edges(scored: DataFrame) -> DataFrame:
    """Rows where the predicted flag becomes true, with whether the label agrees."""
    before = F.lag("predicted", 1, False).over(series(KEYS, "position"))
    return scored.withColumn("before", before).where(F.col("predicted") & ~F.col("before")).drop("before").withColumn("truth_match", F.col("window_label"))


def latest_alerts(scored: DataFrame, n: int = 50) -> DataFrame:
    return rising_edges(scored).orderBy(F.desc(TIME), *KEYS).limit(n)


def visible_alerts(scored: DataFrame, within: int = 200) -> DataFrame:
    """Alerts with fewer than so many later rows in their series."""
    counted = scored.withColumn("later", F.max("position").over(whole()) - F.col("position"))
    return rising_edges(counted).where(F.col("later") < within)


def subsystem_rollup(scored: DataFrame, drifted: DataFrame, subsystems: DataFrame, within: int = 200) -> DataFrame:
    """(keys, subsystem, anomalous, drifted, last_us): whether a channel has a flag within its last rows, whether it has drifted, and its last time."""
    badge = recent(scored, within).groupBy(*KEYS).agg(F.bool_or("predicted").alias("anomalous"), F.max(micros()).alias("last_us"))
    joined = subsystems.join(badge, [*KEYS], "left").join(drifted.select(*KEYS, "drifted"), [*KEYS], "left")
    return joined.select(*KEYS, "subsystem", F.coalesce("anomalous", F.lit(False)).alias("anomalous"), F.coalesce("drifted", F.lit(False)).alias("drifted"), "last_us")


def subsystem_cards(rollup: DataFrame) -> DataFrame:
    """(mission_id, subsystem, channels, anomalous, drifted, nominal): each channel with the first that holds of anomaly, drift, nominal and waiting."""
    status = F.when(F.col("anomalous"), "anomaly").when(F.col("drifted"), "drift").when(F.col("last_us").isNotNull(), "nominal").otherwise("waiting")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    cards = rollup.withColumn("status", status).groupBy("mission_id", "subsystem").agg(listed(F.concat_ws(":", "channel_id", "status")).alias("channels"), listed(F.when(F.col("anomalous"), F.col("channel_id"))).alias("anomalous"), listed(F.when(F.col("drifted"), F.col("channel_id"))).alias("drifted"))
    return cards.withColumn("nominal", (F.col("anomalous") == "") & (F.col("drifted") == ""))


def servable(candidates: DataFrame, champions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidates with a champion and those without; all pass where the registry is not there."""
    if champions is None:
        return candidates, candidates.limit(0)
    return candidates.join(champions, "channel_id", "left_semi"), candidates.join(champions, "channel_id", "left_anti")


def promote(versions: DataFrame) -> DataFrame:
    """(channel_id, champion): the highest version of each model."""
    return versions.groupBy("channel_id").agg(F.max("version").alias("champion"))


def demote(champions: DataFrame, gone: DataFrame) -> DataFrame:
    return champions.join(gone, "channel_id", "left_anti")


def serving_completeness(resolved: DataFrame, loaded: DataFrame) -> DataFrame:
    """One row: how many of the resolved channels are loaded, which are missing, and whether none is."""
    joined = resolved.select("channel_id").distinct().join(loaded.select("channel_id", F.lit(True).alias("loaded")).distinct(), "channel_id", "left")
    found = joined.agg(F.count("*").alias("n_resolved"), F.count("loaded").alias("n_loaded"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("loaded").isNull(), F.col("channel_id")))), ",").alias("missing"))
    return found.withColumn("ok", F.col("missing") == "")


def with_fallback(channels: DataFrame, first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """A column of the first table, else of the second."""
    a, b = first.select(*KEYS, F.col(column).alias("a")), second.select(*KEYS, F.col(column).alias("b"))
    return channels.select(*KEYS).distinct().join(a, [*KEYS], "left").join(b, [*KEYS], "left").select(*KEYS, F.coalesce("a", "b").alias(column))


__all__ = ["ratio", "so_far"]
