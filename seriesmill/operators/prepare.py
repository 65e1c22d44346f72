"""From raw samples to clean, segmented, normalised, labelled and split series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.quantiles import quantiles
from ..functions.series import KEYS, TIME, micros, so_far, whole
from ..sources.io import settled
from .runs import merge_intervals


def _filled(df: DataFrame, value: str, keys, seconds: float) -> DataFrame:
    """The rows from the first value on, in blocks by time, with nulls filled, their number (`__at`) and the time of the row before (`__previous_us`). A block has to know of those before it their last value, their last time and how many of their rows stay."""
    inside = blocks.within(keys)
    local = blocks.by_time(df, seconds).withColumns({"__known": F.last(value, ignorenulls=True).over(so_far(inside)), "__us": F.lag(micros()).over(inside), "__row": F.row_number().over(inside)})
    local = local.withColumn("__met", F.count("__known").over(so_far(inside)))
    ends = local.groupBy(*keys, blocks.BLOCK).agg(F.count("*").alias("__n"), F.count("__known").alias("__kept"), F.max_by("__known", "__row").alias("__end"), F.max(micros()).alias("__end_us"))
    ends = ends.withColumn("__before", F.last("__end", ignorenulls=True).over(blocks.earlier(keys))).withColumn("__last_us", F.lag("__end_us").over(blocks.sequence(keys)))
    stay = F.when(F.col("__before").isNotNull(), F.col("__n")).otherwise(F.col("__kept"))
    carries = ends.select(*keys, blocks.BLOCK, "__before", "__last_us", F.coalesce(F.sum(stay).over(blocks.earlier(keys)), F.lit(0)).alias("__rows"))
    carried = F.col("__before").isNotNull()
    previous = F.when(carried, F.coalesce("__us", "__last_us")).when(F.col("__met") > 1, F.col("__us"))
    at = F.col("__rows") + F.when(carried, F.col("__row")).otherwise(F.col("__met")) - 1
    out = local.join(carries, [*keys, blocks.BLOCK]).withColumn(value, F.coalesce("__known", "__before")).where(F.col(value).isNotNull())
    return out.select(*df.columns, blocks.BLOCK, at.alias("__at"), previous.alias("__previous_us"))


def _segmented(df: DataFrame, multiplier: float, value: str, keys, seconds: float) -> DataFrame:
    """_filled with is_gap, segment_id and facts of the whole series (mean, std, __first, __last), which are gathered at once."""
    x = F.col(value).cast("double")
    rows = settled(_filled(df, value, keys, seconds).withColumn("__step", micros() - F.col("__previous_us")), "filled")
    facts = rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(micros()).alias("__first"), F.max(micros()).alias("__last"))
    facts = facts.join(quantiles(rows, "__step", {"__median": 0.5}, keys), [*keys], "left")
    flagged = rows.join(facts, [*keys]).withColumn("is_gap", F.coalesce(F.col("__step") > F.col("__median") * multiplier, F.lit(False)))
    return blocks.running(flagged, F.col("is_gap").cast("int"), "segment_id", keys).withColumn("segment_id", F.col("segment_id").cast("int"))


def fill_nulls(df: DataFrame, value: str = "value", keys=KEYS, seconds: float = blocks.DAY) -> DataFrame:
    """Carry the last value forward over nulls; rows before the first value go. The work is split into blocks of so many seconds."""
    return _filled(df, value, keys, seconds).select(*df.columns)


def detect_gaps(df: DataFrame, multiplier: float = 3.0, keys=KEYS, value: str = "value", seconds: float = blocks.DAY) -> DataFrame:
    """fill_nulls with columns is_gap and segment_id: a gap is a step in time of more than so many exact medians of the series' steps; segments are numbered from 0."""
    return _segmented(df, multiplier, value, keys, seconds).select(*df.columns, "is_gap", "segment_id")


def split_at_outages(df: DataFrame, keys=KEYS, seconds: float = blocks.DAY) -> DataFrame:
    """Changes of is_los start segments too; before the first row there is no outage."""
    inside = blocks.within(keys)
    local = blocks.by_time(df, seconds).withColumn("__row", F.row_number().over(inside)).withColumn("__change", F.coalesce(F.col("is_los") != F.lag("is_los").over(inside), F.lit(False)).cast("int"))
    ends = local.groupBy(*keys, blocks.BLOCK).agg(F.min_by("is_los", "__row").alias("__first"), F.max_by("is_los", "__row").alias("__end"), F.sum("__change").alias("__changes"))
    ends = ends.withColumn("__start", (F.col("__first") != F.lag("__end", 1, False).over(blocks.sequence(keys))).cast("int"))
    carry = F.coalesce(F.sum(F.col("__changes") + F.col("__start")).over(blocks.earlier(keys)), F.lit(0)) + F.col("__start")
    joined = local.withColumn("__change", F.sum("__change").over(so_far(inside))).join(ends.select(*keys, blocks.BLOCK, carry.alias("__before")), [*keys, blocks.BLOCK])
    return joined.withColumn("segment_id", (F.col("segment_id") + F.col("__change") + F.col("__before")).cast("int")).select(*df.columns)


def normalization_params(df: DataFrame, value: str = "value", keys=KEYS, stats_scope: str = "full") -> DataFrame:
    """(keys, mean, std): the sample deviation, 0 where it is undefined; of all rows, or of the training rows only."""
    rows = df if stats_scope == "full" else df.where("split = 'train'")
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"))


def _normalized(df: DataFrame, value: str = "value") -> DataFrame:
    x = F.when(F.col("std") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col(value).cast("double") - F.col("mean"), F.col("std")))
    return df.withColumn("value_normalized", x.cast("float")).drop("mean", "std")


def apply_params(df: DataFrame, params: DataFrame, value: str = "value", keys=KEYS) -> DataFrame:
    """value_normalized by stored parameters; 0 for a constant series."""
    return _normalized(df.join(params.select(*keys, "mean", "std"), [*keys]), value)


def normalize(df: DataFrame, value: str = "value", keys=KEYS, stats_scope: str = "full") -> DataFrame:
    return apply_params(df, normalization_params(df, value, keys, stats_scope), value, keys)


def label_timesteps(df: DataFrame, labels: DataFrame, keys=KEYS, bucket: str = "day") -> DataFrame:
    """is_anomaly: whether the time lies in a labelled half-open interval of the series.

    Overlapping intervals are merged first, so a row meets at most one. Intervals are cut at day borders, so the join has the day among its equal keys and many long label lists stay a hash join.
    """
    merged = merge_intervals(labels.select(*keys, "start_time", "end_time"), keys)
    days = F.sequence(F.date_trunc(bucket, "start_time"), F.date_trunc(bucket, F.col("end_time") - F.expr("INTERVAL 1 MICROSECOND")), F.expr(f"INTERVAL 1 {bucket}"))
    cut = merged.select(*keys, "start_time", "end_time", F.explode(days).alias("label_bucket"))
    rows = df.withColumn("label_bucket", F.date_trunc(bucket, TIME))
    inside = [rows[k] == cut[k] for k in (*keys, "label_bucket")] + [rows[TIME] >= cut["start_time"], rows[TIME] < cut["end_time"]]
    joined = rows.join(cut, inside, "left")
    return joined.select(*[rows[c] for c in df.columns], cut["start_time"].isNotNull().alias("is_anomaly"))


def _split(df: DataFrame, fraction: float, lookback_us: int | None) -> DataFrame:
    cutoff = F.col("__first") + F.lit(fraction) * (F.col("__last") - F.col("__first"))
    out = df.withColumn("split", F.when(micros() <= cutoff, "train").otherwise("test"))
    if lookback_us is not None:
        out = out.where((F.col("split") == "test") | (micros() >= cutoff - lookback_us))
    return out.drop("__first", "__last")


def split_by_time(df: DataFrame, fraction: float = 0.8, lookback_us: int | None = None, keys=KEYS) -> DataFrame:
    """split: train up to the given fraction of the series' time span, test after it; with a lookback, training rows from before it go."""
    bounds = df.groupBy(*keys).agg(F.min(micros()).alias("__first"), F.max(micros()).alias("__last"))
    return _split(df.join(bounds, [*keys]), fraction, lookback_us).select(*df.columns, "split")


def prepare(ticks: DataFrame, labels: DataFrame, multiplier: float = 3.0, fraction: float = 0.8, lookback_us: int | None = None, stats_scope: str = "full", seconds: float = blocks.DAY) -> DataFrame:
    """Full preparation of all series in one job, with each row's position in its filled series. The work is split into blocks of so many seconds."""
    rows = _segmented(ticks, multiplier, "value", KEYS, seconds).withColumnRenamed("__at", "position")
    if stats_scope != "full":
        split = _split(rows.drop("mean", "std"), fraction, lookback_us)
        done = normalize(split, stats_scope=stats_scope)
    else:
        done = _split(_normalized(rows), fraction, lookback_us)
    return label_timesteps(done.select(*ticks.columns, "is_gap", "segment_id", "value_normalized", "split", "position"), labels)


def resolve_channels(df: DataFrame, explicit: list[str] | None = None, listed: list[str] | None = None, subsystems: DataFrame | None = None, subsystem: str | None = None, some: bool = False) -> DataFrame:
    """Distinct channels: those given, else those of a list, else all, each cut down to a subsystem if one is given. With `some`, none at all is an error."""
    chosen = explicit if explicit is not None else listed
    out = df.select(*KEYS).distinct()
    if chosen is not None:
        out = out.where(F.col("channel_id").isin(chosen))
    if subsystem is not None:
        out = out.join(subsystems.where(F.col("subsystem") == subsystem), [*KEYS], "left_semi")
    if some and out.isEmpty():
        raise ValueError("no channel is left")
    return out


def subsystem_map(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary map, completed by the fallback; blank names are left out."""

    def clean(df: DataFrame, name: str) -> DataFrame:
        return df.where((F.trim("channel_id") != "") & (F.trim("subsystem") != "")).groupBy("channel_id").agg(F.min(F.trim("subsystem")).alias(name))

    return clean(primary, "a").join(clean(fallback, "b"), "channel_id", "full_outer").select("channel_id", F.coalesce("a", "b").alias("subsystem"))


def anomaly_slice(df: DataFrame, warmup: int, max_rows: int, keys=KEYS) -> DataFrame:
    """Rows from `warmup` rows before the first anomalous one on, at most max_rows (0: all); the first rows where there is none."""
    first = F.min(F.when(F.col("is_anomaly"), F.col("position"))).over(whole(keys))
    start = F.greatest(F.coalesce(first - warmup, F.lit(0)), F.lit(0))
    kept = df.withColumn("slice_start", start).where(F.col("position") >= F.col("slice_start"))
    if max_rows:
        kept = kept.where(F.col("position") < F.col("slice_start") + max_rows)
    return kept.drop("slice_start")


def warmup_headroom(df: DataFrame, window: int, threshold_window: int, keys=KEYS) -> DataFrame:
    """(keys, first_anomaly, first_run, enough) of positioned rows: whether the first anomaly leaves room to warm up."""
    first = F.min(F.when(F.col("is_anomaly"), F.col("position"))).over(whole(keys))
    after = df.withColumn("first_anomaly", first).where("position >= first_anomaly")
    grouped = after.groupBy(*keys, "first_anomaly").agg(F.min(F.when(~F.col("is_anomaly"), F.col("position"))).alias("ends"), (F.max("position") + 1).alias("last"))
    found = grouped.select(*keys, "first_anomaly", (F.coalesce("ends", "last") - F.col("first_anomaly")).alias("first_run"), (F.col("first_anomaly") >= window + threshold_window).alias("enough"))
    return df.select(*keys).distinct().join(found, [*keys], "left")
