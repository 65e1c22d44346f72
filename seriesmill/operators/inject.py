"""Faults put into series to make labels, and the shapes of labelled anomalies."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import KEYS, series, whole
from .runs import mark_runs

FAULTS = ("spike", "drift", "flatline")
#: A profile where nothing is given (fixed values).
DEFAULTS = {"signal_class": "slow_lownoise", "magnitude_sigma_range": (0.4, 1.5), "spike_duration_range": (1, 5), "drift_duration_range": (30, 300), "flatline_duration_range": (30, 300)}
WEIGHTS = {"drift": 0.45, "flatline": 0.45, "spike": 0.10}
#: Profiles of classes with too few channels: weights of spike, drift and flatline, magnitudes, and the durations of each (fixed values). The mixed class has that of slow_lownoise.
CLASS_DEFAULTS = {
    "periodic_flatlines": ((0.20, 0.15, 0.65), (0.5, 2.5), (1, 5), (10, 200), (20, 400)),
    "smooth_ramp": ((0.15, 0.55, 0.30), (0.4, 2.0), (1, 5), (20, 500), (20, 300)),
    "slow_lownoise": ((0.10, 0.45, 0.45), (0.4, 2.0), (1, 4), (30, 600), (30, 600)),
    "bounded_oscillatory": ((0.30, 0.40, 0.30), (0.3, 1.5), (1, 6), (15, 300), (15, 200)),
}
#: What faults need to be seen by a forecast's residual, instead of a class's own profile (fixed values).
DETECTABLE = ((0.40, 0.30, 0.30), (3.0, 5.0), (1, 10), (20, 120), (20, 120))
PROFILE_COLUMNS = ["spike", "drift", "flatline", *(f"{name}_{end}" for name in ("magnitude", "spike_duration", "drift_duration", "flatline_duration") for end in ("low", "high"))]


def apply_faults(df: DataFrame, faults: DataFrame, value: str = "value_normalized", keys=KEYS) -> DataFrame:
    """The positioned rows with faults (keys, type, start, end, magnitude) applied: new values, and is_anomaly true inside of them.

    A spike adds its magnitude, downwards if the value at its start is below the mean of up to 20 rows before it. A drift rises over the first half of its rows and stays. A flatline holds the value before it, or its own first.
    """
    order = series(keys, "position")
    v = F.col(value).cast("double")
    known = df.withColumn("__before", F.coalesce(F.avg(v).over(order.rowsBetween(-20, -1)), F.lit(0.0))).withColumn("__held", F.coalesce(F.lag(v).over(order), v))
    at = faults.select(*keys, F.col("start").alias("position"), "type", F.col("end").alias("__end"), F.coalesce("magnitude", F.lit(0.0)).alias("__magnitude"))
    anchors = known.join(at, [*keys, "position"]).select(*keys, F.col("position").alias("__start"), "__end", "type", F.when(v >= F.col("__before"), F.col("__magnitude")).otherwise(-F.col("__magnitude")).alias("__signed"), "__magnitude", "__held")
    spread = anchors.withColumn("position", F.explode(F.sequence(F.col("__start"), F.col("__end") - 1)))
    # Where faults touch, the later one holds.
    spread = spread.groupBy(*keys, "position").agg(F.max_by(F.struct("__start", "__end", "type", "__signed", "__magnitude", "__held"), "__start").alias("f")).select(*keys, "position", "f.*")
    step = F.col("position") - F.col("__start")
    ramp = F.greatest(F.lit(1), F.floor((F.col("__end") - F.col("__start")) / 2))
    risen = F.when(step < ramp, F.col("__magnitude") * step / F.greatest(F.lit(1), ramp - 1)).otherwise(F.col("__magnitude"))
    risen = F.when((ramp == 1) & (step == 0), F.lit(0.0)).otherwise(risen)
    joined = df.join(spread, [*keys, "position"], "left")
    new = F.when(F.col("type") == "spike", v + F.col("__signed")).when(F.col("type") == "drift", v + risen).when(F.col("type") == "flatline", F.col("__held")).otherwise(v)
    out = joined.withColumn(value, new.cast("float")).withColumn("is_anomaly", F.col("type").isNotNull())
    return out.select(*df.columns, *([] if "is_anomaly" in df.columns else ["is_anomaly"]))


def fault_manifest(faults: DataFrame, keys=KEYS) -> DataFrame:
    return faults.groupBy(*keys).agg(F.count("*").alias("n_faults"), F.array_sort(F.collect_list(F.struct("start", "end", "type", "magnitude"))).alias("faults"))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """The profiles with defaults for nulls and an array `errors`: unknown faults, no positive weight, ranges whose ends are not in order."""
    filled = profiles
    for name, default in DEFAULTS.items():
        made = F.lit(default) if isinstance(default, str) else F.array(*map(F.lit, default))
        filled = filled.withColumn(name, F.coalesce(F.col(name), made))
    filled = filled.withColumn("fault_type_weights", F.coalesce("fault_type_weights", F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair))))
    checks = [
        F.when(F.size(F.array_except(F.map_keys("fault_type_weights"), F.array(*map(F.lit, FAULTS)))) > 0, "unknown fault"),
        F.when(F.forall(F.map_values("fault_type_weights"), lambda w: w <= 0), "no positive weight"),
        *(F.when(F.element_at(name, 1) >= F.element_at(name, 2), f"{name} not in order") for name, d in DEFAULTS.items() if not isinstance(d, str)),
    ]
    return filled.withColumn("errors", F.array_compact(F.array(*checks)))


def place_faults(df: DataFrame, faults_per_series: int, min_gap: int, tail: int, seed: int = 0, profile: dict | None = None, keys=KEYS, value: str = "value_normalized", before: int = 250, flat: float = 0.01) -> DataFrame:
    """A fault table (keys, type, start, end, magnitude, signal_class) placed at random, the same for one seed and series.

    Faults keep within a segment, at whose end they are cut, and off its first row, off lost rows and the last `tail` rows, and apart by min_gap; one at least is tried in the first 60 % and in the rest. A flatline starts only where the variance of the rows before it, up to `before` in its segment, is not under `flat`. Only the extents of usable stretches go to Python, one row of arrays for each series.
    """
    profile = {**DEFAULTS, "fault_type_weights": WEIGHTS, **(profile or {})}
    usable = df.withColumn("usable", ~F.coalesce(F.col("is_los"), F.lit(False)) if "is_los" in df.columns else F.lit(True))
    earlier = series((*keys, "segment_id"), "position").rowsBetween(-before, -1)
    still = (F.count(value).over(earlier) > 1) & (F.var_pop(F.col(value).cast("double")).over(earlier) < flat)
    usable = usable.withColumn("lively", F.col("usable") & ~still)

    def stretches(flag: str) -> DataFrame:
        marked = mark_runs(usable, flag, "run", (*keys, "segment_id"), "position").where(flag)
        found = marked.groupBy(*keys, "segment_id", "run").agg(F.min("position").alias("a"), (F.max("position") + 1).alias("b"))
        return found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(flag))

    rows = stretches("usable").join(stretches("lively"), [*keys], "left").join(df.groupBy(*keys).agg((F.max("position") + 1).alias("n")), [*keys])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.array([max(0.0, profile["fault_type_weights"].get(t, 0.0)) for t in FAULTS])
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                rng = np.random.default_rng([seed, zlib.crc32("/".join(str(row[k]) for k in keys).encode())])
                spans = [(int(s["a"]) + 1, min(int(s["b"]), int(row["n"]) - tail)) for s in row["usable"]]
                # (first start, last start, end of the stretch); lively stretches lie within usable ones.
                starts = dict.fromkeys(FAULTS, [(s, e, e) for s, e in spans])
                lively = [] if row["lively"] is None else row["lively"]
                inside = [(spans[bisect_right(spans, int(x["a"]) + 1, key=lambda span: span[0]) - 1], x) for x in lively]
                starts["flatline"] = [(max(s, int(x["a"])), int(x["b"]) - 1, e) for (s, e), x in inside]
                cut, taken = int(row["n"] * 0.6), []
                for k in range(faults_per_series):
                    low, high = (0, cut) if k % 2 == 0 else (cut, int(row["n"]))
                    for _ in range(30):
                        kind = FAULTS[rng.choice(3, p=weights / weights.sum())]
                        a, b = profile[f"{kind}_duration_range"]
                        least = 2 if kind == "drift" else 1
                        size = max(int(rng.integers(a, b + 1)), least)
                        magnitude = None if kind == "flatline" else float(rng.uniform(*profile["magnitude_sigma_range"]))
                        fits = [(max(s, low), min(last, e - least, high - 1), e) for s, last, e in starts[kind] if min(last, e - least, high - 1) >= max(s, low)]
                        if not fits:
                            continue
                        s, last, e = fits[rng.integers(len(fits))]
                        start = int(rng.integers(s, last + 1))
                        end = min(start + size, e)
                        if all(start >= y + min_gap or end + min_gap <= x for x, y in taken):
                            taken.append((start, end))
                            out.append({**{key: row[key] for key in keys}, "type": kind, "start": start, "end": end, "magnitude": magnitude, "signal_class": profile["signal_class"]})
                            break
            yield pd.DataFrame(out, columns=[*keys, "type", "start", "end", "magnitude", "signal_class"])

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInPandas(place, f"{types}, type string, start bigint, end bigint, magnitude double, signal_class string")


def anomaly_shapes(df: DataFrame, value: str = "value_normalized", least: int = 50, keys=KEYS) -> DataFrame:
    """(keys, start, n, level, spread, rise, magnitude, shape) of each labelled run of positioned rows, all taken against the mean and deviation of the series' nominal rows: how far its mean is off, its deviation, its slope times its length, and the median distance of its rows. Series with fewer nominal rows than `least` are left out."""
    v = F.col(value).cast("double")
    nominal = df.where(~F.col("is_anomaly")).groupBy(*keys).agg(F.count("*").alias("rows"), F.avg(v).alias("usual"), F.coalesce(F.nullif(F.stddev_pop(v), F.lit(0.0)), F.lit(1.0)).alias("deviation")).where(F.col("rows") >= least)
    marked = mark_runs(df, "is_anomaly", "run", keys, "position").where("is_anomaly").join(nominal, [*keys])
    off = (v - F.col("usual")) / F.greatest("deviation", F.lit(1e-9))
    runs = marked.groupBy(*keys, "run").agg(F.min("position").alias("start"), F.count("*").alias("n"), F.avg(off).alias("level"), F.stddev_pop(off).alias("spread"), (F.coalesce(F.regr_slope(off, F.col("position").cast("double")), F.lit(0.0)) * F.count("*")).alias("rise"), F.median(F.abs(off)).alias("magnitude"))
    level, rise = F.abs("level"), F.abs("rise")
    shape = (
        F.when(F.col("n") < 2, "spike")
        .when((F.col("n") < 10) & (level > 1.5), "spike")
        .when((F.col("spread") < 0.25) & (level > 0.3), "flatline")
        .when((rise > 0.8) & (F.col("spread") < F.greatest(rise, F.lit(0.3))), "drift_ramp")
        .otherwise("level_shift")
    )
    return runs.withColumn("shape", shape).drop("run")


def channel_characteristics(df: DataFrame, value: str = "value_normalized", least: int = 50, keys=KEYS) -> DataFrame:
    """(keys, flat, noise, autocorrelation, range) of nominal rows; differences skip over the rows between. Series with fewer nominal rows than `least` are left out."""
    nominal = df.where(~F.col("is_anomaly")).withColumn("v", F.col(value).cast("double"))
    stepped = nominal.withColumn("p", F.lag("v").over(series(keys, "position"))).withColumn("d", F.col("v") - F.col("p"))
    grouped = stepped.groupBy(*keys).agg(
        F.count("*").alias("n"),
        ratio_of(F.count_if(F.abs("d") < 0.02), F.count("d")).alias("flat"),
        F.stddev_pop("d").alias("noise"),
        F.corr("v", "p").alias("autocorrelation"),
        (F.max("v") - F.min("v")).alias("range"),
    )
    return grouped.where(F.col("n") >= least).drop("n")


def channel_profiles(df: DataFrame, value: str = "value_normalized", least: int = 50, keys=KEYS) -> DataFrame:
    """channel_characteristics with what the labelled runs of each series are like: their number, percentiles of their lengths and magnitudes, and the shares of their shapes. Series without a labelled run are left out."""
    percentiles = [F.percentile(c, p / 100).alias(f"{name}_p{p}") for name, c in (("duration", "n"), ("magnitude", "magnitude")) for p in (10, 50, 90)]
    shares = [F.avg((F.col("shape") == shape).cast("double")).alias(f"share_{shape}") for shape in ("spike", "flatline", "drift_ramp", "level_shift")]
    own = anomaly_shapes(df, value, least, keys).groupBy(*keys).agg(F.count("*").alias("n_runs"), *percentiles, *shares)
    return channel_characteristics(df, value, least, keys).join(own, [*keys])


def ratio_of(a, b):
    return F.try_divide(a.cast("double"), b.cast("double"))


def signal_classes(characteristics: DataFrame) -> DataFrame:
    """signal_class by rules on the characteristics, the first that holds; a missing autocorrelation fails its rules."""
    flat, noise, correlated, spread = (F.col(c) for c in ("flat", "noise", "autocorrelation", "range"))
    rules = (
        F.when((flat > 0.25) & (spread > 1.5), "periodic_flatlines")
        .when((correlated > 0.97) & (noise < 0.04) & (spread < 2.0), "slow_lownoise")
        .when((correlated > 0.92) & (noise < 0.10), "smooth_ramp")
        .when((spread < 3.0) & (flat < 0.20), "bounded_oscillatory")
        .otherwise("mixed")
    )
    return characteristics.withColumn("signal_class", rules)


def class_profiles(classes: DataFrame, shapes: DataFrame, least: int = 3, detectable: bool = False, keys=KEYS) -> DataFrame:
    """(signal_class, n_channels, then the columns PROFILE_COLUMNS) of every class: weights of faults, and the lower and upper end of magnitudes and durations.

    Of each channel with labelled runs the median duration and magnitude and the mix of shapes count. A class's weights are the means of the mix, where a level shift counts as a flatline by 0.6 and as a drift by 0.4, made to add up to one; its ranges go by the tenth, fiftieth and ninetieth percentile of the channels' medians, within bounds. A class of fewer channels than `least` has its default profile; with `detectable`, all have that of faults that a forecast's residual shows.
    """
    kinds = ("spike", "flatline", "drift_ramp", "level_shift")
    each = shapes.groupBy(*keys).agg(F.median("magnitude").alias("magnitude"), F.median("n").alias("duration"), *(F.avg((F.col("shape") == s).cast("double")).alias(s) for s in kinds))
    joined = classes.select(*keys, "signal_class").join(each, [*keys])
    percentiles = [F.percentile(c, p / 100).alias(f"{c}_p{p}") for c in ("magnitude", "duration") for p in (10, 50, 90)]
    grouped = joined.groupBy("signal_class").agg(F.count("*").alias("n_channels"), *percentiles, *(F.avg(s).alias(f"{s}_share") for s in kinds))
    share = F.col("level_shift_share")
    parts = {"spike": F.col("spike_share"), "drift": F.col("drift_ramp_share") + share * 0.4, "flatline": F.col("flatline_share") + share * 0.6}
    grouped = grouped.select("*", *(F.round(x, 2).alias(f"{name}_part") for name, x in parts.items()))
    total = F.col("spike_part") + F.col("drift_part") + F.col("flatline_part")
    whole = lambda p: F.floor(f"duration_p{p}").cast("int")
    low = F.greatest(F.lit(0.3), F.round("magnitude_p10", 2))
    short, long = F.greatest(F.lit(3), F.least(F.lit(20), whole(10))), F.greatest(F.lit(100), F.least(F.lit(2000), whole(90)))
    own = [*(F.round(F.try_divide(F.col(f"{name}_part"), total), 3) for name in parts), low, F.least(F.lit(6.0), F.round(F.greatest(F.col("magnitude_p90"), low + 0.5), 2)), F.lit(1), F.greatest(F.lit(2), short), short, long, short, long]
    found = grouped.select("signal_class", "n_channels", *(x.cast("double").alias(f"own_{c}") for c, x in zip(PROFILE_COLUMNS, own, strict=True)))

    def flat(profile: tuple) -> list[float]:
        return [float(x) for part in profile for x in part]

    rows = [(name, *flat(DETECTABLE if detectable else CLASS_DEFAULTS.get(name, CLASS_DEFAULTS["slow_lownoise"]))) for name in (*CLASS_DEFAULTS, "mixed")]
    defaults = classes.sparkSession.createDataFrame(rows, "signal_class string, " + ", ".join(f"{c} double" for c in PROFILE_COLUMNS))
    both = defaults.join(found, "signal_class", "left").withColumn("n_channels", F.coalesce("n_channels", F.lit(0)).cast("bigint"))
    chosen = [F.when((F.col("n_channels") >= least) & F.lit(not detectable), F.col(f"own_{c}")).otherwise(F.col(c)).alias(c) for c in PROFILE_COLUMNS]
    return both.select("signal_class", "n_channels", *chosen)


__all__ = ["Window", "anomaly_shapes", "apply_faults", "channel_characteristics", "class_profiles", "fault_manifest", "place_faults", "signal_classes", "validate_profiles", "whole"]
