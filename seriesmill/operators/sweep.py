"""Parameter sweeps of the scoring pass as one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks, kernels
from ..functions.series import KEYS, ratio, sent_if_small, so_far
from ..sources.io import settled
from .scoring import flag_anomalies, point_scores, segment_scores, smooth_errors

#: Bounds of span, window, z and run; the upper ends of whole numbers are exclusive.
BOUNDS = {"span": (5, 100), "window": (50, 500), "z": (2.5, 5.0), "least_run": (1, 10)}
LIVE_BOUNDS = {**BOUNDS, "window": (50, 250), "least_run": (1, 4)}
DEFAULT = {"span": 30, "window": 250, "z": 3.0, "least_run": 3}


def sample_configs(spark: SparkSession, n: int, bounds: dict = BOUNDS, seed: int = 0) -> DataFrame:
    """(config, span, window, z, least_run): n configurations in bounds, from hashes of their number and the seed."""
    share = {name: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1_000_003)) / 1_000_003.0 for name in bounds}
    columns = [(F.lit(a) + share[name] * (b - a)).cast("double" if isinstance(a, float) else "int").alias(name) for name, (a, b) in bounds.items()]
    return spark.range(n).select(F.col("id").cast("int").alias("config"), *columns)


def clamp_configs(configs: DataFrame, bounds: dict = BOUNDS) -> DataFrame:
    for name, (a, b) in bounds.items():
        top = b if isinstance(a, float) else b - 1
        configs = configs.withColumn(name, F.greatest(F.lit(a), F.least(F.lit(top), F.col(name))))
    return configs


def with_default(configs: DataFrame, config: int, bounds: dict = BOUNDS, default: dict = DEFAULT) -> DataFrame:
    """The configurations and, under the given number, the default clamped into the bounds."""
    row = configs.sparkSession.range(1).select(F.lit(config).alias("config"), *(F.lit(default[name]).alias(name) for name in bounds))
    return configs.unionByName(clamp_configs(row, bounds))


def thresholds_by_row(df: DataFrame, keys, most_window: int = 500, rows: int = 4096) -> DataFrame:
    """threshold with window and z from columns: the running sums of a block of so many rows, about the block's mean, are gathered in one array, in which each row looks up those of `window` rows before. Windows are at most most_window long; longer ones are an error."""
    inside = so_far(blocks.within(keys, "position"))
    window = F.when(F.col("window") <= most_window, F.col("window")).otherwise(F.raise_error(F.lit(f"a window above most_window, {most_window}")))
    spread = blocks.by_position(df.withColumn("window", window), most_window, rows=rows)
    centred = spread.withColumn("__m", F.avg("smoothed").over(Window.partitionBy(*keys, blocks.BLOCK))).withColumn("__c", F.col("smoothed") - F.col("__m"))
    sums = centred.withColumn("__s1", F.sum("__c").over(inside) - F.col("__c")).withColumn("__s2", F.sum(F.col("__c") * F.col("__c")).over(inside) - F.col("__c") * F.col("__c"))
    values = [c for c in df.columns if c not in (*keys, "position")]
    row = F.struct("position", *values, blocks.OWN, "__m", "__s1", "__s2")
    blocked = sums.groupBy(*keys, blocks.BLOCK).agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    placed = F.transform("__rows", lambda r, k: F.struct(r.alias("r"), F.get("__rows", F.greatest(k - r["window"], F.lit(0))).alias("p"), F.least(k, r["window"]).alias("n")))
    out = blocked.select(*keys, F.inline(placed)).where(F.col("r")[blocks.OWN])
    mean = F.try_divide(F.col("r.__s1") - F.col("p.__s1"), F.col("n"))
    variance = F.greatest(F.try_divide(F.col("r.__s2") - F.col("p.__s2"), F.col("n")) - mean * mean, F.lit(0.0))
    made = F.when(F.col("n") > 0, F.col("r.__m") + mean + F.col("r.z") * F.sqrt(variance))
    return out.select(*keys, "r.position", *(F.col(f"r.{c}") for c in values), made.alias("threshold"))


def labelled_errors(errors: DataFrame, labels: DataFrame) -> DataFrame:
    """Errors (keys, position, residual) with the labels (keys, position, window_label) of their windows. Series without either are left out; where a series has more of one than of the other, or at other positions, the job ends with an error that names it, as the two come from different windows."""
    flags = labels.select(*KEYS, "position", "window_label", F.lit(True).alias("__label"))
    both = errors.withColumn("__error", F.lit(True)).join(flags, [*KEYS, "position"], "full_outer")
    counts = both.groupBy(*KEYS).agg(F.count("__error").alias("e"), F.count("__label").alias("l"), F.count_if(F.col("__error") & F.col("__label")).alias("both"))
    told = F.concat(F.lit("the labels do not fit the errors of "), F.concat_ws("/", *KEYS), F.lit(": "), F.col("l"), F.lit(" against "), F.col("e"))
    fits = F.when((F.col("e") == F.col("both")) & (F.col("l") == F.col("both")), F.lit(True)).otherwise(F.raise_error(told))
    usable = counts.where("e > 0 and l > 0").withColumn("__fits", fits).where("__fits").select(*KEYS)
    return both.where("__error and __label").drop("__error", "__label").join(usable, [*KEYS], "left_semi")


def sweep_parts(errors: DataFrame, subsystems: DataFrame, fraction: float = 0.6) -> DataFrame:
    """(mission_id, subsystem, n, labelled_first, labelled_rest, warning): labelled windows of the part that a sweep tries on and of the rest, over all series of a subsystem; a warning where a part has none, as scores there are then 0 whatever the configuration."""
    size = errors.groupBy(*KEYS).agg(F.count("*").alias("size"))
    first = F.col("position") < F.floor(F.col("size") * F.lit(fraction))
    counted = errors.join(size, [*KEYS]).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if(first & F.col("window_label")).alias("a"), F.count_if(~first & F.col("window_label")).alias("b"))
    found = counted.join(subsystems, [*KEYS]).groupBy("mission_id", "subsystem").agg(F.sum("n").alias("n"), F.sum("a").alias("labelled_first"), F.sum("b").alias("labelled_rest"))
    told = F.concat_ws("; ", F.when(F.col("labelled_first") == 0, "no labelled window to try on"), F.when(F.col("labelled_rest") == 0, "no labelled window in the rest"))
    return found.withColumn("warning", F.nullif(told, F.lit("")))


def _block_trials(configs: list[tuple]):
    """What one block of a series tells of each configuration: counts over its own rows, runs of labels and of flags that lie within it and how many of them meet the other, and those that touch its ends. Errors are smoothed once for each span, and windows summed once for each span and window."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        position, own = frame["position"].to_numpy(), frame[blocks.OWN].to_numpy(bool)
        if not own.any():
            return pd.DataFrame([], columns=_TOLD)
        errors, truth = np.abs(frame["residual"].to_numpy(float)), frame["window_label"].to_numpy(bool)[own]
        whole_before = np.concatenate(([0], np.cumsum(truth)))
        left, right = position[own][0], position[own][-1] + 1
        smooth, sums, out = {}, {}, []
        for config, span, window, z, least in configs:
            if span not in smooth:
                smooth[span] = kernels.smoothed(errors, span, None if position[0] == 0 else 0.0)
            if (span, window) not in sums:
                sums[span, window] = kernels.limits(smooth[span], window)
            mean, deviation = sums[span, window]
            flags = kernels.long_runs(smooth[span] > mean + z * deviation, least)[own]
            told, edges = [], []
            for kind, mine, other in ((True, truth, np.concatenate(([0], np.cumsum(flags)))), (False, flags, whole_before)):
                a, b = kernels.runs(mine)
                hit = other[b] > other[a]
                inside = ((a > 0) | (left == 0)) & (b < len(mine))
                told += [int(inside.sum()), int((inside & hit).sum())]
                edges += [{"kind": kind, "a": int(left + x), "b": int(left + y), "hit": bool(h)} for x, y, h in zip(a[~inside], b[~inside], hit[~inside], strict=True)]
            both = int((truth & flags).sum())
            out.append((*key[:-1], config, both, int(flags.sum()) - both, int(truth.sum()) - both, int(truth.sum()), int(flags.sum()), int(right - left), *told, edges))
        return pd.DataFrame(out, columns=_TOLD)

    return run


_COUNTS = ["tp", "fp", "fn", "n_true", "n_predicted", "n"]
_RUNS = ["seg_true", "hit_true", "seg_predicted", "hit_predicted"]
_TOLD = [*KEYS, "config", *_COUNTS, *_RUNS, "edges"]


def trials(errors: DataFrame, configs: DataFrame, subsystems: DataFrame, penalty: float = 5.0, fraction: float = 0.6, rows: int = 16_384) -> DataFrame:
    """(mission_id, subsystem, config, f05, seg_f05, false_rate, objective) over the first windows of each series.

    errors: keys, position, residual, window_label. Configurations are a sweep's list, which goes to every task. Each block of so many rows is a task's work for all configurations at once: its rows are shuffled once, with those before it that a smoothed error, a window and a run can see (what lies further back weighs less than 1e-17), and only counts and the runs that touch its ends come out; those that follow each other across blocks are joined afterwards.
    """
    keys, listed = (*KEYS, "config"), [tuple(r) for r in configs.select("config", "span", "window", "z", "least_run").collect()]
    size = errors.groupBy(*KEYS).agg(F.floor(F.count("*") * F.lit(fraction)).alias("__cut"))
    first = errors.select(*KEYS, "position", "residual", F.coalesce("window_label", F.lit(False)).alias("window_label")).join(size, [*KEYS]).where(F.col("position") < F.col("__cut")).drop("__cut")
    run = max((c[4] for c in listed), default=1)
    back = 20 * (max((c[1] for c in listed), default=1) + 1) + max((c[2] for c in listed), default=1) + run
    spread = blocks.by_position(first, back, run, rows)
    kinds = ", ".join(f"{k} {errors.schema[k].dataType.simpleString()}" for k in KEYS)
    schema = f"{kinds}, config int, {', '.join(f'{c} bigint' for c in [*_COUNTS, *_RUNS])}, edges array<struct<kind:boolean,a:bigint,b:bigint,hit:boolean>>"
    # Written once: counts and edges are both read from it.
    told = settled(spread.groupBy(*KEYS, blocks.BLOCK).applyInPandas(_block_trials(listed), schema), "trials")

    order = Window.partitionBy(*keys, "kind").orderBy("a")
    pieces = told.select(*keys, F.inline("edges"))
    pieces = pieces.withColumn("__new", F.coalesce((F.lag("b").over(order) < F.col("a")).cast("int"), F.lit(1)))
    joined = pieces.withColumn("__run", F.sum("__new").over(so_far(order))).groupBy(*keys, "kind", "__run").agg(F.bool_or("hit").alias("hit"))
    kind, hit = F.col("kind"), F.col("hit")
    across = joined.groupBy(*keys).agg(F.count_if(kind).alias("__seg_true"), F.count_if(kind & hit).alias("__hit_true"), F.count_if(~kind).alias("__seg_predicted"), F.count_if(~kind & hit).alias("__hit_predicted"))
    counts = told.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in [*_COUNTS, *_RUNS])).join(across, [*keys], "left")
    counts = counts.withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in _RUNS})
    each = segment_scores(point_scores(counts)).withColumn("false_rate", ratio(F.col("fp"), F.col("n") - F.col("n_true"))).join(subsystems, [*KEYS])
    means = each.groupBy("mission_id", "subsystem", "config").agg(*(F.avg(c).alias(c) for c in ("f05", "seg_f05", "false_rate")))
    return means.withColumn("objective", F.col("seg_f05") - F.col("false_rate") * penalty)


def best_configs(results: DataFrame, configs: DataFrame, default_config: int, bounds: dict = BOUNDS) -> DataFrame:
    """The best configuration of each subsystem; the default stays where it is at least as good. near_bound marks a z within 0.1 of the lower bound."""
    order = F.struct("objective", (F.col("config") == default_config).cast("int").alias("d"), (-F.col("config")).alias("c"))
    best = results.groupBy("mission_id", "subsystem").agg(F.max_by(F.struct("config", "objective"), order).alias("b")).select("mission_id", "subsystem", "b.*")
    return best.join(sent_if_small(configs), "config").withColumn("near_bound", F.col("z") <= bounds["z"][0] + 0.1)


def tuned_parameters(channels: DataFrame, subsystems: DataFrame, tuned: DataFrame, default: dict = DEFAULT) -> DataFrame:
    """The parameters of each channel: its subsystem's tuned ones, else the default. Other columns of the tuned table are ignored."""
    chosen = tuned.select("mission_id", "subsystem", *(F.col(c).alias(f"__{c}") for c in default))
    joined = channels.select(*KEYS).distinct().join(subsystems, [*KEYS], "left").join(chosen, ["mission_id", "subsystem"], "left")
    return joined.select(*KEYS, "subsystem", *(F.coalesce(f"__{c}", F.lit(v)).alias(c) for c, v in default.items()))


def score_with_parameters(errors: DataFrame, parameters: DataFrame) -> DataFrame:
    """Windows with residuals, scored with the parameters of their own channel (columns span, window, z and least_run of tuned_parameters), all channels in one job. How far blocks look back follows from the largest parameters, which are looked up first."""
    most = parameters.agg(*(F.coalesce(F.max(c), F.lit(1)).alias(c) for c in ("span", "window", "least_run"))).first()
    rows = errors.join(parameters.select(*KEYS, *DEFAULT), [*KEYS])
    smooth = smooth_errors(rows, F.col("span"), most_span=most["span"])
    return flag_anomalies(thresholds_by_row(smooth, KEYS, most_window=most["window"]), F.col("least_run"), most_run=most["least_run"])
