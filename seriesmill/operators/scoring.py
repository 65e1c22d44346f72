"""Windows, forecasts, smoothed errors, thresholds, flags, pruning and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.series import KEYS, f_score, ratio, series, so_far, whole
from .runs import find_runs, mark_runs, with_position

BLOCK = 256


def valid_windows(df: DataFrame, inputs: int, horizon: int = 1, skip_anomalous: bool = False, value: str = "value_normalized", pairs: bool = False, rows: int = blocks.ROWS) -> DataFrame:
    """The target rows of windows of so many inputs and a horizon that lie within one segment, with the value before the horizon (`previous`), the label of the span (`window_label`) and their number in the series (`position`).

    The rows' own positions are made if they are not there. Blocks of so many rows are tasks of their own. With `pairs`, the inputs (x) and the target (y) are there too.
    """
    span = inputs + horizon
    placed = df if "position" in df.columns else with_position(df)
    window = blocks.within(KEYS, "position")
    now = F.col(value).cast("double")
    made = {
        "__segment": F.lag("segment_id", span - 1).over(window),
        "window_label": F.coalesce(F.max(F.col("is_anomaly").cast("int")).over(window.rowsBetween(-(span - 1), 0)) == 1, F.lit(False)),
        "previous": F.lag(now, horizon).over(window),
    }
    if pairs:
        made |= {"x": F.collect_list(now).over(window.rowsBetween(-(span - 1), -horizon)), "y": now}
    marked = blocks.by_position(placed, span - 1, rows=rows).withColumns(made).where(F.col(blocks.OWN) & (F.col("__segment") == F.col("segment_id")))
    if skip_anomalous:
        marked = marked.where(~F.col("window_label"))
    kept = marked.withColumnRenamed("position", "__at").drop(blocks.OWN, "__segment")
    return blocks.running(kept, F.lit(1), "position", KEYS, "__at").withColumn("position", F.col("position") - 1).drop("__at", blocks.BLOCK)


def window_pairs(df: DataFrame, inputs: int, horizon: int = 1, value: str = "value_normalized") -> DataFrame:
    """valid_windows with the array of inputs (x) and the target (y), for models that need them."""
    return valid_windows(df, inputs, horizon, value=value, pairs=True)


def validation_split(windows: DataFrame, fraction: float = 0.1) -> DataFrame:
    """part: the last tenth of a series' windows (one at least) is validation, the rest training; series with fewer than two windows are left out."""
    n = F.count("*").over(whole())
    held = F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    return windows.withColumn("n", n).where("n >= 2").withColumn("part", F.when(F.col("position") >= F.col("n") - held, "validation").otherwise("train")).drop("n")


def fit_ar1(windows: DataFrame, value: str = "value_normalized") -> DataFrame:
    """(keys, slope, intercept) of the target on the value before it."""
    y = F.col(value).cast("double")
    fitted = windows.groupBy(*KEYS).agg(F.regr_slope(y, F.col("previous")).alias("slope"), F.regr_intercept(y, F.col("previous")).alias("intercept"), F.avg(y).alias("m"))
    return fitted.select(*KEYS, F.coalesce("slope", F.lit(0.0)).alias("slope"), F.coalesce("intercept", "m").alias("intercept"))


def fit_ar(windows: DataFrame, order: int, ridge: float = 1e-3) -> DataFrame:
    """(keys, coefficients, intercept) of a ridge regression of y on the last `order` inputs of x: one row of sums for each series, and one small system to solve from it."""
    import numpy as np

    names = [f"x{k}" for k in range(order)]
    rows = windows.select(*KEYS, "y", *(F.element_at("x", -(k + 1)).alias(f"x{k}") for k in range(order)))
    terms = ["1.0", *names, "y"]
    sums = rows.groupBy(*KEYS).agg(F.array(*[F.sum(F.expr(f"{a} * {b}")) for i, a in enumerate(terms) for b in terms[i:]]).alias("sums"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = order + 2
        for batch in batches:
            out = []
            for sums in batch["sums"]:
                m = np.zeros((size, size))
                m[np.triu_indices(size)] = sums
                m = m + m.T - np.diag(np.diag(m))
                penalty = np.diag([0.0] + [ridge * m[0, 0]] * order)
                out.append(np.linalg.lstsq(m[:-1, :-1] + penalty, m[:-1, -1], rcond=None)[0])
            yield batch[[*KEYS]].assign(coefficients=[list(map(float, w[1:])) for w in out], intercept=[float(w[0]) for w in out])

    schema = ", ".join(f"{k} string" for k in KEYS)
    return sums.mapInPandas(solve, f"{schema}, coefficients array<double>, intercept double")


def predict_ar(windows: DataFrame, model: DataFrame) -> DataFrame:
    """prediction of fit_ar's model for windows with arrays x; windows without a model are left out."""
    last = F.slice(F.reverse("x"), 1, F.size("coefficients"))
    terms = F.aggregate(F.zip_with(last, F.col("coefficients"), lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)
    return windows.join(model, [*KEYS]).withColumn("prediction", terms + F.col("intercept")).drop("coefficients", "intercept")


def predict_ar1(windows: DataFrame, model: DataFrame) -> DataFrame:
    return windows.join(model, [*KEYS]).withColumn("prediction", F.col("slope") * F.col("previous") + F.col("intercept")).drop("slope", "intercept")


def predict_persistence(windows: DataFrame) -> DataFrame:
    return windows.withColumn("prediction", F.col("previous"))


def predict_with(windows: DataFrame, predictor, value: str = "prediction") -> DataFrame:
    """predictions of any Python function from a pandas frame of windows to a series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{value: predictor(batch)})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema)
    return windows.mapInPandas(run, f"{schema}, {value} double")


def select_model(windows: DataFrame, models: dict[str, DataFrame]) -> DataFrame:
    """(keys, model, train_mse, validation_mse): the candidate with the least validation loss of each series; windows need `part`, models are frames with a prediction for them."""
    losses = None
    for name, predicted in models.items():
        square = F.pow(F.col("prediction") - F.col("value_normalized").cast("double"), F.lit(2))
        loss = predicted.groupBy(*KEYS).agg(F.avg(F.when(F.col("part") == "train", square)).alias("train_mse"), F.avg(F.when(F.col("part") == "validation", square)).alias("validation_mse")).withColumn("model", F.lit(name))
        losses = loss if losses is None else losses.unionByName(loss)
    best = losses.groupBy(*KEYS).agg(F.min_by(F.struct("model", "train_mse", "validation_mse"), F.struct("validation_mse", "model")).alias("b"))
    return best.select(*KEYS, "b.*")


def ar_losses(windows: DataFrame, orders: tuple[int, ...] = (1, 2, 3, 5), ridges: tuple[float, ...] = (1e-3, 0.1, 10.0)) -> DataFrame:
    """(keys, order, ridge, train_mse, validation_mse) of every candidate, a ridge regression of y on the last inputs of x fitted to the part `train`; windows need `part`.

    One pass makes the sums of products of all lags for each part. A candidate's weights come from the sums of training, and its loss on either part is the quadratic form of its weights and that part's sums, so no candidate looks at the windows again.
    """
    import numpy as np

    most = max(orders)
    rows = windows.select(*KEYS, "part", "y", *(F.element_at("x", -(k + 1)).alias(f"x{k}") for k in range(most)))
    terms = ["1.0", *(f"x{k}" for k in range(most)), "y"]
    products = F.array(*[F.sum(F.expr(f"{a} * {b}")) for i, a in enumerate(terms) for b in terms[i:]])
    sums = rows.groupBy(*KEYS, "part").agg(products.alias("sums")).groupBy(*KEYS).agg(*(F.max(F.when(F.col("part") == part, F.col("sums"))).alias(part) for part in ("train", "validation")))

    def whole(listed) -> np.ndarray:
        m = np.zeros((most + 2, most + 2))
        m[np.triu_indices(most + 2)] = listed
        return m + m.T - np.diag(np.diag(m))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                parts = [None if x is None else whole(x) for x in (row.train, row.validation)]
                for order in orders if parts[0] is not None else ():
                    at = [*range(order + 1), most + 1]
                    train = parts[0][np.ix_(at, at)]
                    for ridge in ridges:
                        penalty = np.diag([0.0] + [ridge * train[0, 0]] * order)
                        w = np.append(np.linalg.lstsq(train[:-1, :-1] + penalty, train[:-1, -1], rcond=None)[0], -1.0)
                        losses = [None if m is None else max(0.0, float(w @ m[np.ix_(at, at)] @ w) / m[0, 0]) for m in parts]
                        out.append((*(getattr(row, k) for k in KEYS), order, ridge, *losses))
            yield pd.DataFrame(out, columns=[*KEYS, "order", "ridge", "train_mse", "validation_mse"])

    return sums.mapInPandas(judge, "mission_id string, channel_id string, order int, ridge double, train_mse double, validation_mse double")


def best_ar(losses: DataFrame) -> DataFrame:
    """(keys, order, ridge, train_mse, validation_mse): the candidate with the least validation loss of each series, of equal ones the simplest."""
    best = losses.groupBy(*KEYS).agg(F.min_by(F.struct("order", "ridge", "train_mse", "validation_mse"), F.struct("validation_mse", "order", -F.col("ridge"))).alias("b"))
    return best.select(*KEYS, "b.*")


def residuals(predicted: DataFrame, value: str = "value_normalized") -> DataFrame:
    return predicted.withColumn("residual", F.col("prediction") - F.col(value).cast("double"))


def smooth_errors(df: DataFrame, span: int | Column, error: str = "residual", keys=KEYS, most_span: int = 800) -> DataFrame:
    """smoothed: the exponentially weighted mean of absolute errors in order of position, starting with the first.

    With q = 1 - 2 / (span + 1), each block of rows is summed by itself, weighted by powers of q; only one number of each block is carried to those after it. So blocks are partitions of their own, and a long series is many tasks. The span may be a column, of values up to most_span; larger ones are an error.
    """
    if isinstance(span, int):
        span, most_span = F.lit(span), span
    else:
        span = F.when(span <= most_span, span).otherwise(F.raise_error(F.lit(f"a span above most_span, {most_span}")))
    q = F.lit(1.0) - F.lit(2.0) / (span + 1)
    x = F.abs(F.col(error)).cast("double")
    base = df.withColumn("__q", q).withColumn("__x", F.when(F.col("position") == 0, x).otherwise(x * (F.lit(1.0) - F.col("__q"))))
    base = base.withColumn("__block", F.floor(F.col("position") / BLOCK)).withColumn("__k", (F.col("position") % BLOCK).cast("double"))
    inside = so_far(Window.partitionBy(*keys, "__block").orderBy("position"))
    local = F.sum(F.col("__x") * F.pow("__q", -F.col("__k"))).over(inside) * F.pow("__q", F.col("__k"))
    base = base.withColumn("__local", F.when(F.col("__q") > 0, local).otherwise(F.col("__x")))
    blocks = base.groupBy(*keys, "__block").agg(F.max_by("__local", "__k").alias("tail"), F.max("__k").alias("k"), F.first("__q").alias("q"))
    # What lies so many blocks back weighs less than 1e-17.
    back = max(1, -int(-40 * (most_span + 1) // (2 * BLOCK)))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(-back, -1)
    listed = F.collect_list(F.struct("tail", "k", "q")).over(before)
    carry = F.aggregate(listed, F.lit(0.0), lambda c, b: c * F.pow(b["q"], b["k"] + 1) + b["tail"])
    blocks = blocks.select(*keys, "__block", carry.alias("__carry"))
    joined = base.join(blocks, [*keys, "__block"])
    return joined.withColumn("smoothed", F.col("__local") + F.when(F.col("__q") > 0, F.col("__carry") * F.pow("__q", F.col("__k") + 1)).otherwise(0.0)).drop("__q", "__x", "__block", "__k", "__local", "__carry")


def dynamic_threshold(df: DataFrame, window: int, z: float | Column, mode: str = "batch", keys=KEYS, rows: int = blocks.ROWS) -> DataFrame:
    """threshold: mean and z population deviations of the previous smoothed errors; in strict mode only where there are as many as the window holds. Positions count from 0 without gaps; blocks of so many are tasks of their own."""
    frame = blocks.within(keys, "position").rowsBetween(-window, -1)
    made = F.avg("smoothed").over(frame) + (F.lit(z) if isinstance(z, float | int) else z) * F.stddev_pop("smoothed").over(frame)
    if mode == "strict":
        made = F.when(F.col("position") >= window, made)
    return blocks.by_position(df, window, rows=rows).withColumn("threshold", made).where(blocks.OWN).drop(blocks.BLOCK, blocks.OWN)


def flag_anomalies(df: DataFrame, least_run: int | Column, keys=KEYS, most_run: int = 64, rows: int = blocks.ROWS) -> DataFrame:
    """above (the error exceeds its threshold) and predicted (in a run of at least so many of these).

    A row only has to see so far back and ahead as the least run is long, so blocks of so many rows are tasks of their own. The least run may be a column, of values up to most_run; larger ones are an error.
    """
    if isinstance(least_run, int):
        least, most_run = F.lit(least_run), max(1, least_run)
    else:
        least = F.when(least_run <= most_run, least_run).otherwise(F.raise_error(F.lit(f"a least run above most_run, {most_run}")))
    above = df.withColumn("above", F.coalesce(F.col("smoothed") > F.col("threshold"), F.lit(False)))
    forward, backward = so_far(blocks.within(keys, "position")), so_far(blocks.within(keys, F.desc("position")))
    at, below = F.col("position"), F.when(~F.col("above"), F.col("position"))
    start = F.coalesce(F.max(below).over(forward), F.min(at).over(forward) - 1)
    end = F.coalesce(F.min(below).over(backward), F.max(at).over(backward) + 1)
    marked = blocks.by_position(above, most_run - 1, most_run - 1, rows).withColumns({"__start": start, "__end": end}).where(blocks.OWN)
    return marked.withColumn("predicted", F.col("above") & (F.col("__end") - F.col("__start") - 1 >= least)).drop("__start", "__end", blocks.BLOCK, blocks.OWN)


def trailing_flag(df: DataFrame, least_run: int, keys=KEYS) -> DataFrame:
    """predicted as a live scorer has it: true from the so-manieth row above on."""
    order = series(keys, "position")
    full = (F.min(F.col("above").cast("int")).over(order.rowsBetween(-(least_run - 1), 0)) == 1) & (F.row_number().over(order) >= least_run)
    return df.withColumn("predicted", full)


def prune(df: DataFrame, least_drop: float, keys=KEYS) -> DataFrame:
    """pruned: predicted without the runs after the last clear drop.

    Runs are ranked by their largest error, and the largest error outside of runs comes last; a run stays if it stands before, or at, the last rank from which the error falls by the given share to the next.
    """
    marked = mark_runs(df, "predicted", "run", keys, "position")
    peaks = marked.where("predicted").groupBy(*keys, "run").agg(F.max("smoothed").alias("peak"), F.min("position").alias("start"))
    base = marked.groupBy(*keys).agg(F.coalesce(F.max(F.when(~F.col("predicted"), F.col("smoothed"))), F.lit(0.0)).alias("base"))
    order = Window.partitionBy(*keys).orderBy(F.desc("peak"), "start")
    ranked = peaks.join(base, [*keys]).withColumn("rank", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("peak").over(order), F.col("base")))
    drop = F.try_divide(F.col("peak") - F.col("next"), F.col("peak")) >= least_drop
    kept = ranked.withColumn("last", F.coalesce(F.max(F.when(drop, F.col("rank"))).over(whole(keys)), F.lit(0)))
    gone = kept.where((F.col("rank") > F.col("last")) & (F.col("peak") > 0) & F.lit(least_drop > 0)).select(*keys, "run", F.lit(True).alias("predicted"), F.lit(True).alias("gone"))
    return marked.join(gone, [*keys, "run", "predicted"], "left").withColumn("pruned", F.col("predicted") & F.col("gone").isNull()).drop("run", "gone")


def point_metrics(df: DataFrame, truth: str = "window_label", predicted: str = "predicted", keys=KEYS) -> DataFrame:
    t, p = F.col(truth), F.col(predicted)
    counts = df.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t).alias("n_true"), F.count_if(p).alias("n_predicted"), F.count("*").alias("n"))
    return point_scores(counts)


def point_scores(counts: DataFrame) -> DataFrame:
    scored = counts.withColumn("precision", ratio(F.col("tp"), F.col("n_predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("n_true")))
    return scored.withColumn("f1", f_score(F.col("precision"), F.col("recall"), 1.0)).withColumn("f05", f_score(F.col("precision"), F.col("recall"), 0.5))


def segment_metrics(df: DataFrame, truth: str = "window_label", predicted: str = "predicted", keys=KEYS) -> DataFrame:
    """Shares of true runs that any predicted run overlaps, and the converse. Two runs overlap where a row has both flags, so each run only has to know whether one of its rows has the other."""
    flags = df.select(*keys, "position", F.coalesce(truth, F.lit(False)).alias("t"), F.coalesce(predicted, F.lit(False)).alias("p"))
    marked = mark_runs(flags, {"t": "t_run", "p": "p_run"}, None, keys, "position")
    true_row = F.when(F.col("t"), F.struct(F.lit(True).alias("true_run"), F.col("t_run").alias("run"), F.col("p").alias("hit")))
    predicted_row = F.when(F.col("p"), F.struct(F.lit(False).alias("true_run"), F.col("p_run").alias("run"), F.col("t").alias("hit")))
    rows = marked.select(*keys, F.explode_outer(F.array_compact(F.array(true_row, predicted_row))).alias("r")).select(*keys, "r.*")
    met = rows.groupBy(*keys, "true_run", "run").agg(F.bool_or("hit").alias("hit"))
    is_true, hit = F.col("true_run"), F.col("hit")
    both = met.groupBy(*keys).agg(F.count_if(is_true).alias("seg_true"), F.count_if(is_true & hit).alias("hit_true"), F.count_if(~is_true).alias("seg_predicted"), F.count_if(~is_true & hit).alias("hit_predicted"))
    return segment_scores(both)


def segment_scores(both: DataFrame) -> DataFrame:
    scored = both.withColumn("seg_recall", ratio(F.col("hit_true"), F.col("seg_true"))).withColumn("seg_precision", ratio(F.col("hit_predicted"), F.col("seg_predicted")))
    return scored.withColumn("seg_f1", f_score(F.col("seg_precision"), F.col("seg_recall"), 1.0)).withColumn("seg_f05", f_score(F.col("seg_precision"), F.col("seg_recall"), 0.5))


def evaluation_slice(df: DataFrame, part: str = "full", fraction: float = 0.6, keys=KEYS) -> DataFrame:
    """All windows, the first share of them, or the rest; positions start anew."""
    if part == "full":
        return df
    cut = F.floor(F.count("*").over(whole(keys)) * F.lit(fraction))
    kept = df.withColumn("__cut", cut).where(F.col("position") < F.col("__cut") if part == "first" else F.col("position") >= F.col("__cut"))
    return kept.withColumn("position", F.row_number().over(series(keys, "position")).cast("bigint") - 1).drop("__cut")


def score(predicted: DataFrame, span: int, window: int, z: float, least_run: int, mode: str = "batch") -> DataFrame:
    """Residuals, smoothed errors, thresholds and flags of windows with predictions."""
    return flag_anomalies(dynamic_threshold(smooth_errors(residuals(predicted), span), window, z, mode), least_run)


def channel_report(scored: DataFrame, least_drop: float = 0.13, part: str = "full") -> DataFrame:
    """Point and segment metrics of each series, and what pruning would leave."""
    kept = evaluation_slice(prune(scored, least_drop), part)
    plain = point_metrics(kept).join(segment_metrics(kept), [*KEYS])
    pruned = point_metrics(kept, predicted="pruned").select(*KEYS, F.col("precision").alias("pruned_precision"), F.col("recall").alias("pruned_recall"))
    segments = segment_metrics(kept, predicted="pruned").select(*KEYS, F.col("seg_f05").alias("pruned_seg_f05"), F.col("seg_precision").alias("pruned_seg_precision"))
    return plain.join(pruned, [*KEYS]).join(segments, [*KEYS])


def channel_status(channels: DataFrame, models: DataFrame, reports: DataFrame) -> DataFrame:
    """Each channel with ok, skipped (no model) or error (a model, no report)."""
    m, r = models.select(*KEYS, F.lit(True).alias("has_model")).distinct(), reports.withColumn("has_report", F.lit(True))
    joined = channels.select(*KEYS).distinct().join(m, [*KEYS], "left").join(r, [*KEYS], "left")
    status = F.when(F.col("has_model").isNull(), "skipped").when(F.col("has_report").isNull(), "error").otherwise("ok")
    return joined.withColumn("status", status).drop("has_model", "has_report")
