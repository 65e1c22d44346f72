"""Distribution drift against reference profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.features import WINDOWS, feature_frame, names
from ..functions.quantiles import quantiles
from ..functions.series import KEYS, TIE, TIME, series, so_far, whole
from ..sources.io import settled

FLOOR = 0.001


def newest_rows(df: DataFrame, rows: int, nominal_only: bool = False) -> DataFrame:
    """The last so many rows of each series, of the nominal ones if asked for."""
    kept = df.where(~F.col("is_anomaly")) if nominal_only else df
    newest = Window.partitionBy(*KEYS).orderBy(F.desc(TIME), F.desc(TIE))
    return kept.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= rows).drop("newest")


def profile(df: DataFrame, rows: int, nominal_only: bool, value: str = "value_normalized", windows=WINDOWS) -> DataFrame:
    """At most so many feature rows of each series: those with the smallest hashes of their time, the same in every run."""
    frame = feature_frame(newest_rows(df, rows + max(windows), nominal_only), value, windows)
    order = Window.partitionBy(*KEYS).orderBy(F.md5(F.unix_micros(TIME).cast("string")), TIE)
    return frame.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rows).drop("rank")


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.unpivot([*KEYS], columns, "feature", "x").where("x is not null")


def wasserstein(reference: DataFrame, current: DataFrame, keys=(*KEYS, "feature"), parts: int = 64) -> DataFrame:
    """(keys, score): the area between the two distribution functions over the reference's population deviation (at least 0.001); 0 if a side has no rows.

    Values are counted first, so equal ones are one row; no sample is collected. Each key's values are cut into up to so many ranges, which are tasks of their own: sums run within them, and each range gets those of the ones before it and the first value of the next.
    """
    counted = reference.select(*keys, "x", F.lit(1).alias("r"), F.lit(0).alias("c")).union(current.select(*keys, "x", F.lit(0), F.lit(1)))
    counted = settled(counted.groupBy(*keys, "x").agg(F.sum("r").alias("r"), F.sum("c").alias("c")), "values")
    placed = blocks.by_value(counted, "x", keys, parts)
    order = blocks.within(keys, "x")
    ends = placed.groupBy(*keys, blocks.BLOCK).agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.min("x").alias("x"))
    total, before = Window.partitionBy(*keys), blocks.earlier(keys)
    carried = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in ("r", "c")] + [F.sum(n).over(total).alias(f"all_{n}") for n in ("r", "c")]
    ends = ends.select(*keys, blocks.BLOCK, *carried, F.lead("x").over(blocks.sequence(keys)).alias("next_x"))
    share = lambda n: F.try_divide((F.sum(n).over(so_far(order)) + F.col(f"before_{n}")).cast("double"), F.col(f"all_{n}"))
    step = F.coalesce(F.lead("x").over(order), F.col("next_x")) - F.col("x")
    areas = placed.join(ends, [*keys, blocks.BLOCK]).select(*keys, (F.abs(share("r") - share("c")) * step).alias("area"), "r", "c")
    areas = areas.groupBy(*keys).agg(F.sum("area").alias("area"), F.sum("r").alias("r"), F.sum("c").alias("c"))
    spread = reference.groupBy(*keys).agg(F.stddev_pop("x").alias("spread"))
    joined = areas.join(spread, [*keys], "left")
    score = F.when((F.col("r") > 0) & (F.col("c") > 0), F.coalesce("area", F.lit(0.0)) / F.greatest(F.col("spread"), F.lit(FLOOR)))
    return joined.select(*keys, F.coalesce(score, F.lit(0.0)).alias("score"))


def drift_report(reference: DataFrame, current: DataFrame, threshold: float = 0.1, share: float = 0.3, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Features with scores and flags, and series with the number and share of drifted features and an alert."""
    columns = columns or ["value_normalized", *names()]
    scores = wasserstein(long_form(reference, columns), long_form(current, columns)).withColumn("drifted", F.col("score") >= threshold)
    return scores, drift_alerts(scores, share)


def drift_alerts(scores: DataFrame, share: float = 0.3, at_least: bool = False) -> DataFrame:
    """Batch reports alert above the share, live ones from it on."""
    found = scores.groupBy(*KEYS).agg(F.count_if("drifted").alias("n_drifted"), F.avg(F.col("drifted").cast("double")).alias("share"))
    return found.withColumn("alert", F.col("share") >= share if at_least else F.col("share") > share)


def mission_sweep(reference: DataFrame, current: DataFrame, threshold: float = 0.1, share: float = 0.3) -> DataFrame:
    """A row for each series of either profile; those that lack one are errors. drifted_total counts the alerts of the mission."""
    _, alerts = drift_report(reference, current, threshold, share)
    a = reference.select(*KEYS).distinct().withColumn("in_reference", F.lit(True))
    b = current.select(*KEYS).distinct().withColumn("in_current", F.lit(True))
    both = a.join(b, [*KEYS], "full_outer").join(alerts, [*KEYS], "left")
    ok = F.col("in_reference").isNotNull() & F.col("in_current").isNotNull()
    rows = both.select(*KEYS, F.when(ok, "ok").otherwise("error").alias("status"), *(F.when(ok, F.col(c)).alias(c) for c in ("n_drifted", "share", "alert")))
    return rows.withColumn("drifted_total", F.sum(F.coalesce(F.col("alert").cast("int"), F.lit(0))).over(whole(("mission_id",))))


def quality_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(keys, feature, n, missing, mean, std, least, q25, median, q75, most) of each column."""
    every = df.unpivot([*KEYS], columns, "feature", "x")
    keys, names = (*KEYS, "feature"), {"q25": 0.25, "median": 0.5, "q75": 0.75}
    found = every.groupBy(*keys).agg(F.count("x").alias("n"), F.count_if(F.col("x").isNull()).alias("missing"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most"))
    return found.join(quantiles(every, "x", names, keys), [*keys], "left").select(*keys, "n", "missing", "mean", "std", "least", *names, "most")


def rolling_features(df: DataFrame, value: str = "value_normalized", interval: float = 1.0) -> DataFrame:
    """(keys, position, value, change): the value and its change since the row before by the interval."""
    now = F.col(value).cast("double")
    return df.select(*KEYS, "position", now.alias("value"), ((now - F.lag(now).over(series(KEYS, "position"))) / interval).alias("change"))


def rolling_drift(df: DataFrame, reference: DataFrame, size: int = 256, every: int = 10, value: str = "value_normalized", interval: float = 1.0) -> DataFrame:
    """(keys, position, feature, score): drift of the last `size` rows against the reference, every so many rows once there are enough. Features are the value and its change by the interval; the first row of a window has no change, and a feature that lacks values on a side scores 0.

    reference: keys, feature, x. It is counted once for each (keys, feature); each row then looks up how much of it lies at or below its own value. The area between two distribution functions is also that between their inverses, so an evaluation with n values needs these lookups and the integral of the reference's inverse at the n levels only.
    """
    keys, order, rows = (*KEYS, "feature"), series(KEYS, "position"), 10 * size
    base = rolling_features(df, value, interval)
    base = base.select("*", *(F.count(c).over(so_far(order)).alias(f"so_far_{c}") for c in ("value", "change")))
    held = {"value": F.col("so_far_value") - F.coalesce(F.lag("so_far_value", size).over(order), F.lit(0)), "change": F.col("so_far_change") - F.lag("so_far_change", size - 1).over(order)}
    evaluated = (F.col("position") >= size - 1) & (F.pmod(F.col("position") - (size - 1), F.lit(every)) == 0)
    base = base.select("*", *(F.when(evaluated, n).alias(f"n_{c}") for c, n in held.items()))
    long = base.select(*KEYS, "position", F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x"), F.col(f"n_{c}").alias("n")) for c in held))))
    long = long.where("x is not null or n is not null")

    counted = reference.where("x is not null").groupBy(*keys, "x").agg(F.count("*").alias("r"))
    # Of equal values the reference's comes first, so that running sums hold all of it.
    both = long.select(*keys, "position", "x", "n", F.lit(0).cast("bigint").alias("r")).unionByName(counted, allowMissingColumns=True)
    running = so_far(series(keys, "x", F.desc("r")))
    sums = [F.sum("r").over(running).alias("below"), F.sum(F.col("r") * F.col("x")).over(running).alias("area")]
    located = both.select(*keys, "position", "x", "n", "r", *sums).where("r = 0").drop("r")

    wanted = long.where("n > 0").select(*keys, "n", F.floor(F.col("position") / rows).alias("block")).distinct()
    totals = reference.where("x is not null").groupBy(*keys).agg(F.count("*").alias("total"), F.stddev_pop("x").alias("spread"))
    steps = counted.select(*keys, "x", "r", *sums).join(wanted.select(*keys, "n").distinct(), [*keys]).join(totals, [*keys])
    # Level i / n lies on the step that takes the count above i * total / n.
    steps = steps.withColumn("first", F.expr("(below - r) * n div total + 1")).withColumn("last", F.expr("below * n div total")).where("first <= last")
    steps = steps.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("level", F.expr("(area - r * x + (i * total / n - (below - r)) * x) / total"))
    curves = steps.groupBy(*keys, "n", "total", "spread").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "level"))), lambda s: s["level"]).alias("curve"))

    block = F.explode(F.sequence(F.floor(F.col("position") / rows), F.floor((F.col("position") + size - 1) / rows))).alias("block")
    parts = located.select("*", block).unionByName(wanted.join(curves, [*keys, "n"]), allowMissingColumns=True)
    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in KEYS)
    return parts.groupBy(*keys, "block").applyInArrow(_rolling_scores(size, rows), f"{kinds}, position bigint, feature string, score double")


def areas(x: np.ndarray, below: np.ndarray, sums: np.ndarray, total: float, curve: np.ndarray) -> np.ndarray:
    """The area between a window's inverse distribution and the reference's on each of its n levels. x: the n values in order, with how much of the reference lies at or below each, and the sum of that; curve: the integral of the reference's inverse at the n + 1 levels."""
    n = x.shape[-1]
    a, b = np.arange(n) / n, np.arange(1, n + 1) / n
    share = below / total
    until = np.where(share <= a, curve[:-1], np.where(share >= b, curve[1:], sums / total))
    return x * (2 * np.clip(share, a, b) - a - b) + curve[:-1] + curve[1:] - 2 * until


def _rolling_scores(size: int, rows: int):
    """The scores of one block of a series' feature from its located rows and its reference curves (rows without a position)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        feature, block = key[-2].as_py(), key[-1].as_py()
        width, low = size - (feature == "change"), max(0, block * rows - size + 1)
        curves = {r["n"]: r for r in table.filter(pc.is_null(table["position"])).select(["n", "curve", "total", "spread"]).to_pylist()}
        table = table.filter(pc.is_valid(table["position"]))
        position = table["position"].to_numpy()
        dense = np.full((3, (block + 1) * rows - low), np.nan)
        dense[:, position - low] = [table[c].cast(pa.float64()).fill_null(np.nan).to_numpy() for c in ("x", "below", "area")]
        n = table["n"].fill_null(-1).to_numpy()
        own = (n >= 0) & (position >= block * rows)
        at, n = position[own], n[own]
        scores = np.zeros(len(at))
        for k in set(n.tolist()) & set(curves):
            these = n == k
            x, below, area = dense[:, (at[these] - low - width + 1)[:, None] + np.arange(width)]
            order = np.argsort(x, axis=1)[:, :k]  # nan is last
            x, below, area = (np.take_along_axis(v, order, 1) for v in (x, below, area))
            made = areas(x, below, area, curves[k]["total"], np.array([0.0, *curves[k]["curve"]]))
            scores[these] = made.sum(axis=1) / max(curves[k]["spread"], FLOOR)
        columns = [pa.array([k.as_py()] * len(at), k.type) for k in key[:-2]]
        return pa.table([*columns, pa.array(at, pa.int64()), pa.array([feature] * len(at), pa.string()), pa.array(scores)], [*KEYS, "position", "feature", "score"])

    return run


def rolling_snapshots(scores: DataFrame, threshold: float = 0.1, share: float = 0.3) -> DataFrame:
    """(keys, position, features, share, alert): the features of each evaluation with scores and flags, and a live alert from a share of drifted ones on."""
    flagged = scores.withColumn("drifted", F.col("score") >= threshold)
    found = flagged.groupBy(*KEYS, "position").agg(F.sort_array(F.collect_list(F.struct("feature", "score", "drifted"))).alias("features"), F.avg(F.col("drifted").cast("double")).alias("share"))
    return found.withColumn("alert", F.col("share") >= share)


def confirm(alerts: DataFrame, consecutive: int, alert: str = "alert", order: str = "position") -> DataFrame:
    """confirmed: the last so many evaluations all alerted."""
    window = series(KEYS, order)
    run = F.min(F.col(alert).cast("int")).over(window.rowsBetween(-(consecutive - 1), 0)) == 1
    return alerts.withColumn("confirmed", run & (F.row_number().over(window) >= consecutive))


def subsystem_alerts(snapshots: DataFrame, subsystems: DataFrame, share: float = 0.3, order: str = "position") -> DataFrame:
    """(mission_id, subsystem, share, alert) from the newest snapshot of each channel."""
    newest = snapshots.groupBy(*KEYS).agg(F.max_by("confirmed", order).alias("drifted"))
    found = newest.join(subsystems, [*KEYS]).groupBy("mission_id", "subsystem").agg(F.avg(F.col("drifted").cast("double")).alias("share"))
    return found.withColumn("alert", F.col("share") >= share)


def shown_features(snapshots: DataFrame) -> DataFrame:
    """features (array of structs with drifted), each shown as drifted only where its channel is confirmed so."""
    return snapshots.withColumn("features", F.transform("features", lambda f: f.withField("drifted", f["drifted"] & F.col("confirmed"))))


def drifted_since(snapshots: DataFrame, order: str = "position") -> DataFrame:
    """(keys, drifted, since): the newest state, and the first place of the streak that it ends; null where it is not drifted."""
    last_calm = F.max(F.when(~F.col("confirmed"), F.col(order))).over(whole())
    marked = snapshots.withColumn("calm", F.coalesce(last_calm, F.lit(-1)))
    return marked.groupBy(*KEYS).agg(F.max_by("confirmed", order).alias("drifted"), F.min(F.when(F.col(order) > F.col("calm"), F.col(order))).alias("since"))
