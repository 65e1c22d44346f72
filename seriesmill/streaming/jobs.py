"""Structured Streaming forms of resampling, scoring, drift and staleness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.series import KEYS, TIME, sent_if_small
from ..operators.prepare import apply_params
from ..operators.resample import floor_to_grid
from .online import OnlineScorer, Reference

GRID = "mission_id string, channel_id string, bucket_us bigint, value float"
SCORING = "v array<double>, smoothed double, ring array<double>, flags int, last bigint, past array<double>"
SNAPSHOT = "mission_id string, channel_id string, bucket_us bigint, features array<struct<feature:string,score:double,drifted:boolean>>, share double, alert boolean, confirmed boolean"
SCORED = "mission_id string, channel_id string, bucket_us bigint, value double, prediction double, smoothed double, threshold double, predicted boolean"


def _with_state(stream: DataFrame, processor: StatefulProcessor, schema: str, keys=KEYS, clock: str = "None", state: DataFrame | None = None) -> DataFrame:
    """The stream handled by key with state, which starts from a table if there is one. Such state is kept by RocksDB, on disk and not in the heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    start = None if state is None else state.groupBy(*keys)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", clock, start)


def parse_updates(updates: DataFrame) -> DataFrame:
    """Ticks of raw updates (mission_id, channel_id, received, value and aos as text): those without a readable value go, an unreadable second stamp is null."""
    value = F.expr("try_cast(value AS float)")
    return updates.select("mission_id", "channel_id", F.col("received").cast("timestamp").alias(TIME), value.alias("value"), F.expr("try_cast(aos AS double)").alias("aos_timestamp")).where("value is not null")


def archive(ticks: DataFrame, path: str, checkpoint: str, **trigger):
    """Append ticks as files by channel; what a failed flush did not write is written again from the checkpoint."""
    return ticks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("channel_id").trigger(**(trigger or {"availableNow": True})).start()


def bucket_means(ticks: DataFrame, seconds: int, delay: str) -> DataFrame:
    """(keys, bucket_us, value) of closed buckets; ticks later than the delay are dropped, and counted by Spark."""
    grouped = ticks.withWatermark(TIME, delay).groupBy(*KEYS, F.window(TIME, f"{seconds} seconds"))
    return grouped.agg(F.avg(F.col("value").cast("double")).alias("value")).select(*KEYS, F.unix_micros("window.start").alias("bucket_us"), F.col("value").cast("float").alias("value"))


def flush_open(ticks: DataFrame, means: DataFrame, seconds: int) -> DataFrame:
    """(keys, bucket_us, value) of the buckets that a finished stream has left open, from its ticks and the means that it has put out: those after the last one of each series."""
    closed = means.groupBy(*KEYS).agg(F.max("bucket_us").alias("closed_us"))
    bucketed = ticks.withColumn("bucket_us", floor_to_grid(F.unix_micros(TIME), seconds)).join(closed, [*KEYS], "left")
    left = bucketed.where(F.col("closed_us").isNull() | (F.col("bucket_us") > F.col("closed_us")))
    return left.groupBy(*KEYS, "bucket_us").agg(F.avg(F.col("value").cast("double")).cast("float").alias("value"))


def normalized_ticks(ticks: DataFrame, params: DataFrame, value: str = "value") -> DataFrame:
    """The raw stream beside the scored one: each tick normalised at once by its series' stored parameters, without waiting for its bucket. Ticks of series without parameters go."""
    return apply_params(ticks, params, value)


def fill_grid(means: DataFrame, seconds: int, stale_s: float | None = None) -> DataFrame:
    """Closed buckets with the empty ones between two of them filled from the one before. A stretch longer than stale_s is an outage and is not filled."""
    grid = seconds * 1_000_000

    def fill(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("bucket_us")
        last = state.get if state.exists else None
        out = []
        for at, value in zip(rows["bucket_us"].tolist(), rows["value"].tolist(), strict=True):
            if last is not None and at <= last[0]:
                continue
            if last is not None and not (stale_s and at - last[0] > stale_s * 1e6):
                out += [(*key, t, last[1]) for t in range(last[0] + grid, at, grid)]
            out.append((*key, at, value))
            last = (at, value)
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[*KEYS, "bucket_us", "value"])

    return means.groupBy(*KEYS).applyInPandasWithState(fill, GRID, "bucket_us bigint, value float", "append", GroupStateTimeout.NoTimeout)


class _Scoring(StatefulProcessor):
    """A series' scorer, its last time and its last values as one value state."""

    def __init__(self, parameters: tuple, stale_s: float | None, recent: int):
        self.parameters, self.stale_s, self.recent = parameters, stale_s, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", SCORING)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.held.update(([*row.v], None if pd.isna(row.smoothed) else float(row.smoothed), [*row.ring], int(row.flags), None if pd.isna(row.last) else int(row.last), [*row.past][-self.recent :] if self.recent else []))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *kept, last, past = self.held.get() if self.held.exists() else ([], None, [], 0, None, [])
        scorer, frame = OnlineScorer(*self.parameters, tuple(kept)), pd.concat(list(rows)).sort_values("bucket_us")
        at, values, made = frame["bucket_us"].to_numpy(), frame["value"].to_numpy(float), []
        before = np.concatenate(([at[0] if last is None else last], at[:-1]))
        breaks = np.flatnonzero(at - before > self.stale_s * 1e6).tolist() if self.stale_s else []
        past = np.array(past, float)
        for a, b in zip([0, *breaks], [*breaks, len(at)], strict=True):
            if a in breaks:
                scorer.prime(past[-self.recent :] if self.recent else [])
            made.append(scorer.run(values[a:b]))
            past = np.concatenate((past, values[a:b]))[-self.recent :] if self.recent else past[:0]
        self.held.update((*scorer.state(), int(at[-1]), past.tolist() if self.stale_s else []))
        columns = [np.concatenate(x) for x in zip(*made, strict=True)]
        frame = frame[[*KEYS, "bucket_us", "value"]].astype({"value": float})
        yield frame.assign(**dict(zip(("prediction", "smoothed", "threshold", "predicted"), columns, strict=True)))


def score_grid(grid: DataFrame, inputs: int, span: int, window: int, z: float, least_run: int, state: DataFrame | None = None, stale_s: float | None = None, recent: int | None = None) -> DataFrame:
    """Scores of a grid stream by a persistence forecast, a micro-batch's rows of a series all at once. state: a table of `scoring_state` or `primed_state`, the series' state at the start; it is read where the series is, never by the driver.

    With stale_s, a step of more than that between two buckets of a series is an outage: after it the series' state starts anew, primed with its last `recent` values from before (as many as inputs and threshold hold), so that neither smoothed errors nor flags go on across it.
    """
    recent = inputs + window if recent is None else recent
    return _with_state(grid, _Scoring((inputs, span, window, z, least_run), stale_s, recent), SCORED, state=state)


def _newest(df: DataFrame, order: str, rows: int, *columns: str) -> DataFrame:
    """(keys, r): the last so many rows of each series in order, as one array."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc(order))
    kept = df.select(*KEYS, order, *columns).withColumn("__newest", F.row_number().over(newest)).where(F.col("__newest") <= rows)
    return kept.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("r"))


def scoring_state(series: DataFrame, scored: DataFrame, inputs: int, window: int, least_run: int, recent: int | None = None, value: str = "value_normalized", order: str = "bucket_us") -> DataFrame:
    """The state with which a stream goes on exactly where a batch ends: a row for each series, made from its last rows and its last windows scored in strict mode (columns smoothed and above)."""
    recent = inputs + window if recent is None else recent
    values = _newest(series, order, max(inputs, recent, 1), value).select(*KEYS, F.element_at("r", -1)[order].alias("last"), F.transform("r", lambda x: x[value].cast("double")).alias("past"))
    ends = _newest(scored, "position", max(window, least_run), "smoothed", "above")
    flags = F.aggregate("r", F.lit(0), lambda n, x: F.when(x["above"], n + 1).otherwise(F.lit(0)))
    ends = ends.select(*KEYS, F.element_at("r", -1)["smoothed"].alias("smoothed"), F.transform(F.slice("r", -F.least(F.size("r"), F.lit(window)), F.lit(window)), lambda x: x["smoothed"]).alias("ring"), flags.alias("flags"))
    tail = lambda n: F.slice("past", -F.least(F.size("past"), F.lit(n)), F.lit(n)) if n else F.array().cast("array<double>")
    joined = values.join(ends, [*KEYS], "left")
    return joined.select(*KEYS, tail(inputs).alias("v"), "smoothed", F.coalesce("ring", F.array().cast("array<double>")).alias("ring"), F.coalesce("flags", F.lit(0)).alias("flags"), F.col("last").cast("bigint").alias("last"), tail(recent).alias("past"))


def primed_state(history: DataFrame, inputs: int, span: int, window: int, z: float, least_run: int, recent: int | None = None, rows: int = 2000) -> DataFrame:
    """The state of series primed with their last so many rows of a history (keys, bucket_us, value)."""
    recent = inputs + window if recent is None else recent
    listed = _newest(history, "bucket_us", rows, "value").select(*KEYS, F.element_at("r", -1)["bucket_us"].alias("last"), F.transform("r", lambda x: x["value"].cast("double")).alias("past"))

    def prime(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for past in batch["past"]:
                scorer = OnlineScorer(inputs, span, window, z, least_run)
                scorer.prime(past)
                out.append((*scorer.state(), [*past][-recent:] if recent else []))
            yield batch[[*KEYS]].assign(**{c: [x[k] for x in out] for c, k in (("v", 0), ("smoothed", 1), ("ring", 2), ("flags", 3))}, last=batch["last"], past=[x[4] for x in out])

    return listed.mapInPandas(prime, f"mission_id string, channel_id string, {SCORING}")


class _Drift(StatefulProcessor):
    """A series' last values and alerts as one value state, and its reference samples as another, which is read but never written again."""

    def __init__(self, features: tuple[str, ...], interval: float, size: int, every: int, threshold: float, share: float, confirmations: int, known_only: bool):
        self.features, self.interval, self.size, self.every = features, interval, size, every
        self.threshold, self.share, self.confirmations, self.known_only = threshold, share, confirmations, known_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "v array<double>, n bigint, alerts int")
        self.known = handle.getValueState("known", "value binary, change binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples():
            self.known.update(tuple(np.sort(np.array([x for x in sample if x is not None] if sample is not None else [], "<f8")).tobytes() for sample in (row.value, row.change)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before, n, alerts = self.held.get() if self.held.exists() else ([], 0, 0)
        known = dict(zip(("value", "change"), self.known.get() if self.known.exists() else (b"", b""), strict=True))
        frame = pd.concat(list(rows)).sort_values("bucket_us")
        values = np.concatenate((np.array(before, float), frame["value"].to_numpy(float)))
        place = np.arange(len(before), len(values))
        count = n + 1 + place - len(before)
        ends = place[(count >= self.size) & ((count - self.size) % self.every == 0)]
        self_known = {f: Reference(np.frombuffer(known[f], "<f8")) for f in self.features}
        if self.known_only and not len(self_known["value"].x):
            ends = ends[:0]
        made = {"value": (values, ends, self.size), "change": (np.diff(values) / self.interval, ends - 1, self.size - 1)}
        scores = {f: self_known[f].scores(*made[f]) for f in self.features} if len(ends) else {}
        out = []
        for k, at in enumerate(frame["bucket_us"].to_numpy()[ends - len(before)].tolist()):
            now = {f: float(s[k]) for f, s in scores.items()}
            drifted = sum(s >= self.threshold for s in now.values()) / len(now)
            alerts = alerts + 1 if drifted >= self.share else 0
            out.append((*key, at, [{"feature": f, "score": s, "drifted": s >= self.threshold} for f, s in now.items()], drifted, drifted >= self.share, alerts >= self.confirmations))
        self.held.update((values[-self.size :].tolist(), int(n + len(frame)), alerts))
        yield pd.DataFrame(out, columns=[*KEYS, "bucket_us", "features", "share", "alert", "confirmed"])


def drift_reference(reference: DataFrame) -> DataFrame:
    """(keys, value, change): bounded reference samples (keys, feature, x) as one row of arrays for each series, the state with which drift streams start."""
    of = lambda f: F.collect_list(F.when(F.col("feature") == f, F.col("x").cast("double"))).alias(f)
    return reference.groupBy(*KEYS).agg(of("value"), of("change"))


def drift_stream(grid: DataFrame, reference: DataFrame, size: int = 256, every: int = 10, threshold: float = 1.0, confirmations: int = 3) -> DataFrame:
    """(keys, bucket_us, score, alert, confirmed): drift of the last values against a bounded reference sample (keys, feature, x; feature is `value`), every so many ticks once there are enough. Series without a sample have no rows."""
    processor = _Drift(("value",), 1.0, size, every, threshold, 1.0, confirmations, True)
    found = _with_state(grid, processor, SNAPSHOT, state=drift_reference(reference))
    return found.select(*KEYS, "bucket_us", F.col("features")[0]["score"].alias("score"), "alert", "confirmed")


def drift_snapshots(grid: DataFrame, reference: DataFrame, interval: float = 1.0, size: int = 256, every: int = 10, threshold: float = 0.1, share: float = 0.3, confirmations: int = 3) -> DataFrame:
    """(keys, bucket_us, features, share, alert, confirmed): drift of the last values, and of their changes by the interval, against bounded reference samples (keys, feature, x), every so many buckets once there are enough. A feature without values on a side scores 0. An alert is confirmed when so many in a row have alerted. The samples are the state with which each series starts; scores equal `drift.rolling_drift`."""
    processor = _Drift(("value", "change"), interval, size, every, threshold, share, confirmations, False)
    return _with_state(grid, processor, SNAPSHOT, state=drift_reference(reference))


def subsystem_drift(snapshots: DataFrame, subsystems: DataFrame, share: float = 0.3) -> DataFrame:
    """(mission_id, subsystem, bucket_us, share, alert): after each snapshot, the share of a subsystem's channels heard so far whose newest snapshot is confirmed, and whether it is so large."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, flags = state.get if state.exists else ([], [])
        newest, out = dict(zip(names, flags, strict=True)), []
        for row in pd.concat(list(frames)).sort_values(["bucket_us", "channel_id"]).itertuples():
            newest[row.channel_id] = bool(row.confirmed)
            now = sum(newest.values()) / len(newest)
            out.append((*key, row.bucket_us, now, now >= share))
        state.update(([*newest], [*newest.values()]))
        yield pd.DataFrame(out, columns=["mission_id", "subsystem", "bucket_us", "share", "alert"])

    named = snapshots.select(*KEYS, "bucket_us", "confirmed").join(subsystems.select(*KEYS, "subsystem"), [*KEYS])
    schema = "mission_id string, subsystem string, bucket_us bigint, share double, alert boolean"
    return named.groupBy("mission_id", "subsystem").applyInPandasWithState(run, schema, "names array<string>, flags array<boolean>", "append", GroupStateTimeout.NoTimeout)


class _Silence(StatefulProcessor):
    """A mission's last tick, when it came, and what has been told since (1: lost, 2: fatal)."""

    def __init__(self, lost_s: float, fatal_s: float, by_arrival: bool):
        self.limits, self.by_arrival = (int(lost_s * 1e6), int(fatal_s * 1e6)), by_arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "last bigint, came_ms bigint, told int")

    def _wait(self, came_ms: int, told: int) -> None:
        """Leave one timer: for the loss, or after it for the fatal one."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if told < 2:
            self.handle.registerTimer(came_ms + self.limits[told] // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, _, told = self.held.get() if self.held.exists() else (None, 0, 0)
        frame = pd.concat(list(rows)).sort_values("first")
        first, until = frame["first"].to_numpy(np.int64), frame["last"].to_numpy(np.int64)
        before = np.maximum.accumulate(np.concatenate(([first[0] if last is None else last], until)))
        gap = first - before[:-1]
        newer, events = np.flatnonzero(gap > 0)[:1].tolist(), []
        if told and self.by_arrival and not newer:
            events, told = [("recovered", int(last))], 0
        for k in sorted({*np.flatnonzero(gap > self.limits[0]).tolist(), *(newer if told else [])}):
            for kind, name in enumerate(("lost", "fatal")):
                if gap[k] > self.limits[kind] and told <= kind:
                    events.append((name, int(before[k]) + self.limits[kind]))
            events.append(("recovered", int(first[k])))
            told = 0
        came = int(timerValues.getCurrentProcessingTimeInMs()) if self.by_arrival else -(-int(before[-1]) // 1000)
        self.held.update((int(before[-1]), came, told))
        self._wait(came, told)
        yield pd.DataFrame([(key[0], *e) for e in events], columns=["mission_id", "event", "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, came, told = self.held.get()
        if told < 2:
            self.held.update((last, came, told + 1))
            self._wait(came, told + 1)
            yield pd.DataFrame([(key[0], ("lost", "fatal")[told], last + self.limits[told])], columns=["mission_id", "event", "us"])


def staleness(ticks: DataFrame, lost_s: float = 60.0, fatal_s: float = 5400.0, clock: str = "event", delay: str = "0 seconds") -> DataFrame:
    """(mission_id, event, us): lost once no channel has had a tick for lost_s, fatal after fatal_s, recovered with the next tick; older ticks change nothing. Each partition's ticks are reduced to a row a second before they meet in the single state of the mission.

    Losses are told while the feed is silent, by a timer: with the clock `event` once the watermark (of all missions' ticks, held back by the delay) has passed the limit; with `processing` once so much time has passed since the last ticks came, so a feed needs no further tick of anyone, and any tick that comes is a recovery; such a query has no end, so `availableNow` is not for it. Both also see silences between ticks that come together, as in a replay; us is by event time in each case.
    """
    if clock not in ("event", "processing"):
        raise ValueError("the clock is event or processing")

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df = df.assign(second=df["us"] // 1_000_000)
            yield df.groupby(["mission_id", "second"], as_index=False).agg(first=("us", "min"), last=("us", "max"))[["mission_id", "first", "last"]]

    timed = ticks.withWatermark(TIME, delay) if clock == "event" else ticks
    each = timed.select("mission_id", F.unix_micros(TIME).alias("us")).mapInPandas(reduce, "mission_id string, first bigint, last bigint")
    processor = _Silence(lost_s, fatal_s, clock == "processing")
    return _with_state(each, processor, "mission_id string, event string, us bigint", ("mission_id",), "EventTime" if clock == "event" else "ProcessingTime")


def inject_live(grid: DataFrame, faults: DataFrame) -> DataFrame:
    """A grid stream with faults (keys, type, from_us, to_us, magnitude, anchor) on the buckets within [from_us, to_us): a spike goes the value's way, a drift rises over the first half, a flatline holds its anchor. The fault table is a bounded list of active faults."""
    active = sent_if_small(faults)
    on = [grid[k] == active[k] for k in KEYS] + [grid["bucket_us"] >= active["from_us"], grid["bucket_us"] < active["to_us"]]
    half = (active["to_us"] - active["from_us"]) / 2
    share = F.least(F.lit(1.0), (grid["bucket_us"] - active["from_us"]) / half)
    v = grid["value"].cast("double")
    new = F.when(active["type"] == "spike", v + F.when(v >= 0, active["magnitude"]).otherwise(-active["magnitude"])).when(active["type"] == "drift", v + active["magnitude"] * share).when(active["type"] == "flatline", active["anchor"]).otherwise(v)
    return grid.join(active, on, "left").select(*(grid[c] for c in grid.columns if c != "value"), new.cast("float").alias("value"), active["type"].isNotNull().alias("injected"))


def inject_live_anchored(grid: DataFrame, faults: DataFrame) -> DataFrame:
    """inject_live for faults without an anchor: a flatline holds the first value that its series has within it, which is kept as state."""
    flat = sent_if_small(faults.where("type = 'flatline'"))
    within = [grid[k] == flat[k] for k in KEYS] + [grid["bucket_us"] >= flat["from_us"], grid["bucket_us"] < flat["to_us"]]
    marked = grid.join(flat, within, "left").select(*(grid[c] for c in ("mission_id", "channel_id", "bucket_us", "value")), flat["from_us"].alias("since"))

    def hold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, anchor = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("bucket_us").itertuples():
            start = None if pd.isna(row.since) else int(row.since)
            if start is not None and start != since:
                since, anchor = start, float(row.value)
            out.append((*key, row.bucket_us, row.value if start is None else anchor, start is not None))
        if since is not None:
            state.update((since, anchor))
        yield pd.DataFrame(out, columns=[*KEYS, "bucket_us", "value", "held"])

    held = marked.groupBy(*KEYS).applyInPandasWithState(hold, f"{GRID}, held boolean", "since bigint, anchor double", "append", GroupStateTimeout.NoTimeout)
    others = inject_live(held, faults.where("type != 'flatline'").withColumn("anchor", F.lit(None).cast("double")))
    return others.withColumn("injected", F.col("injected") | F.col("held")).drop("held")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has now, as a table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
