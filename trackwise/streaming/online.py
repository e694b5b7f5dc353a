"""Structured Streaming: online sampling, lags, posteriors and accuracy.

Late rows beyond the watermark are dropped, repeats of an agent's event are dropped, and
windows and tracks close by the watermark in append mode, so that state stays bounded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackwise.functions import angle_diff
from trackwise.shared import shared_folder


def deduplicated(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "10 days") -> DataFrame:
    """Drop repeats of ``keys`` that come within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def per_second(stream: DataFrame, keys: list[str], ts: str = "ts", length: str = "1 second") -> DataFrame:
    """The last state of each key in each tumbling window of a watermarked stream."""
    rest = [c for c in stream.columns if c not in (*keys, ts)]
    return stream.groupBy(F.window(ts, length).alias("win"), *keys).agg(F.max_by(F.struct(*rest), ts).alias("s")).select(*keys, F.col("win.start").alias("win"), "s.*")


def closed_tracks(stream: DataFrame, keys: list[str], values: list[str], gap: str, ts: str = "ts") -> DataFrame:
    """A track of each key once it has been silent for ``gap``: ``keys ts steps``, its steps (``ts`` and values) in order of time; ``ts`` is the time at which it closed."""
    steps = F.array_sort(F.collect_list(F.struct(ts, *values)))
    closed = stream.groupBy(F.session_window(ts, gap).alias("session"), *keys).agg(steps.alias("steps"))
    return closed.select(*keys, F.window_time("session").alias("ts"), "steps")


def accuracy_by_fraction(tracks: DataFrame, length: str, correct: str = "correct") -> DataFrame:
    """``win fraction accuracy n`` of closed tracks (a watermarked stream), by the window in which they closed and the tenth of the track observed."""
    each = tracks.select("ts", F.size("steps").alias("_n"), F.posexplode("steps").alias("_i", "_s"))
    fraction = F.bround(F.col("_i") / F.col("_n"), 1).alias("fraction")
    return each.groupBy(F.window("ts", length).alias("win"), fraction).agg(F.avg(F.col(f"_s.{correct}")).alias("accuracy"), F.count("*").alias("n")).select(F.col("win.start").alias("win"), "fraction", "accuracy", "n")


LAG_OUT = "agent_id long, frame_id long, speed_change double, dist_travelled double, occluded boolean, first_seen long"
LAG_STATE = "frames array<long>, xs array<double>, ys array<double>, speeds array<double>, hidden array<boolean>, first_seen long"


def online_lags(stream: DataFrame, fps: int, seconds: int = 3, ts: str | None = None, idle_ms: int = 3_600_000) -> DataFrame:
    """Lags and hidden history per agent from a stream of ``agent_id frame_id x y speed hidden``: emits at whole seconds; repeats of a frame count once.

    State is the last ``seconds`` of one agent. With ``ts``, a column under a watermark,
    it goes ``idle_ms`` of event time after the agent's last row; without, it stays.
    """
    keep = seconds * fps

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames, xs, ys, speeds, hidden, first = (list(v) if isinstance(v, (list, tuple)) else v for v in state.get) if state.exists else ([], [], [], [], [], -1)
        past = {f: (x, y, v, h) for f, x, y, v, h in zip(frames, xs, ys, speeds, hidden, strict=True)}
        out = []
        rows = pd.concat(list(batches)).drop_duplicates("frame_id").sort_values("frame_id")
        for r in rows[~rows["frame_id"].isin(frames)].itertuples():
            past[int(r.frame_id)] = (float(r.x), float(r.y), float(r.speed), bool(r.hidden))
            if not r.hidden and first < 0:
                first = int(r.frame_id)
            if r.frame_id % fps == 0:
                ago = past.get(int(r.frame_id) - keep)
                out.append((key[0], int(r.frame_id), float(r.speed) - ago[2] if ago else 0.0, ((r.x - ago[0]) ** 2 + (r.y - ago[1]) ** 2) ** 0.5 if ago else 0.0, bool(r.hidden or ago is None or ago[3]), first))
            past = {f: v for f, v in past.items() if f >= r.frame_id - keep}
        kept = sorted(past)
        cols = list(zip(*[past[f] for f in kept], strict=True)) if kept else [[], [], [], []]
        state.update((kept, *[list(c) for c in cols], first))
        if ts:
            state.setTimeoutTimestamp(max(int(rows[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["agent_id", "frame_id", "speed_change", "dist_travelled", "occluded", "first_seen"])

    return stream.groupBy("agent_id").applyInPandasWithState(step, LAG_OUT, LAG_STATE, "append", GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout)


PAIR = ["scenario", "episode", "agent_id", "ego_id"]
HISTORY_OUT = "scenario int, episode int, agent_id long, ego_id long, frame_id long, x double, y double, heading double, speed double, speed_change double, occluded boolean"


class PairHistory(StatefulProcessor):
    """What an ego remembers of a target: the frames of the last second, with speeds and whether it saw it.

    At whole seconds it gives the change of speed since a second ago and whether the target was
    hidden then, is now, or was not there. A timer ``idle_ms`` after the pair's last row
    clears it.
    """

    def __init__(self, fps: int, idle_ms: int):
        self.fps, self.idle_ms = fps, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "frame_id long, speed double, hidden boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = {int(f): (float(v), bool(h)) for f, v, h in self.recent.get()}
        new = pd.concat(list(rows)).drop_duplicates("frame_id").sort_values("frame_id")
        out = []
        for r in new[~new["frame_id"].isin(past)].itertuples():
            frame = int(r.frame_id)
            past[frame] = (float(r.speed), bool(r.hidden))
            if frame % self.fps == 0:
                ago = past.get(frame - self.fps)
                out.append((*(int(k) for k in key), frame, r.x, r.y, r.heading, r.speed, r.speed - ago[0] if ago else 0.0, bool(r.hidden or ago is None or ago[1])))
        last = max(past)
        self.recent.put([(f, *past[f]) for f in sorted(past) if f > last - 2 * self.fps])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(int(new["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY_OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.recent.clear()
        yield pd.DataFrame([], columns=[c.split()[0] for c in HISTORY_OUT.split(", ")])

    def close(self) -> None:
        pass


def pair_history(stream: DataFrame, fps: int, idle_ms: int) -> DataFrame:
    """``HISTORY_OUT`` of a watermarked stream of ``PAIR frame_id ts x y heading speed hidden``."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return stream.groupBy(*PAIR).transformWithStateInPandas(PairHistory(fps, idle_ms), HISTORY_OUT, "Append", "EventTime")


def segments_by_cell(segments: DataFrame, reach: float) -> DataFrame:
    """A map's segments as one row a grid cell, for a stream to be joined with."""
    cells = lambda c: F.explode(F.sequence(F.floor((F.least(f"{c}0", f"{c}1") - reach) / reach), F.floor((F.greatest(f"{c}0", f"{c}1") + reach) / reach)))
    spread = segments.withColumn("_cx", cells("x")).withColumn("_cy", cells("y"))
    return spread.groupBy("scenario", "_cx", "_cy").agg(F.collect_list(F.struct("lane", "seg", "x0", "y0", "x1", "y1", "s0", "len")).alias("near"))


def located(stream: DataFrame, cells: DataFrame, reach: float, angle: float = math.pi / 4) -> DataFrame:
    """States of a stream with ``lane lon`` of the nearest segment in their direction; a join with a static table and no state."""
    met = stream.withColumn("_cx", F.floor(F.col("x") / reach)).withColumn("_cy", F.floor(F.col("y") / reach)).join(cells, ["scenario", "_cx", "_cy"])

    def on(s):
        dx, dy = s["x1"] - s["x0"], s["y1"] - s["y0"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("x") - s["x0"]) * dx + (F.col("y") - s["y0"]) * dy) / (s["len"] * s["len"])))
        dist = F.hypot(F.col("x") - s["x0"] - t * dx, F.col("y") - s["y0"] - t * dy)
        turn = F.abs(angle_diff(F.atan2(dy, dx), F.col("heading")))
        return F.struct(F.round(dist, 9).alias("dist"), F.round(turn, 9).alias("turn"), s["lane"].alias("lane"), s["seg"].alias("seg"), (s["s0"] + t * s["len"]).alias("lon"))

    best = F.array_min(F.filter(F.transform("near", on), lambda s: (s["dist"] <= reach) & (s["turn"] <= angle + 1e-9)))
    return met.withColumn("_b", best).filter(F.col("_b").isNotNull()).withColumn("lane", F.col("_b.lane")).withColumn("lon", F.col("_b.lon")).drop("_cx", "_cy", "near", "_b")


def goal_posterior(stream: DataFrame, goals: DataFrame, likelihood: Callable[[Column], Column]) -> DataFrame:
    """Rows of a stream of located states with ``goal_lane goal_type prob``: the goals that a state's lane leads to (``goals``: lane, goals), by the likelihood of each over their sum; goals out of reach have no row, as their probability is 0."""
    met = stream.join(goals, "lane")
    scored = F.transform("goals", lambda g: F.struct(g["goal_lane"].alias("goal_lane"), g["goal_type"].alias("goal_type"), likelihood(g).alias("u")))
    total = F.aggregate("_scored", F.lit(0.0), lambda acc, g: acc + g["u"])
    each = met.withColumn("_scored", scored).withColumn("_total", total).select(*stream.columns, "_total", F.explode("_scored").alias("_g"))
    return each.select(*stream.columns, "_g.goal_lane", "_g.goal_type", F.when(F.col("_total") > 0, F.col("_g.u") / F.col("_total")).alias("prob"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has written to the shared ``folder``."""
    spark = stream.sparkSession
    run = f"{folder}/{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{run}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{run}/out")


def replayed(table: DataFrame) -> DataFrame:
    """A table as a stream: written to the shared folder, then read from there as it would arrive."""
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)


def run_in_order(batches: list[DataFrame], plan: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[dict]]:
    """What an append-mode stream has written after ``batches`` arrived one after the other, and the progress of every micro-batch.

    The batches are added to one folder of the shared storage; after each the stream runs on
    from its checkpoint over all that is new, so state and watermark carry over as they
    would in one long run.
    """
    spark = batches[0].sparkSession
    run = f"{shared_folder(spark)}/arrival-{uuid.uuid4().hex}"
    progress: list[dict] = []
    for batch in batches:
        batch.write.mode("append").parquet(f"{run}/in")
        stream = plan(spark.readStream.schema(batch.schema).parquet(f"{run}/in"))
        started = stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
        started.awaitTermination()
        progress += [{"rows": p.numInputRows, "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "dropped_late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)} for p in started.recentProgress]
    return spark.read.parquet(f"{run}/out"), progress
