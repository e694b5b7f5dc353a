"""Track operators: life spans, sampling, lags, goal hits, pairs and peers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.functions import angle_diff
from trackwise.shared import spread

#: Episode and agent numbers start anew in every scenario.
EPISODE = ["scenario", "episode"]
AGENT = [*EPISODE, "agent_id"]
FRAME = [*EPISODE, "frame_id"]


def corners(x: Column, y: Column, length: Column, width: Column, heading: Column) -> Column:
    """The four corners of a rotated box, in the order (-l,-w), (l,-w), (l,w), (-l,w)."""
    c, s = F.cos(heading), F.sin(heading)

    def at(l_: float, w_: float) -> Column:
        dx, dy = length * l_, width * w_
        return F.struct((x + dx * c - dy * s).alias("x"), (y + dx * s + dy * c).alias("y"))

    return F.array(at(-0.5, -0.5), at(0.5, -0.5), at(0.5, 0.5), at(-0.5, 0.5))


def to_image(x: Column, y: Column, heading_deg: Column, metres_per_px: float) -> list[Column]:
    """Image coordinates: y points down, so the heading is mirrored and wrapped to [0, 360)."""
    h = -heading_deg
    return [(x / metres_per_px).alias("x_vis"), (-y / metres_per_px).alias("y_vis"), F.when(h < 0, h + 360).otherwise(h).alias("heading_vis")]


def life_spans(states: DataFrame) -> DataFrame:
    """First and last frame, number of states and of frames."""
    return states.groupBy(*AGENT, "agent_type").agg(
        F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame"), F.count("*").alias("n_states"),
    ).withColumn("num_frames", F.col("last_frame") - F.col("first_frame") + 1)


def moving_agents(states: DataFrame, *, least: float = 1.0, bicycles: bool = True) -> DataFrame:
    """Drop pedestrians, parked agents (those that never get ``least`` away from their first position) and, if asked, bicycles."""
    w = Window.partitionBy(*AGENT)
    first = F.first(F.struct("x", "y")).over(w.orderBy("frame_id"))
    kinds = ["pedestrian"] if bicycles else ["pedestrian", "bicycle"]
    far = F.max(F.hypot(F.col("x") - F.col("_f.x"), F.col("y") - F.col("_f.y"))).over(w)
    out = states.filter(~F.col("agent_type").isin(kinds)).withColumn("_f", first).withColumn("_far", far)
    return out.filter(F.col("_far") >= least).drop("_f", "_far")


def each_second(states: DataFrame, fps: int) -> DataFrame:
    """The frames that are whole seconds."""
    return states.filter(F.col("frame_id") % fps == 0)


def lags(states: DataFrame, fps: int, seconds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Change of speed and heading and distance travelled since k seconds ago, 0.0 where the track is younger; frame-exact by a range window."""
    out = states
    for k in seconds:
        ago = Window.partitionBy(*AGENT).orderBy("frame_id").rangeBetween(-k * fps, -k * fps)
        past = F.first(F.struct("x", "y", "speed", "heading")).over(ago)
        out = out.withColumn(f"_p{k}", past)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    cols = []
    for k in seconds:
        p = F.col(f"_p{k}")
        cols += [
            zero(F.col("speed") - p["speed"]).alias(f"speed_change_{k}s"),
            zero(angle_diff(p["heading"], F.col("heading"))).alias(f"heading_change_{k}s"),
            zero(F.hypot(F.col("x") - p["x"], F.col("y") - p["y"])).alias(f"dist_travelled_{k}s"),
        ]
    return out.select(*[c for c in states.columns], *cols)


def goal_hits(states: DataFrame, goals: DataFrame, radius: float) -> DataFrame:
    """First frame within ``radius`` of each goal, per agent; goals (``goal_idx gx gy``, with ``scenario`` where they differ by it) meet the states by grid cells."""
    cell = max(radius, 1.0)
    around = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell)))
    spots = goals.select("*", around("gx").alias("_cx")).select("*", around("gy").alias("_cy"))
    on = ["_cx", "_cy", *(["scenario"] if "scenario" in goals.columns else [])]
    there = states.select(*AGENT, "frame_id", "x", "y", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    met = there.join(spots, on).filter(F.hypot(F.col("x") - F.col("gx"), F.col("y") - F.col("gy")) <= radius)
    return met.groupBy(*AGENT, "goal_idx").agg(F.min("frame_id").alias("hit_frame"))


def true_goals(hits: DataFrame) -> DataFrame:
    """The goal first hit last; on the same frame the higher goal."""
    return hits.groupBy(*AGENT).agg(F.max("hit_frame").alias("goal_frame"), F.max_by("goal_idx", F.struct("hit_frame", "goal_idx")).alias("true_goal"))


def trimmed(states: DataFrame, goals_of: DataFrame) -> DataFrame:
    """States up to the goal, with the fraction of the trimmed trajectory observed."""
    out = states.join(goals_of, AGENT).filter(F.col("frame_id") <= F.col("goal_frame"))
    w = Window.partitionBy(*AGENT)
    return out.withColumn("initial_frame_id", F.min("frame_id").over(w)).withColumn("fraction_observed", (F.col("frame_id") - F.col("initial_frame_id")) / F.count("*").over(w))


def pairs(spans: DataFrame, fps: int) -> DataFrame:
    """Ordered ego-target pairs of an episode whose life spans overlap; the ego must live a second or more."""
    spans = spread(spans, *EPISODE)
    ego = spans.select(*EPISODE, F.col("agent_id").alias("ego_id"), F.col("first_frame").alias("_a"), F.col("last_frame").alias("_b"))
    met = spans.select(*AGENT, "first_frame", "last_frame").join(ego, EPISODE).filter(
        (F.col("agent_id") != F.col("ego_id")) & (F.col("first_frame") <= F.col("_b")) & (F.col("_a") <= F.col("last_frame")) & (F.col("_b") - F.col("_a") + 1 >= fps)
    )
    return met.select(*AGENT, "ego_id", F.greatest("first_frame", "_a").alias("start_frame"), F.least("last_frame", "_b").alias("end_frame"))


def peers(states: DataFrame) -> DataFrame:
    """Every other agent in the same frame of an episode, with its distance."""
    states = spread(states, *FRAME)
    other = states.select(*FRAME, F.col("agent_id").alias("peer_id"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = states.join(other, FRAME).filter(F.col("agent_id") != F.col("peer_id"))
    return met.withColumn("distance", F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))).drop("_x", "_y")


#: Places of one leaf of a frame's places.
LEAF = 64


def _leaves(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Places cut at medians, of the wider side, into leaves of at most ``LEAF``."""
    todo, done = [np.arange(len(x))], []
    while todo:
        i = todo.pop()
        if len(i) <= LEAF:
            done.append(i)
            continue
        c = x if np.ptp(x[i]) >= np.ptp(y[i]) else y
        order = i[np.argpartition(c[i], len(i) // 2)]
        todo += [order[: len(i) // 2], order[len(i) // 2 :]]
    return done


def _first(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of peers in order of ``ids`` the first ``k`` of each place by distance rounded, then id: ids and distances (n, k), nan where there are fewer or a distance is unknown."""
    d = np.hypot(px - x[:, None], py - y[:, None])
    take = np.argsort(np.round(d, 9), 1, kind="stable")[:, :k]
    pad = ((0, 0), (0, k - take.shape[1]))
    return np.pad(ids[take], pad, constant_values=-1), np.pad(np.take_along_axis(d, take, 1), pad, constant_values=np.nan)


def _nearest_of_frame(x: np.ndarray, y: np.ndarray, ids: np.ndarray, spot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place ``x y`` the first ``k`` (``_first``) of the agents ``ids`` that stand at places ``spot``; -1 where a frame has fewer."""
    order = np.argsort(ids, kind="stable")
    ids, spot = ids[order], spot[order]
    k = min(k, len(ids))
    found, dist = np.full((len(x), k), -1, ids.dtype), np.full((len(x), k), np.nan)
    known = np.isfinite(x) & np.isfinite(y)
    place = np.flatnonzero(known)
    leaves = [place[i] for i in _leaves(x[place], y[place])] if len(place) else []
    at = np.full(len(x), -1)
    for n, leaf in enumerate(leaves):
        at[leaf] = n
    low, high = (np.array([[f(x[i]), f(y[i])] for i in leaves]).reshape(-1, 2) for f in (np.min, np.max))
    by = np.argsort(at[spot], kind="stable")
    ends = np.searchsorted(at[spot][by], np.arange(-1, len(leaves) + 1))
    seats = [by[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # those at places that are not finite first
    for n, leaf in enumerate(leaves):
        own = seats[n + 1]
        _, near = _first(x[leaf], y[leaf], x[spot[own]], y[spot[own]], ids[own], k)
        reach = near[:, -1].max() if len(own) >= k else np.inf  # the leaf's own agents bound the distance
        gap = np.hypot(*np.maximum(np.maximum(low - high[n], low[n] - high), 0.0).T)
        peers = np.sort(np.concatenate([seats[0], *[seats[m + 1] for m in np.flatnonzero(gap <= reach + 1e-6)]]))
        found[leaf], dist[leaf] = _first(x[leaf], y[leaf], x[spot[peers]], y[spot[peers]], ids[peers], k)
    for i in np.flatnonzero(~known):
        found[i], dist[i] = (c[0] for c in _first(x[i : i + 1], y[i : i + 1], x[spot], y[spot], ids, k))
    return found, dist


def nearest_peers(states: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest peers of each state, by distance, then id.

    All agents in one place of a frame have the same nearest ``k + 1``, themselves perhaps included, of whom at most ``k + 1`` stand in any one place.
    A frame's places are cut into leaves, and a leaf asks only those no farther than its own agents' distances allow: the work grows with the
    frame's agents, not with their pairs, and nothing but the states is shuffled.
    """
    types = dict(states.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("agent_id", kind="stable", ignore_index=True)
        spots = pdf.groupby(["x", "y"], sort=False, dropna=False)
        spot, ids = spots.ngroup().to_numpy(), pdf["agent_id"].to_numpy()
        first, seat = np.unique(spot, return_index=True)[1], spots.cumcount().to_numpy() <= k
        peers, dist = _nearest_of_frame(pdf["x"].to_numpy(float)[first], pdf["y"].to_numpy(float)[first], ids[seat], spot[seat], k + 1)
        peers, dist = peers[spot], dist[spot]
        other = peers != ids[:, None]
        rank = np.cumsum(other, 1)
        row, col = np.nonzero(other & (rank <= k))
        out = pdf.iloc[row].reset_index(drop=True)
        return out.assign(peer_id=peers[row, col], distance=dist[row, col], rank=rank[row, col])

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + f", peer_id {types['agent_id']}, distance double, rank int"
    there = states.dropna(subset=[*FRAME, "agent_id"]).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    return spread(there, *FRAME).groupBy(*FRAME).applyInPandas(run, schema)


def hidden_history(samples: DataFrame, seconds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``target_ks_occluded``: hidden now, hidden k samples ago, or history too short; over one-second samples."""
    w = Window.partitionBy(*AGENT).orderBy("frame_id")
    return samples.select("*", *[(F.coalesce(F.lag("hidden", k).over(w), F.lit(True)) | F.col("hidden")).alias(f"target_{k}s_occluded") for k in seconds])


def visible_span(samples: DataFrame) -> DataFrame:
    """First and last frame at which an agent is seen."""
    seen = F.when(~F.col("hidden"), F.col("frame_id"))
    return samples.groupBy(*AGENT).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))


def renumbered(states: DataFrame, ts: str, per_chunk: int) -> DataFrame:
    """Tracks renumbered by first time stamp, time from the start, chunks of ``per_chunk`` tracks.

    Only the tracks' first times are put in order, not the states; the ranks come from
    counts by range, so no task orders all tracks.
    """
    first = states.groupBy(*AGENT).agg(F.min(ts).alias("_t"))
    ranked = ranked_rows(first, ["_t", "agent_id", *EPISODE])
    start = states.agg(F.min(ts).alias("_start"))
    joined = states.join(ranked.select(*AGENT, F.col("rank").alias("new_id")), AGENT).crossJoin(start)  # a one-row table
    return joined.withColumn("seconds", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_start").cast("timestamp"))) / 1e6).withColumn("chunk", F.floor(F.col("new_id") / per_chunk).cast("long")).drop("_start")


def ranked_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """Global 0-based ``rank`` by ``order``: range partitions are numbered inside, then shifted by the rows before them."""
    parts = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    inside = parts.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = inside.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b._part") < F.col("a._part"), "left").groupBy(F.col("a._part").alias("_part")).agg(F.coalesce(F.sum("b._n"), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + F.col("_in") - 1).drop("_part", "_in", "_before")


def reachable_prefix(states: DataFrame, n_reachable: str) -> DataFrame:
    """States before the first one without any reachable candidate."""
    stop = F.min(F.when(F.col(n_reachable) == 0, F.col("frame_id"))).over(Window.partitionBy(*AGENT))
    return states.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("frame_id") < F.col("_stop"))).drop("_stop")


def _between_seen(states: DataFrame, *columns: str) -> DataFrame:
    """``states`` with ``_a`` and ``_b``, these columns of the last state seen up to each and of the next one from it on.

    Both look back, over frames in rising and in falling order: a window that looks ahead is scanned anew for every row.
    """
    seen = F.when(~F.col("hidden"), F.struct(*columns))
    over = lambda order: Window.partitionBy(*AGENT).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return states.withColumn("_b", F.last(seen, ignorenulls=True).over(over(F.desc("frame_id")))).withColumn("_a", F.last(seen, ignorenulls=True).over(over(F.asc("frame_id"))))


def gap_curves(states: DataFrame, fps: float, least_move: float = 0.1) -> DataFrame:
    """Hidden stretches as curves: ``states`` with ``filled`` and ``x_filled y_filled speed_filled heading_filled acceleration_filled``.

    Between the last and the next seen state runs the cubic that has their places and velocities (``speed`` along
    ``heading``); speed, heading and signed acceleration are its derivatives. An agent whose two seen places lie less than
    ``least_move`` apart stands still in between: at the first place, with speed and acceleration 0 and the next seen
    heading. Where the curve comes to rest, it has the heading of the straight line. Seen states keep their own values,
    ``acceleration`` (if there is such a column, else null) included.

    Only closed gaps are filled: hidden states before the first or after the last seen one, and those of a gap that
    opens right after a track's first frame, are left out. States without place, speed or heading at a gap's ends give null.
    """
    w = Window.partitionBy(*AGENT)
    values = states if "acceleration" in states.columns else states.withColumn("acceleration", F.lit(None).cast("double"))
    ends = _between_seen(values.withColumn("_start", F.min("frame_id").over(w)), "frame_id", "x", "y", "speed", "heading")
    a, b = (lambda c: F.col("_a")[c]), (lambda c: F.col("_b")[c])
    closed = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (a("frame_id") > F.col("_start"))
    rows = ends.filter(~F.col("hidden") | closed)
    span = F.nullif(b("frame_id") - a("frame_id"), F.lit(0))  # null at seen states
    rows = rows.withColumn("_u", (F.col("frame_id") - a("frame_id")) / span).withColumn("_time", span / F.lit(float(fps)))
    u, u2 = F.col("_u"), F.col("_u") * F.col("_u")

    def curve(c: str, turn: Callable[[Column], Column]) -> list[Column]:
        """Place, velocity and acceleration of one coordinate."""
        p, q = a(c), b(c)
        m, n = (e("speed") * turn(e("heading")) * F.col("_time") for e in (a, b))
        cubic, square = 2 * (p - q) + m + n, 3 * (q - p) - 2 * m - n
        return [cubic * u2 * u + square * u2 + m * u + p, (3 * cubic * u2 + 2 * square * u + m) / F.col("_time"), (6 * cubic * u + 2 * square) / (F.col("_time") * F.col("_time"))]

    names = [f"_{d}{c}" for c in "xy" for d in ("p", "v", "a")]
    rows = rows.withColumns(dict(zip(names, curve("x", F.cos) + curve("y", F.sin), strict=True)))
    rows = rows.withColumn("_still", F.hypot(b("x") - a("x"), b("y") - a("y")) < least_move).withColumn("_v", F.hypot("_vx", "_vy"))
    rests = F.col("_v") < 1e-9
    line = F.atan2(b("y") - a("y"), b("x") - a("x"))

    def fill(own: str, standing: Column, moving: Column) -> Column:
        return F.when(~F.col("hidden"), F.col(own)).when(F.col("_still"), standing).otherwise(moving).alias(f"{own}_filled")

    zero = F.lit(0.0)
    return rows.select(
        *states.columns, F.col("hidden").alias("filled"), fill("x", a("x"), F.col("_px")), fill("y", a("y"), F.col("_py")), fill("speed", zero, F.col("_v")),
        fill("heading", b("heading"), F.when(rests, line).otherwise(F.atan2("_vy", "_vx"))),
        fill("acceleration", zero, F.when(rests, zero).otherwise((F.col("_vx") * F.col("_ax") + F.col("_vy") * F.col("_ay")) / F.col("_v"))),
    )


def gap_filled(states: DataFrame) -> DataFrame:
    """Replace hidden states by the straight line between the last and the next seen state; at a track's ends, repeat the nearest seen state.

    If the seen positions on both sides agree within 0.1 the agent stands still, and its last seen state is repeated.
    """
    out = _between_seen(states, "frame_id", "x", "y")
    share = (F.col("frame_id") - F.col("_a.frame_id")) / (F.col("_b.frame_id") - F.col("_a.frame_id"))
    still = F.hypot(F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")) < 0.1

    def fill(c: str) -> Column:
        a, b = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        return F.when(~F.col("hidden"), F.col(c)).when(F.col("_a").isNull(), b).when(F.col("_b").isNull() | still, a).otherwise(a + (b - a) * share)

    return out.select(*states.columns, fill("x").alias("x_filled"), fill("y").alias("y_filled")).withColumn("filled", F.col("hidden"))


def padded_sequences(states: DataFrame) -> DataFrame:
    """Per agent the steps from first to last seen frame, [0,0,0,0] where hidden, padded with zeros to the longest.

    The longest length is one number, so it meets every row.
    """
    span = visible_span(states)
    kept = states.join(span, AGENT).filter((F.col("frame_id") >= F.col("first_seen")) & (F.col("frame_id") <= F.col("last_seen")))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("x", "y", "heading", "visible")])
    step = F.when(F.col("hidden"), zero).otherwise(F.struct("x", "y", "heading", F.lit(1.0).alias("visible")))
    seqs = kept.groupBy(*AGENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("frame_id", step.alias("s")))), lambda z: z["s"]).alias("steps"), F.count("*").alias("length"))
    longest = seqs.agg(F.max("length").alias("_m"))
    return seqs.crossJoin(longest).withColumn("steps", F.concat("steps", F.array_repeat(zero, (F.col("_m") - F.col("length")).cast("int")))).drop("_m")
