"""Road network as tables, and where states stand and can go on it.

Tables: ``lanes(lane, road, section, junction, jgroup, ord)``, ``segments(lane, seg, x0, y0,
x1, y1, s0, len)`` with arc length ``s0`` at a segment's start, ``links(src, dst, ord)``,
``priorities(junction, high, low)`` of roads. All of a map's tables are static and small
beside the states; the searches over them run once a map. Lane keys are unique over all
maps; where states and segments carry a ``scenario``, they meet within it only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.functions import angle_diff
from trackwise.operators.tracks import FRAME
from trackwise.shared import held, spread

KEY = [*FRAME, "agent_id"]


def with_arc_length(points: DataFrame) -> DataFrame:
    """Segments with ``s0`` and ``len`` from ``lane seg x0 y0 x1 y1``."""
    n = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    before = F.coalesce(F.sum("len").over(Window.partitionBy("lane").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return points.withColumn("len", n).withColumn("s0", before)


def ends(segments: DataFrame) -> DataFrame:
    """Per lane its length, start and end heading and end point."""
    h = F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    return segments.groupBy("lane").agg(
        F.sum("len").alias("length"), F.min_by(h, "seg").alias("start_heading"), F.max_by(h, "seg").alias("end_heading"), F.max_by("x1", "seg").alias("end_x"), F.max_by("y1", "seg").alias("end_y"),
    )


def project(x: Column, y: Column) -> tuple[Column, Column]:
    """Arc length of the nearest point of a segment, and the distance to it."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / (F.col("len") * F.col("len"))))
    return F.col("s0") + t * F.col("len"), F.hypot(x - F.col("x0") - t * dx, y - F.col("y0") - t * dy)


def lane_candidates(states: DataFrame, segments: DataFrame, *, reach: float, angle: float = math.pi / 4) -> DataFrame:
    """Lanes within ``reach`` of a state whose direction differs by at most ``angle``, with ``lon dist turn``.

    Segments are spread over the grid cells they come near, states carry their cell, so
    the spatial join is an equi join whose hot cells can be split.
    """
    cell = max(reach, 1.0)
    lo = lambda a, b: F.floor((F.least(a, b) - reach) / cell)
    hi = lambda a, b: F.floor((F.greatest(a, b) + reach) / cell)
    spread = segments.withColumn("_cx", F.explode(F.sequence(lo("x0", "x1"), hi("x0", "x1")))).withColumn("_cy", F.explode(F.sequence(lo("y0", "y1"), hi("y0", "y1"))))
    near = states.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    near = near.join(spread, ["_cx", "_cy", *(["scenario"] if "scenario" in segments.columns else [])])
    lon, dist = project(F.col("x"), F.col("y"))
    turn = angle_diff(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), F.col("heading"))
    near = near.withColumn("lon", lon).withColumn("dist", dist).withColumn("turn", turn).filter((F.col("dist") <= reach) & (F.abs("turn") <= angle + 1e-9))
    best = F.min_by(F.struct("lon", "dist", "turn"), F.struct("dist", "seg"))
    return near.groupBy(*states.columns, "lane").agg(best.alias("_b")).select(*states.columns, "lane", "_b.lon", "_b.dist", "_b.turn")


def best_lane(candidates: DataFrame, state: list[str]) -> DataFrame:
    """The nearest candidate lane of each state; ties by angle, then by lane."""
    w = Window.partitionBy(*state).orderBy(F.round("dist", 9), F.round(F.abs("turn"), 9), "lane")
    return candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def junction_flags(lanes: DataFrame, links: DataFrame) -> DataFrame:
    """Per lane: whether it leads into several junction lanes, is in a roundabout, enters or leaves one."""
    to = links.join(lanes.select(F.col("lane").alias("dst"), F.col("junction").alias("_j"), F.col("jgroup").alias("_g")), "dst")
    out = to.groupBy(F.col("src").alias("lane")).agg(F.sum(F.col("_j").isNotNull().cast("int")).alias("n_junction"), F.max(F.coalesce(F.col("_g") == "roundabout", F.lit(False))).alias("to_roundabout"))
    back = links.join(lanes.select(F.col("lane").alias("src"), F.col("jgroup").alias("_g")), "src").groupBy(F.col("dst").alias("lane")).agg(F.max(F.coalesce(F.col("_g") == "roundabout", F.lit(False))).alias("from_roundabout"))
    ring = F.coalesce(F.col("jgroup") == "roundabout", F.lit(False))
    return lanes.join(out, "lane", "left").join(back, "lane", "left").select(
        "lane", ring.alias("in_roundabout"), (F.coalesce("n_junction", F.lit(0)) > 1).alias("branches"), (~ring & F.coalesce("to_roundabout", F.lit(False))).alias("enters_roundabout"), (~ring & F.coalesce("from_roundabout", F.lit(False))).alias("leaves_roundabout"),
    )


def lane_paths(links: DataFrame, starts: DataFrame, *, max_depth: int = 20, stop: DataFrame | None = None) -> DataFrame:
    """Shortest lane paths ``start lane depth path`` by breadth first, first arrival by (depth, order of links); paths do not go on from lanes in ``stop``.

    One join a level over the static network; only first arrivals are carried on.
    """
    front = starts.select(F.col("lane").alias("start"), "lane", F.lit(0).alias("depth"), F.array("lane").alias("path"), F.array().cast("array<int>").alias("way"))
    seen = front
    for level in range(1, max_depth + 1):
        go = front if stop is None or level == 1 else front.join(stop.select("lane"), "lane", "left_anti")
        nxt = go.join(links.withColumnRenamed("src", "lane"), "lane").select("start", F.col("dst").alias("lane"), F.lit(level).alias("depth"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("ord")).alias("way"))
        first = nxt.groupBy("start", "lane").agg(F.min(F.struct("way", "path", "depth")).alias("m")).select("start", "lane", "m.depth", "m.path", "m.way")
        front = first.join(seen.select("start", "lane"), ["start", "lane"], "left_anti")
        front = held(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.drop("way")


def lane_direction(turn: Column) -> Column:
    """left, right, straight or backward by the change of heading over a lane."""
    e = math.pi / 8
    return F.when((turn > e) & (turn < 7 * e), "left").when((turn < -e) & (turn > -7 * e), "right").when((turn >= -e) & (turn <= e), "straight").otherwise("backward")


def goal_type(direction: Column, entry: Column, roundabout: Column) -> Column:
    """The type of a goal by how its path crosses the junction."""
    return (
        F.when(roundabout, "exit-roundabout").when(direction.isin("left", "right"), F.concat(F.when(entry, "enter-").otherwise("exit-"), direction))
        .when(direction == "straight", F.when(entry, "cross-road").otherwise("straight-on")).otherwise("u-turn")
    )


def reachable_goals(lanes: DataFrame, segments: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Static table ``start goal_lane goal_type gx gy path depth``: ends reached by breadth first from every lane.

    A search ends at a lane without successor, at one that branches into a junction
    other than a roundabout (its successors' ends are the goals), and at a roundabout's exit.
    """
    closed = search_ends(lanes, links)
    paths = lane_paths(links, lanes.select("lane"), stop=closed)
    return typed_goals(paths.join(closed, "lane"), lanes, segments, links, entries).select("start", "goal_lane", "goal_type", "gx", "gy", "path", "depth")


def search_ends(lanes: DataFrame, links: DataFrame) -> DataFrame:
    """The lanes that end every search: without successor, of a junction other than a roundabout, out of a roundabout."""
    goes_on = links.select(F.col("src").alias("lane")).distinct()
    in_junction = lanes.filter(F.col("junction").isNotNull() & F.col("jgroup").isNull()).select("lane")
    leaves = junction_flags(lanes, links).filter("leaves_roundabout").select("lane")
    return leaves.union(in_junction).union(lanes.select("lane").join(goes_on, "lane", "left_anti")).distinct()


def typed_goals(found: DataFrame, lanes: DataFrame, segments: DataFrame, links: DataFrame, entries: DataFrame) -> DataFrame:
    """Searches' last lanes (``lane path`` and others) with ``goal_lane goal_type gx gy``; a lane outside of junctions is straight on."""
    flags = junction_flags(lanes, links)
    e = ends(segments)
    turn = angle_diff(F.col("_sh"), F.col("_eh"))
    head = e.select(F.col("lane").alias("_prev"), F.col("end_heading").alias("_sh"))
    tail = links.join(e.select(F.col("lane").alias("dst"), F.col("start_heading").alias("_eh")), "dst").groupBy(F.col("src").alias("lane")).agg(F.min("_eh").alias("_eh"))
    found = found.withColumn("_prev", F.when(F.size("path") > 1, F.element_at("path", -2)).otherwise(F.col("lane")))
    typed = (
        found.join(head, "_prev").join(tail, "lane", "left").join(e.select("lane", "end_x", "end_y", "end_heading"), "lane").withColumn("_eh", F.coalesce("_eh", "end_heading"))
        .join(flags.select("lane", "leaves_roundabout"), "lane").join(entries.withColumn("_entry", F.lit(True)), "lane", "left").join(lanes.select("lane", "junction"), "lane")
    )
    kind = F.when(F.col("junction").isNull() & ~F.col("leaves_roundabout"), "straight-on").otherwise(goal_type(lane_direction(turn), F.coalesce("_entry", F.lit(False)), F.col("leaves_roundabout")))
    named = typed.withColumn("goal_type", kind).withColumnsRenamed({"lane": "goal_lane", "end_x": "gx", "end_y": "gy"})
    return named.drop("_prev", "_sh", "_eh", "end_heading", "leaves_roundabout", "_entry", "junction")


def junction_entries(lanes: DataFrame, links: DataFrame, segments: DataFrame, priorities: DataFrame) -> DataFrame:
    """Junction lanes that give way: another lane of the junction has the same successor and its incoming road has priority over ours."""
    inc = links.join(lanes.select(F.col("lane").alias("src"), F.col("road").alias("in_road")), "src").select(F.col("dst").alias("lane"), "in_road")
    out = links.select(F.col("src").alias("lane"), F.col("dst").alias("to"))
    j = lanes.filter(F.col("junction").isNotNull()).select("lane", "junction").join(inc, "lane").join(out, "lane")
    other = j.select("junction", "to", F.col("lane").alias("_l"), F.col("in_road").alias("high"))
    met = j.join(other, ["junction", "to"]).filter(F.col("lane") != F.col("_l")).withColumn("low", F.col("in_road"))
    return met.join(priorities, ["junction", "high", "low"], "left_semi").select("lane").distinct()


def conflict_lanes(lanes: DataFrame, links: DataFrame, overlap: DataFrame, priorities: DataFrame, least_area: float = 1.0) -> DataFrame:
    """Pairs ``lane other`` of a junction: other's incoming road has not to give way to ours, comes from another lane, and overlaps by more than ``least_area``."""
    inc = links.join(lanes.select(F.col("lane").alias("src"), F.col("road").alias("road")), "src").select(F.col("dst").alias("lane"), F.col("src").alias("from_lane"), "road")
    j = lanes.filter(F.col("junction").isNotNull()).select("lane", "junction").join(inc, "lane")
    o = j.select("junction", F.col("lane").alias("other"), F.col("from_lane").alias("_f"), F.col("road").alias("low"))
    met = j.withColumnRenamed("road", "high").join(o, "junction").filter((F.col("lane") != F.col("other")) & (F.col("from_lane") != F.col("_f")))
    return met.join(priorities, ["junction", "high", "low"], "left_anti").join(overlap.filter(F.col("area") > least_area), ["lane", "other"]).select("lane", "other", "cross_s", "cross_s_other")


def upstream(links: DataFrame, segments: DataFrame, lanes: DataFrame, least: float = 100.0) -> DataFrame:
    """Per lane the sequence ``lane up gap`` of first predecessors until their lengths reach ``least``; gap is the way from the start of ``up`` to the start of ``lane``."""
    first = links.groupBy(F.col("dst").alias("lane")).agg(F.min_by("src", F.struct("ord", "src")).alias("prev"))
    length = ends(segments).select("lane", "length")
    step = first.join(length.withColumnRenamed("lane", "prev"), "prev").select(F.col("lane").alias("up"), "prev", "length")
    at = lanes.select("lane", F.col("lane").alias("up"), F.lit(0.0).alias("gap"))
    out = at
    while True:
        at = at.filter(F.col("gap") < least).join(step, "up").select("lane", F.col("prev").alias("up"), (F.col("gap") + F.col("length")).alias("gap"))
        at = held(at)
        if at.isEmpty():
            break
        out = out.unionByName(at)
    return out


def path_table(paths: DataFrame, lanes: DataFrame, segments: DataFrame) -> DataFrame:
    """Path positions ``start goal_lane pos lane section s_before length``: a lane whose predecessor on the path has the same section (a lane change) adds nothing."""
    e = ends(segments).select("lane", "length")
    rows = paths.select("start", "goal_lane", F.posexplode("path").alias("pos", "lane")).join(lanes.select("lane", "section", "junction"), "lane").join(e, "lane")
    w = Window.partitionBy("start", "goal_lane").orderBy("pos")
    adds = F.when(F.coalesce(F.lead("section").over(w) == F.col("section"), F.lit(False)), F.lit(0.0)).otherwise(F.col("length"))
    rows = rows.withColumn("_adds", adds)
    return rows.withColumn("s_before", F.coalesce(F.sum("_adds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_adds")


def path_facts(table: DataFrame) -> DataFrame:
    """Per path: whole length, first junction lane, whether it never changes lane within a section."""
    w = Window.partitionBy("start", "goal_lane").orderBy("pos")
    marked = table.withColumn("_same", F.coalesce(F.lag("section").over(w) == F.col("section"), F.lit(False)))
    return marked.groupBy("start", "goal_lane").agg(
        F.max(F.col("s_before") + F.col("length")).alias("path_length"), F.min_by("lane", F.when(F.col("junction").isNotNull(), F.col("pos"))).alias("junction_lane"), (~F.max("_same")).alias("in_correct_lane"),
    )


def path_lengths(paths: DataFrame, lanes: DataFrame, segments: DataFrame) -> DataFrame:
    """``start goal_lane path_length in_correct_lane road_heading``: the length leaves out a lane that is changed to within a section, unless it is the last; the heading is the last lane's turn from start to end."""
    e = ends(segments).select("lane", "length", angle_diff(F.col("start_heading"), F.col("end_heading")).alias("turn"))
    rows = paths.select("start", "goal_lane", F.posexplode("path").alias("pos", "lane")).join(lanes.select("lane", "section"), "lane").join(e, "lane")
    w = Window.partitionBy("start", "goal_lane").orderBy("pos")
    changed = F.coalesce(F.lag("section").over(w) == F.col("section"), F.lit(False))
    marked = rows.withColumn("_changed", changed).withColumn("_last", F.lead("lane").over(w).isNull())
    return marked.groupBy("start", "goal_lane").agg(
        F.sum(F.when(F.col("_changed") & ~F.col("_last"), 0.0).otherwise(F.col("length"))).alias("path_length"), (~F.max("_changed")).alias("in_correct_lane"), F.max_by("turn", "pos").alias("road_heading"),
    )


def lane_crossings(segments: DataFrame, lanes: DataFrame, width: float = 3.0) -> DataFrame:
    """``lane other area cross_s cross_s_other``: where the midlines of two lanes of a junction first cross, for lanes of any number of segments; the area is that of two strips of ``width``."""
    seg = segments.join(lanes.filter("junction IS NOT NULL").select("lane", "junction"), "lane").select("junction", "lane", "x0", "y0", "x1", "y1", "s0", "len")
    o = seg.select("junction", *[F.col(c).alias(f"_{c}") for c in ("lane", "x0", "y0", "x1", "y1", "s0", "len")])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    met = seg.join(o, "junction").filter(F.col("lane") != F.col("_lane")).withColumn("_det", F.nullif(F.round(dx * ey - dy * ex, 9), F.lit(0.0))).filter(F.col("_det").isNotNull())
    met = met.withColumn("_t", ((F.col("_x0") - F.col("x0")) * ey - (F.col("_y0") - F.col("y0")) * ex) / F.col("_det")).withColumn("_u", ((F.col("_x0") - F.col("x0")) * dy - (F.col("_y0") - F.col("y0")) * dx) / F.col("_det"))
    at = F.struct((F.col("s0") + F.col("_t") * F.col("len")).alias("s"), (F.col("_s0") + F.col("_u") * F.col("_len")).alias("o"), (width * width * F.col("len") * F.col("_len") / F.abs("_det")).alias("area"))
    first = met.filter(F.col("_t").between(0, 1) & F.col("_u").between(0, 1)).groupBy("lane", F.col("_lane").alias("other")).agg(F.min(at).alias("m"))
    return first.select("lane", "other", "m.area", F.col("m.s").alias("cross_s"), F.col("m.o").alias("cross_s_other"))


def exit_numbers(goals: DataFrame, flags: DataFrame, lanes: DataFrame) -> DataFrame:
    """Rank of each roundabout exit among a start lane's, by length of path; 0 where the goal is none or no entrance lies on the path."""
    enters = F.broadcast(flags.filter("enters_roundabout").select("lane"))
    via = goals.select("start", "goal_lane", F.explode("path").alias("lane")).join(enters, "lane").select("start", "goal_lane").distinct().withColumn("_in", F.lit(True))
    met = goals.join(via, ["start", "goal_lane"], "left")
    counts = (F.col("goal_type") == "exit-roundabout") & F.coalesce("_in", F.lit(False))
    w = Window.partitionBy("start").orderBy(F.when(counts, 0).otherwise(1), F.size("path"), "goal_lane")
    return met.select("start", "goal_lane", F.when(counts, F.row_number().over(w)).otherwise(0).cast("long").alias("exit_number"))


def _first_two(rounded: np.ndarray, ids: np.ndarray, d: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """Of candidates by row (n, k), nan where there is none: the nearest and the nearest of another id, by ``rounded``, then id, as ``[id, rounded, d, v]`` (n, 2)."""
    order = np.lexsort((ids, rounded))  # nan last
    ids, rounded, d, v = (np.take_along_axis(c, order, 1) for c in (ids, rounded, d, v))
    other = (ids != ids[:, :1]) & ~np.isnan(rounded)
    second = np.where(other.any(1), other.argmax(1), -1)
    rows = np.arange(len(ids))
    return [np.stack([c[:, 0], np.where(second >= 0, c[rows, second], none)], 1) for c, none in ((ids, 0), (rounded, np.nan), (d, np.nan), (v, np.nan))]


def _from(at: np.ndarray, along: np.ndarray, ids: np.ndarray, speed: np.ndarray, offset: float, least: float, most: float) -> list[np.ndarray]:
    """The first two (``_first_two``) of peers at ``along`` (ascending) at the least distance ``offset + along - at`` between two bounds."""
    start, wide = np.searchsorted(along, at - offset + least - 1e-8), 8
    while True:
        place = start[:, None] + np.arange(wide)
        there = place < len(along)
        place = np.minimum(place, len(along) - 1)
        d = offset + along[place] - at[:, None]
        near = there & (d > least) & (d < most)
        rounded = np.where(near, np.round(d, 9), np.nan)
        two = _first_two(rounded, ids[place], np.where(near, d, np.nan), np.where(near, speed[place], np.nan))
        # what lies beyond the places looked at is farther than the second, or there is nothing beyond
        done = (start + wide >= len(along)) | (two[1][:, 1] < np.round(d[:, -1], 9)) | (d[:, -1] >= most)
        if done.all():
            return two
        wide *= 4


def nearest_along(located: DataFrame, watch: DataFrame, ahead: bool, least: float, most: float = math.inf) -> DataFrame:
    """``KEY start goal_lane lon _dist _speed``: of the vehicles on the lanes that each path watches the one at the least distance between two bounds (ties by id), null where there is none.

    ``watch`` is ``start goal_lane peer_lane offset``, as small as the map. The distance is ``offset`` and the peer's ``lon`` less the own ``lon`` if ``ahead``, else ``offset`` less the peer's ``lon``.
    A frame's vehicles are put in order by lane and each place of a path looks its first peers up there, so nothing is made of pairs.
    """
    paths: dict[str, dict[str, list]] = {}
    for r in watch.select("start", "goal_lane", "peer_lane", "offset").collect():
        paths.setdefault(r.start, {}).setdefault(r.goal_lane, []).append((r.peer_lane, float(r.offset)))
    types = dict(located.dtypes)
    sign = 1.0 if ahead else -1.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lanes = {}
        for lane, g in pdf.assign(_t=sign * pdf["lon"]).sort_values(["_t", "agent_id"]).groupby("lane", sort=False):
            t = g["_t"].to_numpy()
            seat = np.arange(len(t)) - np.searchsorted(t, t)  # the first two of a place stand for all
            lanes[lane] = tuple(c[seat < 2] for c in (t, g["agent_id"].to_numpy(), g["speed"].to_numpy(float)))
        out = []
        for start, g in pdf.groupby("lane", sort=False):
            own, lon = g["agent_id"].to_numpy(), g["lon"].to_numpy(float)
            at, each = np.unique(lon, return_inverse=True) if ahead else (np.zeros(1), np.zeros(len(g), int))
            for goal, watched in paths.get(start, {}).items():
                found = [_from(at, *lanes[lane], offset, least, most) for lane, offset in watched if lane in lanes]
                dist, speed = np.full((2, len(g)), np.nan)
                if found:
                    ids, rounded, d, v = (np.concatenate(c, 1) for c in zip(*found, strict=True))
                    ids, _, d, v = _first_two(rounded, ids, d, v)
                    take = (each, (ids[each, 0] == own).astype(int))
                    dist, speed = d[take], v[take]
                out.append(pd.DataFrame({**{c: g[c].to_numpy() for c in KEY}, "start": start, "goal_lane": goal, "lon": lon, "_dist": dist, "_speed": speed}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names})

    names = [*KEY, "start", "goal_lane", "lon", "_dist", "_speed"]
    schema = ", ".join(f"{c} {types[c]}" for c in KEY) + ", start string, goal_lane string, lon double, _dist double, _speed double"
    rows = spread(located.select(*KEY, "lane", "lon", "speed"), *FRAME).groupBy(*FRAME).applyInPandas(run, schema)
    return rows.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("_dist", "_speed")})
