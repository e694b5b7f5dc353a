"""Goal candidates of a state: every lane it may be on, searched as far as it is seen.

A search from a lane ends where the road does (``lanes.search_ends``) and at lanes outside
of junctions whose end lies outside the region the state is judged by. What the region
closes is told by the set of such lanes among those that can be reached at all, so states
are first reduced to ``start`` and ``closed``; each distinct pair is searched once, one join
a level, and joined back. The same holds for the union over a state's candidate lanes:
goals of equal places are clustered once for each distinct combination of searches.

A cluster is the place first seen; a later goal within ``TOLERANCE`` of it on both axes, plus
``RELATIVE`` of its own coordinate, joins the first such cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise.operators import lanes as road
from trackwise.shared import held, kept

TOLERANCE, RELATIVE = 3.5, 1e-5


def reaches(lanes: DataFrame, segments: DataFrame, links: DataFrame, moves: DataFrame) -> DataFrame:
    """``start spots``: per lane the lanes outside of junctions that a search from it can come to, with their ends."""
    paths = road.lane_paths(moves, lanes.select("lane"), stop=road.search_ends(lanes, links))
    open_lanes = lanes.filter("junction IS NULL").select("lane").join(road.ends(segments).select("lane", "end_x", "end_y"), "lane")
    spots = paths.join(open_lanes, "lane").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("lane", "end_x", "end_y"))).alias("spots"))
    return held(lanes.select(F.col("lane").alias("start")).join(spots, "start", "left"))


def closed_by(spots: Column, x: Column, y: Column, radius: Column) -> Column:
    """The lanes among ``spots`` that end outside of a circle; none where the circle is null."""
    outside = F.filter(spots, lambda s: F.hypot(s["end_x"] - x, s["end_y"] - y) > radius)
    return F.coalesce(F.transform(outside, lambda s: s["lane"]), F.array().cast("array<string>"))


def searched(asks: DataFrame, lanes: DataFrame, links: DataFrame, moves: DataFrame, *, max_depth: int = 20) -> DataFrame:
    """``start closed lane depth path way`` of the lanes that end the searches of ``asks`` (``start closed``), first arrivals in order of discovery (``depth way``).

    ``moves`` are the links and the lane changes; a search may come to a lane over them in
    several ways, of which the one found first counts.
    """
    ends = road.search_ends(lanes, links).withColumn("_end", F.lit(True))
    key = ["start", "closed", "lane"]
    front = asks.select("start", "closed", F.col("start").alias("lane"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.array().cast("array<int>").alias("way"))

    def told(rows: DataFrame) -> DataFrame:
        stop = F.coalesce("_end", F.lit(False)) | F.array_contains("closed", F.col("lane"))
        return held(rows.join(ends, "lane", "left").withColumn("stop", stop).select(*key, "depth", "path", "way", "stop"))

    front = told(front)
    seen = front
    for level in range(1, max_depth + 1):
        nxt = front.filter("NOT stop").join(moves.withColumnRenamed("src", "lane"), "lane").select("start", "closed", F.col("dst").alias("lane"), F.concat("path", F.array("dst")).alias("path"), F.concat("way", F.array("ord")).alias("way"))
        first = nxt.groupBy(*key).agg(F.min(F.struct("way", "path")).alias("m")).select(*key, F.lit(level).alias("depth"), "m.path", "m.way")
        front = told(first.join(seen.select(*key), key, "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("stop").drop("stop")


def near(a: Column, b: Column) -> Column:
    """Whether place ``b`` falls to a cluster first seen at ``a``; not symmetric."""
    close = lambda p, q: F.abs(p - q) <= TOLERANCE + RELATIVE * F.abs(q)
    return close(a["gx"], b["gx"]) & close(a["gy"], b["gy"])


def first_seen(goals: Column) -> Column:
    """The clusters' places, by a fold over ``goals`` in their order."""
    place = lambda g: F.struct(g["gx"].alias("gx"), g["gy"].alias("gy"))
    none = F.array().cast("array<struct<gx:double,gy:double>>")
    return F.aggregate(goals, none, lambda acc, g: F.when(F.exists(acc, lambda c: near(c, g)), acc).otherwise(F.concat(acc, F.array(place(g)))))


def cluster_of(places: Column, goal: Column) -> Column:
    """The number of the first cluster that a goal falls to, from 0."""
    numbers = F.transform(places, lambda c, i: F.when(near(c, goal), i))
    return F.array_min(numbers)


def goal_candidates(states: DataFrame, net: dict[str, DataFrame], key: list[str], *, reach: float, region: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """``key cluster start goal_lane goal_type gx gy depth path lon dist turn``: one goal a state and place, that of the best lane it can be reached from.

    ``states`` have ``key x y heading`` (and others, which are left out); ``net`` names the
    map's tables: lanes, segments, links, moves, entries, reaches. Candidate lanes are taken in
    the order of their keys. A state without a lane, or whose lanes lead nowhere, has no rows.
    """
    placed = states.select(*key, "x", "y", "heading", *([c.alias(n) for c, n in zip(region, ("_rx", "_ry", "_rr"), strict=True)] if region else []))
    on = road.lane_candidates(placed, net["segments"], reach=reach).withColumnRenamed("lane", "start").join(net["reaches"], "start")
    closed = closed_by(F.col("spots"), F.col("_rx"), F.col("_ry"), F.col("_rr")) if region else F.array().cast("array<string>")
    on = kept(on.select(*key, "start", "lon", "dist", "turn", closed.alias("closed")))
    found = searched(held(on.select("start", "closed").distinct()), net["lanes"], net["links"], net["moves"])
    goals = held(road.typed_goals(found, net["lanes"], net["segments"], net["links"], net["entries"]))
    combos = on.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "closed"))).alias("combo"))
    # of its text: a hash of nested arrays does not tell where one ends
    combos = kept(combos.withColumn("combo_id", F.xxhash64(F.to_json("combo"))))
    distinct = combos.groupBy("combo_id").agg(F.first("combo").alias("combo"))
    every = distinct.select("combo_id", F.explode("combo").alias("c")).select("combo_id", "c.start", "c.closed").join(goals, ["start", "closed"])
    item = F.struct("start", "depth", "way", "goal_lane", "goal_type", "gx", "gy", "path")
    lists = every.groupBy("combo_id").agg(F.array_sort(F.collect_list(item)).alias("goals")).withColumn("places", first_seen(F.col("goals")))
    flat = held(lists.select("combo_id", "places", F.posexplode("goals").alias("seen", "g")).select("combo_id", "seen", "g.*", cluster_of(F.col("places"), F.col("g")).alias("cluster")))
    met = combos.select(*key, "combo_id").join(on.select(*key, "start", "lon", "dist", "turn"), key).join(flat, ["combo_id", "start"])
    best = Window.partitionBy(*key, "cluster").orderBy(F.round("dist", 9), F.round(F.abs("turn"), 9), "seen")
    one = met.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1)
    return one.select(*key, "cluster", "start", "goal_lane", "goal_type", "gx", "gy", "depth", "path", "lon", "dist", "turn")


def configured_goals(candidates: DataFrame, goals: DataFrame, key: list[str], radius: float = TOLERANCE) -> DataFrame:
    """Candidates with ``goal_idx``: for each configured goal (``scenario goal_idx cx cy``) the first candidate, by cluster, within ``radius`` of it."""
    place = ["scenario", "goal_lane"]
    matches = candidates.select(*place, "gx", "gy").distinct().join(goals, "scenario").filter(F.hypot(F.col("gx") - F.col("cx"), F.col("gy") - F.col("cy")) <= radius)
    met = candidates.join(matches.select(*place, "goal_idx"), place)
    first = Window.partitionBy(*key, "goal_idx").orderBy("cluster")
    return met.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1).drop("_r")
