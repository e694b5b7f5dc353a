"""Queries of states on a literal road network: a four-arm crossing and a roundabout with three exits."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.functions import angle_diff
from trackwise.operators import lanes as op
from trackwise.operators import tracks
from trackwise.operators.posterior import r9
from trackwise.registry import query
from trackwise.shared import spread, static

LANES = """SELECT * FROM (VALUES
('w_in', 1, 10, NULL, NULL, 0.0, 48.0, 45.0, 48.0), ('w_out', 1, 11, NULL, NULL, 45.0, 52.0, 0.0, 52.0), ('e_in', 2, 20, NULL, NULL, 100.0, 52.0, 55.0, 52.0), ('e_out', 2, 21, NULL, NULL, 55.0, 48.0, 100.0, 48.0),
('s_in', 3, 30, NULL, NULL, 52.0, 0.0, 52.0, 45.0), ('s_out', 3, 31, NULL, NULL, 48.0, 45.0, 48.0, 0.0), ('n_in', 4, 40, NULL, NULL, 48.0, 100.0, 48.0, 55.0), ('n_out', 4, 41, NULL, NULL, 52.0, 55.0, 52.0, 100.0),
('j_we', 5, 50, 1, NULL, 45.0, 48.0, 55.0, 48.0), ('j_wn', 6, 60, 1, NULL, 45.0, 48.0, 52.0, 55.0), ('j_ws', 7, 70, 1, NULL, 45.0, 48.0, 48.0, 45.0), ('j_ew', 8, 80, 1, NULL, 55.0, 52.0, 45.0, 52.0),
('j_es', 9, 90, 1, NULL, 55.0, 52.0, 48.0, 45.0), ('j_en', 10, 100, 1, NULL, 55.0, 52.0, 52.0, 55.0), ('j_sn', 11, 110, 1, NULL, 52.0, 45.0, 52.0, 55.0), ('j_sw', 12, 120, 1, NULL, 52.0, 45.0, 45.0, 52.0), ('j_se', 13, 130, 1, NULL, 52.0, 45.0, 55.0, 48.0),
('j_ns', 14, 140, 1, NULL, 48.0, 55.0, 48.0, 45.0), ('j_ne', 15, 150, 1, NULL, 48.0, 55.0, 55.0, 48.0), ('j_nw', 16, 160, 1, NULL, 48.0, 55.0, 45.0, 52.0),
('r_in', 17, 170, NULL, NULL, 100.0, 48.0, 115.0, 48.0), ('r_a', 18, 180, 2, 'roundabout', 115.0, 48.0, 130.0, 33.0), ('r_b', 18, 181, 2, 'roundabout', 130.0, 33.0, 145.0, 48.0), ('r_c', 18, 182, 2, 'roundabout', 145.0, 48.0, 130.0, 63.0), ('r_d', 18, 183, 2, 'roundabout', 130.0, 63.0, 115.0, 48.0),
('x_1', 19, 190, NULL, NULL, 130.0, 33.0, 130.0, 0.0), ('x_2', 20, 200, NULL, NULL, 145.0, 48.0, 180.0, 48.0), ('x_3', 21, 210, NULL, NULL, 130.0, 63.0, 130.0, 100.0)
) AS v(lane, road, section, junction, jgroup, x0, y0, x1, y1)"""
LINKS = """SELECT * FROM (VALUES
('w_in', 'j_we', 0), ('w_in', 'j_wn', 1), ('w_in', 'j_ws', 2), ('e_in', 'j_ew', 0), ('e_in', 'j_es', 1), ('e_in', 'j_en', 2), ('s_in', 'j_sn', 0), ('s_in', 'j_sw', 1), ('s_in', 'j_se', 2), ('n_in', 'j_ns', 0), ('n_in', 'j_ne', 1), ('n_in', 'j_nw', 2),
('j_we', 'e_out', 0), ('j_wn', 'n_out', 0), ('j_ws', 's_out', 0), ('j_ew', 'w_out', 0), ('j_es', 's_out', 0), ('j_en', 'n_out', 0), ('j_sn', 'n_out', 0), ('j_sw', 'w_out', 0), ('j_se', 'e_out', 0), ('j_ns', 's_out', 0), ('j_ne', 'e_out', 0), ('j_nw', 'w_out', 0),
('e_out', 'r_in', 0), ('r_in', 'r_a', 0), ('r_a', 'r_b', 0), ('r_a', 'x_1', 1), ('r_b', 'r_c', 0), ('r_b', 'x_2', 1), ('r_c', 'r_d', 0), ('r_c', 'x_3', 1), ('r_d', 'r_a', 0)
) AS v(src, dst, ord)"""
#: Roads 1 and 2 (west-east) have priority over roads 3 and 4.
PRIORITIES = "SELECT * FROM (VALUES (1, 1, 3), (1, 1, 4), (1, 2, 3), (1, 2, 4)) AS v(junction, high, low)"
REACH = 6.0
FRAME = tracks.FRAME
KEY = [*FRAME, "agent_id"]


class Net:
    """The literal network as the operators' tables; what is derived from the map alone is computed once."""

    def __init__(self, spark: SparkSession):
        raw = spark.sql(LANES)
        self.lanes = raw.select("lane", "road", "section", "junction", "jgroup")
        self.segments = static(op.with_arc_length(raw.select("lane", F.lit(0).alias("seg"), "x0", "y0", "x1", "y1")))
        self.links = spark.sql(LINKS)
        self.priorities = spark.sql(PRIORITIES)
        self.entries = op.junction_entries(self.lanes, self.links, self.segments, self.priorities)
        self.flags = op.junction_flags(self.lanes, self.links)

    @cached_property
    def paths(self) -> DataFrame:
        return static(op.reachable_goals(self.lanes, self.segments, self.links, self.entries))

    def goals(self) -> DataFrame:
        return self.paths

    @cached_property
    def table(self) -> DataFrame:
        return static(op.path_table(self.paths, self.lanes, self.segments))

    @cached_property
    def facts(self) -> DataFrame:
        return static(op.path_facts(self.table))

    @cached_property
    def crossed(self) -> DataFrame:
        """``start goal_lane lane other cross_s_other``: where paths cross lanes that they have no priority over."""
        conflicts = op.conflict_lanes(self.lanes, self.links, crossings(self), self.priorities)
        return static(self.paths.select("start", "goal_lane", F.explode("path").alias("lane")).join(conflicts, "lane").select("start", "goal_lane", "lane", "other", "cross_s_other"))

    @cached_property
    def upstream(self) -> DataFrame:
        return static(op.upstream(self.links, self.segments, self.lanes))


@lru_cache(maxsize=1)
def net_of(spark: SparkSession) -> Net:
    """The network's tables of a session."""
    return Net(spark)


def _states(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.each_second(probes.states(spark, sf), probes.FPS).select(*KEY, "x", "y", "heading", "speed")


def _located(spark: SparkSession, sf: str, net: Net) -> DataFrame:
    return op.best_lane(op.lane_candidates(_states(spark, sf), net.segments, reach=REACH), KEY)


S = f"s AS (SELECT episode, agent_id, frame_id, x, y, heading, speed FROM ({probes.STATES}) WHERE frame_id % {probes.FPS} = 0)"
L = f"""l AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, atan2(y1 - y0, x1 - x0) AS lh FROM ({LANES})), k AS ({LINKS}), pr AS ({PRIORITIES})"""
CAND = f"""c0 AS (SELECT s.*, lane, len, lh, x0, y0, x1, y1, least(1.0, greatest(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (len * len))) AS t, heading - lh AS d FROM s, l),
c1 AS (SELECT *, t * len AS lon, sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))) AS dist, d - 2 * pi() * floor((d + pi()) / (2 * pi())) AS turn FROM c0),
c AS (SELECT * FROM c1 WHERE dist <= {REACH} AND abs(turn) <= pi() / 4 + 1e-9),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode, agent_id, frame_id ORDER BY round(dist, 9), round(abs(turn), 9), lane) AS rn FROM c) WHERE rn = 1)"""
#: Static goals: paths as text, first arrivals only; lanes that end a search are stops.
GOALS = """st AS (SELECT lane FROM l WHERE (junction IS NOT NULL AND jgroup IS NULL) OR lane IN ('x_1', 'x_2', 'x_3') OR lane NOT IN (SELECT src FROM k)),
pa AS (WITH RECURSIVE p AS (SELECT lane AS start, lane, 0 AS depth, '/' || lane || '/' AS path, '' AS way FROM l UNION ALL
  SELECT p.start, k.dst, p.depth + 1, p.path || k.dst || '/', p.way || k.ord FROM p JOIN k ON k.src = p.lane WHERE p.path NOT LIKE '%/' || k.dst || '/%' AND (p.depth = 0 OR p.lane NOT IN (SELECT lane FROM st))) SELECT * FROM p),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start, lane ORDER BY depth, way) AS rn FROM pa) WHERE rn = 1),
ent AS (SELECT DISTINCT a.dst AS lane FROM k a JOIN l la ON la.lane = a.src JOIN l ja ON ja.lane = a.dst AND ja.junction IS NOT NULL JOIN k ao ON ao.src = a.dst JOIN k bo ON bo.dst = ao.dst AND bo.src <> ao.src JOIN k b ON b.dst = bo.src JOIN l lb ON lb.lane = b.src JOIN pr ON pr.junction = ja.junction AND pr.high = lb.road AND pr.low = la.road),
g0 AS (SELECT fa.*, l.junction, l.x1 AS gx, l.y1 AS gy, coalesce((SELECT min(n.lh) FROM k JOIN l n ON n.lane = k.dst WHERE k.src = fa.lane), l.lh) AS eh, CASE WHEN depth > 0 THEN (SELECT pl.lh FROM l pl WHERE pl.lane = string_split(trim(path, '/'), '/')[-2]) ELSE l.lh END AS sh FROM fa JOIN st ON st.lane = fa.lane JOIN l ON l.lane = fa.lane),
g1 AS (SELECT *, (eh - sh) - 2 * pi() * floor(((eh - sh) + pi()) / (2 * pi())) AS tn FROM g0),
g AS (SELECT start, lane AS goal_lane, gx, gy, path, depth, CASE WHEN lane IN ('x_1', 'x_2', 'x_3') THEN 'exit-roundabout' WHEN junction IS NULL THEN 'straight-on'
  WHEN tn > pi() / 8 AND tn < 7 * pi() / 8 THEN CASE WHEN lane IN (SELECT lane FROM ent) THEN 'enter-left' ELSE 'exit-left' END WHEN tn < -pi() / 8 AND tn > -7 * pi() / 8 THEN CASE WHEN lane IN (SELECT lane FROM ent) THEN 'enter-right' ELSE 'exit-right' END
  WHEN abs(tn) <= pi() / 8 THEN CASE WHEN lane IN (SELECT lane FROM ent) THEN 'cross-road' ELSE 'straight-on' END ELSE 'u-turn' END AS goal_type FROM g1)"""


@query(f"WITH {S}, {L}, {CAND} SELECT agent_id, frame_id, lane, round(lon, 9) AS lon, round(dist, 9) AS dist, round(turn, 9) AS turn FROM c")
def lane_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """O-19, O-22, O-50: lanes near a state in its direction, by a grid-cell equi join."""
    c = op.lane_candidates(_states(spark, sf), net_of(spark).segments, reach=REACH)
    return c.select("agent_id", "frame_id", "lane", r9("lon").alias("lon"), r9("dist").alias("dist"), r9("turn").alias("turn"))


@query(f"WITH {S}, {L}, {CAND} SELECT agent_id, frame_id, lane, round(dist, 9) AS dist FROM b")
def best_lanes(spark: SparkSession, sf: str) -> DataFrame:
    """O-76."""
    return _located(spark, sf, net_of(spark)).select("agent_id", "frame_id", "lane", r9("dist").alias("dist"))


@query(f"WITH {S}, {L}, {CAND}, {GOALS} SELECT agent_id, frame_id, b.lane, goal_lane, goal_type, CAST(depth AS INT) AS depth, round(atan2(gy - y, gx - x), 9) AS bearing FROM b JOIN g ON g.start = b.lane")
def goals_per_state(spark: SparkSession, sf: str) -> DataFrame:
    """O-27, O-28, O-53, O-57, O-58, O-59, O-60: typed goals reachable from each state's lane."""
    net = net_of(spark)
    met = _located(spark, sf, net).join(F.broadcast(net.goals()), F.col("lane") == F.col("start"))
    return met.select("agent_id", "frame_id", "lane", "goal_lane", "goal_type", "depth", r9(F.atan2(F.col("gy") - F.col("y"), F.col("gx") - F.col("x"))).alias("bearing"))


_PATHLEN = "ps AS (SELECT g.start, g.goal_lane, sum(l.len) AS path_length, min(CASE WHEN l.junction IS NOT NULL THEN strpos(g.path, '/' || l.lane || '/') END) AS jp FROM g JOIN l ON g.path LIKE '%/' || l.lane || '/%' GROUP BY 1, 2)"


@query(f"""WITH {S}, {L}, {CAND}, {GOALS}, {_PATHLEN}, r AS (SELECT b.*, g.goal_lane, g.goal_type, g.gx, g.gy, g.path, ps.path_length, ps.jp, atan2(gy - y, gx - x) AS be FROM b JOIN g ON g.start = b.lane JOIN ps ON ps.start = g.start AND ps.goal_lane = g.goal_lane)
SELECT agent_id, frame_id, goal_lane, round(path_length - lon, 9) AS path_to_goal_length, round(turn, 9) AS angle_in_lane, true AS in_correct_lane, string_split(substr(path, CAST(jp AS INT) + 1), '/')[1] AS junction_lane,
round((heading - be) - 2 * pi() * floor(((heading - be) + pi()) / (2 * pi())), 6) AS angle_to_goal FROM r""")
def route_features(spark: SparkSession, sf: str) -> DataFrame:
    """O-20, O-21, O-24, O-25, O-26."""
    net = net_of(spark)
    goals = net.goals()
    facts = net.facts
    met = _located(spark, sf, net).join(F.broadcast(goals.join(facts, ["start", "goal_lane"])), F.col("lane") == F.col("start"))
    to_goal = F.round(angle_diff(F.atan2(F.col("gy") - F.col("y"), F.col("gx") - F.col("x")), F.col("heading")), 6)
    return met.select("agent_id", "frame_id", "goal_lane", r9(F.col("path_length") - F.col("lon")).alias("path_to_goal_length"), r9("turn").alias("angle_in_lane"), "in_correct_lane", "junction_lane", to_goal.alias("angle_to_goal"))


def _nearest_watched(located: DataFrame, watch: DataFrame, distance: Column, near: Column) -> DataFrame:
    """``lanes.nearest_along`` by joins, for any ``distance`` and ``near``: its rows grow with the square of a frame's places.

    ``watch`` has ``start goal_lane peer_lane`` and what ``distance`` asks beside ``lon`` and the peer's ``_lon``. Vehicles at one place of a lane look at the
    same, but for themselves: places meet the places of watched lanes, of which the first two vehicles stand for all, and two peers are kept for each path,
    the second for the vehicle that would be its own peer.
    """
    at = [*FRAME, "lane", "lon"]
    seat = F.row_number().over(Window.partitionBy(*at).orderBy("agent_id"))
    alone = F.when(F.count("*").over(Window.partitionBy(*at)) == 1, F.col("agent_id"))
    seats = spread(located.select(*at, "agent_id", "speed").withColumn("_seat", seat).withColumn("_alone", alone).filter(F.col("_seat") <= 2), *FRAME)
    place = [*FRAME, "start", "lon", "goal_lane"]
    own = seats.filter(F.col("_seat") == 1).select(*FRAME, F.col("lane").alias("start"), "lon", "_alone").join(F.broadcast(watch), "start")
    peer = seats.select(*FRAME, F.col("agent_id").alias("peer_id"), F.col("lane").alias("peer_lane"), F.col("lon").alias("_lon"), F.col("speed").alias("_v"))
    met = own.join(peer, [*FRAME, "peer_lane"]).filter(F.col("_alone").isNull() | (F.col("_alone") != F.col("peer_id"))).withColumn("_d", distance).filter(near)
    first = F.dense_rank().over(Window.partitionBy(*place).orderBy(F.round("_d", 9), "peer_id"))
    two = met.select(*place, "peer_id", "_d", "_v").withColumn("_n", first).filter(F.col("_n") <= 2)
    kth = lambda c, n: F.min(F.when(F.col("_n") == n, F.col(c))).alias(f"{c}{n}")
    found = two.groupBy(*place).agg(*[kth(c, n) for n in (1, 2) for c in ("peer_id", "_d", "_v")])
    every = located.select(*KEY, F.col("lane").alias("start"), "lon").join(F.broadcast(watch.select("start", "goal_lane").distinct()), "start").join(found, place, "left")
    itself = F.col("peer_id1") == F.col("agent_id")
    return every.select(*KEY, "start", "goal_lane", "lon", *[F.when(itself, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n) for c, n in (("_d", "_dist"), ("_v", "_speed"))])


def in_front(located: DataFrame, table: DataFrame) -> DataFrame:
    """Nearest vehicle ahead on each path: ``front_dist front_speed``, 100 and 20 where there is none."""
    watch = table.select("start", "goal_lane", F.col("lane").alias("peer_lane"), F.col("s_before").alias("offset"))
    near = op.nearest_along(located, watch, True, 1e-4)
    return near.select(*KEY, "start", "goal_lane", "lon", F.coalesce("_dist", F.lit(100.0)).alias("front_dist"), F.coalesce("_speed", F.lit(20.0)).alias("front_speed"))


_SB = "sb AS (SELECT g.start, g.goal_lane, l.lane, coalesce((SELECT sum(q.len) FROM l q WHERE strpos(g.path, '/' || q.lane || '/') > 0 AND strpos(g.path, '/' || q.lane || '/') < strpos(g.path, '/' || l.lane || '/')), 0) AS s_before FROM g JOIN l ON g.path LIKE '%/' || l.lane || '/%')"


AHEAD = """m AS (SELECT a.episode, a.agent_id, a.frame_id, sb.goal_lane, p.speed, p.agent_id AS pid, sb.s_before + p.lon - a.lon AS dd FROM b a JOIN b p ON p.episode = a.episode AND p.frame_id = a.frame_id AND p.agent_id <> a.agent_id JOIN sb ON sb.start = a.lane AND sb.lane = p.lane WHERE sb.s_before + p.lon - a.lon > 1e-4),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode, agent_id, frame_id, goal_lane ORDER BY round(dd, 9), pid) AS rn FROM m) WHERE rn = 1)"""


@query(f"""WITH {S}, {L}, {CAND}, {GOALS}, {_SB}, {AHEAD}
SELECT a.agent_id, a.frame_id, g.goal_lane, round(coalesce(n.dd, 100), 9) AS front_dist, round(coalesce(n.speed, 20), 9) AS front_speed FROM b a JOIN g ON g.start = a.lane LEFT JOIN n ON n.episode = a.episode AND n.agent_id = a.agent_id AND n.frame_id = a.frame_id AND n.goal_lane = g.goal_lane""")
def vehicles_in_front(spark: SparkSession, sf: str) -> DataFrame:
    """O-48, O-49, O-77."""
    net = net_of(spark)
    f = in_front(_located(spark, sf, net), net.table)
    return f.select("agent_id", "frame_id", "goal_lane", r9("front_dist").alias("front_dist"), r9("front_speed").alias("front_speed"))


def crossings(net: Net) -> DataFrame:
    """Where two straight junction lanes cross: ``lane other area cross_s cross_s_other``; area is that of 3 m wide lanes, 9 over the sine of their angle."""
    seg = net.segments.join(net.lanes.filter(F.col("junction") == 1).select("lane"), "lane")
    o = seg.select(*[F.col(c).alias(f"_{c}") for c in ("lane", "x0", "y0", "x1", "y1", "len")])
    dx, dy, ex, ey = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    det = dx * ey - dy * ex
    met = seg.join(F.broadcast(o), F.col("lane") != F.col("_lane")).withColumn("_det", F.nullif(F.round(det, 9), F.lit(0.0))).filter(F.col("_det").isNotNull())
    t = ((F.col("_x0") - F.col("x0")) * ey - (F.col("_y0") - F.col("y0")) * ex) / F.col("_det")
    u = ((F.col("_x0") - F.col("x0")) * dy - (F.col("_y0") - F.col("y0")) * dx) / F.col("_det")
    met = met.withColumn("_t", t).withColumn("_u", u).filter(F.col("_t").between(0, 1) & F.col("_u").between(0, 1))
    return met.select("lane", F.col("_lane").alias("other"), (9 * F.col("len") * F.col("_len") / F.abs("_det")).alias("area"), (F.col("_t") * F.col("len")).alias("cross_s"), (F.col("_u") * F.col("_len")).alias("cross_s_other"))


def oncoming(located: DataFrame, net: Net, goals: DataFrame) -> DataFrame:
    """Nearest vehicle upstream of a crossing with a lane we do not have priority over: ``oncoming_dist oncoming_speed``, 100 and 20 where there is none within 100."""
    paths = net.crossed.join(net.upstream.withColumnRenamed("lane", "other"), "other")
    watch = static(paths.select("start", "goal_lane", F.col("up").alias("peer_lane"), (F.col("gap") + F.col("cross_s_other")).alias("offset")).distinct())
    near = op.nearest_along(located, watch, False, 0.0, 100.0).select(*KEY, "goal_lane", "_dist", "_speed")
    free = static(goals.select("start", "goal_lane").distinct().join(watch, ["start", "goal_lane"], "left_anti"))
    none = located.select(*KEY, F.col("lane").alias("start")).join(F.broadcast(free), "start").select(*KEY, "goal_lane", *[F.lit(None).cast("double").alias(c) for c in ("_dist", "_speed")])
    return near.unionByName(none).select(*KEY, "goal_lane", F.coalesce("_dist", F.lit(100.0)).alias("oncoming_dist"), F.coalesce("_speed", F.lit(20.0)).alias("oncoming_speed"))


#: Crossings (cf) of junction lanes with those they have no priority over, and upstream lanes (up).
CROSSED = """ic AS (SELECT k.dst AS lane, k.src AS from_lane, l.road FROM k JOIN l ON l.lane = k.src),
jl AS (SELECT l.*, ic.from_lane, ic.road AS in_road FROM l JOIN ic ON ic.lane = l.lane WHERE l.junction IS NOT NULL),
cx AS (SELECT a.lane, b.lane AS other, a.len AS la, b.len AS lb, round((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0), 9) AS det, (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) AS tn, (b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0) AS un FROM jl a JOIN jl b ON a.junction = b.junction AND a.lane <> b.lane AND a.from_lane <> b.from_lane
 WHERE a.junction = 1 AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.junction = a.junction AND pr.high = a.in_road AND pr.low = b.in_road)),
cf AS (SELECT DISTINCT lane, other, un / det * lb AS cross_s_other FROM cx WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1 AND 9 * la * lb / abs(det) > 1),
fp AS (SELECT dst AS lane, arg_min(src, lpad(CAST(ord AS VARCHAR), 4, '0') || src) AS prev FROM k GROUP BY 1),
up AS (WITH RECURSIVE u AS (SELECT lane, lane AS up, CAST(0.0 AS DOUBLE) AS gap FROM l UNION ALL SELECT u.lane, fp.prev, u.gap + q.len FROM u JOIN fp ON fp.lane = u.up JOIN l q ON q.lane = fp.prev WHERE u.gap < 100) SELECT * FROM u)"""
ONCOMING = """wt AS (SELECT g.start, g.goal_lane, up.up AS peer_lane, up.gap + cf.cross_s_other AS c FROM g JOIN cf ON g.path LIKE '%/' || cf.lane || '/%' JOIN up ON up.lane = cf.other),
om0 AS (SELECT a.episode, a.agent_id, a.frame_id, wt.goal_lane, p.speed, p.agent_id AS pid, wt.c - p.lon AS d FROM b a JOIN b p ON p.episode = a.episode AND p.frame_id = a.frame_id AND p.agent_id <> a.agent_id JOIN wt ON wt.start = a.lane AND wt.peer_lane = p.lane WHERE wt.c - p.lon > 0 AND wt.c - p.lon < 100),
on1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY episode, agent_id, frame_id, goal_lane ORDER BY round(d, 9), pid) AS rn FROM om0) WHERE rn = 1),
oc AS (SELECT a.episode, a.agent_id, a.frame_id, a.lane AS start, g.goal_lane, coalesce(on1.d, 100) AS oncoming_dist, coalesce(on1.speed, 20) AS oncoming_speed FROM b a JOIN g ON g.start = a.lane LEFT JOIN on1 ON on1.episode = a.episode AND on1.agent_id = a.agent_id AND on1.frame_id = a.frame_id AND on1.goal_lane = g.goal_lane)"""


@query(f"WITH {S}, {L}, {CAND}, {GOALS}, {CROSSED}, {ONCOMING} SELECT agent_id, frame_id, goal_lane, round(oncoming_dist, 9) AS oncoming_dist, round(oncoming_speed, 9) AS oncoming_speed FROM oc")
def oncoming_vehicles(spark: SparkSession, sf: str) -> DataFrame:
    """O-51, O-52, O-56, O-78; the nearest oncoming vehicle wins."""
    net = net_of(spark)
    return oncoming(_located(spark, sf, net), net, net.goals()).select("agent_id", "frame_id", "goal_lane", r9("oncoming_dist").alias("oncoming_dist"), r9("oncoming_speed").alias("oncoming_speed"))


EXITS = "e AS (SELECT start, goal_lane, CASE WHEN goal_type = 'exit-roundabout' AND path LIKE '%/r_in/%' THEN row_number() OVER (PARTITION BY start ORDER BY CASE WHEN goal_type = 'exit-roundabout' AND path LIKE '%/r_in/%' THEN 0 ELSE 1 END, len(string_split(path, '/')), goal_lane) ELSE 0 END AS exit_number FROM g)"


@query(f"""WITH {S}, {L}, {CAND}, {GOALS}, {EXITS}
SELECT agent_id, frame_id, goal_lane, exit_number, exit_number = 0 AS exit_number_missing FROM b JOIN e ON e.start = b.lane""")
def exit_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """O-84."""
    net = net_of(spark)
    nums = op.exit_numbers(net.goals(), net.flags, net.lanes)
    return _located(spark, sf, net).join(F.broadcast(nums), F.col("lane") == F.col("start")).select("agent_id", "frame_id", "goal_lane", "exit_number", (F.col("exit_number") == 0).alias("exit_number_missing"))


@query(f"""WITH {S}, {L}, {CAND}, {GOALS}, cf AS (SELECT * FROM (VALUES (0, 55.0, 48.0), (1, 52.0, 55.0), (2, 45.0, 52.0), (3, 48.0, 45.0), (4, 500.0, 500.0)) AS v(goal_idx, cx, cy)),
m AS (SELECT b.agent_id, b.frame_id, cf.goal_idx, g.goal_lane, g.goal_type, row_number() OVER (PARTITION BY b.agent_id, b.frame_id, cf.goal_idx ORDER BY g.depth, g.goal_lane) AS rn FROM b JOIN g ON g.start = b.lane JOIN cf ON sqrt((gx - cx) * (gx - cx) + (gy - cy) * (gy - cy)) <= 3.5)
SELECT b.agent_id, b.frame_id, cf.goal_idx, m.goal_lane, m.goal_type FROM b CROSS JOIN cf LEFT JOIN m ON m.agent_id = b.agent_id AND m.frame_id = b.frame_id AND m.goal_idx = cf.goal_idx AND m.rn = 1""")
def typed_goal_matches(spark: SparkSession, sf: str) -> DataFrame:
    """O-55: the first generated goal within 3.5 of each configured goal, null if none."""
    net = net_of(spark)
    conf = spark.sql("SELECT * FROM (VALUES (0, 55.0, 48.0), (1, 52.0, 55.0), (2, 45.0, 52.0), (3, 48.0, 45.0), (4, 500.0, 500.0)) AS v(goal_idx, cx, cy)")
    near = net.goals().join(F.broadcast(conf), F.hypot(F.col("gx") - F.col("cx"), F.col("gy") - F.col("cy")) <= 3.5)
    w = Window.partitionBy("start", "goal_idx").orderBy("depth", "goal_lane")
    first = near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select(F.col("start").alias("lane"), "goal_idx", "goal_lane", "goal_type")
    grid = _located(spark, sf, net).select("agent_id", "frame_id", "lane").crossJoin(F.broadcast(conf.select("goal_idx")))  # five configured goals
    return grid.join(F.broadcast(first), ["lane", "goal_idx"], "left").select("agent_id", "frame_id", "goal_idx", "goal_lane", "goal_type")
