"""Queries of vehicles that drive two towns with the same episode and agent numbers."""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import candidates as cand_op
from trackwise.operators import lanes as op
from trackwise.operators import occlusion, polygons, samples, tracks
from trackwise.operators.posterior import r9
from trackwise.queries.occlusion import BUILDING, COVER, QUADS, buildings
from trackwise.registry import query
from trackwise.shared import held, kept, shared_folder
from trackwise.sources import tables

FPS = probes.FPS
KEY = [*tracks.FRAME, "agent_id"]
REACH = 6.0


class Town:
    """The towns' tables; what is derived from the maps alone is computed once."""

    def __init__(self, spark: SparkSession):
        table = lambda name: held(spark.sql(probes.TOWN[name]))
        self.lanes, self.links, self.priorities, self.goals = table("lanes"), table("links").select("src", "dst", "ord"), table("priorities").drop("scenario"), table("goals")
        self.moves = held(self.links.unionByName(table("changes").select("src", "dst", "ord")))
        self.segments = held(op.with_arc_length(spark.sql(probes.TOWN["segments"])))
        self.edges = held(polygons.ring_edges(spark.sql(probes.TOWN["corners"]).drop("scenario")))
        self.entries = held(op.junction_entries(self.lanes, self.links, self.segments, self.priorities))

    @cached_property
    def reaches(self) -> DataFrame:
        return cand_op.reaches(self.lanes, self.segments, self.links, self.moves)

    @cached_property
    def searches(self) -> DataFrame:
        """``start goal_lane goal_type gx gy depth path`` of every lane, without a region."""
        none = self.lanes.select(F.col("lane").alias("start"), F.array().cast("array<string>").alias("closed"))
        found = cand_op.searched(none, self.lanes, self.links, self.moves)
        return held(op.typed_goals(found, self.lanes, self.segments, self.links, self.entries).drop("closed", "way"))

    @cached_property
    def table(self) -> DataFrame:
        return held(op.path_table(self.searches, self.lanes, self.segments))

    @cached_property
    def watched(self) -> DataFrame:
        """``start goal_lane lane at``: the lanes to be watched for vehicles that have not to give way to a path, and the way from their start to where they cross it."""
        conflicts = op.conflict_lanes(self.lanes, self.links, op.lane_crossings(self.segments, self.lanes), self.priorities)
        crossed = self.searches.select("start", "goal_lane", F.explode("path").alias("lane")).join(conflicts, "lane").select("start", "goal_lane", "other", "cross_s_other")
        back = op.upstream(self.links, self.segments, self.lanes).withColumnRenamed("lane", "other")
        return held(crossed.join(back, "other").select("start", "goal_lane", F.col("up").alias("lane"), (F.col("gap") + F.col("cross_s_other")).alias("at")))

    def maps(self) -> samples.Maps:
        flags = op.junction_flags(self.lanes, self.links)
        return samples.Maps(
            tables=self.parts(), edges=self.edges, goals=self.goals, paths=self.searches, path_table=self.table, path_facts=held(op.path_lengths(self.searches, self.lanes, self.segments)),
            exits=held(op.exit_numbers(self.searches, flags, self.lanes)), watched=self.watched,
        )

    def parts(self) -> dict[str, DataFrame]:
        return {"lanes": self.lanes, "segments": self.segments, "links": self.links, "moves": self.moves, "entries": self.entries, "reaches": self.reaches}


@lru_cache(maxsize=1)
def town_of(spark: SparkSession) -> Town:
    return Town(spark)


def _seconds(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.each_second(probes.drives(spark, sf), FPS)


#: The maps: lanes (l), segments (g) with arc lengths and headings, ends (lx), links (k), links and lane changes (mv), ends of searches (st), entries (ent).
MAPS = f"""l AS ({probes.TOWN["lanes"]}), g0 AS ({probes.TOWN["segments"]}), k AS ({probes.TOWN["links"]}), mv AS (SELECT * FROM k UNION ALL {probes.TOWN["changes"]}), pr AS ({probes.TOWN["priorities"]}),
g1 AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len, atan2(y1 - y0, x1 - x0) AS h FROM g0),
g AS (SELECT *, sum(len) OVER (PARTITION BY lane ORDER BY seg) - len AS s0 FROM g1),
lx AS (SELECT lane, sum(len) AS length, arg_min(h, seg) AS sh, arg_max(h, seg) AS eh, arg_max(x1, seg) AS ex, arg_max(y1, seg) AS ey FROM g GROUP BY lane),
lv AS (SELECT DISTINCT k.dst AS lane FROM k JOIN l a ON a.lane = k.src AND a.jgroup = 'roundabout' JOIN l b ON b.lane = k.dst AND b.jgroup IS NULL),
st AS (SELECT lane FROM l WHERE junction IS NOT NULL AND jgroup IS NULL UNION SELECT lane FROM lv UNION SELECT lane FROM l WHERE lane NOT IN (SELECT src FROM k)),
ent AS (SELECT DISTINCT a.dst AS lane FROM k a JOIN l la ON la.lane = a.src JOIN l ja ON ja.lane = a.dst AND ja.junction IS NOT NULL JOIN k ao ON ao.src = a.dst JOIN k bo ON bo.dst = ao.dst AND bo.src <> ao.src JOIN l jb ON jb.lane = bo.src AND jb.junction = ja.junction JOIN k b ON b.dst = bo.src JOIN l lb ON lb.lane = b.src JOIN pr ON pr.junction = ja.junction AND pr.high = lb.road AND pr.low = la.road)"""
#: Candidate lanes (c) of states (s).
ON_LANES = f"""c0 AS (SELECT s.*, g.lane, g.seg, g.x0, g.y0, x1, y1, s0, len, h, greatest(0.0, least(1.0, ((x - g.x0) * (x1 - g.x0) + (y - g.y0) * (y1 - g.y0)) / (len * len))) AS t, heading - h AS d FROM s JOIN g ON g.scenario = s.scenario),
c1 AS (SELECT *, s0 + t * len AS lon, sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))) AS dist, d - 2 * pi() * floor((d + pi()) / (2 * pi())) AS turn FROM c0),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, episode, agent_id, frame_id, lane ORDER BY dist, seg) AS rn FROM c1 WHERE dist <= {REACH} AND abs(turn) <= pi() / 4 + 1e-9) WHERE rn = 1)"""


def _searches(who: str, asks: str, closed: str) -> str:
    """Goals (go) of ``asks`` (columns ``who``, start): simple paths over lanes that are not closed, first arrivals, typed."""
    w = ", ".join(who)
    p = ", ".join(f"p.{c}" for c in who)
    return f"""pa AS (WITH RECURSIVE p AS (SELECT {w}, start, start AS lane, 0 AS depth, '/' || start || '/' AS path, '' AS way FROM {asks}
  UNION ALL SELECT {p}, p.start, mv.dst, p.depth + 1, p.path || mv.dst || '/', p.way || mv.ord FROM p JOIN mv ON mv.src = p.lane JOIN l ON l.lane = p.lane JOIN lx ON lx.lane = p.lane
  WHERE p.path NOT LIKE '%/' || mv.dst || '/%' AND p.lane NOT IN (SELECT lane FROM st) AND NOT (l.junction IS NULL AND {closed})) SELECT * FROM p),
fa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {w}, start, lane ORDER BY depth, way) AS rn FROM pa) WHERE rn = 1),
ty AS (SELECT p.*, l.junction, lx.ex AS gx, lx.ey AS gy, coalesce((SELECT min(n.sh) FROM k JOIN lx n ON n.lane = k.dst WHERE k.src = p.lane), lx.eh) - (SELECT q.eh FROM lx q WHERE q.lane = CASE WHEN depth > 0 THEN string_split(trim(path, '/'), '/')[-2] ELSE p.lane END) AS dh
  FROM fa p JOIN l ON l.lane = p.lane JOIN lx ON lx.lane = p.lane WHERE p.lane IN (SELECT lane FROM st) OR (l.junction IS NULL AND {closed})),
tz AS (SELECT *, dh - 2 * pi() * floor((dh + pi()) / (2 * pi())) AS tn, lane IN (SELECT lane FROM ent) AS entry FROM ty),
go AS (SELECT {w}, start, lane AS goal_lane, depth, way, path, gx, gy, CASE WHEN lane IN (SELECT lane FROM lv) THEN 'exit-roundabout' WHEN junction IS NULL THEN 'straight-on'
  WHEN abs(tn) > pi() / 8 AND abs(tn) < 7 * pi() / 8 THEN CASE WHEN entry THEN 'enter-' ELSE 'exit-' END || CASE WHEN tn > 0 THEN 'left' ELSE 'right' END
  WHEN abs(tn) <= pi() / 8 THEN CASE WHEN entry THEN 'cross-road' ELSE 'straight-on' END ELSE 'u-turn' END AS goal_type FROM tz)"""


_STATE = ["scenario", "episode", "agent_id", "frame_id"]
_W = ", ".join(_STATE)
#: Goals of states clustered by place, first seen first, and the goal of the best lane in each cluster (cd).
CLUSTERS = f"""ix AS (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY start, depth, way, goal_lane) AS i FROM go),
fo AS (WITH RECURSIVE f AS (SELECT {_W}, i, [{{'gx': gx, 'gy': gy}}] AS places FROM ix WHERE i = 1
  UNION ALL SELECT ix.scenario, ix.episode, ix.agent_id, ix.frame_id, ix.i, CASE WHEN len(list_filter(places, lambda z: abs(z.gx - ix.gx) <= 3.5 + 1e-5 * abs(ix.gx) AND abs(z.gy - ix.gy) <= 3.5 + 1e-5 * abs(ix.gy))) > 0 THEN places ELSE list_append(places, {{'gx': ix.gx, 'gy': ix.gy}}) END
  FROM f JOIN ix ON ix.scenario = f.scenario AND ix.episode = f.episode AND ix.agent_id = f.agent_id AND ix.frame_id = f.frame_id AND ix.i = f.i + 1) SELECT * FROM f),
fz AS (SELECT {_W}, arg_max(places, i) AS places FROM fo GROUP BY {_W}),
pl AS (SELECT {_W}, unnest(range(len(places))) AS cluster, unnest(places) AS z FROM fz),
cl0 AS (SELECT ix.*, min(pl.cluster) AS cluster FROM ix JOIN pl USING ({_W}) WHERE abs(z.gx - gx) <= 3.5 + 1e-5 * abs(gx) AND abs(z.gy - gy) <= 3.5 + 1e-5 * abs(gy) GROUP BY ALL),
cd AS (SELECT * FROM (SELECT cl0.*, c.lon, c.dist, c.turn, row_number() OVER (PARTITION BY {", ".join("cl0." + x for x in _STATE)}, cluster ORDER BY round(c.dist, 9), round(abs(c.turn), 9), i) AS best FROM cl0 JOIN c ON c.scenario = cl0.scenario AND c.episode = cl0.episode AND c.agent_id = cl0.agent_id AND c.frame_id = cl0.frame_id AND c.lane = cl0.start) WHERE best = 1)"""
S = f"s AS (SELECT * FROM ({probes.DRIVES}) WHERE frame_id % {FPS} = 0)"


def view_radius(agent: str = "agent_id"):
    """How far a vehicle is looked around: 12, 26 or 40; without limit for every fourth."""
    return F.when(F.col(agent) % 4 != 0, 12.0 + 14.0 * (F.col(agent) % 3))


@query(f"""WITH {S}, {MAPS}, {ON_LANES}, ak AS (SELECT {_W}, x AS rx, y AS ry, CASE WHEN agent_id % 4 <> 0 THEN 12.0 + 14.0 * (agent_id % 3) END AS rr, lane AS start FROM c),
{_searches([*_STATE, "rx", "ry", "rr"], "ak", "coalesce(sqrt((lx.ex - rx) * (lx.ex - rx) + (lx.ey - ry) * (lx.ey - ry)) > rr, false)")}, {CLUSTERS}
SELECT {_W}, CAST(cluster AS INT) AS cluster, start, goal_lane, goal_type, CAST(depth AS INT) AS depth, trim(path, '/') AS path, round(lon, 9) AS lon FROM cd""")
def goals_in_sight(spark: SparkSession, sf: str) -> DataFrame:
    """O-46, O-57, O-60: goals of every state over all its candidate lanes, within a circle around it, clustered by place."""
    town = town_of(spark)
    s = _seconds(spark, sf)
    found = cand_op.goal_candidates(s, town.parts(), KEY, reach=REACH, region=(F.col("x"), F.col("y"), view_radius()))
    return found.select(*_STATE, "cluster", "start", "goal_lane", "goal_type", "depth", F.array_join("path", "/").alias("path"), r9("lon").alias("lon"))


RADIUS = 3.5
#: Paths without a region (go0), their lanes (pt) with the way before each, lengths (pf), exits (ex) and watched lanes (wt).
PATHS = f"""{_searches(["one"], "(SELECT 1 AS one, lane AS start FROM l)", "false").replace("go AS", "go0 AS")},
pp AS (SELECT start, goal_lane, path, unnest(range(len(string_split(trim(path, '/'), '/')))) AS pos, unnest(string_split(trim(path, '/'), '/')) AS lane FROM go0),
pq2 AS (SELECT pp.*, l.section, lx.length, lead(l.section) OVER w AS nxt, lag(l.section) OVER w AS prv, lead(pp.lane) OVER w IS NULL AS is_last, (lx.eh - lx.sh) - 2 * pi() * floor(((lx.eh - lx.sh) + pi()) / (2 * pi())) AS bend FROM pp JOIN l ON l.lane = pp.lane JOIN lx ON lx.lane = pp.lane WINDOW w AS (PARTITION BY start, goal_lane ORDER BY pos)),
pt AS (SELECT *, coalesce(sum(CASE WHEN nxt IS NOT DISTINCT FROM section THEN 0 ELSE length END) OVER (PARTITION BY start, goal_lane ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before FROM pq2),
pf AS (SELECT start, goal_lane, sum(CASE WHEN prv IS NOT DISTINCT FROM section AND NOT is_last THEN 0 ELSE length END) AS path_length, NOT bool_or(prv IS NOT DISTINCT FROM section) AS in_correct_lane, arg_max(bend, pos) AS road_heading FROM pt GROUP BY 1, 2),
en AS (SELECT DISTINCT k.src AS lane FROM k JOIN l a ON a.lane = k.src AND a.jgroup IS NULL JOIN l b ON b.lane = k.dst AND b.jgroup = 'roundabout'),
e0 AS (SELECT go0.*, goal_type = 'exit-roundabout' AND EXISTS (SELECT 1 FROM en WHERE path LIKE '%/' || en.lane || '/%') AS counts FROM go0),
ex AS (SELECT start, goal_lane, CASE WHEN counts THEN row_number() OVER (PARTITION BY start ORDER BY CASE WHEN counts THEN 0 ELSE 1 END, len(string_split(path, '/')), goal_lane) ELSE 0 END AS exit_number FROM e0),
ic AS (SELECT k.dst AS lane, k.src AS from_lane, a.road FROM k JOIN l a ON a.lane = k.src),
jg AS (SELECT g.*, l.junction, ic.from_lane, ic.road AS in_road FROM g JOIN l ON l.lane = g.lane AND l.junction IS NOT NULL JOIN ic ON ic.lane = g.lane),
cx0 AS (SELECT a.lane, b.lane AS other, a.s0 AS sa, b.s0 AS sb, a.len AS la, b.len AS lb, round((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0), 9) AS det, (b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0) AS tn, (b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0) AS un
  FROM jg a JOIN jg b ON a.junction = b.junction AND a.lane <> b.lane AND a.from_lane <> b.from_lane WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.junction = a.junction AND pr.high = a.in_road AND pr.low = b.in_road)),
cf AS (SELECT lane, other, arg_min(sb + un / det * lb, sa + tn / det * la) AS cross_s_other FROM cx0 WHERE det <> 0 AND tn / det BETWEEN 0 AND 1 AND un / det BETWEEN 0 AND 1 AND 9 * la * lb / abs(det) > 1 GROUP BY 1, 2),
fp AS (SELECT dst AS lane, arg_min(src, lpad(CAST(ord AS VARCHAR), 4, '0') || src) AS prev FROM k GROUP BY 1),
up AS (WITH RECURSIVE u AS (SELECT lane, lane AS up, CAST(0.0 AS DOUBLE) AS gap FROM l UNION ALL SELECT u.lane, fp.prev, u.gap + lx.length FROM u JOIN fp ON fp.lane = u.up JOIN lx ON lx.lane = fp.prev WHERE u.gap < 100) SELECT * FROM u),
wt AS (SELECT pp.start, pp.goal_lane, up.up AS lane, up.gap + cf.cross_s_other AS at FROM pp JOIN cf ON cf.lane = pp.lane JOIN up ON up.lane = cf.other)"""
#: Areas (in_area) of points (columns ``key``, x, y of ``pts``): odd crossings to the right, on no edge.


def _holding(key: list[str], points: str, scenario: bool) -> str:
    k = ", ".join(f"q.{c}" for c in key)
    return f"""co AS ({probes.TOWN["corners"]}), ed AS (SELECT scenario, area, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_ FROM co WINDOW w AS (PARTITION BY area, ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
et AS (SELECT {k}, area, q.x, q.y, ax, ay, bx, by_, greatest(0.0, least(1.0, ((q.x - ax) * (bx - ax) + (q.y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM (SELECT {", ".join(key)}, x, y FROM {points}) q JOIN ed ON {"ed.scenario = q.scenario" if scenario else "true"}),
ee AS (SELECT *, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) AS edge_dist, (ay > y) <> (by_ > y) AND ax + (y - ay) * (bx - ax) / nullif(by_ - ay, 0) > x AS crosses FROM et),
in_area AS (SELECT {", ".join(key)}, area FROM ee GROUP BY ALL HAVING count(*) FILTER (crosses) % 2 = 1 AND min(edge_dist) > 1e-9)"""


_A = "scenario, episode, agent_id"
_LAG = ", ".join(
    f"coalesce(a.speed - p{k}.speed, 0) AS speed_change_{k}s, coalesce((a.heading - p{k}.heading) - 2 * pi() * floor(((a.heading - p{k}.heading) + pi()) / (2 * pi())), 0) AS heading_change_{k}s, coalesce(sqrt((a.x - p{k}.x) * (a.x - p{k}.x) + (a.y - p{k}.y) * (a.y - p{k}.y)), 0) AS dist_travelled_{k}s"
    for k in (1, 2, 3)
)
_PAST = " ".join(f"LEFT JOIN tm p{k} ON p{k}.scenario = a.scenario AND p{k}.episode = a.episode AND p{k}.agent_id = a.agent_id AND p{k}.frame_id = a.frame_id - {k * FPS}" for k in (1, 2, 3))


def _near(name: str, watch: str, d: str, cut: str) -> str:
    return f"""{name}0 AS (SELECT o.scenario, o.episode, o.agent_id, o.frame_id, o.goal_idx, v.speed, v.agent_id AS peer, {d} AS d FROM sec o JOIN {watch} ON w.start = o.start AND w.goal_lane = o.goal_lane JOIN ol v ON v.scenario = o.scenario AND v.episode = o.episode AND v.frame_id = o.frame_id AND v.agent_id <> o.agent_id AND v.lane = w.lane WHERE {cut}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_W}, goal_idx ORDER BY round(d, 9), peer) AS rn FROM {name}0) WHERE rn = 1)"""


_COLUMNS = ["speed", "acceleration", "angle_in_lane", "path_to_goal_length", "road_heading", "vehicle_in_front_dist", "vehicle_in_front_speed", "oncoming_vehicle_dist", "oncoming_vehicle_speed", "fraction_observed", *samples.LAGS]
_FLAGS = ["in_correct_lane", "exit_number_missing", "target_1s_occluded", "target_2s_occluded", "target_3s_occluded"]
SAMPLES = f"""s0 AS ({probes.DRIVES}), gl AS ({probes.TOWN["goals"]}),
mg AS (SELECT * FROM (SELECT *, max(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) OVER (PARTITION BY {_A}) AS far FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM s0 WHERE agent_type <> 'pedestrian' WINDOW w AS (PARTITION BY {_A} ORDER BY frame_id))) WHERE far >= 1.0),
vh AS (SELECT * FROM mg WHERE agent_type IN ('car', 'truck_bus')),
hh AS (SELECT vh.scenario, episode, agent_id, goal_idx, min(frame_id) AS hit FROM vh JOIN gl ON gl.scenario = vh.scenario AND sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= {RADIUS} GROUP BY ALL),
tg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_A} ORDER BY hit DESC, goal_idx DESC) AS rn FROM hh) WHERE rn = 1),
tm AS (SELECT vh.*, tg.goal_idx AS true_goal, min(frame_id) OVER w AS initial_frame_id, (frame_id - min(frame_id) OVER w) * 1.0 / count(*) OVER w AS fraction_observed FROM vh JOIN tg USING ({_A}) WHERE frame_id <= hit WINDOW w AS (PARTITION BY {_A})),
s AS (SELECT * FROM tm), {MAPS}, {ON_LANES}, {PATHS}, go AS (SELECT {", ".join("c." + x for x in _STATE)}, go0.* FROM c JOIN go0 ON go0.start = c.lane), {CLUSTERS},
cg AS (SELECT * FROM (SELECT cd.*, gl.goal_idx, row_number() OVER (PARTITION BY {", ".join("cd." + x for x in _STATE)}, gl.goal_idx ORDER BY cluster) AS rk FROM cd JOIN gl ON gl.scenario = cd.scenario AND sqrt((gx - cx) * (gx - cx) + (gy - cy) * (gy - cy)) <= {RADIUS}) WHERE rk = 1),
sx AS (SELECT {_A}, min(frame_id) AS stop FROM tm WHERE NOT EXISTS (SELECT 1 FROM cg WHERE cg.scenario = tm.scenario AND cg.episode = tm.episode AND cg.agent_id = tm.agent_id AND cg.frame_id = tm.frame_id) GROUP BY ALL),
tp AS (SELECT cg.* FROM cg LEFT JOIN sx USING ({_A}) WHERE stop IS NULL OR frame_id < stop),
sp AS (SELECT {_A}, min(frame_id) AS a, max(frame_id) AS b FROM mg WHERE EXISTS (SELECT 1 FROM tg WHERE tg.scenario = mg.scenario AND tg.episode = mg.episode AND tg.agent_id = mg.agent_id) GROUP BY ALL),
pz AS (SELECT t.scenario, t.episode, t.agent_id, e.agent_id AS ego_id, greatest(t.a, e.a) AS a, least(t.b, e.b) AS b FROM sp t JOIN sp e ON e.scenario = t.scenario AND e.episode = t.episode AND e.agent_id <> t.agent_id AND t.a <= e.b AND e.a <= t.b AND e.b - e.a >= {FPS}),
pc AS (SELECT pz.*, tp.goal_type AS true_goal_type FROM pz JOIN tg USING ({_A}) JOIN tp ON tp.scenario = pz.scenario AND tp.episode = pz.episode AND tp.agent_id = pz.agent_id AND tp.frame_id = pz.a AND tp.goal_idx = tg.goal_idx),
hid AS (WITH s AS (SELECT scenario * 1000000 + episode AS episode, frame_id, agent_id, x, y, heading FROM mg WHERE frame_id % {FPS} = 0), {QUADS}, {COVER} SELECT episode // 1000000 AS scenario, episode % 1000000 AS episode, frame_id, ego_id, agent_id FROM hd),
sm0 AS (SELECT pc.*, tm.frame_id, tm.true_goal, tm.initial_frame_id, tm.fraction_observed, hid.ego_id IS NOT NULL AS hidden FROM pc JOIN tm ON tm.scenario = pc.scenario AND tm.episode = pc.episode AND tm.agent_id = pc.agent_id AND tm.frame_id BETWEEN pc.a AND pc.b AND tm.frame_id % {FPS} = 0
  LEFT JOIN hid ON hid.scenario = pc.scenario AND hid.episode = pc.episode AND hid.frame_id = tm.frame_id AND hid.ego_id = pc.ego_id AND hid.agent_id = pc.agent_id
  WHERE EXISTS (SELECT 1 FROM tp WHERE tp.scenario = tm.scenario AND tp.episode = tm.episode AND tp.agent_id = tm.agent_id AND tp.frame_id = tm.frame_id)),
sm AS (SELECT *, min(CASE WHEN NOT hidden THEN frame_id END) OVER (PARTITION BY {_A}, ego_id) AS first_seen, {", ".join(f"frame_id - initial_frame_id < {k * FPS} OR coalesce(lag(hidden, {k}) OVER w, true) OR hidden AS target_{k}s_occluded" for k in (1, 2, 3))} FROM sm0 WINDOW w AS (PARTITION BY {_A}, ego_id ORDER BY frame_id)),
sec AS (SELECT * FROM tp WHERE frame_id % {FPS} = 0),
pts AS (SELECT * FROM mg WHERE frame_id % {FPS} = 0), {_holding(_STATE, "pts", True)},
ol AS (SELECT {", ".join("m." + x for x in _STATE)}, m.area AS lane, pts.speed, arg_min(g.s0 + g.len * greatest(0.0, least(1.0, ((pts.x - g.x0) * (g.x1 - g.x0) + (pts.y - g.y0) * (g.y1 - g.y0)) / (g.len * g.len))), sqrt(pow(pts.x - g.x0 - greatest(0.0, least(1.0, ((pts.x - g.x0) * (g.x1 - g.x0) + (pts.y - g.y0) * (g.y1 - g.y0)) / (g.len * g.len))) * (g.x1 - g.x0), 2) + pow(pts.y - g.y0 - greatest(0.0, least(1.0, ((pts.x - g.x0) * (g.x1 - g.x0) + (pts.y - g.y0) * (g.y1 - g.y0)) / (g.len * g.len))) * (g.y1 - g.y0), 2))) AS lon
  FROM in_area m JOIN pts USING ({_W}) JOIN g ON g.lane = m.area GROUP BY ALL),
{_near("fd", "pt w", "w.s_before + v.lon - o.lon", "w.s_before + v.lon - o.lon > 1e-4")}, {_near("od", "wt w", "w.at - v.lon", "w.at - v.lon > 0 AND w.at - v.lon < 100")},
bl1 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY {_W} ORDER BY round(dist, 9), round(abs(turn), 9), lane) AS rb FROM c) WHERE rb = 1),
xn AS (SELECT bl1.scenario, episode, agent_id, frame_id, goal_lane, exit_number FROM bl1 JOIN ex ON ex.start = bl1.lane WHERE exit_number > 0),
lg AS (SELECT a.scenario, a.episode, a.agent_id, a.frame_id, a.speed, sqrt(a.ax * a.ax + a.ay * a.ay) AS acceleration, {_LAG} FROM tm a {_PAST}),
full_rows AS (SELECT sm.scenario, sm.episode, sm.agent_id, sm.ego_id, sm.frame_id, sec.goal_idx AS possible_goal, sec.goal_type, sm.true_goal, sm.true_goal_type, sm.initial_frame_id, sm.fraction_observed, sm.target_1s_occluded, sm.target_2s_occluded, sm.target_3s_occluded,
  sec.turn AS angle_in_lane, pf.path_length - sec.lon AS path_to_goal_length, pf.in_correct_lane, pf.road_heading, coalesce(fd.d, 100) AS vehicle_in_front_dist, coalesce(fd.speed, 20) AS vehicle_in_front_speed, coalesce(od.d, 100) AS oncoming_vehicle_dist, coalesce(od.speed, 20) AS oncoming_vehicle_speed,
  CASE WHEN sec.goal_type = 'exit-roundabout' THEN coalesce(x1.exit_number, 0) ELSE 0 END AS exit_number, sec.goal_type = 'exit-roundabout' AND x2.exit_number IS NULL AS exit_number_missing, lg.speed, lg.acceleration, {", ".join("lg." + c for c in samples.LAGS)}
  FROM sm JOIN sec USING ({_W}) JOIN pf ON pf.start = sec.start AND pf.goal_lane = sec.goal_lane JOIN lg USING ({_W}) LEFT JOIN fd USING ({_W}, goal_idx) LEFT JOIN od USING ({_W}, goal_idx)
  LEFT JOIN xn x1 ON x1.scenario = sm.scenario AND x1.episode = sm.episode AND x1.agent_id = sm.agent_id AND x1.frame_id = sm.initial_frame_id AND x1.goal_lane = sec.goal_lane
  LEFT JOIN xn x2 ON x2.scenario = sm.scenario AND x2.episode = sm.episode AND x2.agent_id = sm.agent_id AND x2.frame_id = sm.first_seen AND x2.goal_lane = sec.goal_lane WHERE NOT sm.hidden)"""
_LABELS = ["scenario", "episode", "agent_id", "ego_id", "frame_id", "possible_goal", "goal_type", "true_goal", "true_goal_type", "initial_frame_id"]
_OUT = f"SELECT {', '.join(_LABELS)}, CAST(exit_number AS BIGINT) AS exit_number, {', '.join(_FLAGS)}, {', '.join(f'round({c}, 9) AS {c}' for c in _COLUMNS)} FROM full_rows"


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    town = town_of(spark)
    states = kept(probes.drives(spark, sf))
    hidden = occlusion.hidden_between(tracks.each_second(tracks.moving_agents(states), FPS), buildings(spark))
    return samples.sample_table(states, hidden, town.maps(), fps=FPS, reach=REACH, radius=RADIUS)


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*_LABELS, F.col("exit_number").cast("long").alias("exit_number"), *_FLAGS, *[r9(c).alias(c) for c in _COLUMNS])


@query(f"WITH {SAMPLES} {_OUT}")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    """O-20, O-21, O-23, O-24, O-33, O-35, O-38 to O-41, O-45, O-47, O-49, O-55, O-60, O-62, O-77, O-78, O-79, O-80, O-84, O-89, O-92, O-93: the sample table with labels and features."""
    return _rounded(_samples(spark, sf))


@query(f"WITH {SAMPLES} {_OUT} WHERE episode % 2 = scenario")
def stored_samples(spark: SparkSession, sf: str) -> DataFrame:
    """O-05, O-06, O-09, O-97: the sample table written by scenario and episode, one episode of each written again, and the episodes of a split read back."""
    rows = kept(_samples(spark, sf))
    path = f"{shared_folder(spark)}/samples-{spark.sparkContext.applicationId}-{id(rows)}"
    tables.write_samples(rows, path)
    tables.write_samples(rows.filter("episode = 1"), path)
    splits = rows.select("scenario", "episode").distinct().withColumn("subset", F.when(F.col("episode") % 2 == F.col("scenario"), "train").otherwise("test"))
    return _rounded(tables.read_samples(spark, path, splits, "train"))


#: An L, a U and a square with a square hole, beside the lanes of the first town; the L's corners repeat the first one at the end.
SHAPES = """SELECT * FROM (VALUES ('L', 0, 0, 10.0, 10.0), ('L', 0, 1, 40.0, 10.0), ('L', 0, 2, 40.0, 20.0), ('L', 0, 3, 20.0, 20.0), ('L', 0, 4, 20.0, 50.0), ('L', 0, 5, 10.0, 50.0), ('L', 0, 6, 10.0, 10.0),
('U', 0, 0, 50.0, 10.0), ('U', 0, 1, 60.0, 10.0), ('U', 0, 2, 60.0, 30.0), ('U', 0, 3, 70.0, 30.0), ('U', 0, 4, 70.0, 10.0), ('U', 0, 5, 80.0, 10.0), ('U', 0, 6, 80.0, 45.5), ('U', 0, 7, 50.0, 40.0),
('O', 0, 0, 20.0, 60.0), ('O', 0, 1, 60.0, 60.0), ('O', 0, 2, 60.0, 95.0), ('O', 0, 3, 20.0, 95.0), ('O', 1, 0, 30.0, 70.0), ('O', 1, 1, 30.0, 85.0), ('O', 1, 2, 50.0, 85.0), ('O', 1, 3, 50.0, 70.0)) AS v(area, ring, k, x, y)"""
_ANYWHERE = f"pts AS (SELECT scenario, episode, agent_id, frame_id, round(x) AS x, y FROM ({probes.STATES}) WHERE frame_id % {FPS} = 0)"


def _holding_shapes() -> str:
    return _holding(_STATE, "pts", False).replace(probes.TOWN["corners"], f"SELECT 0 AS scenario, * FROM ({SHAPES}) UNION ALL SELECT * FROM ({probes.TOWN['corners']}) WHERE scenario = 0").replace("FROM co WINDOW", "FROM co WHERE NOT (area = 'L' AND k = 6) WINDOW")


@query(f"WITH {_ANYWHERE}, {_holding_shapes()} SELECT {_W}, area FROM in_area")
def states_in_areas(spark: SparkSession, sf: str) -> DataFrame:
    """O-45, O-49: states at whole metres, many of them on edges and corners, in bent lanes, an L, a U and a square with a hole."""
    corners = spark.sql(SHAPES).unionByName(spark.sql(probes.TOWN["corners"]).filter("scenario = 0").drop("scenario"))
    points = tracks.each_second(probes.states(spark, sf), FPS).select(*_STATE, F.round("x").alias("x"), "y")
    return polygons.areas_holding(points, polygons.ring_edges(corners), _STATE)


@query(f"""WITH {MAPS}, {PATHS.split("pq2 AS")[0].rstrip().rstrip(",")}, np AS (SELECT start, goal_lane, row_number() OVER (ORDER BY start, goal_lane) - 1 AS nr, count(*) OVER () AS n FROM go0), {_ANYWHERE}, {_holding(_STATE, "pts", False)},
ak AS (SELECT pts.*, np.start, np.goal_lane FROM pts JOIN np ON (agent_id + frame_id) % n = nr), al AS (SELECT ak.*, pp.pos, pp.lane FROM ak JOIN pp ON pp.start = ak.start AND pp.goal_lane = ak.goal_lane),
ins AS (SELECT {_W}, min(pos) AS pos FROM al JOIN in_area USING ({_W}) WHERE area = lane GROUP BY ALL), nb AS (SELECT {_W}, pos, min(edge_dist) AS d FROM al JOIN ee USING ({_W}) WHERE ee.area = al.lane GROUP BY ALL),
ne AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY round(d, 9), pos) AS rn FROM nb) WHERE rn = 1)
SELECT {", ".join("ne." + c for c in _STATE)}, coalesce(ins.pos, ne.pos) AS pos, ins.pos IS NOT NULL AS inside, al.lane FROM ne LEFT JOIN ins USING ({_W}) JOIN al ON {" AND ".join(f"al.{c} = ne.{c}" for c in _STATE)} AND al.pos = coalesce(ins.pos, ne.pos)""")
def place_on_path(spark: SparkSession, sf: str) -> DataFrame:
    """O-29: where on a path a state is, for every path of the towns; most states are on none of its lanes."""
    town = town_of(spark)
    numbered = tracks.ranked_rows(town.searches.select("start", "goal_lane"), ["start", "goal_lane"]).select("start", "goal_lane", F.col("rank").alias("nr"))
    paths = town.searches.select("start", "goal_lane", F.posexplode("path").alias("pos", "lane"))
    points = tracks.each_second(probes.states(spark, sf), FPS).select(*_STATE, F.round("x").alias("x"), "y")
    asked = kept(points.withColumn("nr", (F.col("agent_id") + F.col("frame_id")) % town.searches.count()).join(numbered, "nr").drop("nr"))
    found = polygons.place_on_path(asked, paths, town.edges, _STATE, ["start", "goal_lane"])
    inside = polygons.areas_holding(asked, town.edges, _STATE).select(*_STATE, F.col("area").alias("lane"), F.lit(True).alias("inside"))
    return found.join(inside, [*_STATE, "lane"], "left").select(*_STATE, F.col("pos").cast("long").alias("pos"), "lane", F.coalesce("inside", F.lit(False)).alias("inside"))


#: Drives in which stretches are out of sight, some agents stop and go, and acceleration is that along the heading.
HIDING = f"""SELECT scenario, episode, agent_id, frame_id, CASE WHEN agent_id % 9 = 5 THEN 30 * floor(x / 30) ELSE x END AS x, CASE WHEN agent_id % 9 = 5 THEN 30 * floor(y / 30) ELSE y END AS y, heading, speed,
ax * cos(heading) + ay * sin(heading) AS acceleration, (frame_id + agent_id) % 13 < 6 AS hidden FROM ({probes.DRIVES}) z"""


def _directions(h: str) -> str:
    return f"round(cos({h}), 6) + 0.0 AS heading_x, round(sin({h}), 6) + 0.0 AS heading_y"


@query(f"""WITH s AS ({HIDING}), w AS (SELECT *, min(frame_id) OVER (PARTITION BY {", ".join(tracks.AGENT)}) AS f0, max(CASE WHEN NOT hidden THEN frame_id END) OVER (PARTITION BY {", ".join(tracks.AGENT)} ORDER BY frame_id) AS fa, min(CASE WHEN NOT hidden THEN frame_id END) OVER (PARTITION BY {", ".join(tracks.AGENT)} ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM s),
j AS (SELECT w.*, a.x AS x0, a.y AS y0, b.x AS x3, b.y AS y3, b.heading AS hb, (fb - fa) / {FPS}.0 AS t, (w.frame_id - fa) * 1.0 / (fb - fa) AS u, a.speed * cos(a.heading) AS vax, a.speed * sin(a.heading) AS vay, b.speed * cos(b.heading) AS vbx, b.speed * sin(b.heading) AS vby
 FROM w JOIN s a ON {" AND ".join(f"a.{c} = w.{c}" for c in tracks.AGENT)} AND a.frame_id = fa JOIN s b ON {" AND ".join(f"b.{c} = w.{c}" for c in tracks.AGENT)} AND b.frame_id = fb WHERE w.hidden AND fa > f0),
z AS (SELECT *, x0 + vax * t / 3 AS x1, y0 + vay * t / 3 AS y1, x3 - vbx * t / 3 AS x2, y3 - vby * t / 3 AS y2, sqrt((x3 - x0) * (x3 - x0) + (y3 - y0) * (y3 - y0)) < 0.1 AS still FROM j),
m AS (SELECT *, {", ".join(f"(1-u)*(1-u)*(1-u)*{c}0 + 3*(1-u)*(1-u)*u*{c}1 + 3*(1-u)*u*u*{c}2 + u*u*u*{c}3 AS p{c}, 3*((1-u)*(1-u)*({c}1-{c}0) + 2*(1-u)*u*({c}2-{c}1) + u*u*({c}3-{c}2))/t AS v{c}, 6*((1-u)*({c}2-2*{c}1+{c}0) + u*({c}3-2*{c}2+{c}1))/(t*t) AS a{c}" for c in "xy")} FROM z)
SELECT {", ".join(tracks.AGENT)}, frame_id, false AS filled, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(speed, 6) AS speed, round(acceleration, 6) + 0.0 AS acceleration, {_directions("heading")} FROM s WHERE NOT hidden
UNION ALL SELECT {", ".join(tracks.AGENT)}, frame_id, true, CASE WHEN still THEN round(x0, 6) ELSE round(px, 6) END + 0.0, CASE WHEN still THEN round(y0, 6) ELSE round(py, 6) END + 0.0, CASE WHEN still THEN 0.0 ELSE round(sqrt(vx * vx + vy * vy), 6) END,
CASE WHEN still OR vx * vx + vy * vy < 1e-18 THEN 0.0 ELSE round((vx * ax + vy * ay) / sqrt(vx * vx + vy * vy), 6) END + 0.0, {_directions("CASE WHEN still THEN hb WHEN vx * vx + vy * vy < 1e-18 THEN atan2(y3 - y0, x3 - x0) ELSE atan2(vy, vx) END")} FROM m""")
def gap_curves(spark: SparkSession, sf: str) -> DataFrame:
    """O-85: closed gaps of vehicles on bent lanes, against the same cubic by its control points."""
    probes.expose(spark, sf, "events")
    s = spark.sql(HIDING.replace("//", "div"))
    c, h = tracks.gap_curves(s, FPS), F.col("heading_filled")
    r6 = lambda v, name: (F.round(v, 6) + F.lit(0.0)).alias(name)
    return c.select(*tracks.AGENT, "frame_id", "filled", *[r6(F.col(f"{n}_filled"), n) for n in ("x", "y", "speed", "acceleration")], r6(F.cos(h), "heading_x"), r6(F.sin(h), "heading_y"))
