"""Tables of the engine's data model, derived from the driver's tables by portable SQL.

The same SQL text runs in Spark (after ``expose``) and in DuckDB, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FPS = 5
GOAL_RADIUS = 8.0

#: Track states: one row per agent and frame; tracks are short, so five frames a second. Agent numbers are unique here; in ``DRIVES`` they start anew in each scenario.
STATES = """
SELECT user_id % 5 % 2 AS scenario, user_id % 5 AS episode, user_id AS agent_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 + (user_id % 4) * 30 AS BIGINT) AS frame_id, ts,
       value / 5.0 AS x, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) AS y, value / 10.0 AS speed,
       CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) * 2 * pi() / 100 - pi() AS heading,
       event_type = 'error' AS hidden,
       CASE user_id % 7 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'truck_bus' ELSE 'car' END AS agent_type
FROM events
"""
GOALS = "SELECT * FROM (VALUES (0, 10.0, 20.0), (1, 60.0, 50.0), (2, 30.0, 80.0)) AS g(goal_idx, gx, gy)"

#: Candidate goals per sample with a likelihood and the true goal.
CAND = """
SELECT o.o_orderstatus AS scenario, l.l_orderkey AS sample_id, l.l_linenumber AS possible_goal,
       MIN(l.l_returnflag) AS goal_type, MAX(l.l_discount) + 0.01 AS likelihood, MAX(l.l_tax) + 0.01 AS likelihood2,
       CAST(l.l_orderkey % 7 + 1 AS INT) AS true_goal, CAST(l.l_orderkey % 101 AS DOUBLE) / 100.0 AS fraction_observed
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
GROUP BY o.o_orderstatus, l.l_orderkey, l.l_linenumber
"""
#: Labelled feature rows; f_tax may be missing where tax_missing is set.
TRAIN = """
SELECT l_returnflag AS tree_key, l_orderkey AS sample_id, l_linenumber AS goal, l_quantity AS f_quantity, l_discount AS f_discount, l_tax AS f_tax,
       (l_linestatus = 'O') AS tax_missing, (l_linenumber = l_orderkey % 7 + 1) AS has_goal, CAST(1.0 AS DOUBLE) AS weight
FROM lineitem
"""


def expose(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make driver tables visible to SQL under their names."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    expose(spark, sf_dir, "events")
    return spark.sql(STATES)


def goals(spark: SparkSession) -> DataFrame:
    return spark.sql(GOALS)


#: Rows of a table that one task is to join and group.
TASK_ROWS = 500_000


def deal(spark: SparkSession, rows: int, keys: dict[str, str]) -> None:
    """Exposed tables by a key of each, in so many partitions that a task has about ``rows`` rows of the largest; tables that the session's own number of partitions splits as finely stay as they are."""
    n = -(-max(spark.table(t).count() for t in keys) // rows)
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        for t, key in keys.items():
            spark.table(t).repartition(n, key).createOrReplaceTempView(t)


def cand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``CAND``; the memory of one task does not grow with the tables."""
    expose(spark, sf_dir, "lineitem", "orders")
    deal(spark, TASK_ROWS, {"lineitem": "l_orderkey", "orders": "o_orderkey"})
    return spark.sql(CAND)


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    expose(spark, sf_dir, "lineitem")
    return spark.sql(TRAIN)


#: Lanes of a town: road, section, junction and kind of its group, and the corners of the midline. Road 1 has two lanes and two
#: sections, its second section is bent; junction 1 is a crossing, junction 2 a roundabout of bent quarters with three exits.
TOWN_LANES = {
    "A1": (1, 10, None, None, [(0, 48), (20, 48)]),
    "A2": (1, 10, None, None, [(0, 44), (20, 44)]),
    "B1": (1, 11, None, None, [(20, 48), (32, 48), (44, 52)]),
    "B2": (1, 11, None, None, [(20, 44), (32, 44), (44, 48)]),
    "Js": (5, 50, 1, None, [(44, 52), (62, 52)]),
    "Jl": (6, 60, 1, None, [(44, 52), (51, 54), (54, 62)]),
    "Jr": (7, 70, 1, None, [(44, 48), (49, 46), (51, 38)]),
    "Jn": (8, 80, 1, None, [(54, 42), (54, 62)]),
    "Je": (9, 90, 1, None, [(54, 42), (56, 49), (62, 52)]),
    "E": (2, 20, None, None, [(62, 52), (80, 52)]),
    "N": (3, 30, None, None, [(54, 62), (54, 95)]),
    "S": (4, 40, None, None, [(54, 12), (54, 42)]),
    "R": (10, 100, None, None, [(51, 38), (51, 30), (45, 10)]),
    "Ri": (11, 110, None, None, [(80, 52), (84, 52)]),
    "Ra": (12, 120, 2, "roundabout", [(84, 52), (86, 48), (90, 46)]),
    "Rb": (12, 121, 2, "roundabout", [(90, 46), (94, 48), (96, 52)]),
    "Rc": (12, 122, 2, "roundabout", [(96, 52), (94, 56), (90, 58)]),
    "Rd": (12, 123, 2, "roundabout", [(90, 58), (86, 56), (84, 52)]),
    "X1": (13, 130, None, None, [(90, 46), (90, 20)]),
    "X2": (14, 140, None, None, [(96, 52), (110, 52)]),
    "X3": (15, 150, None, None, [(90, 58), (90, 90)]),
}
TOWN_LINKS = {
    "A1": ["B1"], "A2": ["B2"], "B1": ["Js", "Jl"], "B2": ["Jr"], "S": ["Jn", "Je"], "Js": ["E"], "Je": ["E"], "Jn": ["N"], "Jl": ["N"], "Jr": ["R"],
    "E": ["Ri"], "Ri": ["Ra"], "Ra": ["Rb", "X1"], "Rb": ["Rc", "X2"], "Rc": ["Rd", "X3"], "Rd": ["Ra"],
}
TOWN_CHANGES = [("A1", "A2"), ("A2", "A1"), ("B1", "B2"), ("B2", "B1")]
#: What vehicles drive, by number of route.
TOWN_ROUTES = [["A1", "B1", "Js", "E", "Ri", "Ra", "X1"], ["A2", "B2", "Jr", "R"], ["A1", "B1", "Jl", "N"], ["S", "Jn", "N"], ["S", "Je", "E", "Ri", "Ra", "Rb", "X2"], ["E", "Ri", "Ra", "Rb", "Rc", "X3"]]
#: Configured goals; the last one is never reached.
TOWN_GOALS = [(62, 52), (54, 62), (51, 38), (90, 20), (110, 52), (90, 90), (500, 500)]
HALF_WIDTH = 1.75


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else repr(v) if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({names})"


def _outline(points: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """A polygon around a midline, ``HALF_WIDTH`` to both sides of each corner, square to the mean of the directions that meet there."""
    import math

    turn = [math.atan2(q[1] - p[1], q[0] - p[0]) for p, q in zip(points, points[1:], strict=False)]
    sides: tuple[list, list] = ([], [])
    for i, (x, y) in enumerate(points):
        around = turn[max(i - 1, 0) : i + 1]
        h = math.atan2(sum(map(math.sin, around)), sum(map(math.cos, around)))
        for side, sign in zip(sides, (1, -1), strict=True):
            side.append((round(x - sign * HALF_WIDTH * math.sin(h), 3), round(y + sign * HALF_WIDTH * math.cos(h), 3)))
    return sides[0] + sides[1][::-1]


def _twice(sql: str, lane_columns: list[str], others: str, xs: tuple[str, str] | None = None, two: tuple[str, str] | None = None) -> str:
    """A table of the town (scenario 0) and of its copy (scenario 1), turned by a right angle: the same agents drive both, on lanes of other names."""
    name = lambda k: ", ".join(f"'{'ab'[k]}' || {c} AS {c}" for c in lane_columns)
    spots = [p for p in (xs, two) if p]
    plain = "".join(f", CAST({x} AS DOUBLE) AS {x}, CAST({y} AS DOUBLE) AS {y}" for x, y in spots)
    turned = "".join(f", CAST(120 - {y} AS DOUBLE) AS {x}, CAST({x} AS DOUBLE) AS {y}" for x, y in spots)
    cols = (name(0), name(1)) if lane_columns else ("", "")
    sep = ", " if lane_columns else ""
    part = lambda k, spot: f"SELECT {k} AS scenario{sep}{cols[k]}, {others.replace('{k}', str(k))}{spot} FROM ({sql}) t"
    return f"{part(0, plain)} UNION ALL {part(1, turned)}"


TOWN = {
    "lanes": _twice(_values([(k, *v[:4]) for k, v in TOWN_LANES.items()], "lane, road, section, junction, jgroup"), ["lane"], "road, section + 1000 * {k} AS section, junction + 10 * {k} AS junction, jgroup"),
    "segments": _twice(_values([(k, i, *p, *q) for k, v in TOWN_LANES.items() for i, (p, q) in enumerate(zip(v[4], v[4][1:], strict=False))], "lane, seg, x0, y0, x1, y1"), ["lane"], "seg", ("x0", "y0"), ("x1", "y1")),
    "links": _twice(_values([(a, b, i) for a, to in TOWN_LINKS.items() for i, b in enumerate(to)], "src, dst, ord"), ["src", "dst"], "ord"),
    "changes": _twice(_values([(a, b, 9) for a, b in TOWN_CHANGES], "src, dst, ord"), ["src", "dst"], "ord"),
    "priorities": _twice(_values([(1, 1, 4)], "junction, high, low"), [], "junction + 10 * {k} AS junction, high, low"),
    "corners": _twice(_values([(k, 0, i, x, y) for k, v in TOWN_LANES.items() for i, (x, y) in enumerate(_outline(v[4]))], "area, ring, k, x, y"), ["area"], "ring, k", ("x", "y")),
    "goals": _twice(_values([(i, *p) for i, p in enumerate(TOWN_GOALS)], "goal_idx, cx, cy"), [], "goal_idx", ("cx", "cy")),
    "routes": _twice(_values([(r, i, lane) for r, lanes in enumerate(TOWN_ROUTES) for i, lane in enumerate(lanes)], "route, pos, lane"), ["lane"], "route, pos"),
}
#: Vehicles that drive the towns' routes: each user's events are its frames, one a fifth of a second; their values move it aside and turn it a little.
DRIVES = f"""
WITH g AS ({TOWN["segments"]}), w AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS len FROM g),
r AS (SELECT rt.scenario, route, x0, y0, x1, y1, len, SUM(len) OVER (PARTITION BY rt.scenario, route ORDER BY pos, seg) - len AS s0 FROM ({TOWN["routes"]}) rt JOIN w ON w.lane = rt.lane),
e AS (SELECT user_id % 2 AS scenario, user_id // 2 AS agent_id, ts, value, event_type, user_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events),
d AS (SELECT *, agent_id % 6 AS route, k * (0.8 + 0.4 * (agent_id % 3)) + 0.013 + (agent_id % 7) * 1.5 AS s, value / 1000.0 - 0.25 AS aside FROM e)
SELECT CAST(d.scenario AS INT) AS scenario, CAST(agent_id // 20 AS INT) AS episode, agent_id, CAST(k + (user_id % 4) * 5 AS BIGINT) AS frame_id, ts,
       x0 + (s - s0) / len * (x1 - x0) - aside * (y1 - y0) / len AS x, y0 + (s - s0) / len * (y1 - y0) + aside * (x1 - x0) / len AS y,
       atan2(y1 - y0, x1 - x0) + aside / 5 AS heading, (0.8 + 0.4 * (agent_id % 3)) * 5 + aside AS speed, value / 100.0 AS ax, (k % 7) / CAST(7 AS DOUBLE) AS ay,
       CASE agent_id % 11 WHEN 0 THEN 'pedestrian' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'truck_bus' ELSE 'car' END AS agent_type
FROM d JOIN r ON r.scenario = d.scenario AND r.route = d.route AND s >= s0 AND s < s0 + len
"""


def drives(spark: SparkSession, sf_dir: str) -> DataFrame:
    expose(spark, sf_dir, "events")
    return spark.sql(DRIVES.replace("//", "div"))
