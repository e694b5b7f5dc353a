"""Goal candidates, areas, sample tables and streams on small literal tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import candidates, occlusion, polygons, samples, tracks
from trackwise.plans import trees
from trackwise.queries import town
from trackwise.sources import tables
from trackwise.streaming import online


def _state(spark, rows):
    return spark.createDataFrame(rows, "scenario int, episode int, frame_id long, agent_id long, x double, y double, heading double")


def _goals(spark, rows, region=None):
    found = candidates.goal_candidates(_state(spark, rows), town.town_of(spark).parts(), town.KEY, reach=town.REACH, region=region)
    return {(r.agent_id, r.goal_lane): r for r in found.collect()}


def test_goals_over_all_candidate_lanes(spark):
    got = _goals(spark, [(0, 0, 0, 1, 10.0, 47.5, 0.0), (0, 0, 0, 2, 70.0, 52.0, 0.0), (0, 0, 0, 3, 300.0, 300.0, 0.0)])
    # from either lane of the two: straight on and left from the first, right by a lane change or from the second
    assert {g for a, g in got if a == 1} == {"aJs", "aJl", "aJr"}
    assert got[1, "aJs"].start == "aA1" and got[1, "aJr"].path == ["aA1", "aB1", "aB2", "aJr"] and got[1, "aJr"].goal_type == "exit-right"
    assert {g: r.goal_type for (a, g), r in got.items() if a == 2} == {"aX1": "exit-roundabout", "aX2": "exit-roundabout", "aX3": "exit-roundabout"}
    assert not [a for a, _ in got if a == 3]


def test_a_region_ends_the_search(spark):
    here = (F.col("x"), F.col("y"), F.lit(15.0))
    got = _goals(spark, [(0, 0, 0, 1, 10.0, 47.5, 0.0), (0, 0, 0, 2, 70.0, 52.0, 0.0)], here)
    # the ends of the second section lie outside; those of the first inside
    assert {g: r.goal_type for (a, g), r in got.items() if a == 1} == {"aB1": "straight-on", "aB2": "straight-on"}
    assert {g for a, g in got if a == 2} == {"aX1", "aX2", "aX3"}  # roundabout lanes do not end a search


def test_clusters_are_first_seen_first(spark):
    goal = "array(named_struct('gx', 0.0D, 'gy', 0.0D), named_struct('gx', 3.0D, 'gy', 0.0D), named_struct('gx', 6.0D, 'gy', 0.0D), named_struct('gx', 3.2D, 'gy', 3.4D))"
    row = spark.range(1).select(F.expr(goal).alias("g")).withColumn("p", candidates.first_seen(F.col("g")))
    got = row.select("p", F.transform("g", lambda g: candidates.cluster_of(F.col("p"), g)).alias("c")).first()
    assert [(p.gx, p.gy) for p in got.p] == [(0.0, 0.0), (6.0, 0.0)] and got.c == [0, 0, 1, 0]


def test_areas_of_any_shape(spark):
    corners = spark.sql(town.SHAPES)
    points = spark.createDataFrame([(1, 15.0, 45.0), (2, 30.0, 30.0), (3, 65.0, 20.0), (4, 55.0, 20.0), (5, 40.0, 75.0), (6, 25.0, 75.0), (7, 20.0, 30.0), (8, 10.0, 10.0), (9, 65.0, 35.0), (10, 30.0, 70.0)], "k int, x double, y double")
    got = {(r.k, r.area) for r in polygons.areas_holding(points, polygons.ring_edges(corners), ["k"]).collect()}
    assert got == {(1, "L"), (4, "U"), (6, "O"), (9, "U")}  # the notch, the hole, edges and corners are outside


def test_place_on_a_path_falls_back_to_the_nearest_outline(spark):
    square = lambda a, x: [(a, 0, k, x + dx, dy) for k, (dx, dy) in enumerate(((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)))]
    edges = polygons.ring_edges(spark.createDataFrame(square("a", 0.0) + square("b", 20.0) + square("c", 5.0), "area string, ring int, k int, x double, y double"))
    paths = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "c"), (2, 2, "a")], "path int, pos int, lane string")
    points = spark.createDataFrame([(1, 1, 7.0, 5.0), (2, 2, 7.0, 5.0), (3, 1, 12.0, 5.0), (4, 1, 15.0, 5.0), (5, 2, -1.0, 5.0)], "k int, path int, x double, y double")
    got = {r.k: (r.pos, r.lane) for r in polygons.place_on_path(points, paths, edges, ["k"], ["path"]).collect()}
    assert got == {1: (0, "a"), 2: (1, "c"), 3: (0, "a"), 4: (0, "a"), 5: (2, "a")}


def _drive(scenario, agent, route, frames, step=1.0, first=0):
    """States along a route's midlines."""
    points = [p for lane in probes.TOWN_ROUTES[route] for p in probes.TOWN_LANES[lane][4]]
    legs = [(p, q, math.dist(p, q)) for p, q in zip(points, points[1:], strict=False) if p != q]
    rows = []
    for k in range(frames):
        s = k * step + 0.01
        for p, q, n in legs:
            if s < n:
                x, y = p[0] + s / n * (q[0] - p[0]), p[1] + s / n * (q[1] - p[1])
                h = math.atan2(q[1] - p[1], q[0] - p[0])
                rows.append((scenario, 0, agent, first + k, x, y, h, step * 5, 3.0, 4.0, "car") if scenario == 0 else (scenario, 0, agent, first + k, 120 - y, x, h + math.pi / 2 - (2 * math.pi if h > math.pi / 2 else 0), step * 5, 3.0, 4.0, "car"))
                break
            s -= n
    return rows


STATES = "scenario int, episode int, agent_id long, frame_id long, x double, y double, heading double, speed double, ax double, ay double, agent_type string"


def test_sample_table(spark, tmp_path):
    rows = _drive(0, 1, 0, 62) + _drive(0, 2, 3, 50, first=3) + _drive(1, 1, 1, 60) + _drive(1, 2, 4, 60)
    s = spark.createDataFrame(rows, STATES)
    pairs = s.select(*tracks.FRAME, "agent_id").join(s.select(*tracks.FRAME, F.col("agent_id").alias("ego_id")), tracks.FRAME).filter("agent_id <> ego_id AND frame_id % 5 = 0")
    hidden = pairs.withColumn("hidden", F.expr("scenario = 0 AND agent_id = 1 AND frame_id IN (5, 15)"))
    got = samples.sample_table(s, hidden, town.town_of(spark).maps(), fps=5, reach=town.REACH, radius=town.RADIUS)
    mine = [r for r in got.filter("scenario = 0 AND agent_id = 1").orderBy("frame_id", "possible_goal").collect()]
    frames = sorted({r.frame_id for r in mine})
    assert frames[:3] == [10, 20, 25] and frames[-1] <= 63  # 0 and 1 lie before the overlap, 5 and 15 are hidden
    assert {(r.true_goal, r.true_goal_type, r.initial_frame_id, r.acceleration) for r in mine} == {(0, "straight-on", 0, 5.0)}
    at = {r.frame_id: r for r in mine if r.possible_goal == 0}
    assert at[10].target_1s_occluded and not at[25].target_1s_occluded and at[25].target_2s_occluded
    assert {r.possible_goal for r in mine if r.frame_id == 10} == {0, 1, 2} and not [r for r in mine if r.frame_id == 10 and r.possible_goal == 2][0].in_correct_lane
    assert got.filter("scenario = 1").count() and got.filter("scenario = 1 AND agent_id = 1").select("true_goal").distinct().collect()[0][0] == 2
    path = str(tmp_path / "samples")
    tables.write_samples(got, path)
    before = sorted(map(repr, spark.read.parquet(path).collect()))
    tables.write_samples(got.filter("scenario = 1"), path)
    assert sorted(map(repr, spark.read.parquet(path).collect())) == before  # writing an episode again changes nothing


def test_prefix_sums_by_ranges(spark):
    rows = [("t", "R", f, float(v), 1.0 + v % 3, float(v % 2), 1) for f in ("a", "b") for v in range(500)]
    got = trees.prefix_sums(spark.createDataFrame(rows, "tree_key string, path string, feature string, v double, w double, wg double, k long").repartition(7))
    by = {(r.feature, r.v): r for r in got.collect()}
    for f in ("a", "b"):
        run = 0.0
        for v in range(500):
            run += 1.0 + v % 3
            r = by[f, float(v)]
            assert (r.lw, r.lk, r.next, r.sk) == (run, v + 1, float(v + 1) if v < 499 else None, 500)


def test_weakest_links_and_cuts(spark):
    leaf = lambda p: ("t", p, len(p) - 1, None, None, None, 0.5, 1.0, 1.0, None)
    split = lambda p, gain: ("t", p, len(p) - 1, "f", ">", 1.0, 0.5, 1.0, 1.0, gain)
    nodes = spark.createDataFrame([split("R", 0.01), split("RT", 0.2), leaf("RF"), split("RTT", 0.001), leaf("RTF"), leaf("RTTT"), leaf("RTTF")], trees.NODE_SCHEMA)
    links = trees.weakest_links(nodes)
    # the small split goes first; the root gains little by itself but carries the large one below it
    assert {r.path: round(r.collapse, 6) for r in links.collect() if r.collapse is not None} == {"RTT": 0.001, "R": 0.105, "RT": 0.105}
    cut = trees.cut_at(links, [0.0, 0.05, 0.2])
    assert {(r.cost, r.path) for r in cut.collect()} == {(0.0, p) for p in ("R", "RT", "RF", "RTT", "RTF", "RTTT", "RTTF")} | {(0.05, p) for p in ("R", "RT", "RF", "RTT", "RTF")} | {(0.2, "R")}


def test_rules(spark):
    rows = [("t", "R", 0, "f", "<=", 2.0, 0.5, 0.0, 0.0, None), ("t", "RT", 1, None, None, None, 0.9, 0.0, 0.0, None), ("t", "RF", 1, None, None, None, 0.1, 0.0, 0.0, None)]
    e = trees.score_exprs(spark.createDataFrame(rows, trees.NODE_SCHEMA), F.lit("t"))
    assert [r[0] for r in spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "f double").select(e["likelihood"]).collect()] == [0.9, 0.9, 0.1]


def _events(spark, rows):
    return spark.createDataFrame(rows, "agent_id long, event_id long, at string, correct double").select("agent_id", "event_id", F.to_timestamp("at").alias("ts"), "correct")


def test_stream_drops_late_rows_and_ends_empty(spark):
    first = _events(spark, [(1, 1, "2024-01-01 00:00:00", 1.0), (1, 2, "2024-01-01 00:30:00", 0.0), (1, 2, "2024-01-01 00:30:00", 0.0), (2, 3, "2024-01-02 00:00:00", 1.0)])
    second = _events(spark, [(1, 4, "2024-01-01 00:40:00", 1.0), (1, 5, "2024-01-01 23:30:00", 1.0), (2, 6, "2024-01-02 01:00:00", 0.0)])
    end = _events(spark, [(-1, -1, "2024-03-01 00:00:00", 0.0)])
    plan = lambda s: online.deduplicated(s, ["event_id"], delay="1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "agent_id").agg(F.count("*").alias("n")).select("agent_id", F.hour("w.start").alias("h"), "n")
    out, progress = online.run_in_order([first, second, end], plan)
    # the row of 00:40 comes when the watermark stands at 23:00; that of 23:30 is in time
    assert sorted(tuple(r) for r in out.filter("agent_id > 0").collect()) == [(1, 0, 2), (1, 23, 1), (2, 0, 1), (2, 1, 1)]
    assert sum(p["dropped_late"] for p in progress) >= 1


def test_closed_tracks(spark):
    rows = [(1, k, f"2024-01-01 0{k}:00:00", float(k % 2)) for k in range(5)] + [(1, 9, "2024-01-03 00:00:00", 1.0)]
    end = _events(spark, [(-1, -1, "2024-03-01 00:00:00", 0.0)])
    plan = lambda s: online.closed_tracks(s.withWatermark("ts", "1 hour"), ["agent_id"], ["correct"], "6 hours")
    out, progress = online.run_in_order([_events(spark, rows), end], plan)
    got = {r.ts.day: [s.correct for s in r.steps] for r in out.filter("agent_id > 0").collect()}
    assert got == {1: [0.0, 1.0, 0.0, 1.0, 0.0], 3: [1.0]}
    assert progress[-1]["state_rows"] <= 1  # the closing row's own track alone is left


def _hides(spark, rows):
    return spark.createDataFrame([(0, 0, *r) for r in rows], "scenario int, episode int, agent_id long, frame_id long, x double, y double, heading double, speed double, hidden boolean")


def test_curved_gap_follows_a_bend(spark):
    # a quarter of a circle of radius 20 at 5 m/s, five frames a second; three of its fourths are hidden
    at = lambda k: (k / 20.0) * 5.0 / 20.0 * 4.0
    rows = [(1, k, 20 * math.sin(at(k)), 20 - 20 * math.cos(at(k)), at(k), 5.0, 6 <= k < 22) for k in range(30)]
    got = {r.frame_id: r for r in tracks.gap_curves(_hides(spark, rows), 5).collect()}
    assert sorted(got) == list(range(30))
    for _, k, x, y, h, v, hidden in rows:
        r = got[k]
        assert r.filled == hidden and math.hypot(r.x_filled - x, r.y_filled - y) < 0.05 and abs(r.speed_filled - v) < 0.1 and abs(r.heading_filled - h) < 0.02
        assert r.acceleration_filled is None if not hidden else abs(r.acceleration_filled) < 0.2


def test_gaps_that_stand_still_or_do_not_close(spark):
    rows = [(1, k, 3.0 + 0.001 * k, 4.0, 0.1 * k, 2.0, k in (2, 3)) for k in range(6)]  # does not move
    rows += [(2, k, float(k), 0.0, 0.0, 5.0, k in (0, 1, 4, 5)) for k in range(6)]  # hidden at both ends
    rows += [(3, k, float(k), 0.0, 0.0, 5.0, k in (1, 2)) for k in range(6)]  # opens right after the first frame
    rows += [(4, k, float(k), 0.0, 0.0, 5.0, True) for k in range(3)]  # never seen
    rows += [(5, k, None if k == 1 else float(k), 0.0, None if k == 1 else 0.0, 5.0, k == 2) for k in range(4)]  # nothing known where the gap opens
    got = {(r.agent_id, r.frame_id): r for r in tracks.gap_curves(_hides(spark, rows), 5).collect()}
    for k in (2, 3):
        r = got[1, k]
        assert (r.x_filled, r.y_filled, r.speed_filled, r.acceleration_filled, r.heading_filled) == (3.001, 4.0, 0.0, 0.0, 0.4)
    frames = lambda a: sorted(k for b, k in got if b == a)
    assert frames(2) == [2, 3] and frames(3) == [0, 3, 4, 5] and frames(4) == [] and frames(5) == [0, 1, 2, 3]
    assert got[5, 2].x_filled is None and got[5, 2].filled
    assert tracks.gap_curves(_hides(spark, rows[:0] or [rows[0]]).limit(0), 5).count() == 0


def test_hidden_area_bounds_halve(spark):
    states = spark.createDataFrame([(0, 0, 0, 1, 0.0, 3.0, 0.0), (0, 0, 0, 2, 20.0, -1.0, 0.4), (0, 0, 0, 3, 35.0, 4.0, 1.2)], "scenario int, episode int, frame_id long, agent_id long, x double, y double, heading double")
    boxes = occlusion.outlines(states)
    quads = occlusion.shadow_quads(occlusion.sightings(boxes))
    segments = spark.createDataFrame([("a", 0.0, -10.0, 0.0, 150.0, 0.0, 160.0), ("b", 0.0, 40.0, -30.0, 70.0, 10.0, 50.0), ("c", 0.0, 500.0, 0.0, 510.0, 0.0, 10.0)], "lane string, s0 double, x0 double, y0 double, x1 double, y1 double, len double")
    rects = occlusion.lane_rects(segments, 4.0)
    assert {r.lane: r.a for r in rects.groupBy("lane").agg(F.round(F.sum(4 * F.col("hs") * F.col("ho")), 6).alias("a")).collect()} == {"a": 640.0, "b": 200.0, "c": 40.0}
    sides = {}
    for q in quads.collect():
        sides.setdefault(q.ego_id, []).append([(q[f"_nx{i}"], q[f"_ny{i}"], q[f"_c{i}"]) for i in range(4)])
    place = {r.agent_id: (r.x, r.y) for r in states.collect()}

    def brute(ego, x0, y0, x1, y1, n, step=0.1):
        ex, ey = place[ego]
        ux, uy = (x1 - x0) / n, (y1 - y0) / n
        hidden = 0
        for i in range(round(n / step)):
            for j in range(round(4 / step)):
                s, o = (i + 0.5) * step, (j + 0.5) * step - 2
                x, y = x0 + ux * s - uy * o, y0 + uy * s + ux * o
                hidden += math.hypot(x - ex, y - ey) > 100 or any(all(a * x + b * y >= c for a, b, c in q) for q in sides.get(ego, []))
        return hidden * step * step

    want = {(e, r.lane): brute(e, r.x0, r.y0, r.x1, r.y1, r.len) for e in (1, 2, 3) for r in segments.collect() if r.lane != "c"}
    open_area = []
    for levels in (1, 2, 3):
        got = {(r.ego_id, r.lane): r for r in occlusion.hidden_areas(boxes, rects, quads, 4.0, levels=levels).collect()}
        assert set(got) == set(want)  # the third lane is out of sight
        for k, r in got.items():
            assert r.at_least - 0.5 <= want[k] <= r.at_most + 0.5 and r.at_least <= r.hidden_area <= r.at_most
        open_area.append(sum(r.at_most - r.at_least for r in got.values()))
    assert open_area[1] < 0.7 * open_area[0] and open_area[2] < 0.7 * open_area[1]
    assert occlusion.hidden_areas(boxes.limit(0), rects, quads.limit(0), 4.0, levels=1).count() == 0
    alone = occlusion.hidden_areas(boxes.filter("agent_id = 1"), rects, quads.limit(0), 4.0, levels=1).filter("lane = 'b'").first()
    assert abs(alone.hidden_area) < 1e-9 and abs(alone.at_most) < 1e-9  # nothing stands in the way
