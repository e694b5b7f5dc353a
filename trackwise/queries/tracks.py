"""Track queries over the states derived from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import tracks as op
from trackwise.operators.posterior import r9
from trackwise.registry import query

S = f"s AS ({probes.STATES})"
G = f"g AS ({probes.GOALS})"
FPS = probes.FPS
MOVING = "mv AS (SELECT * FROM (SELECT *, max(sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy))) OVER (PARTITION BY episode, agent_id) AS far FROM (SELECT *, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM s WHERE agent_type <> 'pedestrian' WINDOW w AS (PARTITION BY episode, agent_id ORDER BY frame_id))) WHERE far >= 1.0)"
HITS = f"h AS (SELECT episode, agent_id, goal_idx, min(frame_id) AS hit_frame FROM s, g WHERE sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) <= {probes.GOAL_RADIUS} GROUP BY 1, 2, 3)"
TRUE = "tg AS (SELECT episode, agent_id, goal_idx AS true_goal, hit_frame AS goal_frame FROM (SELECT *, row_number() OVER (PARTITION BY episode, agent_id ORDER BY hit_frame DESC, goal_idx DESC) AS rn FROM h) WHERE rn = 1)"
DIFF = "CASE WHEN d - 2 * pi() * floor((d + pi()) / (2 * pi())) = -pi() AND d > 0 THEN pi() ELSE d - 2 * pi() * floor((d + pi()) / (2 * pi())) END"


@query(f"""WITH {S} SELECT agent_id, frame_id, k, round(x + dx * cos(heading) - dy * sin(heading), 9) AS cx, round(y + dx * sin(heading) + dy * cos(heading), 9) AS cy
FROM s, (VALUES (0, -2.25, -0.9), (1, 2.25, -0.9), (2, 2.25, 0.9), (3, -2.25, 0.9)) AS v(k, dx, dy)""")
def track_bounding_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """O-12: a box of 4.5 by 1.8 at every state."""
    box = op.corners(F.col("x"), F.col("y"), F.lit(4.5), F.lit(1.8), F.col("heading"))
    return probes.states(spark, sf).select("agent_id", "frame_id", F.posexplode(box).alias("k", "c")).select("agent_id", "frame_id", "k", r9("c.x").alias("cx"), r9("c.y").alias("cy"))


@query(f"WITH {S}, a AS (SELECT *, -degrees(heading) AS h FROM s) SELECT agent_id, frame_id, round(x / 0.1, 9) AS x_vis, round(-y / 0.1, 9) AS y_vis, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 9) AS heading_vis, round(speed * 3.6, 9) AS kmh FROM a")
def image_projection(spark: SparkSession, sf: str) -> DataFrame:
    """O-13, O-15, O-16."""
    s = probes.states(spark, sf)
    x, y, h = op.to_image(F.col("x"), F.col("y"), F.degrees("heading"), 0.1)
    return s.select("agent_id", "frame_id", r9(x).alias("x_vis"), r9(y).alias("y_vis"), r9(h).alias("heading_vis"), r9(F.hypot(F.col("speed"), F.lit(0.0)) * 3.6).alias("kmh"))


@query(f"""WITH {S} SELECT agent_id, CAST(round_even(frame_id * 0.0333 / 0.033366, 0) AS BIGINT) AS frame, round(degrees(heading), 9) AS heading_deg, round(speed * cos(heading), 9) AS vx, round(speed * sin(heading), 9) AS vy,
CASE agent_type WHEN 'truck_bus' THEN 'truck_bus' WHEN 'car' THEN 'car' WHEN 'bicycle' THEN 'bicycle' ELSE 'pedestrian' END AS class FROM s""")
def unit_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """O-17, O-18: time to frames (half to even), radians to degrees, velocity components, class names; an unknown class raises."""
    from trackwise.sources.tables import class_name

    s = probes.states(spark, sf)
    return s.select("agent_id", F.bround(F.col("frame_id") * 0.0333 / 0.033366).cast("long").alias("frame"), r9(F.degrees("heading")).alias("heading_deg"), r9(F.col("speed") * F.cos("heading")).alias("vx"), r9(F.col("speed") * F.sin("heading")).alias("vy"), class_name(F.col("agent_type")).alias("class"))


@query(f"WITH {S} SELECT episode, agent_id, agent_type, min(frame_id) AS first_frame, max(frame_id) AS last_frame, count(*) AS n_states, max(frame_id) - min(frame_id) + 1 AS num_frames FROM s GROUP BY 1, 2, 3")
def life_spans(spark: SparkSession, sf: str) -> DataFrame:
    """O-75."""
    return op.life_spans(probes.states(spark, sf)).drop("scenario")


@query(f"WITH {S}, {MOVING} SELECT episode, agent_id, frame_id FROM mv WHERE frame_id % {FPS} = 0 AND agent_type IN ('car', 'truck_bus')")
def sampled_moving_vehicles(spark: SparkSession, sf: str) -> DataFrame:
    """O-35, O-36, O-37."""
    s = op.each_second(op.moving_agents(probes.states(spark, sf)), FPS)
    return s.filter(F.col("agent_type").isin("car", "truck_bus")).select("episode", "agent_id", "frame_id")


def _lag_sql() -> str:
    cols = []
    for k in (1, 2, 3):
        d = f"(s.heading - p{k}.heading)"
        cols.append(f"round(coalesce(s.speed - p{k}.speed, 0), 9) AS speed_change_{k}s, round(coalesce({DIFF.replace('d ', d + ' ').replace('(d', '(' + d)}, 0), 9) AS heading_change_{k}s, round(coalesce(sqrt((s.x - p{k}.x) * (s.x - p{k}.x) + (s.y - p{k}.y) * (s.y - p{k}.y)), 0), 9) AS dist_travelled_{k}s")
    joins = " ".join(f"LEFT JOIN s p{k} ON p{k}.agent_id = s.agent_id AND p{k}.frame_id = s.frame_id - {k * FPS}" for k in (1, 2, 3))
    return f"WITH {S} SELECT s.agent_id, s.frame_id, {', '.join(cols)} FROM s {joins} WHERE s.frame_id % {FPS} = 0"


@query(_lag_sql())
def lag_features(spark: SparkSession, sf: str) -> DataFrame:
    """O-14, O-79: lags on all frames, then one-second sampling."""
    out = op.each_second(op.lags(probes.states(spark, sf), FPS), FPS)
    names = [f"{n}_{k}s" for k in (1, 2, 3) for n in ("speed_change", "heading_change", "dist_travelled")]
    return out.select("agent_id", "frame_id", *[r9(n).alias(n) for n in names])


@query(f"WITH {S}, {G}, {HITS} SELECT * FROM h")
def goal_hits(spark: SparkSession, sf: str) -> DataFrame:
    """O-62."""
    return op.goal_hits(probes.states(spark, sf), probes.goals(spark), probes.GOAL_RADIUS).drop("scenario")


@query(f"""WITH {S}, {G}, {HITS}, {TRUE}, t AS (SELECT s.*, tg.true_goal, tg.goal_frame FROM s JOIN tg ON tg.episode = s.episode AND tg.agent_id = s.agent_id WHERE s.frame_id <= tg.goal_frame)
SELECT agent_id, frame_id, true_goal, min(frame_id) OVER w AS initial_frame_id, round((frame_id - min(frame_id) OVER w) * 1.0 / count(*) OVER w, 9) AS fraction_observed FROM t WINDOW w AS (PARTITION BY episode, agent_id)""")
def trimmed_to_goal(spark: SparkSession, sf: str) -> DataFrame:
    """O-33, O-38, O-62."""
    s = probes.states(spark, sf)
    t = op.trimmed(s, op.true_goals(op.goal_hits(s, probes.goals(spark), probes.GOAL_RADIUS)))
    return t.select("agent_id", "frame_id", "true_goal", "initial_frame_id", r9("fraction_observed").alias("fraction_observed"))


@query(f"""WITH {S}, {G}, {HITS}, {TRUE}, {MOVING}, sp AS (SELECT mv.episode, mv.agent_id, min(frame_id) AS a, max(frame_id) AS b FROM mv JOIN tg ON tg.episode = mv.episode AND tg.agent_id = mv.agent_id WHERE mv.frame_id <= tg.goal_frame GROUP BY 1, 2)
SELECT t.episode, t.agent_id, e.agent_id AS ego_id, greatest(t.a, e.a) AS start_frame, least(t.b, e.b) AS end_frame FROM sp t JOIN sp e ON e.episode = t.episode AND e.agent_id <> t.agent_id AND t.a <= e.b AND e.a <= t.b AND e.b - e.a + 1 >= {FPS}""")
def ego_target_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """O-47: pairs of goal-reaching, moving agents."""
    s = probes.states(spark, sf)
    kept = op.trimmed(op.moving_agents(s), op.true_goals(op.goal_hits(s, probes.goals(spark), probes.GOAL_RADIUS)))
    return op.pairs(op.life_spans(kept), FPS).drop("scenario")


@query(f"""WITH {S}, p AS (SELECT a.episode, a.frame_id, a.agent_id, b.agent_id AS peer_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM s a JOIN s b ON a.episode = b.episode AND a.frame_id = b.frame_id AND a.agent_id <> b.agent_id WHERE a.frame_id % {FPS} = 0)
SELECT episode, frame_id, agent_id, peer_id, round(distance, 9) AS distance, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY episode, frame_id, agent_id ORDER BY round(distance, 9), peer_id) AS rn FROM p) WHERE rn <= 3""")
def nearest_peers(spark: SparkSession, sf: str) -> DataFrame:
    """O-48, O-86."""
    near = op.nearest_peers(op.each_second(probes.states(spark, sf), FPS).select(*op.FRAME, "agent_id", "x", "y"), 3)
    return near.select("episode", "frame_id", "agent_id", "peer_id", r9("distance").alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {S}, q AS (SELECT * FROM s WHERE frame_id % {FPS} = 0), l AS (SELECT *, {', '.join(f'coalesce(lag(hidden, {k}) OVER w, true) OR hidden AS target_{k}s_occluded' for k in (1, 2, 3))} FROM q WINDOW w AS (PARTITION BY episode, agent_id ORDER BY frame_id))
SELECT agent_id, frame_id, target_1s_occluded, target_2s_occluded, target_3s_occluded FROM l WHERE NOT hidden""")
def hidden_history(spark: SparkSession, sf: str) -> DataFrame:
    """O-41, O-80: history first, then only visible samples."""
    h = op.hidden_history(op.each_second(probes.states(spark, sf), FPS))
    return h.filter(~F.col("hidden")).select("agent_id", "frame_id", *[f"target_{k}s_occluded" for k in (1, 2, 3)])


@query(f"WITH {S} SELECT episode, agent_id, min(CASE WHEN NOT hidden THEN frame_id END) AS first_seen, max(CASE WHEN NOT hidden THEN frame_id END) AS last_seen FROM s GROUP BY 1, 2")
def visible_spans(spark: SparkSession, sf: str) -> DataFrame:
    """O-81."""
    return op.visible_span(probes.states(spark, sf)).drop("scenario")


@query(f"""WITH {S}, f AS (SELECT agent_id, row_number() OVER (ORDER BY min(ts), agent_id) - 1 AS new_id FROM s GROUP BY agent_id)
SELECT s.agent_id, s.frame_id, f.new_id, f.new_id // 40 AS chunk, round((epoch_us(s.ts) - (SELECT min(epoch_us(ts)) FROM s)) / 1e6, 3) AS seconds FROM s JOIN f ON f.agent_id = s.agent_id""")
def renumbered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """O-82, O-83."""
    out = op.renumbered(probes.states(spark, sf), "ts", 40)
    return out.select("agent_id", "frame_id", F.col("new_id").cast("long").alias("new_id"), "chunk", F.round("seconds", 3).alias("seconds"))


@query(f"""WITH {S}, r AS (SELECT *, CASE WHEN speed > 45 THEN 0 ELSE 2 END AS n_reachable FROM s), t AS (SELECT *, min(CASE WHEN n_reachable = 0 THEN frame_id END) OVER (PARTITION BY episode, agent_id) AS stop FROM r)
SELECT episode, agent_id, count(*) AS n FROM t WHERE stop IS NULL OR frame_id < stop GROUP BY 1, 2""")
def reachable_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """O-39: stop at the first state without candidates (here: too fast for any)."""
    s = probes.states(spark, sf).withColumn("n_reachable", F.when(F.col("speed") > 45, 0).otherwise(2))
    return op.reachable_prefix(s, "n_reachable").groupBy("episode", "agent_id").agg(F.count("*").alias("n"))


@query(f"""WITH {S}, w AS (SELECT *, last_value(CASE WHEN NOT hidden THEN frame_id END IGNORE NULLS) OVER a AS fa, first_value(CASE WHEN NOT hidden THEN frame_id END IGNORE NULLS) OVER b AS fb FROM s
WINDOW a AS (PARTITION BY episode, agent_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY episode, agent_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
j AS (SELECT w.*, p.x AS ax, p.y AS ay, n.x AS bx, n.y AS by_ FROM w LEFT JOIN s p ON p.agent_id = w.agent_id AND p.frame_id = w.fa LEFT JOIN s n ON n.agent_id = w.agent_id AND n.frame_id = w.fb)
SELECT agent_id, frame_id, hidden AS filled, round(CASE WHEN NOT hidden THEN x WHEN fa IS NULL THEN bx WHEN fb IS NULL OR sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) < 0.1 THEN ax ELSE ax + (bx - ax) * (frame_id - fa) / (fb - fa) END, 9) AS x_filled,
round(CASE WHEN NOT hidden THEN y WHEN fa IS NULL THEN by_ WHEN fb IS NULL OR sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) < 0.1 THEN ay ELSE ay + (by_ - ay) * (frame_id - fa) / (fb - fa) END, 9) AS y_filled FROM j""")
def filled_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """O-85."""
    return op.gap_filled(probes.states(spark, sf)).select("agent_id", "frame_id", "filled", r9("x_filled").alias("x_filled"), r9("y_filled").alias("y_filled"))


@query(f"""WITH {S}, v AS (SELECT episode, agent_id, min(CASE WHEN NOT hidden THEN frame_id END) AS a, max(CASE WHEN NOT hidden THEN frame_id END) AS b FROM s GROUP BY 1, 2),
k AS (SELECT s.*, v.a FROM s JOIN v ON v.episode = s.episode AND v.agent_id = s.agent_id WHERE s.frame_id BETWEEN v.a AND v.b), n AS (SELECT agent_id, count(*) AS length FROM k GROUP BY agent_id)
SELECT k.agent_id, n.length, (SELECT max(length) FROM n) AS padded_length, k.frame_id - k.a AS step, round(CASE WHEN hidden THEN 0 ELSE x END, 9) AS x, CASE WHEN hidden THEN 0.0 ELSE 1.0 END AS visible FROM k JOIN n ON n.agent_id = k.agent_id WHERE k.frame_id % {FPS} = 0""")
def padded_sequence_steps(spark: SparkSession, sf: str) -> DataFrame:
    """O-94, O-95: padded sequences, read back at the one-second offsets."""
    s = probes.states(spark, sf)
    seq = op.padded_sequences(s).join(op.visible_span(s), op.AGENT)
    at = seq.select("agent_id", "length", F.size("steps").cast("long").alias("padded_length"), "first_seen", F.posexplode("steps").alias("step", "v"))
    at = at.filter((F.col("step") < F.col("length")) & ((F.col("first_seen") + F.col("step")) % FPS == 0))
    return at.select("agent_id", "length", "padded_length", F.col("step").cast("long").alias("step"), r9("v.x").alias("x"), F.col("v.visible").alias("visible"))


@query(f"""WITH {S}, l AS (UNPIVOT (SELECT agent_id, frame_id, x, y, speed, heading FROM s WHERE frame_id % {FPS} = 0) ON x, y, speed, heading INTO NAME feature VALUE v)
SELECT agent_id, frame_id, feature, round(v, 9) AS v, round(min(v) OVER w - 1, 9) AS low, round(max(v) OVER w + 1, 9) AS high FROM l WINDOW w AS (PARTITION BY agent_id, feature)""")
def feature_series(spark: SparkSession, sf: str) -> DataFrame:
    """O-96."""
    s = op.each_second(probes.states(spark, sf), FPS).select("agent_id", "frame_id", "x", "y", "speed", "heading")
    long = s.unpivot(["agent_id", "frame_id"], ["x", "y", "speed", "heading"], "feature", "v")
    w = Window.partitionBy("agent_id", "feature")
    return long.select("agent_id", "frame_id", "feature", r9("v").alias("v"), r9(F.min("v").over(w) - 1).alias("low"), r9(F.max("v").over(w) + 1).alias("high"))


@query(f"""WITH {S}, {G}, {HITS}, {TRUE} SELECT s.agent_id, count(*) AS n FROM s JOIN tg ON tg.agent_id = s.agent_id JOIN g ON g.goal_idx = tg.true_goal
WHERE s.frame_id = (SELECT min(frame_id) FROM s z WHERE z.agent_id = s.agent_id) AND sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) <= 60 GROUP BY s.agent_id""")
def starts_with_reachable_goal(spark: SparkSession, sf: str) -> DataFrame:
    """O-40, O-46: agents whose true goal lies within 60 of their first state."""
    s, g = probes.states(spark, sf), probes.goals(spark)
    first = s.groupBy(*op.AGENT).agg(F.min_by(F.struct("x", "y"), "frame_id").alias("p"))
    met = first.join(op.true_goals(op.goal_hits(s, g, probes.GOAL_RADIUS)), op.AGENT).join(F.broadcast(g), F.col("goal_idx") == F.col("true_goal"))
    return met.filter(F.hypot(F.col("p.x") - F.col("gx"), F.col("p.y") - F.col("gy")) <= 60).groupBy("agent_id").agg(F.count("*").alias("n"))
