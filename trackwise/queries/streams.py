"""Queries over the event table as a stream whose order of arrival is known.

The table arrives in batches of ten days. Rows planted by the numbers of the events come two
batches late, beyond the watermark, one batch late but within it, or twice. A last row far
ahead moves the watermark past all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import probes
from trackwise.operators import lanes as road
from trackwise.operators.posterior import r9
from trackwise.plans import trees
from trackwise.queries import town
from trackwise.registry import query
from trackwise.shared import kept
from trackwise.streaming import online

DELAY = "1 day"
BATCHES = 5


def _arrivals(spark: SparkSession, sf: str) -> list[DataFrame]:
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("agent_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value", (F.col("event_type") == "error").alias("hidden"))
    own = F.floor((F.dayofmonth("ts") - 1) / 10)
    last_hours = ((F.dayofmonth("ts") - 1) % 10 == 9) & (F.hour("ts") >= 12)
    late, twice, in_time = (F.col("event_id") % 20 == 3) & (F.dayofmonth("ts") <= 28), F.col("event_id") % 20 == 4, last_hours & (F.col("event_id") % 3 == 0)
    comes = F.when(late, F.array(own + 2)).when(in_time, F.array(own + 1)).when(twice, F.array(own, own, own + 1)).otherwise(F.array(own))
    there = events.select("*", F.explode(comes).alias("batch"))
    end = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("agent_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"), F.lit(0.0).alias("value"), F.lit(False).alias("hidden"))
    return [there.filter(F.col("batch") == i).drop("batch") for i in range(BATCHES)] + [end.select(*events.columns)]


#: The rows that are not beyond the watermark when they come, each once.
IN_TIME = "SELECT user_id AS agent_id, event_id, ts, value, event_type = 'error' AS hidden FROM events WHERE NOT (event_id % 20 = 3 AND day(ts) <= 28)"


@query(f"WITH e AS ({IN_TIME}) SELECT agent_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS win, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value, arg_max(hidden, ts) AS hidden FROM e GROUP BY 1, 2")
def streamed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """O-117: the last state of each agent in each window, in append mode; late rows beyond the watermark and repeats are dropped, late rows within it count."""
    plan = lambda s: online.per_second(online.deduplicated(s, ["event_id"], delay=DELAY), ["agent_id"], length="6 hours")
    out, _ = online.run_in_order(_arrivals(spark, sf), plan)
    return out.filter("agent_id >= 0").select("agent_id", F.col("win").cast("timestamp_ntz").alias("win"), "event_id", "value", "hidden")


@query(f"""WITH e AS ({IN_TIME}), s AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY agent_id ORDER BY ts) >= INTERVAL 30 HOUR, true) AS new FROM e),
n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY agent_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS track FROM s),
f AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER t AS n, max(ts) OVER t + INTERVAL 30 HOUR - INTERVAL 1 MICROSECOND AS closed FROM n WINDOW w AS (PARTITION BY agent_id, track ORDER BY ts), t AS (PARTITION BY agent_id, track))
SELECT time_bucket(INTERVAL 10 DAY, closed, TIMESTAMP '1970-01-01') AS win, CAST(round_even(i / n, 1) AS DOUBLE) AS fraction, round(avg(CASE WHEN value > 200 THEN 1.0 ELSE 0.0 END), 9) AS accuracy, count(*) AS n FROM f GROUP BY 1, 2""")
def streamed_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """O-118: two stateful operators in a row, in append mode: tracks close after 30 hours of silence, and closed tracks are summed up by fraction observed."""
    def plan(stream: DataFrame) -> DataFrame:
        clean = online.deduplicated(stream, ["event_id"], delay=DELAY).withColumn("correct", (F.col("value") > 200).cast("double"))
        tracks = online.closed_tracks(clean.filter("agent_id >= 0 OR event_id = -1"), ["agent_id"], ["correct"], "30 hours")
        return online.accuracy_by_fraction(tracks.filter("agent_id >= 0"), "10 days")

    out, _ = online.run_in_order(_arrivals(spark, sf), plan)
    return out.select(F.col("win").cast("timestamp_ntz").alias("win"), "fraction", r9("accuracy").alias("accuracy"), "n")


FPS = probes.FPS
#: A likelihood by the way that is left and, if the target was seen a second ago, by whether it gains speed.
NODES = [
    ("t", "R", 0, "left", ">", 40.0, 0.5, 0.0, 0.0, None), ("t", "RT", 1, None, None, None, 0.3, 0.0, 0.0, None), ("t", "RF", 1, "speed_change", ">", 0.0, 0.65, 0.0, 0.0, None),
    ("t", "RFT", 2, None, None, None, 0.8, 0.0, 0.0, None), ("t", "RFF", 2, None, None, None, 0.6, 0.0, 0.0, None),
]
#: Pairs of each vehicle with the one of the next number, while both are there.
PAIRS = f"""WITH d AS ({probes.DRIVES}) SELECT d.scenario, d.episode, d.agent_id, e.agent_id AS ego_id, d.frame_id, d.x, d.y, d.heading, d.speed, (d.agent_id + d.frame_id) % 7 = 0 AS hidden
FROM d JOIN d e ON e.scenario = d.scenario AND e.episode = d.episode AND e.frame_id = d.frame_id AND e.agent_id = d.agent_id + 1"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    probes.expose(spark, sf, "events")
    return spark.sql(PAIRS.replace("//", "div")).withColumn("ts", F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("frame_id") * (1000 // FPS)))


_OLD = " AND ".join(f"o.{c} = p.{c}" for c in ("scenario", "episode", "agent_id", "ego_id"))


@query(f"""WITH p AS ({PAIRS}), {town.MAPS}, {town.PATHS.split("en AS")[0].rstrip().rstrip(",")},
h AS (SELECT p.*, coalesce(p.speed - o.speed, 0) AS speed_change, p.hidden OR o.frame_id IS NULL OR o.hidden AS occluded FROM p LEFT JOIN p o ON {_OLD} AND o.frame_id = p.frame_id - {FPS} WHERE p.frame_id % {FPS} = 0),
a0 AS (SELECT h.*, g.lane, g.seg, g.x0, g.y0, x1, y1, s0, len, g.h AS lh, greatest(0.0, least(1.0, ((x - g.x0) * (x1 - g.x0) + (y - g.y0) * (y1 - g.y0)) / (len * len))) AS t FROM h JOIN g ON g.scenario = h.scenario),
a1 AS (SELECT *, s0 + t * len AS lon, round(sqrt((x - x0 - t * (x1 - x0)) * (x - x0 - t * (x1 - x0)) + (y - y0 - t * (y1 - y0)) * (y - y0 - t * (y1 - y0))), 9) AS dist, round(abs((heading - lh) - 2 * pi() * floor(((heading - lh) + pi()) / (2 * pi()))), 9) AS turn FROM a0),
a2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario, episode, agent_id, ego_id, frame_id ORDER BY dist, turn, lane, seg) AS rn FROM a1 WHERE dist <= {town.REACH} AND turn <= pi() / 4 + 1e-9) WHERE rn = 1),
u AS (SELECT a2.*, go0.goal_lane, go0.goal_type, CASE WHEN path_length - lon > 40 THEN 0.3 WHEN occluded THEN 0.65 WHEN speed_change > 0 THEN 0.8 ELSE 0.6 END AS u FROM a2 JOIN go0 ON go0.start = a2.lane JOIN pf ON pf.start = go0.start AND pf.goal_lane = go0.goal_lane)
SELECT scenario, episode, agent_id, ego_id, frame_id, lane, goal_lane, goal_type, round(speed_change, 9) AS speed_change, occluded, round(u / sum(u) OVER (PARTITION BY scenario, episode, agent_id, ego_id, frame_id), 9) AS prob FROM u""")
def streamed_posterior(spark: SparkSession, sf: str) -> DataFrame:
    """O-115, O-116: histories of pairs kept by a stateful processor with timers, states placed on lanes and scored against the goals these lead to by joins with static tables."""
    maps = town.town_of(spark)
    cells = kept(online.segments_by_cell(maps.segments, town.REACH))
    lengths = road.path_lengths(maps.searches, maps.lanes, maps.segments)
    goal = F.struct("goal_lane", "goal_type", "path_length")
    goals = kept(maps.searches.join(lengths, ["start", "goal_lane"]).groupBy(F.col("start").alias("lane")).agg(F.array_sort(F.collect_list(goal)).alias("goals")))
    nodes = spark.createDataFrame(NODES, trees.NODE_SCHEMA)

    def likelihood(g):
        at = {"left": g["path_length"] - F.col("lon")}
        return trees.score_exprs(nodes, F.lit("t"), {"speed_change": "occluded"}, lambda f: at[f] if f in at else F.col(f))["truncated"]

    def plan(stream: DataFrame) -> DataFrame:
        history = online.pair_history(stream.withWatermark("ts", "4 seconds"), FPS, 10_000)
        return online.goal_posterior(online.located(history, cells, town.REACH), goals, likelihood)

    rows = kept(_pairs(spark, sf))
    end = rows.limit(1).withColumn("agent_id", F.lit(-1).cast("long")).withColumn("ts", F.timestamp_millis(F.lit(1_704_067_200_000 + 86_400_000)))
    out, _ = online.run_in_order([rows.filter(F.col("frame_id").between(a, b)) for a, b in ((0, 29), (30, 59), (60, 10**9))] + [end], plan)
    return out.filter("agent_id >= 0").select(*online.PAIR, "frame_id", "lane", "goal_lane", "goal_type", r9("speed_change").alias("speed_change"), "occluded", r9("prob").alias("prob"))
