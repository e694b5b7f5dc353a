"""The nearest vehicles along paths looked up in order, against the join of each pair of places."""

import random

from pyspark.sql import functions as F

from trackwise.operators import lanes
from trackwise.queries import roads


def _located(spark, n: int):
    dice = random.Random(n)
    places = [0.0, 0.0, 10.0, 0.1 + 0.2, 0.3, *[dice.uniform(0, 10) for _ in range(n // 3)]]
    rows = [(0, 0, a % 2, a, dice.choice(places), dice.choice("abc"), float(a)) for a in range(n)]
    return spark.createDataFrame(rows, "scenario int, episode int, frame_id long, agent_id long, lon double, lane string, speed double")


def test_nearest_along_is_what_the_join_tells(spark):
    watch = spark.createDataFrame([("a", "g", "a", 0.0), ("a", "g", "b", 10.0), ("a", "h", "a", 0.0), ("a", "h", "c", 10.0), ("b", "g", "b", 0.0), ("c", "i", "x", 3.0), ("b", "k", "b", 4.5)], "start string, goal_lane string, peer_lane string, offset double")
    rows = lambda df: sorted((tuple(r) for r in df.select(*roads.KEY, "start", "goal_lane", F.round("_dist", 9), "_speed").collect()), key=str)
    for n in (9, 150):
        located = _located(spark, n)
        ahead = roads._nearest_watched(located, watch, F.col("offset") + F.col("_lon") - F.col("lon"), F.col("_d") > 1e-4)
        got = rows(lanes.nearest_along(located, watch, True, 1e-4))
        assert got == rows(ahead) and len({r[-2] for r in got}) > 3
        back = roads._nearest_watched(located, watch, F.col("offset") - F.col("_lon"), (F.col("_d") > 0) & (F.col("_d") < 8))
        assert rows(lanes.nearest_along(located, watch, False, 0.0, 8.0)) == rows(back)


def test_nothing_of_pairs_is_shuffled(spark):
    """Vehicles are shuffled once, by frame, and no join of places with places is planned."""
    watch = spark.createDataFrame([("a", "g", "b", 10.0)], "start string, goal_lane string, peer_lane string, offset double")
    plan = lanes.nearest_along(_located(spark, 9), watch, True, 1e-4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
