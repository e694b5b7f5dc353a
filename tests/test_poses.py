"""What agents that stand in one pose share, against each agent on its own."""

import random

from pyspark.sql import functions as F

from trackwise.operators import occlusion, tracks
from trackwise.queries import roads

NAMES = "scenario int, episode int, frame_id long, agent_id long, x double, y double, heading double, speed double"


def crowd(spark, n_poses: int, copies: int):
    """Agents of one frame in ``n_poses`` poses, of which every third holds one agent, the others ``copies``."""
    dice = random.Random(5)
    rows = []
    for p in range(n_poses):
        x, y, heading = dice.uniform(0, 60), dice.uniform(0, 40), dice.uniform(-3, 3)
        rows += [(0, 0, 0, p + 100 * c, x, y, heading, float(c)) for c in range(1 if p % 3 == 0 else copies)]
    return spark.createDataFrame(rows, NAMES)


def test_hidden_pairs_of_shared_poses(spark):
    states = crowd(spark, 9, 3)
    boxes = occlusion.outlines(states)
    alone = occlusion.hidden_targets(boxes, occlusion.shadow_quads(occlusion.sightings(boxes)))
    key = lambda df: sorted((r.ego_id, r.agent_id, r.hidden) for r in df.collect())
    want = key(alone)
    assert key(occlusion.hidden_between(states)) == want and len(want) == 21 * 20 and {h for *_, h in want} == {True, False}


def test_views_do_not_grow_with_the_agents_of_a_pose(spark):
    """Sightings, of which every view's shadows are made, are as many for 3 agents a pose as for 40."""
    sizes = []
    for copies in (3, 40):
        members = occlusion.posed(crowd(spark, 9, copies))
        sizes.append(occlusion.sightings(occlusion.pose_boxes(members)).count())
        ids = occlusion.followers(members)
        assert ids.select(F.explode("ids")).count() == members.count()
    assert sizes == [9 * 8 + 6] * 2


def test_nearest_peers_of_a_crowd(spark):
    states = spark.createDataFrame([(0, 0, 0, a, float(a % 4), float(a % 3), 0.0, 0.0) for a in range(40)], NAMES)
    at = {r.agent_id: (r.x, r.y) for r in states.collect()}
    dist = lambda a, b: round(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5, 9)
    want = {(a, i + 1): b for a in at for i, b in enumerate(sorted((b for b in at if b != a), key=lambda b: (dist(a, b), b))[:5])}
    assert {(r.agent_id, r["rank"]): r.peer_id for r in tracks.nearest_peers(states, 5).collect()} == want
    # 30,000 agents in one place, 9e8 pairs
    many = spark.range(30_000).select(F.lit(0).alias("scenario"), F.lit(0).alias("episode"), F.lit(0).alias("frame_id"), F.col("id").alias("agent_id"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    got = tracks.nearest_peers(many, 3)
    assert got.count() == 90_000 and got.agg(F.max("peer_id")).first()[0] == 3


def test_vehicles_in_front_of_a_crowd(spark):
    """Against each pair of vehicles, with many at one place of a lane and a path whose own lane is watched."""
    dice = random.Random(3)
    rows = [(0, 0, 0, a, float(dice.choice([0, 3, 7, 11])), dice.choice(["a", "b"]), float(a)) for a in range(30)] + [(0, 0, 0, 99, 5.0, "a", 1.0)]
    located = spark.createDataFrame(rows, "scenario int, episode int, frame_id long, agent_id long, lon double, lane string, speed double")
    watch = spark.createDataFrame([("a", "g", "a", 5.5), ("a", "g", "b", 6.0), ("b", "g", "b", 9.0)], "start string, goal_lane string, peer_lane string, at double")
    got = roads._nearest_watched(located, watch, F.col("at") - F.col("_lon"), F.col("_d") > 0)
    far = {(r[5], r[3]): r for r in rows}
    for r in got.collect():
        near = [(round(w.at - p[4], 9), p[3], p[6]) for w in watch.collect() if w.start == r.start for p in rows if p[5] == w.peer_lane and p[3] != r.agent_id and w.at - p[4] > 0]
        d, _, v = min(near)
        assert (round(r._dist, 9), r._speed) == (d, v), far[r.start, r.agent_id]
    assert got.count() == len(rows)
