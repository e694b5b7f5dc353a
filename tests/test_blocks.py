"""Pairs of views and targets made where their blocks meet, against joins of each pair with its hidden cells."""

import numpy as np
from pyspark.sql import functions as F
from test_poses import crowd
from test_views import _map, _rows

import __spark_entry__ as entry
from trackwise.operators import occlusion

VIEW, FRAME = occlusion.VIEW, occlusion.FRAME
FAR = 80.0


def test_blocks_tell_what_joins_tell(spark, monkeypatch):
    """Paths along two lanes, with a crossing that looks up the other lane; blocks of 5 members, which cut poses in two."""
    monkeypatch.setattr(occlusion, "BLOCK", 5)
    segments, house = _map(spark)
    members = occlusion.posed(crowd(spark, 12, 3))
    boxes = occlusion.pose_boxes(members)
    cells = occlusion.lane_cells(segments, 2.0, 2.0)
    seen = occlusion.views(boxes, house)
    every = boxes.select(*FRAME, F.col("agent_id").alias("ego_id"), F.col("x").alias("ex"), F.col("y").alias("ey")).crossJoin(cells)
    hidden = every.join(occlusion.hidden_cells_of(seen, cells), [*VIEW, "cell"], "left").filter((F.hypot(F.col("cx") - F.col("ex"), F.col("cy") - F.col("ey")) > occlusion.SIGHT) | F.col("hidden"))
    path = F.when(F.col("lane") == "a", 0).otherwise(1)
    asked = boxes.select(*FRAME, "agent_id", "x", "y", (F.col("x") / 2).alias("lon"))
    ahead = asked.join(hidden.drop("hidden"), FRAME).filter(F.col("s") > F.col("lon")).withColumn("dist", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y"))).filter(F.col("dist") <= FAR)
    near = occlusion.patches(ahead.withColumn("path", path), ["agent_id", "path"], "s", 2.0).groupBy(*VIEW, "agent_id", "path").agg(F.min("dist").alias("front"))
    up = occlusion.patches(hidden.filter("lane = 'b' AND s <= 60").withColumn("dist", F.col("s")), ["lane"], "s", 2.0).groupBy(*VIEW).agg(F.min("dist").alias("oncoming"))
    wide = boxes.select(*FRAME, F.col("agent_id").alias("ego_id")).join(asked, FRAME).withColumn("path", F.explode(F.array(F.lit(0), F.lit(1))))
    want = wide.join(near, [*VIEW, "agent_id", "path"], "left").join(up, VIEW, "left")
    pick = lambda df: df.select("ego_id", "agent_id", "path", F.coalesce("front", F.lit(-1.0)).alias("front"), F.when(F.col("path") == 0, F.coalesce("oncoming", F.lit(-1.0))).otherwise(-1.0).alias("oncoming"))

    at = occlusion.CellMap(cells)
    rows = cells.toPandas().sort_values("s")
    lists = {p: (at.numbers(g["cell"].to_numpy()), g["s"].to_numpy(), g["area"].to_numpy()) for p, g in ((0, rows[rows.lane == "a"]), (1, rows[rows.lane == "b"]))}
    watched = occlusion.Watched(lists, {0: [tuple(c[lists[1][1] <= 60] for c in lists[1])]}, FAR, 2.0)
    egos = members.select(*FRAME, F.col("pose").alias("ego_id"), "agent_id").join(occlusion.seen_cells(seen, at), VIEW)
    targets = members.join(asked.select(*FRAME, F.col("agent_id").alias("pose"), "lon"), [*FRAME, "pose"]).withColumn("path", F.explode(F.array(F.lit(0), F.lit(1))))
    met = occlusion.missing_blocks(occlusion.blocks(egos, ["ego_id", "ex", "ey", "bits"], ["agent_id"], "egos"), occlusion.blocks(targets, ["pose", "path", "x", "y", "lon"], ["agent_id"], "targets"), at, watched, front=True, oncoming=True)
    got = set()
    agents = 0
    for r in met.collect():
        assert sum(len(e["rows"]) for e in r["egos"]) <= 5 and sum(len(t["rows"]) for t in r["targets"]) <= 5
        for e, front, oncoming in zip(r["egos"], r["front"], r["oncoming"], strict=True):
            for t, f, o in zip(r["targets"], front, oncoming, strict=True):
                agents += len(e["rows"]) * len(t["rows"])
                got.add((e["ego_id"], t["pose"], t["path"], *[round(v, 6) if np.isfinite(v) else -1.0 for v in (f, o)]))
    assert sorted(got) == _rows(pick(want)) and len({f for *_, f, _ in got}) > 10 and len({o for *_, o in got}) > 1
    assert agents == members.count() ** 2 * 2


def test_pairs_of_a_frame_are_not_shuffled(spark):
    """Above the step where views meet targets there is no exchange."""
    for name in ("feature_rows", "oncoming_vehicle_missing", "vehicle_in_front_missing"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")], name


def test_views_are_not_shuffled_with_their_arrays(spark):
    """Views with the whole frame as targets: no exchange holds a view's shadows."""
    boxes = occlusion.outlines(crowd(spark, 6, 2))
    plan = occlusion.views(boxes.withColumn("ids", F.array("agent_id")), targets=["ids"])._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange" in line]
    made = next(i for i, line in enumerate(lines) if "filter(_there" in line)
    assert all(i > made for i in exchanges) and "_there" not in "".join(line for line in lines if "Exchange" in line)
    assert plan.count("Exchange hashpartitioning") <= 2
