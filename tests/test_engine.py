"""The trajectory engine on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from trackwise.functions import angle_diff, bucket
from trackwise.operators import lanes, occlusion, posterior, tracks
from trackwise.plans import trees
from trackwise.queries import roads
from trackwise.sources import tables


def states(spark, rows):
    return spark.createDataFrame([(0, *r) for r in rows], "scenario int, episode long, agent_id long, frame_id long, x double, y double, heading double, speed double, hidden boolean, agent_type string")


@pytest.mark.parametrize(("a", "b", "d"), [(0.0, 1.0, 1.0), (3.0, -3.0, 2 * math.pi - 6), (0.0, math.pi, math.pi), (math.pi, 0.0, -math.pi), (-3.1, 3.1, 6.2 - 2 * math.pi)])
def test_angle_diff(spark, a, b, d):
    assert spark.range(1).select(angle_diff(F.lit(a), F.lit(b))).first()[0] == pytest.approx(d)


def test_bucket_is_half_even(spark):
    assert [r[0] for r in spark.createDataFrame([(0.25,), (0.35,), (0.05,)], "x double").select(bucket(F.col("x"))).collect()] == [0.2, 0.4, 0.0]


def test_posterior_sums_to_one_and_ties_go_low(spark):
    c = spark.createDataFrame([(1, 2, "a", 0.5, 2), (1, 1, "b", 0.5, 2), (2, 5, "a", 0.3, 1)], "sample_id int, possible_goal int, goal_type string, likelihood double, true_goal int")
    p = posterior.posterior(posterior.uniform_prior(c, ["sample_id"]), ["sample_id"])
    assert all(r[1] == pytest.approx(1) for r in p.groupBy("sample_id").agg(F.sum("prob")).collect())
    by = {r.sample_id: r for r in posterior.summarise(p, ["sample_id"], []).collect()}
    assert by[1].model_prediction == 1 and by[1].entropy_norm == pytest.approx(1) and by[1].cross_entropy == pytest.approx(math.log(2) / 2)
    assert by[2].entropy_norm == 0 and by[2].true_goal_prob == 0 and by[2].cross_entropy == 0


def test_goal_ties_go_high_and_trim(spark):
    s = states(spark, [(0, 1, f, float(f), 0.0, 0.0, 1.0, False, "car") for f in range(10)])
    goals = spark.createDataFrame([(0, 3.0, 0.0), (1, 3.5, 0.0), (2, 99.0, 0.0)], "goal_idx int, gx double, gy double")
    true = tracks.true_goals(tracks.goal_hits(s, goals, 1.0))
    r = true.first()
    assert (r.true_goal, r.goal_frame) == (1, 3)
    assert tracks.trimmed(s, true).agg(F.max("fraction_observed")).first()[0] == pytest.approx(3 / 4)


def test_lags_are_frame_exact(spark):
    s = states(spark, [(0, 1, f, float(f), 0.0, 0.0, float(f), False, "car") for f in range(12) if f != 5])
    got = {r.frame_id: r.speed_change_1s for r in tracks.lags(s, 5, (1,)).collect()}
    assert got[4] == 0.0 and got[6] == 5.0 and got[10] == 0.0  # frame 5 is missing


def test_gap_fill(spark):
    s = states(spark, [(0, 1, f, float(2 * f), 0.0, 0.0, 1.0, f in (2, 3, 5), "car") for f in range(6)]).withColumn("x", F.when(F.col("hidden"), F.lit(-1.0)).otherwise(F.col("x")))
    assert [r.x_filled for r in tracks.gap_filled(s).orderBy("frame_id").collect()] == [0.0, 2.0, 4.0, 6.0, 8.0, 8.0]


def test_global_ranks(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    assert [r.rank for r in tracks.ranked_rows(rows, ["v"]).orderBy("v").collect()] == list(range(1000))


def test_road_search(spark):
    net = roads.Net(spark)
    got = {(r.start, r.goal_lane): r.goal_type for r in net.goals().collect()}
    assert got[("w_in", "j_we")] == "straight-on" and got[("w_in", "j_wn")] == "exit-left" and got[("s_in", "j_sw")] == "enter-left" and got[("s_in", "j_sn")] == "cross-road"
    assert {g for s, g in got if s == "e_out"} == {"x_1", "x_2", "x_3"}
    exits = {r.goal_lane: r.exit_number for r in lanes.exit_numbers(net.goals(), net.flags, net.lanes).filter("start = 'e_out'").collect()}
    assert exits == {"x_1": 1, "x_2": 2, "x_3": 3}


def test_projection_on_a_bent_lane(spark):
    seg = lanes.with_arc_length(spark.createDataFrame([("l", 0, 0.0, 0.0, 10.0, 0.0), ("l", 1, 10.0, 0.0, 10.0, 10.0)], "lane string, seg int, x0 double, y0 double, x1 double, y1 double"))
    s = spark.createDataFrame([(1, 9.0, 4.0, math.pi / 2), (2, 3.0, 1.0, 0.1)], "k int, x double, y double, heading double")
    got = {r.k: (r.lon, r.dist) for r in lanes.lane_candidates(s, seg, reach=3.0).collect()}
    assert got[1] == pytest.approx((14.0, 1.0)) and got[2] == pytest.approx((3.0, 1.0))


def test_hidden_outline(spark):
    rows = [(0, 1, 0, 0.0, 0.0, 0.0, 1.0, False, "car"), (0, 2, 0, 10.0, 0.0, math.pi / 2, 1.0, False, "car"), (0, 3, 0, 30.0, 0.0, 0.0, 1.0, False, "car"), (0, 4, 0, 10.0, 30.0, 0.0, 1.0, False, "car"), (0, 5, 0, 150.0, 90.0, 0.0, 1.0, False, "car"), (0, 6, 0, 30.0, 7.0, 0.0, 1.0, False, "car")]
    boxes = occlusion.outlines(states(spark, rows))
    got = {r.agent_id: r.hidden for r in occlusion.hidden_targets(boxes, occlusion.shadow_quads(occlusion.sightings(boxes))).filter("ego_id = 1").collect()}
    assert got == {2: False, 3: True, 4: False, 5: True, 6: False}


def test_tree_fit_look_ahead_and_prune(spark):
    rows = [("k", float(i % 10), float(i % 7), i % 4 == 0, i % 10 > 5, 1.0) for i in range(400)]
    s = spark.createDataFrame(rows, "tree_key string, a double, b double, b_missing boolean, has_goal boolean, weight double")
    nodes = {n.path: n for n in trees.fit(s, trees.Options(["a", "b"], {"b": "b_missing"}, max_depth=3)).collect()}
    assert nodes["R"].feature == "a" and nodes["R"].threshold == 5.5 and nodes["RT"].feature is None and nodes["RT"].value > 0.95
    assert set(nodes) == {"R", "RT", "RF"}


def test_scoring_null_takes_false_branch(spark):
    e = trees.score_exprs(trees.hand_written(spark), F.col("tree_key"), {"f_tax": "tax_missing"})
    s = spark.createDataFrame([("A", None, 0.1, 0.0, False), ("N", 1.0, 0.0, 0.9, True), ("Z", 1.0, 0.0, 0.9, False)], "tree_key string, f_quantity double, f_discount double, f_tax double, tax_missing boolean")
    assert [(r.path, r.likelihood, r.truncated) for r in s.select("tree_key", *[v.alias(k) for k, v in e.items()]).orderBy("tree_key").collect()] == [("RFT", 0.2, 0.2), ("RT", 0.6, 0.5), (None, 0.5, 0.5)]


def test_sources(spark, tmp_path):
    (tmp_path / "07_tracks.csv").write_text("recordingId,trackId,frame,trackLifetime,xCenter,yCenter,heading,width,length,xVelocity,yVelocity,xAcceleration,yAcceleration,lonAcceleration,latAcceleration\n7,1,0,0,1.0,2.0,180.0,2,4,1,0,0,0,0,0\n")
    (tmp_path / "07_tracksMeta.csv").write_text("recordingId,trackId,initialFrame,finalFrame,numFrames,width,length,class\n7,1,0,0,1,2,4,van\n")
    (tmp_path / "07_recordingMeta.csv").write_text("recordingId,locationId,frameRate,speedLimit,weekday,startTime,duration,numVehicles,xUtmOrigin,yUtmOrigin,orthoPxToMeter\n,1,25,13.9,2,8,1,1,0,0,0.1\n,1,30,13.9,2,9,1,1,0,0,0.1\n")
    m = tables.read_recording_meta(spark, str(tmp_path / "07_recordingMeta.csv")).collect()
    assert [(x.recordingId, x.frameRate, x.startTime, x.duration, x.numVehicles) for x in m] == [("07", 25.0, 8.0, 1.0, 1)]
    (tmp_path / "07_recordingMeta.csv").write_text("orthoPxToMeter,frameRate,recordingId\n0.1,25,7\n")
    (tmp_path / "08_recordingMeta.csv").write_text("recordingId,startTime,frameRate\n8,2,30\n")
    assert sorted((x.recordingId, x.frameRate, x.startTime) for x in tables.read_recording_meta(spark, str(tmp_path / "*_recordingMeta.csv")).collect()) == [("7", 25.0, None), ("8", 30.0, 2.0)]
    r = tables.read_recordings(spark, str(tmp_path)).first()
    assert (r.agent_type, r.fps, r.recording_id) == ("truck_bus", 25.0, "7") and r.heading == pytest.approx(math.pi)
    (tmp_path / "town.json").write_text('{"goals": [[1, 2], [3, 4]], "goal_types": [["a"], ["b", "c"]], "buildings": [[[0, 0], [1, 0], [1, 1]]]}')
    c = tables.read_config(spark, str(tmp_path / "town.json"))
    assert [(g.scenario, g.goal_idx, g.x) for g in tables.config_goals(c).collect()] == [("town", 0, 1.0), ("town", 1, 3.0)]
    assert tables.config_goal_types(c).count() == 3 and len(tables.config_buildings(c).first().ring) == 3
    (tmp_path / "splits").write_text('{"town": {"train": [1, 2], "test": [2]}}')
    splits = tables.read_splits(spark, str(tmp_path / "splits"))
    assert posterior.leaking(splits).first().episode == 2
    tables.write_samples(spark.createDataFrame([("town", 1, 9, 5), ("town", 3, 9, 6)], "scenario string, episode int, agent_id int, v int"), str(tmp_path / "samples"))
    assert [x.v for x in tables.read_samples(spark, str(tmp_path / "samples"), splits, "train").collect()] == [5]
    tables.write_model(trees.hand_written(spark), spark.createDataFrame([("A", 0.5)], "true_goal_type string, prior double"), str(tmp_path / "model"))
    assert tables.read_model(spark, str(tmp_path / "model"))[0].count() == trees.hand_written(spark).count()


def test_online_lags(spark, tmp_path):
    from trackwise.streaming import online

    spark.createDataFrame([(1, f, float(f), 0.0, float(f), f == 0) for f in range(11)], "agent_id long, frame_id long, x double, y double, speed double, hidden boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    got = {r.frame_id: r for r in online.run_to_table(online.online_lags(stream, 5, 1), str(tmp_path)).collect()}
    assert sorted(got) == [0, 5, 10] and got[5].speed_change == 5.0 and got[5].occluded and not got[10].occluded and got[10].first_seen == 1
