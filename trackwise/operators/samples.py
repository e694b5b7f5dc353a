"""The sample table: one row per target, ego, sampled frame and candidate goal, with labels, features and indicators.

A target is a moving vehicle that reaches a configured goal; its states after the last
goal it reaches are cut off, and those from the first on that has no configured goal among
its candidates. An ego is another such vehicle whose life span overlaps the target's. A pair
counts if the target's true goal is a candidate in the first state of the overlap, whose
candidate also gives the true type. Samples are the whole seconds of the overlap at which the
ego sees the target.

All of it is joins on (scenario, episode, agent) and windows over one agent or pair; what
depends on the target's state alone is computed once a state, before pairs multiply it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwise.operators import candidates, polygons, tracks
from trackwise.operators import lanes as road
from trackwise.shared import kept

AGENT, FRAME = tracks.AGENT, tracks.FRAME
KEY = [*FRAME, "agent_id"]
GOAL = [*KEY, "goal_idx"]
VEHICLES = ("car", "truck_bus")
LAGS = [f"{n}_{k}s" for k in (1, 2, 3) for n in ("speed_change", "heading_change", "dist_travelled")]
NO_DISTANCE, NO_SPEED = 100.0, 20.0


@dataclass
class Maps:
    """A map's tables: ``lanes segments links moves entries reaches``, outlines as ``edges``, configured ``goals`` (scenario goal_idx cx cy), ``paths`` (start goal_lane path) and what follows from them."""

    tables: dict[str, DataFrame]
    edges: DataFrame
    goals: DataFrame
    paths: DataFrame
    path_table: DataFrame
    path_facts: DataFrame
    exits: DataFrame
    watched: DataFrame


def targets(states: DataFrame, maps: Maps, radius: float) -> DataFrame:
    """The trimmed states of moving vehicles that reach a goal: ``true_goal initial_frame_id fraction_observed`` beside their own columns."""
    vehicles = tracks.moving_agents(states).filter(F.col("agent_type").isin(*VEHICLES))
    spots = maps.goals.select("scenario", "goal_idx", F.col("cx").alias("gx"), F.col("cy").alias("gy"))
    return tracks.trimmed(vehicles, tracks.true_goals(tracks.goal_hits(vehicles, spots, radius)))


def reachable(trimmed: DataFrame, maps: Maps, *, reach: float, radius: float) -> DataFrame:
    """``KEY goal_idx start goal_lane goal_type lon turn``: the configured goals that each state can reach, of states before the first without any."""
    found = candidates.goal_candidates(trimmed, maps.tables, KEY, reach=reach)
    typed = kept(candidates.configured_goals(found, maps.goals, KEY, radius).select(*GOAL, "start", "goal_lane", "goal_type", "lon", "turn"))
    counts = trimmed.select(*KEY).join(typed.groupBy(*KEY).agg(F.count("*").alias("_n")), KEY, "left").fillna(0, ["_n"])
    return typed.join(tracks.reachable_prefix(counts, "_n").select(*KEY), KEY)


def pairs_that_count(spans: DataFrame, goals_of: DataFrame, typed: DataFrame, fps: int) -> DataFrame:
    """``AGENT ego_id start_frame end_frame true_goal_type``: overlaps whose first state has the true goal among its candidates; the ego lives longer than a second."""
    met = tracks.pairs(spans, fps + 1)
    first = typed.join(goals_of.select(*AGENT, F.col("true_goal").alias("goal_idx")), [*AGENT, "goal_idx"]).select(*AGENT, F.col("frame_id").alias("start_frame"), F.col("goal_type").alias("true_goal_type"))
    return met.join(first, [*AGENT, "start_frame"])


def seen_samples(pairs: DataFrame, frames: DataFrame, hidden: DataFrame, fps: int) -> DataFrame:
    """Sampled frames of each pair with ``target_ks_occluded`` and ``first_seen``, of which the hidden ones are then left out."""
    met = pairs.join(frames, AGENT).filter(F.col("frame_id").between(F.col("start_frame"), F.col("end_frame")))
    met = met.join(hidden, [*KEY, "ego_id"])
    w = Window.partitionBy(*AGENT, "ego_id").orderBy("frame_id")
    young = lambda k: F.col("frame_id") - F.col("initial_frame_id") < k * fps
    past = [(young(k) | F.coalesce(F.lag("hidden", k).over(w), F.lit(True)) | F.col("hidden")).alias(f"target_{k}s_occluded") for k in (1, 2, 3)]
    first = F.min(F.when(~F.col("hidden"), F.col("frame_id"))).over(Window.partitionBy(*AGENT, "ego_id")).alias("first_seen")
    return met.select("*", *past, first).filter(~F.col("hidden")).drop("hidden")


def on_lanes(states: DataFrame, maps: Maps) -> DataFrame:
    """``KEY speed lane lon``: each state on every lane whose outline holds it, by the nearest point of the lane's midline."""
    inside = polygons.areas_holding(states.select(*KEY, "x", "y"), maps.edges, KEY).withColumnRenamed("area", "lane")
    lon, dist = road.project(F.col("x"), F.col("y"))
    near = inside.join(states.select(*KEY, "x", "y", "speed"), KEY).join(maps.tables["segments"].drop("scenario"), "lane")
    return near.groupBy(*KEY, "lane", "speed").agg(F.min_by(lon, F.struct(dist, "seg")).alias("lon"))


def nearest_on(own: DataFrame, watch: DataFrame, there: DataFrame, along, least: float, most: float, names: tuple[str, str]) -> DataFrame:
    """``GOAL`` with distance and speed of the nearest vehicle among the lanes that a path watches.

    ``watch`` names for a path (``start goal_lane``) the lanes to look at (``lane`` and a
    distance ``at``); rows meet the vehicles of their frame by lane. ``along`` gives the distance.
    """
    peers = there.select(*FRAME, F.col("agent_id").alias("_peer"), "lane", F.col("lon").alias("_lon"), F.col("speed").alias("_v"))
    met = own.join(watch, ["start", "goal_lane"]).join(peers, [*FRAME, "lane"]).filter(F.col("_peer") != F.col("agent_id")).withColumn("_d", along)
    near = met.filter((F.col("_d") > least) & (F.col("_d") < most)).groupBy(*GOAL).agg(F.min("_d").alias("_dist"), F.min_by("_v", F.struct(F.round("_d", 9), "_peer")).alias("_speed"))
    out = own.select(*GOAL).join(near, GOAL, "left")
    return out.select(*GOAL, F.coalesce("_dist", F.lit(NO_DISTANCE)).alias(names[0]), F.coalesce("_speed", F.lit(NO_SPEED)).alias(names[1]))


def state_features(typed: DataFrame, states: DataFrame, trimmed: DataFrame, maps: Maps, fps: int) -> DataFrame:
    """``GOAL`` with what depends on the target's state and goal alone."""
    second = tracks.each_second(typed, fps)
    there = kept(on_lanes(tracks.each_second(states, fps), maps))
    own = kept(second.select(*GOAL, "start", "goal_lane", "lon"))
    ahead = maps.path_table.select("start", "goal_lane", "lane", F.col("s_before").alias("at"))
    front = nearest_on(own, ahead, there, F.col("at") + F.col("_lon") - F.col("lon"), 1e-4, float("inf"), ("vehicle_in_front_dist", "vehicle_in_front_speed"))
    oncoming = nearest_on(own, maps.watched, there, F.col("at") - F.col("_lon"), 0.0, 100.0, ("oncoming_vehicle_dist", "oncoming_vehicle_speed"))
    lagged = tracks.each_second(tracks.lags(trimmed, fps), fps).select(*KEY, "speed", F.hypot("ax", "ay").alias("acceleration"), *LAGS)
    rows = second.join(lagged, KEY).join(front, GOAL).join(oncoming, GOAL).join(maps.path_facts, ["start", "goal_lane"])
    rows = rows.withColumn("path_to_goal_length", F.col("path_length") - F.col("lon")).withColumnRenamed("turn", "angle_in_lane")
    return rows.drop("path_length", "lon", "start")


def sample_table(states: DataFrame, hidden: DataFrame, maps: Maps, *, fps: int, reach: float, radius: float) -> DataFrame:
    """The sample table of ``states`` (``AGENT frame_id x y heading speed ax ay agent_type``), given which targets each ego cannot see (``VIEW agent_id hidden``)."""
    states = kept(states)
    moving = kept(tracks.moving_agents(states))
    trimmed = kept(targets(states, maps, radius))
    typed = kept(reachable(trimmed, maps, reach=reach, radius=radius))
    goals_of = trimmed.groupBy(*AGENT).agg(F.first("true_goal").alias("true_goal"), F.first("initial_frame_id").alias("initial_frame_id"))
    spans = tracks.life_spans(moving.join(goals_of.select(*AGENT), AGENT, "left_semi"))
    pairs = pairs_that_count(spans, goals_of, typed, fps)
    frames = tracks.each_second(trimmed, fps).join(typed.select(*KEY).distinct(), KEY).select(*KEY, "true_goal", "initial_frame_id", "fraction_observed")
    best = road.best_lane(road.lane_candidates(trimmed.select(*KEY, "x", "y", "heading"), maps.tables["segments"], reach=reach), KEY)
    entered = kept(best.select(*AGENT, F.col("frame_id").alias("_at"), F.col("lane").alias("start")).join(maps.exits.filter("exit_number > 0"), "start").select(*AGENT, "_at", "goal_lane", "exit_number"))
    # exits are looked up before egos and features multiply the rows, which then need not be shuffled again
    first = entered.join(goals_of.select(*AGENT, F.col("initial_frame_id").alias("_at")), [*AGENT, "_at"]).select(*AGENT, "goal_lane", "exit_number")
    seen = entered.groupBy(*AGENT, F.col("_at").alias("first_seen")).agg(F.collect_set("goal_lane").alias("_seen"))
    rows = seen_samples(pairs, frames, hidden, fps).join(seen, [*AGENT, "first_seen"], "left")
    features = state_features(typed.join(first, [*AGENT, "goal_lane"], "left"), moving, trimmed, maps, fps)
    out = rows.join(features, KEY)
    exits = F.col("goal_type") == "exit-roundabout"
    known = F.coalesce(F.array_contains("_seen", F.col("goal_lane")), F.lit(False))
    out = out.withColumn("exit_number", F.when(exits, F.coalesce("exit_number", F.lit(0))).otherwise(0)).withColumn("exit_number_missing", exits & ~known)
    return out.withColumnRenamed("goal_idx", "possible_goal").drop("_seen", "goal_lane", "start_frame", "end_frame", "first_seen")
