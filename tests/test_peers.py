"""Nearest peers by leaves of a frame's places, against every pair."""

import random

import numpy as np
from test_poses import NAMES

from trackwise.operators import tracks


def test_peers_of_many_places(spark):
    """600 agents in uneven places, with ties on a grid, shared places and some whose place is not finite."""
    dice = random.Random(7)
    rows = []
    for a in range(600):
        x, y = (float(dice.randrange(12)), float(dice.randrange(12))) if a % 3 else (dice.expovariate(0.1), dice.uniform(0, 99))
        rows.append((0, 0, a % 2 and 5, a, float("inf") if a % 97 == 0 else x, y, 0.0, 0.0))
    got = {(r.agent_id, r["rank"]): (r.peer_id, r.distance) for r in tracks.nearest_peers(spark.createDataFrame(rows, NAMES), 3).collect()}
    for r in rows:
        others = [o for o in rows if o[2] == r[2] and o[3] != r[3]]
        with np.errstate(invalid="ignore"):
            far = [float(np.hypot(np.subtract(o[4], r[4]), o[5] - r[5])) for o in others]
        near = sorted(zip([np.inf if np.isnan(d) else round(d, 9) for d in far], [np.isnan(d) for d in far], [o[3] for o in others], strict=True))[:3]
        assert [got[r[3], n][0] for n in (1, 2, 3)] == [n[2] for n in near], r
    assert len(got) == 1800


def test_work_grows_with_the_agents_of_a_frame(monkeypatch):
    """Distances made in a frame of 8,000 places are about four times those of 2,000, not sixteen."""
    made = []
    first = tracks._first

    def counted(x, y, px, *rest):
        made[-1] += len(x) * len(px)
        return first(x, y, px, *rest)

    monkeypatch.setattr(tracks, "_first", counted)
    for n in (2000, 8000):
        made.append(0)
        dice = np.random.default_rng(n)
        found, dist = tracks._nearest_of_frame(dice.exponential(10, n), dice.integers(0, 100, n).astype(float), np.arange(n), np.arange(n), 4)
        assert (found[:, 0] >= 0).all() and (dist[:, 0] == 0).all()
    assert made[1] < 6 * made[0]


def test_only_states_are_shuffled(spark):
    states = spark.createDataFrame([(0, 0, 0, 1, 0.0, 0.0, 0.0, 0.0)], NAMES)
    plan = tracks.nearest_peers(states, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan
