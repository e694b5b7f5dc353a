"""Pairs leave a tile only if sizes and parity sketches leave a link possible."""

import random

import numpy as np

from pyspark.sql import functions as F

from trackwise.llm import jaccard


def test_parities_lose_no_link_and_tell_most_others_apart():
    r = np.random.default_rng(4)
    linked, other = [], []
    for n in (1, 4, 20, 90, 400, 1100, 3000):
        for _ in range(40):
            u = r.integers(0, 1 << 63, n, dtype=np.uint64)
            keep = np.sort(u)[: n - int(r.integers(0, n // 9 + 1))]
            v = np.union1d(keep, r.integers(0, 1 << 63, int(r.integers(0, n // 9 + 1)), dtype=np.uint64))
            w = np.union1d(u[: n // 2], r.integers(0, 1 << 63, n - n // 2, dtype=np.uint64))
            for x, y in ((u, v), (u, w)):
                x, y = np.unique(x), np.unique(y)
                common = len(np.intersect1d(x, y))
                (linked if 100 * common >= 80 * (len(x) + len(y) - common) else other).append((x, y))
    ask = lambda pairs: jaccard.Parities(np.array([len(u) for p in pairs for u in p]), [jaccard.parity(u) for p in pairs for u in p]).may_link(np.arange(0, 2 * len(pairs), 2), np.arange(1, 2 * len(pairs), 2))
    assert len(linked) > 200 and ask(linked).all()
    assert len(other) > 200 and ask(other).mean() < 0.1


def test_a_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share half their words meet in every tile of the passage, 19,900 pairs of them, and link with none."""
    dice = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{dice.randrange(10**6)}" for _ in range(60)])) for i in range(200)]
    rows += [(500 + i, " ".join(f"c{k if k != 7 * i else -i}" for k in range(100))) for i in range(1, 4)]
    made = []
    told = jaccard._tile_pairs
    monkeypatch.setattr(jaccard, "_tile_pairs", lambda tiles: made.append(told(tiles)) or made[-1])
    got = {r.doc_id: r.component_id for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 501 if i > 500 else i for i, _ in rows}
    assert made[0].count() < 50
    plan = made[0].agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "times" not in plan
