"""Points in polygons of any shape, with holes, by the even-odd rule.

Polygons are tables of corners, ``area ring k x y``: the first ring (0) is the outline, further
rings are holes or islands. They are turned into edges once. A point meets the areas whose
bounding boxes share its grid cell, then those areas' edges that share its strip of y, both
by equi joins; the parity of the edges to its right tells whether it is inside. A point
on an edge is in no area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = 10.0
STRIP = 2.0
ON_EDGE = 1e-9


def ring_edges(corners: DataFrame) -> DataFrame:
    """``area ring k x0 y0 x1 y1``: each corner with the next of its ring, the last with the first; a closing corner that repeats the first adds nothing."""
    w = Window.partitionBy("area", "ring").orderBy("k")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    edges = corners.select("area", "ring", "k", F.col("x").alias("x0"), F.col("y").alias("y0"), nxt("x").alias("x1"), nxt("y").alias("y1"))
    return edges.filter((F.col("x0") != F.col("x1")) | (F.col("y0") != F.col("y1")))


def edge_distance(x: Column, y: Column) -> Column:
    """Distance of a point to an edge ``x0 y0 x1 y1``."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - F.col("x0")) * dx + (y - F.col("y0")) * dy) / (dx * dx + dy * dy)))
    return F.hypot(x - F.col("x0") - t * dx, y - F.col("y0") - t * dy)


def _cells(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def areas_holding(points: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """``key area``: every area that holds a point (``key x y``); points and edges with a ``scenario`` meet within it only."""
    both = ["scenario"] if "scenario" in edges.columns else []
    box = edges.groupBy(*both, "area").agg(*[f(c).alias(f"_{n}{c[0]}") for c in ("x", "y") for n, f in (("lo", lambda c: F.min(F.least(f"{c}0", f"{c}1"))), ("hi", lambda c: F.max(F.greatest(f"{c}0", f"{c}1"))))])
    over = lambda c, size: F.explode(F.sequence(_cells(f"_lo{c}", size), _cells(f"_hi{c}", size)))
    boxes = box.select("*", over("x", CELL).alias("_cx")).select("*", over("y", CELL).alias("_cy"))
    there = points.select(*key, "x", "y", _cells("x", CELL).alias("_cx"), _cells("y", CELL).alias("_cy"))
    met = there.join(boxes, [*both, "_cx", "_cy"]).filter(F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy")))
    strips = edges.select(*both, "area", "x0", "y0", "x1", "y1", F.explode(F.sequence(F.floor(F.least("y0", "y1") / STRIP), F.floor(F.greatest("y0", "y1") / STRIP))).alias("_strip"))
    near = met.select(*key, "area", "x", "y", _cells("y", STRIP).alias("_strip")).join(strips, [*both, "area", "_strip"])
    crosses = (F.col("y0") > F.col("y")) != (F.col("y1") > F.col("y"))
    at = F.col("x0") + (F.col("y") - F.col("y0")) * (F.col("x1") - F.col("x0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))
    right = F.coalesce(crosses & (at > F.col("x")), F.lit(False))
    told = near.groupBy(*key, "area").agg(F.sum(right.cast("int")).alias("_n"), F.max(edge_distance(F.col("x"), F.col("y")) <= ON_EDGE).alias("_on"))
    return told.filter((F.col("_n") % 2 == 1) & ~F.col("_on")).select(*key, "area")


def place_on_path(points: DataFrame, paths: DataFrame, edges: DataFrame, key: list[str], path: list[str]) -> DataFrame:
    """``key pos lane``: where on its path (``path pos lane``) a point (``key path x y``) is: the first lane whose area holds it, else the lane with the nearest outline, the first of equals.

    Only points that no lane of their path holds meet the outlines of all its lanes.
    """
    lanes = points.select(*key, *path, "x", "y").join(paths.select(*path, "pos", "lane"), path)
    inside = areas_holding(points, edges, key).withColumnRenamed("area", "lane")
    held = lanes.join(inside, [*key, "lane"]).groupBy(*key).agg(F.min(F.struct("pos", "lane")).alias("m"))
    outline = edges.filter(F.col("ring") == 0).select(F.col("area").alias("lane"), "x0", "y0", "x1", "y1")
    outside = lanes.join(held, key, "left_anti").join(outline, "lane")
    far = outside.groupBy(*key, "pos", "lane").agg(F.min(edge_distance(F.col("x"), F.col("y"))).alias("d"))
    nearest = far.groupBy(*key).agg(F.min(F.struct(F.round("d", 9), "pos", "lane")).alias("n"))
    return held.select(*key, "m.pos", "m.lane").unionByName(nearest.select(*key, "n.pos", "n.lane"))
