"""Scalar and aggregate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def angle_diff(a: Column, b: Column) -> Column:
    """Turn from heading a to heading b, in (-pi, pi]; a half turn keeps the sign of b - a."""
    d = b - a
    wrapped = d - TWO_PI * F.floor((d + math.pi) / TWO_PI)
    return F.when((wrapped == -math.pi) & (d > 0), F.lit(math.pi)).otherwise(wrapped)


def entropy_term(x: Column, y: Column) -> Column:
    """x * ln(y), and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.ln(y))


def bucket(x: Column) -> Column:
    """Round to one decimal, half to even."""
    return F.bround(x, 1)


def standard_error(x: Column) -> Column:
    """Sample deviation over the root of the count; null for one row."""
    return F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x)))


def smoothed_rate(hits: Column, total: Column, alpha: float, cells: Column) -> Column:
    """Additive smoothing of a relative frequency over a number of cells."""
    return (hits + alpha) / (total + alpha * cells)
