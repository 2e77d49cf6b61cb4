"""Column expressions: grid arithmetic, grey values, estimator values, outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """Integer division of non-negative values."""
    return F.call_function("div", a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def gray(r: Column, g: Column, b: Column, channel_order: str = "reference") -> Column:
    """8-bit grey in 15-bit fixed point. channel_order "reference" gives red the weight of blue and
    blue that of red, as the images are converted there; "rgb" uses the usual weights."""
    first, last = (3735, 9798) if channel_order == "reference" else (9798, 3735)
    return div(F.lit(first) * r + F.lit(19235) * g + F.lit(last) * b + F.lit(16384), F.lit(32768))


def cell_id(i: Column, j: Column, columns: Column) -> Column:
    return i * columns + j


def cell_ij(k: Column, columns: Column) -> tuple[Column, Column]:
    return div(k, columns), k % columns


def capped_inverse(spread: Column, scale: float) -> Column:
    """1 for no spread, else min(1, scale / spread)."""
    return F.when(spread == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(scale) / F.nullif(spread, F.lit(0.0))))


def variance_terms(n: Column, s: Column, ss: Column) -> Column:
    """n² times the population variance, from integer sums (exact)."""
    return (n * ss - s * s).cast("double")


def binarize(t: Column, threshold: float) -> Column:
    """1 above the threshold (on the caller's scale), else 0."""
    return F.when(t > F.lit(threshold), 1.0).when(t.isNotNull(), 0.0)


def outcome_score(existence: Column, found: Column, score: Column) -> Column:
    """Reachable pairs get the route's score (0 without a route); unreachable ones 1 without a route."""
    return F.when(existence, F.when(found, score).otherwise(F.lit(0.0))).otherwise(F.when(found, F.lit(0.0)).otherwise(F.lit(1.0)))
