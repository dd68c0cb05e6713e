"""Numbers: three rounding regimes, piecewise-linear interpolation and its inverse."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into halves whose products are exact (2**27 + 1).
_SPLIT = 134_217_729.0


def round_tenth(value: Column) -> Column:
    """``value`` to one decimal as Python's ``round`` has it: by its exact binary value, ties to even.

    Ten times a value may round onto a half that the exact product misses.  The product's error is recovered from
    split halves, and decides on which side of the half the exact product lies.
    """
    scaled = value * 10.0
    big = value * F.lit(_SPLIT)
    high = big - (big - value)
    low = value - high
    error = (high * 10.0 - scaled) + low * 10.0
    below = F.floor(scaled).cast("double")
    on_half = (scaled - below) == 0.5
    even = F.when(F.pmod(below, F.lit(2.0)) == 0, below).otherwise(below + 1)
    settled = F.when(error > 0, below + 1).when(error < 0, below).otherwise(even)
    return F.when(on_half, settled).otherwise(F.rint(scaled)) / 10.0


def round_significant(value: Column, digits: int = 4) -> Column:
    """``value`` to significant digits; zero stays zero."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.rint(value * power) / power)


def interpolate(value: Column, points: Sequence[tuple[float, float]]) -> Column:
    """The broken line through ``points`` (ascending x) at ``value``; beyond its ends their y; null stays null."""
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("x must ascend strictly")
    out = F.when(value <= points[0][0], F.lit(float(points[0][1])))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(value <= x1, F.lit(float(y0)) + (value - x0) * ((y1 - y0) / (x1 - x0)))
    return out.when(value.isNotNull(), F.lit(float(points[-1][1])))


def first_reached(score: Column, points: Sequence[tuple[float, float]]) -> Column:
    """The inverse of ``interpolate`` from zero up: the least x of zero or more at which the line has ``score``, else that of the nearest knot."""
    start = (0.0, _line(points, 0.0))
    right = [start, *(p for p in points if p[0] > 0)]
    piece = lambda p, q: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((*p, *q), ("x0", "y0", "x1", "y1"), strict=True)])
    knot = lambda p: F.struct(F.abs(score - p[1]).alias("gap"), F.lit(float(p[0])).alias("x"))
    crossed = [piece(p, q) for p, q in zip(right, right[1:], strict=False)]
    nearest = F.array_min(F.array(*map(knot, right)))["x"]
    if not crossed:
        return F.when(score.isNotNull(), nearest)
    hit = F.get(F.filter(F.array(*crossed), lambda s: score.between(F.least(s["y0"], s["y1"]), F.greatest(s["y0"], s["y1"]))), F.lit(0))
    along = hit["x0"] + F.coalesce(F.try_divide(score - hit["y0"], hit["y1"] - hit["y0"]), F.lit(0.0)) * (hit["x1"] - hit["x0"])
    return F.when(score.isNotNull(), F.coalesce(along, nearest))


def _line(points: Sequence[tuple[float, float]], x: float) -> float:
    if x <= points[0][0]:
        return points[0][1]
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        if x <= x1:
            return y0 + (x - x0) * (y1 - y0) / (x1 - x0)
    return points[-1][1]


def compensated_sum(terms: Sequence[Column]) -> Column:
    """Neumaier's sum of a few columns: rounding errors are gathered apart and added last."""
    if not terms:
        return F.lit(0.0)

    def step(state: tuple[Column, Column], term: Column) -> tuple[Column, Column]:
        total, lost = state
        new = total + term
        return new, lost + F.when(F.abs(total) >= F.abs(term), (total - new) + term).otherwise((term - new) + total)

    total, lost = reduce(step, terms[1:], (terms[0], F.lit(0.0)))
    return total + lost


def bilinear(q00: Column, q10: Column, q01: Column, q11: Column, fx: Column, fy: Column) -> Column:
    """Bilinear interpolation between grid values; null if any of the four is."""
    return q00 * (1 - fx) * (1 - fy) + q10 * fx * (1 - fy) + q01 * (1 - fx) * fy + q11 * fx * fy
