"""Distances, affine maps, tapered tubes, triangles and ellipses as Column expressions over points (x, y, z)."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def dot(a: Point, b: Point) -> Column:
    first, *rest = [x * y for x, y in zip(a, b, strict=True)]
    for x in rest:
        first = first + x
    return first


def minus(a: Point, b: Point) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def cross(a: Point, b: Point) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def segment_share(p: Point, a: Point, b: Point) -> Column:
    """Where the projection of p lies on the segment a to b: 0 at a, 1 at b, not clamped; 0 on a segment of no length."""
    along = minus(b, a)
    length = dot(along, along)
    return F.when(length > 0, dot(minus(p, a), along) / length).otherwise(F.lit(0.0))


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    share = F.least(F.greatest(segment_share(p, a, b), F.lit(0.0)), F.lit(1.0))
    return distance(p, [x + share * (y - x) for x, y in zip(a, b, strict=True)])


def frustum_distance(p: Point, a: Point, b: Point, ra: Column, rb: Column) -> Column:
    """Distance from p to the cone surface between spheres (a, ra) and (b, rb); negative inside."""
    share = segment_share(p, a, b)
    along, away = minus(b, a), minus(p, a)
    length = dot(along, along)
    square = dot(away, away) - F.when(length > 0, dot(away, along) * dot(away, along) / length).otherwise(F.lit(0.0))
    beside = F.sqrt(F.greatest(square, F.lit(0.0))) - ((1 - share) * ra + share * rb)
    return F.when(share < 0, norm(away) - ra).when(share > 1, distance(p, b) - rb).otherwise(beside)


def in_tube(p: Point, a: Point, b: Point, ra: Column, rb: Column) -> Column:
    """Whether p lies in the tapered tube, a sphere where the segment has no length; a tube of radius 0 there holds nothing."""
    return at_tube(p, a, b, ra, rb, F.least(F.greatest(segment_share(p, a, b), F.lit(0.0)), F.lit(1.0)))


def at_tube(p: Point, a: Point, b: Point, ra: Column, rb: Column, share: Column) -> Column:
    """in_tube() where the clamped share of p's projection is known."""
    centre = [x + share * (y - x) for x, y in zip(a, b, strict=True)]
    radius = ra + share * (rb - ra)
    away = minus(p, centre)
    return (radius > 0) & (dot(away, away) <= radius * radius)


def affine(p: Point, matrix: Sequence[Sequence[float]]) -> list[Column]:
    """p mapped by the rows of an affine matrix (n rows of n + 1 numbers)."""
    return [dot(p, [F.lit(float(v)) for v in row[:-1]]) + float(row[-1]) for row in matrix]


def inverse_affine(matrix: Sequence[Sequence[float]]) -> list[list[float]]:
    import numpy as np

    n = len(matrix)
    whole = np.vstack([np.asarray(matrix, dtype=float), [0.0] * n + [1.0]])
    return np.linalg.inv(whole)[:n].tolist()


def morton(values: Sequence[Column], bits: Sequence[int]) -> Column:
    """Compressed Morton code: bits of the coordinates interleaved, from the lowest, each coordinate as long as it has bits."""
    out, at = F.lit(0).cast("bigint"), 0
    for level in range(max(bits)):
        for value, n in zip(values, bits, strict=True):
            if level < n:
                bit = F.shiftright(value.cast("bigint"), level).bitwiseAND(F.lit(1).cast("bigint"))
                out = out.bitwiseOR(F.shiftleft(bit, at))
                at += 1
    return out


def confidence_radius(share: float) -> float:
    """Radius, in standard deviations, of the plane ellipse that holds a share of a normal distribution."""
    return math.sqrt(-2 * math.log(1 - share))


def ellipse_overlap(one: Sequence[Column], other: Sequence[Column], radius: float, lines: int = 256) -> Column:
    """Larger share of either ellipse (x, y, var x, cov, var y; so many standard deviations) that lies in the other; 1 where one holds the other's centre.

    The common area is a sum of so many lines. An ellipse without area shares nothing but its centre.
    """

    def held(p: Sequence[Column], e: Sequence[Column]) -> Column:
        dx, dy, det = p[0] - e[0], p[1] - e[1], e[2] * e[4] - e[3] * e[3]
        return (det > 0) & (e[4] * dx * dx - 2 * e[3] * dx * dy + e[2] * dy * dy <= radius * radius * det)

    def area(e: Sequence[Column]) -> Column:
        return math.pi * radius * radius * F.sqrt(e[2] * e[4] - e[3] * e[3])

    low = F.greatest(*(e[1] - radius * F.sqrt(e[4]) for e in (one, other)))
    high = F.least(*(e[1] + radius * F.sqrt(e[4]) for e in (one, other)))

    common = common_area(lines)(*one, *other, low, high, F.lit(radius))
    flat = functools.reduce(lambda a, b: a | b, (e[2] * e[4] - e[3] * e[3] <= 0 for e in (one, other)))
    share = F.when(flat | (high <= low), F.lit(0.0)).otherwise(F.least(F.lit(1.0), common / F.least(area(one), area(other))))
    return F.when(held(one, other) | held(other, one), F.lit(1.0)).otherwise(share)


def common_area(lines: int):  # noqa: ANN201
    """Area that two ellipses share between the heights low and high, summed over so many lines; whole columns at a time."""

    @F.pandas_udf("double")
    def area(ax: pd.Series, ay: pd.Series, axx: pd.Series, axy: pd.Series, ayy: pd.Series, bx: pd.Series, by: pd.Series, bxx: pd.Series, bxy: pd.Series, byy: pd.Series, low: pd.Series, high: pd.Series, radius: pd.Series) -> pd.Series:
        sides = [[x.to_numpy(dtype=float) for x in e] for e in ((ax, ay, axx, axy, ayy), (bx, by, bxx, bxy, byy))]
        low, high, square = low.to_numpy(dtype=float), high.to_numpy(dtype=float), radius.to_numpy(dtype=float) ** 2
        total = np.zeros(len(low))
        with np.errstate(divide="ignore", invalid="ignore"):
            tilts = [(e[3] / e[4], e[2] - e[3] * e[3] / e[4]) for e in sides]
            for k in range(lines):
                y = low + (k + 0.5) * (high - low) / lines
                ends = []
                for e, (tilt, wide) in zip(sides, tilts, strict=True):
                    dy = y - e[1]
                    half = np.sqrt(np.maximum(wide * (square - dy * dy / e[4]), 0.0))
                    ends.append((e[0] + tilt * dy - half, e[0] + tilt * dy + half))
                total += np.maximum(np.minimum(ends[0][1], ends[1][1]) - np.maximum(ends[0][0], ends[1][0]), 0.0)
            return pd.Series(total * (high - low) / lines)

    return area
