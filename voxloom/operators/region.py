"""Addressing: boxes, crops, padding, slices, linear indices and tiles over voxel rows (image_id, t, c, z, y, x, v)."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("t", "c", "z", "y", "x")
Box = Mapping[str, tuple[int, int]]


def check(box: Box) -> None:
    for axis, (start, end) in box.items():
        if axis not in AXES or start < 0 or (end != -1 and end < start):
            raise ValueError(f"invalid region {axis}: [{start}, {end})")


def inside(box: Box) -> Column:
    """Predicate of a half-open box; end -1 leaves the axis open. Plain comparisons, which reach a parquet scan."""
    check(box)
    tests = [F.col(axis) >= start if end == -1 else (F.col(axis) >= start) & (F.col(axis) < end) for axis, (start, end) in box.items()]
    return functools.reduce(operator.and_, tests, F.lit(True))


def crop(voxels: DataFrame, box: Box) -> DataFrame:
    """The voxels of the box, coordinates from 0; an empty box gives an empty image."""
    shifted = {axis: (F.col(axis) - start).alias(axis) for axis, (start, _) in box.items()}
    return voxels.where(inside(box)).select(*(shifted.get(c, F.col(c)) for c in voxels.columns))


def extract(voxels: DataFrame, **at: int) -> DataFrame:
    """One plane, row, channel, ... : the voxels at the given positions; -1 keeps the whole axis."""
    tests = [F.col(axis) == k for axis, k in at.items() if k != -1]
    return voxels.where(functools.reduce(operator.and_, tests, F.lit(True)))


def resolve(box: Box, size: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    """box with open ends closed and everything within an image of that size."""
    check(box)
    return {axis: (min(start, size[axis]), size[axis] if end == -1 else min(end, size[axis])) for axis, (start, end) in box.items()}


def linear_index(size: Mapping[str, int]) -> Column:
    """Index of a voxel, x fastest; t counts whole images and may be negative."""
    out = F.col("t")
    for axis in AXES[1:]:
        out = out * size[axis] + F.col(axis)
    return out


def coordinates(index: Column, size: Mapping[str, int]) -> dict[str, Column]:
    """t, c, z, y, x of a linear index; t by floor division, so negative indices lie in images before the first."""
    out, rest = {}, index
    for axis in reversed(AXES[1:]):
        out[axis] = F.pmod(rest, F.lit(size[axis]))
        rest = F.floor((rest - out[axis]) / size[axis]).cast("bigint")
    return {"t": rest} | dict(reversed(out.items()))


def grid(frame: DataFrame, **axes: tuple[int, int]) -> DataFrame:
    """Each row of frame with every coordinate of the half-open ranges."""
    for axis, (start, end) in axes.items():
        frame = frame.withColumn(axis, F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(end - 1).cast("bigint")))) if end > start else frame.withColumn(axis, F.lit(None).cast("bigint")).where("false")
    return frame


def wrapped(position: Column, n: int, pad: str) -> Column:
    """The position of an image of n voxels that a pad rule puts at a position outside; null where the rule is constant."""
    if pad == "replicate":
        return F.least(F.greatest(position, F.lit(0)), F.lit(n - 1))
    if pad == "circular":
        return F.pmod(position, F.lit(n))
    if pad == "symmetric":  # the edge voxel is repeated
        folded = F.pmod(position, F.lit(2 * n))
        return F.when(folded < n, folded).otherwise(2 * n - 1 - folded)
    if pad == "constant":
        return F.when((position >= 0) & (position < n), position)
    raise ValueError(f"unknown pad rule {pad}")


def crop_with_pad(voxels: DataFrame, size: Mapping[str, int], box: Mapping[str, tuple[int, int]], pad: str, value: int = 0, keys: Sequence[str] = ("image_id", "t", "c", "z")) -> DataFrame:
    """A box that may reach outside the image (axes of size), coordinates from 0; outside, the pad rule or the value.

    Only the map of coordinates is made, a small table per axis that is joined to the voxels; constant padding adds the missing rows.
    """
    spark, out = voxels.sparkSession, voxels
    for axis, (start, end) in box.items():
        table = spark.range(end - start).select(F.col("id").alias("_to"), wrapped(F.col("id") + start, size[axis], pad).alias("_from"))
        out = out.join(F.broadcast(table.where("_from IS NOT NULL")), out[axis] == table["_from"]).drop("_from", axis).withColumnRenamed("_to", axis)
    if pad == "constant":
        whole = grid(voxels.select(*keys).distinct(), **{axis: (0, end - start) for axis, (start, end) in box.items()})
        out = whole.join(out, [*keys, *box], "left").withColumn("v", F.coalesce("v", F.lit(value)))
    return out.select(*voxels.columns) if set(voxels.columns) <= set(out.columns) else out.select(*keys, *box, "v")


def tiles(width: int, height: int, tile: int, halo: int) -> list[dict[str, int]]:
    """Core boxes of a plane cut into tiles and the boxes grown by a halo, clipped to the plane."""
    out = []
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            core = {"x0": x, "x1": min(x + tile, width), "y0": y, "y1": min(y + tile, height)}
            grown = {"hx0": max(0, x - halo), "hx1": min(width, x + tile + halo), "hy0": max(0, y - halo), "hy1": min(height, y + tile + halo)}
            out.append({"tile_id": len(out), **core, **grown})
    return out


def with_tiles(points: DataFrame, tile: int, halo: int, x: str = "x", y: str = "y") -> DataFrame:
    """points, repeated for each tile whose halo they lie in: tile_x, tile_y and core (true in one tile only)."""
    for axis, name in ((x, "tile_x"), (y, "tile_y")):
        at = F.sequence(F.floor((F.col(axis) - halo) / tile), F.floor((F.col(axis) + halo) / tile))
        points = points.withColumn(name, F.explode(F.filter(at, lambda k: k >= 0)))
    return points.withColumn("core", (F.floor(F.col(x) / tile) == F.col("tile_x")) & (F.floor(F.col(y) / tile) == F.col("tile_y")))


def box_union(a: str, b: str, axes: Sequence[str]) -> list[Column]:
    """Bounding box of the boxes in struct columns a and b (fields x0, x1, ...)."""
    return [f(F.col(f"{a}.{axis}{k}"), F.col(f"{b}.{axis}{k}")).alias(f"{axis}{k}") for axis in axes for k, f in ((0, F.least), (1, F.greatest))]


def box_intersection(a: str, b: str, axes: Sequence[str]) -> list[Column]:
    return [f(F.col(f"{a}.{axis}{k}"), F.col(f"{b}.{axis}{k}")).alias(f"{axis}{k}") for axis in axes for k, f in ((0, F.greatest), (1, F.least))]
