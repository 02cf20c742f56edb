"""Meshes (mesh_v: mesh_id, vid, x, y, z; mesh_t: mesh_id, tid, a, b, c) and regions of interest as masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with the points of their corners (ax, ay, ...)."""
    out = triangles
    for k in "abc":
        out = out.join(vertices.select("mesh_id", F.col("vid").alias(k), *(F.col(x).alias(f"{k}{x}") for x in "xyz")), ["mesh_id", k])
    return out


def triangle_area(prefixes: Sequence[str] = "abc") -> Column:
    a, b, c = ([F.col(f"{p}{x}") for x in "xyz"] for p in prefixes)
    return geometry.norm(geometry.cross(geometry.minus(b, a), geometry.minus(c, a))) / 2


def properties(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, triangles, area, volume (of the closed surface, by signed tetrahedra), smallest and largest triangle, shape index (1 for a sphere)."""
    rows = corners(vertices, triangles)
    a, b, c = ([F.col(f"{p}{x}") for x in "xyz"] for p in "abc")
    signed = geometry.dot(a, geometry.cross(b, c)) / 6
    out = rows.withColumns({"_area": triangle_area(), "_signed": signed}).groupBy("mesh_id").agg(F.count("*").alias("triangles"), F.sum("_area").alias("area"), F.abs(F.sum("_signed")).alias("volume"), F.min("_area").alias("min_area"), F.max("_area").alias("max_area"))
    return out.withColumn("shape_index", F.when(F.col("volume") > 0, F.col("area") / (F.pow(F.lit(36 * 3.141592653589793) * F.col("volume") * F.col("volume"), F.lit(1 / 3)))))


def bounding_boxes(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*(f(x).alias(f"{x}{k}") for x in "xyz" for k, f in ((0, F.min), (1, F.max))))


def normals(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """mesh_id, vid, nx, ny, nz: unit normals, the triangles around a vertex weighted by area."""
    a, b, c = ([F.col(f"{p}{x}") for x in "xyz"] for p in "abc")
    n = geometry.cross(geometry.minus(b, a), geometry.minus(c, a))
    rows = corners(vertices, triangles).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *(v.alias(f"n{x}") for v, x in zip(n, "xyz", strict=True)))
    sums = rows.groupBy("mesh_id", "vid").agg(*(F.sum(f"n{x}").alias(f"n{x}") for x in "xyz"))
    length = geometry.norm([F.col(f"n{x}") for x in "xyz"])
    return sums.select("mesh_id", "vid", *(F.when(length > 0, F.col(f"n{x}") / length).otherwise(F.lit(0.0)).alias(f"n{x}") for x in "xyz"))


def transformed(vertices: DataFrame, matrix: Sequence[Sequence[float]]) -> DataFrame:
    moved = geometry.affine([F.col(x) for x in "xyz"], matrix)
    return vertices.withColumns(dict(zip("xyz", moved, strict=True)))


def merged(parts: Sequence[tuple[DataFrame, DataFrame]], mesh_id: int) -> tuple[DataFrame, DataFrame]:
    """One mesh of several: vertex numbers move up by those before."""
    at, vs, ts = 0, None, None
    for v, t in parts:
        v2 = v.withColumns({"mesh_id": F.lit(mesh_id), "vid": F.col("vid") + at})
        t2 = t.withColumns({"mesh_id": F.lit(mesh_id), **{k: F.col(k) + at for k in "abc"}})
        vs, ts = (v2, t2) if vs is None else (vs.unionByName(v2), ts.unionByName(t2))
        at += v.agg(F.max("vid")).first()[0] + 1
    return vs, ts


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd rule over an array of corners (x, y)."""
    n = F.size(points)
    crossings = F.transform(F.sequence(F.lit(0), n - 1), lambda i: _crosses(x, y, F.get(points, i), F.get(points, F.pmod(i + 1, n))))
    return F.aggregate(crossings, F.lit(0), lambda s, c: s + c.cast("int")) % 2 == 1


def _crosses(x: Column, y: Column, a: Column, b: Column) -> Column:
    high = (a["y"] > y) != (b["y"] > y)
    return F.when(high, x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(high, b["y"] - a["y"]) + a["x"]).otherwise(False)


def covers(kind: Column, x: Column, y: Column, points: Column) -> Column:
    """Whether a shape holds a pixel: rect and ellipse by two corners, polygon by its corners."""
    a, b = points[0], points[1]
    low = lambda k: F.least(a[k], b[k])
    high = lambda k: F.greatest(a[k], b[k])
    rect = (x >= low("x")) & (x <= high("x")) & (y >= low("y")) & (y <= high("y"))
    rx, ry = (F.abs(a[k] - b[k]) / 2 for k in ("x", "y"))
    square = lambda v, k, r: (v - (a[k] + b[k]) / 2) * (v - (a[k] + b[k]) / 2) / F.when(r > 0, r * r)
    ellipse = F.coalesce(square(x, "x", rx) + square(y, "y", ry) <= 1, F.lit(False))
    return F.when(kind == "rect", rect).when(kind == "ellipse", ellipse).otherwise(in_polygon(x, y, points))


def reaching(axis: str) -> Callable[[Column], Column]:
    return lambda op: (op[f"{axis}0"] <= F.col(axis)) & (F.col(axis) <= op[f"{axis}1"])


#: Side of the tiles in which the operations on a region meet.
TILE = 64


def roi_mask(ops: DataFrame) -> DataFrame:
    """roi_id, slice, y, x of the pixels inside: the last operation that covers a pixel decides (roi_ops: roi_id, slice, shape_id, op_idx, is_add, type, pts).

    Operations meet in tiles, so pixels are made and judged one by one, and only operations are shuffled. They are dealt to all the session's
    shuffle partitions, however small they are, as each makes many pixels.
    """
    ends = {f"{k}{e}": f(F.col(f"pts.{k}")) for k in "xy" for e, f in ((0, F.array_min), (1, F.array_max))}
    rows = ops.withColumns(ends)
    for k in "yx":
        low = F.ceil(f"{k}0").cast("bigint")
        rows = rows.withColumns({f"{k}0": low, f"{k}1": F.greatest(low, F.floor(f"{k}1").cast("bigint"))})
        rows = rows.withColumn(f"_{k}", F.explode(F.sequence(F.floor(F.col(f"{k}0") / TILE), F.floor(F.col(f"{k}1") / TILE))))
    tile = ["roi_id", "slice", "_y", "_x"]
    op = F.struct("shape_id", "op_idx", "is_add", "type", "pts", "y0", "y1", "x0", "x1")
    tasks = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.groupBy(*tile).agg(F.sort_array(F.collect_list(op), asc=False).alias("_ops")).repartition(tasks, *tile)
    for k in "yx":  # the operations that reach a line of the tile, then those that reach a pixel of it
        first, last = (f(F.col(f"_ops.{k}{e}")) for f, e in ((F.array_min, 0), (F.array_max, 1)))
        inside = F.sequence(F.greatest(first, F.col(f"_{k}") * TILE), F.least(last, F.col(f"_{k}") * TILE + TILE - 1))
        rows = rows.withColumn(k, F.explode(inside))
        rows = rows.withColumn("_ops", F.filter("_ops", reaching(k))).where(F.size("_ops") > 0)
    hit = F.filter("_ops", lambda o: covers(o["type"], F.col("x").cast("double"), F.col("y").cast("double"), o["pts"]))
    return rows.where(F.get(hit, 0)["is_add"]).select("roi_id", "slice", "y", "x")


def moved_roi(ops: DataFrame, dx: float, dy: float) -> DataFrame:
    return ops.withColumn("pts", F.transform("pts", lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))))


def flipped_roi(ops: DataFrame, axis: str, about: float) -> DataFrame:
    turn = lambda p, k: (2 * about - p[k] if k == axis else p[k]).alias(k)
    return ops.withColumn("pts", F.transform("pts", lambda p: F.struct(turn(p, "x"), turn(p, "y"))))
