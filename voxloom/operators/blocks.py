"""Parts of images (components, plateaus, basins) found block by block: an image is cut into blocks of bounded size, a block is a row of
arrays, and only what crosses a border between blocks goes on as rows.

A block also holds the voxels around it, so that it sees the neighbours of its own. It gives each of its voxels a node: the first voxel of
its part within the block or, where the flood leaves the block, the voxel outside to which it flows. Images of one block are done then. For
others the nodes of voxels at borders are followed to their ends, and nodes that touch across a border are joined by components().
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.neighborhood import KEYS, offsets
from voxloom.storage import written

#: Side of a block in planes and in volumes.
SIDE = {2: 64, 3: 16}
#: Places of blocks that are worked on at once.
PLACES = 1 << 21
AXES = ("z", "y", "x")


def smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of the class of each of 0 to n - 1, where a and b are linked pairwise."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        root = ends(root)
    return root


def ends(up: np.ndarray) -> np.ndarray:
    """Where the pointers of a forest end; a root points to itself."""
    while True:
        twice = up[up]
        if (twice == up).all():
            return up
        up = twice


class Solver:
    """The nodes of whole batches of blocks. kind: components (neighbours are linked), plateaus (neighbours of equal value are) or basins."""

    def __init__(self, kind: str, side: Sequence[int], size: Sequence[int], shifts: Sequence[tuple[int, int, int]], greatest: bool = True, depth: float = 0.0) -> None:
        self.kind, self.side, self.greatest, self.depth = kind, list(side), greatest, depth
        self.pads = [int(any(s[k] for s in shifts)) for k in range(3)]
        self.frame = [n + 2 * p for n, p in zip(side, self.pads, strict=True)]
        self.volume = math.prod(self.frame)
        steps = [self.frame[1] * self.frame[2], self.frame[2], 1]
        self.shifts = sorted(sum(d * s for d, s in zip(x, steps, strict=True)) for x in shifts)
        place = np.indices(self.frame).reshape(3, -1)
        inner = [(place[k] >= p) & (place[k] < p + n) for k, (p, n) in enumerate(zip(self.pads, side, strict=True))]
        edge = [(place[k] == p) | (place[k] == p + n - 1) if p and size[k] > n else np.zeros(self.volume, bool) for k, (p, n) in enumerate(zip(self.pads, side, strict=True))]
        self.own, self.face = np.logical_and.reduce(inner), np.logical_or.reduce(edge)
        self.number = ((place[0] - self.pads[0]) * size[1] + place[1] - self.pads[1]) * size[2] + place[2] - self.pads[2]

    def solve(self, at: np.ndarray, v: np.ndarray, block: np.ndarray, blocks: int, origin: np.ndarray) -> dict[str, tuple]:
        """Of the voxels (place in the frame, value, block): marks, and per list its blocks and columns. A mark counts the nodes of a block by their first voxel."""
        flat = block * self.volume + at
        spot = np.full(blocks * self.volume, -1, dtype=np.int32)
        spot[flat] = 0
        cells = np.flatnonzero(spot == 0)  # by block and then by place, x fastest
        n = len(cells)
        spot[cells] = np.arange(n)
        back = spot[flat]
        value = np.empty(n, dtype=v.dtype)
        value[back] = v
        home, place = cells // self.volume, cells % self.volume
        own, number = self.own[place], origin[home] + self.number[place]
        mine = np.flatnonzero(own)
        best = np.arange(n)
        lost = np.zeros(n, dtype=bool)
        near, far = [], []
        for shift in self.shifts:
            j = spot[cells[mine] + shift]
            i, j = mine[j >= 0], j[j >= 0]
            if self.kind == "plateaus":
                lost[i[value[j] > value[i] if self.greatest else value[j] < value[i]]] = True
                same = value[i] == value[j]
                i, j = i[same], j[same]
            elif self.kind == "basins":  # the brightest neighbour before it, of equals the first
                take = ((value[j] > value[i]) | ((value[j] == value[i]) & (j < i))) & ((best[i] == i) | (value[j] > value[best[i]]))
                best[i[take]] = j[take]
            if shift > 0:  # each pair once, by the block of the earlier voxel
                near.append(i)
                far.append(j)
        a, b = np.concatenate([*near, best[:0]]), np.concatenate([*far, best[:0]])
        if self.kind == "basins":
            saddle, end = np.minimum(value[a], value[b]), ends(best)
            a, b = end[a], end[b]  # a voxel around the block ends at itself
            apart = a != b
            a, b, saddle = a[apart], b[apart], saddle[apart]
            inside = own[a] & own[b]
            shallow = inside & (np.minimum(value[a], value[b]) - saddle <= self.depth)
            joined = smallest(n, a[shallow], b[shallow])
        else:
            saddle, inside = value[a], own[a] & own[b]
            end = joined = smallest(n, a[inside], b[inside])
            a, b = end[a], end[b]
        node = joined[end]
        named, first, which = np.unique(node[mine], return_index=True, return_inverse=True)
        order = np.argsort(first)
        named, first = named[order], mine[first[order]]
        place_of = np.empty(len(order), dtype=np.int64)
        place_of[order] = np.arange(len(order))
        mark = np.full(n, -1, dtype=np.int32)
        began = np.searchsorted(home[named], np.arange(blocks))
        mark[mine] = place_of[which] - began[home[mine]]
        over = np.zeros(len(named), dtype=bool)
        np.logical_or.at(over, place_of[which], lost[mine])
        out = {"mark": mark[back], "nodes": (home[named], number[named], number[first], over)}
        border, outside = mine[self.face[place[mine]]], np.flatnonzero(~inside)
        a, b, saddle = a[outside], b[outside], saddle[outside]
        rows = np.lexsort((-saddle, b, a))
        rows = rows[np.flatnonzero(np.r_[True, (np.diff(a[rows]) != 0) | (np.diff(b[rows]) != 0)])] if len(rows) else rows
        roots = np.unique(end[mine])
        roots = roots[own[roots]] if self.face.any() else roots[:0]
        a, b = a[rows], b[rows]
        return out | {"ends": (home[border], number[border], number[end[border]]), "roots": (home[roots], number[roots], number[joined[roots]], value[roots]), "pairs": (home[a], number[a], number[b], saddle[rows])}


def outcome(value: T.DataType) -> T.StructType:
    long = T.LongType()
    lists = {"nodes": {"node": long, "first": long, "lost": T.BooleanType()}, "ends": {"id": long, "up": long}, "roots": {"root": long, "node": long, "v": value}, "pairs": {"p": long, "q": long, "saddle": value}}
    return T.StructType([T.StructField("mark", T.ArrayType(T.IntegerType())), *(T.StructField(k, T.ArrayType(T.StructType([T.StructField(c, t) for c, t in v.items()]))) for k, v in lists.items())])


def solved(solver: Solver, value: T.DataType):  # noqa: ANN201
    """The solver as a function of columns: places, values, the number of the block's first voxel."""
    schema = outcome(value)
    bounds = (-np.inf, np.inf) if isinstance(value, T.DoubleType) else (-(1 << 63), (1 << 63) - 1)
    none = bounds[0] if solver.greatest else bounds[1]  # nothing is beaten by a null

    @F.arrow_udf(schema)
    def run(at: pa.Array, v: pa.Array, origin: pa.Array) -> pa.Array:
        counts = at.value_lengths().to_numpy(zero_copy_only=False)
        first = origin.to_numpy(zero_copy_only=False)
        place, level = at.flatten().to_numpy(zero_copy_only=False), v.flatten().fill_null(none).to_numpy(zero_copy_only=False)
        if level.dtype.kind == "f":
            level = np.where(np.isnan(level), np.inf, level)  # as Spark orders them
        starts, step, parts = np.r_[0, np.cumsum(counts)], max(1, PLACES // solver.volume), []
        for k in range(0, len(counts), step):
            some = counts[k : k + step]
            rows = slice(starts[k], starts[k + len(some)])
            parts.append((some, solver.solve(place[rows].astype(np.int64), level[rows], np.repeat(np.arange(len(some)), some), len(some), first[k : k + step])))
        whole = lambda x: np.concatenate([np.zeros(0, dtype=np.int64), *x])
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(whole([p["mark"] for _, p in parts]), pa.int32()))]
        for field in schema.fields[1:]:
            length = whole([np.bincount(p[field.name][0], minlength=len(some)) for some, p in parts])
            inner = field.dataType.elementType.fields
            columns = [pa.array(np.concatenate([p[field.name][i + 1] for _, p in parts]) if parts else [], {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for i, f in enumerate(inner)]
            lists.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pa.StructArray.from_arrays(columns, [f.name for f in inner])))
        return pa.StructArray.from_arrays(lists, [f.name for f in schema.fields])

    return run


def parts(voxels: DataFrame, size: dict[str, int], connectivity: int, kind: str, greatest: bool = True, depth: float = 0.0) -> DataFrame:
    """voxels with label, the number of their part in each (image, t, c) from 1 in the order of first voxels (x fastest), and _lost: whether a voxel of the part has a greater (lesser) neighbour."""
    dimensions = 2 if size["z"] == 1 else 3
    groups = [k for k in KEYS if k in voxels.columns and k not in AXES]
    rest = [k for k in voxels.columns if k not in (*groups, *AXES)]
    side = [min(size[k], SIDE[dimensions]) for k in AXES]
    solver = Solver(kind, side, [size[k] for k in AXES], offsets(connectivity, dimensions), greatest, depth)
    value = T.DoubleType() if isinstance(voxels.schema["v"].dataType, T.FractionalType) else T.LongType()
    own, back, rows = [], {}, voxels.dropna(subset=[*groups, *AXES])
    step = [solver.frame[1] * solver.frame[2], solver.frame[2], 1]
    for k, n, pad, frame, stride in zip(AXES, side, solver.pads, solver.frame, step, strict=True):
        cell = lambda d, k=k, n=n: F.floor((F.col(k) + d) / n).cast("bigint")
        around = F.sequence(F.greatest(cell(-1), F.least(cell(0), F.lit(0))), F.least(cell(1), F.greatest(cell(0), F.lit((size[k] - 1) // n))))
        rows = rows.withColumn(f"_{k}", F.explode(around) if pad and size[k] > n else cell(0))
        own.append((F.col(k) - F.col(f"_{k}") * n + pad) * stride)
        back[k] = (F.col(f"_{k}") * n - pad + F.expr(f"_v.row.at div {stride} % {frame}")).cast(voxels.schema[k].dataType).alias(k)
    place = [f"_{k}" for k in AXES]
    rows = rows.groupBy(*groups, *place).agg(F.collect_list(F.struct(sum(own[1:], own[0]).cast("int").alias("at"), *rest)).alias("_rows"))
    origin = (F.col("_z") * side[0] * size["y"] + F.col("_y") * side[1]) * size["x"] + F.col("_x") * side[2]
    found = rows.withColumn("_found", solved(solver, value)(F.col("_rows.at"), F.col("_rows.v").cast(T.ArrayType(value)), origin))
    if solver.face.any():
        found = written(found, "blocks")
        found = found.join(across(found, size, groups, place, kind, depth), [*groups, *place])
        label, lost = F.get("_names.label", F.col("_v.mark")), "_names.lost"
    else:
        label, lost = F.col("_v.mark").cast("bigint") + 1, "_found.nodes.lost"
    out = found.withColumn("_v", F.explode(F.arrays_zip(F.col("_rows").alias("row"), F.col("_found.mark").alias("mark")))).where("_v.mark >= 0")
    return out.select(*groups, *(back[k] if k in back else F.col(f"_v.row.{k}").alias(k) for k in voxels.columns if k not in groups), label.alias("label"), F.get(lost, F.col("_v.mark")).alias("_lost"))


def across(found: DataFrame, size: dict[str, int], groups: list[str], place: list[str], kind: str, depth: float) -> DataFrame:
    """groups, place, _names: label and lost of each node of a block, in the order of its marks; what stands at borders is followed and joined."""
    from voxloom.operators import graph, watershed

    whole = math.prod(size[k] for k in AXES)
    stack = found.select(*groups).distinct().withColumn("_s", F.dense_rank().over(Window.orderBy(*groups)) - 1)  # a row per image of several blocks
    number = lambda c: (F.col("_s") * whole + F.col(c)).cast("bigint").alias(c.split(".")[-1])
    table = lambda k, ids, *more: found.select(*groups, F.explode(f"_found.{k}").alias("_e")).join(stack, groups).select(*(number(f"_e.{i}") for i in ids), *(F.col(f"_e.{m}") for m in more))
    roots, pairs = table("roots", ("root", "node"), "v"), table("pairs", ("p", "q"), "saddle")
    border = table("ends", ("id", "up"))
    if kind == "basins":
        up = border.union(roots.select("root", "root")).distinct()
        last = written(watershed.ends(up).join(roots, "root").select("id", "node", "v"), "ends")  # of voxels at borders and of roots
    else:
        last = border.select("id", F.col("up").alias("node")).union(roots.select("root", "node")).distinct()
    side = lambda k: last.select(F.col("id").alias(k), F.col("node").alias(f"n{k}"), *([F.col("v").alias(f"v{k}")] if kind == "basins" else []))
    touching = pairs.join(side("p"), "p").join(side("q"), "q").where("np <> nq")
    if kind == "basins":
        touching = touching.where(F.least("vp", "vq") - F.col("saddle") <= depth)
    merged = graph.components(touching.select(F.col("np").alias("a"), F.col("nq").alias("b"))).select(F.col("id").alias("_node"), F.col("label").alias("_to"))
    nodes = found.select(*groups, *place, F.posexplode("_found.nodes").alias("_k", "_e")).join(stack, groups).select(*groups, *place, "_k", number("_e.node"), "_e.first", F.col("_e.lost"))
    leads = last.select(F.col("id").alias("node"), F.col("node").alias("_node"))
    nodes = nodes.join(leads, "node", "left").withColumn("_node", F.coalesce("_node", "node")).join(merged, "_node", "left").withColumn("_part", F.coalesce("_to", "_node"))
    nodes = written(nodes.select(*groups, *place, "_k", "_part", "first", "lost"), "nodes")
    heads = nodes.groupBy(*groups, "_part").agg(F.min("first").alias("_first"), F.max("lost").alias("_lost"))
    heads = heads.withColumn("_label", F.row_number().over(Window.partitionBy(*groups).orderBy("_first")).cast("bigint"))
    named = nodes.join(heads, [*groups, "_part"]).groupBy(*groups, *place)
    return named.agg(F.sort_array(F.collect_list(F.struct("_k", F.col("_label").alias("label"), F.col("_lost").alias("lost")))).alias("_names"))
