"""Operators over spatial neighbourhoods: window sums, smoothing, convolution, resampling, extrema, morphology, distance maps, correlation."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.region import AXES, grid, wrapped

KEYS = ("image_id", *AXES)


def lines(voxels: DataFrame, axis: str) -> list[str]:
    return [k for k in KEYS if k != axis and k in voxels.columns]


def block_sum(voxels: DataFrame, size: Mapping[str, int], block: Mapping[str, int]) -> DataFrame:
    """Sum over every window of block that meets the image: n + k - 1 values an axis, one window pass per axis. Values are wide, not saturated."""
    out = voxels
    for axis, k in block.items():
        rest = lines(out, axis)
        line = Window.partitionBy(*rest).orderBy(axis).rowsBetween(-(k - 1), 0)
        whole = grid(out.select(*rest).distinct(), **{axis: (0, size[axis] + k - 1)})
        out = whole.join(out, [*rest, axis], "left").withColumn("v", F.sum(F.coalesce("v", F.lit(0))).over(line))
    return out


def block_sum_part(voxels: DataFrame, size: Mapping[str, int], block: Mapping[str, int], box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """block_sum within a box, coordinates from its corner; only voxels that its windows meet are read."""
    for axis, (start, end) in box.items():
        voxels = voxels.where((F.col(axis) > start - block.get(axis, 1)) & (F.col(axis) < end))
    out = block_sum(voxels, size, block)
    for axis, (start, end) in box.items():
        out = out.where((F.col(axis) >= start) & (F.col(axis) < end)).withColumn(axis, F.col(axis) - start)
    return out


def mean_smooth(series: DataFrame, width: int, order: str, by: Sequence[str], value: str = "v") -> DataFrame:
    """Mean over the window [i - left, i + right], right = width div 2, left = width - right - 1, cut at the ends; width 0 or less copies."""
    if width <= 0:
        return series.withColumn("smooth", F.col(value).cast("double"))
    right = width // 2
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - right - 1), right)
    return series.withColumn("smooth", F.avg(value).over(frame))


def median_filter(series: DataFrame, width: int, order: str, by: Sequence[str], value: str = "v") -> DataFrame:
    """Median over the same window; of an even number of samples the upper one, unless the lower equals the sample in the centre."""
    if width <= 0:
        return series.withColumn("smooth", F.col(value))
    right = width // 2
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(width - right - 1), right)
    own = F.array_sort(F.collect_list(value).over(frame))
    series = series.withColumn("_w", own)
    half = F.floor(F.size("_w") / 2).cast("int")
    upper, lower = F.element_at("_w", half + 1), F.element_at("_w", F.greatest(half, F.lit(1)))
    even = F.size("_w") % 2 == 0
    return series.withColumn("smooth", F.when(even & (lower == F.col(value)), lower).otherwise(upper)).drop("_w")


def separable(kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Column and row kernels whose product a two-dimensional kernel is, if it has rank one."""
    u, s, v = np.linalg.svd(np.asarray(kernel, dtype=float))
    if len(s) > 1 and s[1] > 1e-12 * s[0]:
        return None
    return u[:, 0] * math.sqrt(s[0]), v[0] * math.sqrt(s[0])


def gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    radius = math.ceil(3 * sigma) if radius is None else radius
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return k / k.sum()


def laplacian_of_gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    """Square kernel of zero sum."""
    radius = math.ceil(3 * sigma) if radius is None else radius
    y, x = np.mgrid[-radius : radius + 1, -radius : radius + 1]
    r = (x**2 + y**2) / (2 * sigma**2)
    k = (r - 1) * np.exp(-r)
    return k - k.mean()


def correlate(voxels: DataFrame, kernel: np.ndarray, size: Mapping[str, int], pad: str = "constant", axes: Sequence[str] = ("y", "x"), flip: bool = False) -> DataFrame:
    """Correlation (convolution with flip) of each image with a small kernel, centred, of the image's size.

    Per axis a table of (position of a sample, position of an output, offset in the kernel) carries the pad rule; both tables and the
    kernel have a number of rows that the image's side and the kernel bound. A kernel of rank one takes one pass per axis instead.
    """
    kernel = np.asarray(kernel, dtype=float)
    if kernel.ndim == 2 and min(kernel.shape) > 1 and (parts := separable(kernel)):
        return correlate(correlate(voxels, parts[0], size, pad, axes[:1], flip), parts[1], size, pad, axes[1:], flip)
    if flip:
        kernel = np.flip(kernel)
    kernel = kernel.reshape([n for n in kernel.shape if kernel.ndim == len(axes)] or [-1])
    spark, out = voxels.sparkSession, voxels
    for axis, n in zip(axes, kernel.shape, strict=True):
        half = (n - 1) // 2
        pairs = spark.range(size[axis]).crossJoin(spark.range(n).select(F.col("id").alias(f"_k_{axis}")))  # a side times a kernel: constants
        table = pairs.select(F.col("id").alias("_to"), f"_k_{axis}", wrapped(F.col("id") + F.col(f"_k_{axis}") - half, size[axis], pad).alias("_from")).where("_from IS NOT NULL")
        out = out.join(F.broadcast(table), F.col(axis) == F.col("_from")).drop("_from", axis).withColumnRenamed("_to", axis)
    weights = spark.createDataFrame([(*map(int, at), float(w)) for at, w in np.ndenumerate(kernel)], ", ".join(f"_k_{a} long" for a in axes) + ", _w double")
    keys = [k for k in KEYS if k in voxels.columns]
    return out.join(F.broadcast(weights), [f"_k_{a}" for a in axes]).groupBy(*keys).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))


def contributions(n: int, m: int, method: str = "linear", antialias: bool = True) -> list[tuple[int, int, float]]:
    """(output, input, weight) of resizing n samples to m; weights of an output sum to 1, edges repeat."""
    scale = n / m
    if method == "nearest":
        return [(i, min(n - 1, int((i + 0.5) * scale)), 1.0) for i in range(m)]
    kernels = {
        "linear": (1, lambda t: max(0.0, 1 - abs(t))),
        "cubic": (2, lambda t: 1.5 * abs(t) ** 3 - 2.5 * t * t + 1 if abs(t) <= 1 else -0.5 * abs(t) ** 3 + 2.5 * t * t - 4 * abs(t) + 2 if abs(t) < 2 else 0.0),
        "lanczos2": (2, lambda t: float(np.sinc(t) * np.sinc(t / 2)) if abs(t) < 2 else 0.0),
        "lanczos3": (3, lambda t: float(np.sinc(t) * np.sinc(t / 3)) if abs(t) < 3 else 0.0),
    }
    reach, kernel = kernels[method]
    stretch = max(1.0, scale) if antialias else 1.0
    out = []
    for i in range(m):
        centre = (i + 0.5) * scale - 0.5
        weights: dict[int, float] = {}
        for k in range(math.floor(centre - reach * stretch), math.ceil(centre + reach * stretch) + 1):
            at = min(max(k, 0), n - 1)
            weights[at] = weights.get(at, 0.0) + kernel((k - centre) / stretch)
        whole = sum(weights.values())
        out += [(i, at, w / whole) for at, w in sorted(weights.items()) if w]
    return out


def resize(voxels: DataFrame, size: Mapping[str, int], to: Mapping[str, int], method: str = "linear", antialias: bool = True) -> DataFrame:
    """Resampled images, one join with a table of weights and one grouped sum per axis."""
    out = voxels
    for axis, m in to.items():
        rest = lines(out, axis)
        table = out.sparkSession.createDataFrame(contributions(size[axis], m, method, antialias), f"_to long, {axis} long, _w double")
        out = out.join(F.broadcast(table), axis).groupBy(*rest, F.col("_to").alias(axis)).agg(F.sum(F.col("v") * F.col("_w")).alias("v"))
    return out


def offsets(connectivity: int, dimensions: int) -> list[tuple[int, int, int]]:
    """(dz, dy, dx) of the neighbours: 4 or 8 in a plane, 6, 18 or 26 in space; 0 picks the largest, and a plane takes 6 as 4 and others as 8."""
    if dimensions == 2:
        connectivity = {0: 8, 4: 4, 6: 4}.get(connectivity, 8)
    connectivity = connectivity or 26
    reach = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}[connectivity]
    depth = (0,) if connectivity in (4, 8) else (-1, 0, 1)
    return [d for d in itertools.product(depth, (-1, 0, 1), (-1, 0, 1)) if 0 < sum(map(abs, d)) <= reach]


#: Voxels of a line that stay together.
LINE = 64


def line_pairs(own: DataFrame, other: DataFrame, shifts: Sequence[tuple[int, int, int]], value: str) -> DataFrame:
    """Every voxel of own (keys, v) with each of other (keys, value) that lies at one of the shifts from it: the keys, v, and nz, ny, nx, value.

    Pieces of lines meet, once per shift of lines, and voxels within them: a shuffle holds each voxel once on one side and about once per
    shift of lines on the other, not once per shift.
    """
    keys = [k for k in own.columns if k != "v"]
    fixed = [k for k in keys if k not in ("z", "y", "x")]
    beside: dict[tuple[int, int], list[int]] = {}
    for z, y, x in shifts:
        beside.setdefault((z, y), []).append(x)
    low, high = min(s[2] for s in shifts), max(s[2] for s in shifts)
    line = [*fixed, "z", "y", "_t"]
    left = own.withColumn("_t", F.floor(F.col("x") / LINE)).groupBy(*line).agg(F.collect_list(F.struct("x", "v")).alias("_own"))
    right = other.withColumn("_t", F.explode(F.sequence(F.floor((F.col("x") - high) / LINE), F.floor((F.col("x") - low) / LINE))))
    right = right.groupBy(*line).agg(F.collect_list(F.struct(F.col("x").alias("nx"), value)).alias("_other"))
    moved = F.explode(F.array(*(F.struct(F.lit(z).alias("dz"), F.lit(y).alias("dy"), F.array(*map(F.lit, xs)).alias("dx")) for (z, y), xs in beside.items()))).alias("d")
    right = right.select("*", moved).select(*fixed, "_t", (F.col("z") - F.col("d.dz")).alias("z"), (F.col("y") - F.col("d.dy")).alias("y"), F.col("z").alias("nz"), F.col("y").alias("ny"), "d.dx", "_other")
    both = left.join(right, line).withColumn("_o", F.explode("_own")).withColumn("_n", F.explode("_other"))
    near = both.where(F.array_contains("dx", (F.col("_n.nx") - F.col("_o.x")).cast("int")))
    return near.select(*(F.col("_o.x").alias("x") if k == "x" else F.col(k) for k in keys), F.col("_o.v").alias("v"), "nz", "ny", F.col("_n.nx").alias("nx"), F.col(f"_n.{value}").alias(value))


def neighbour_pairs(voxels: DataFrame, shifts: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Every voxel with each neighbour: the keys, v, and nz, ny, nx, nv."""
    keys = [k for k in KEYS if k in voxels.columns]
    fixed = [k for k in keys if k not in ("z", "y", "x")]
    moved = F.explode(F.array(*(F.struct(F.lit(d[0]).alias("dz"), F.lit(d[1]).alias("dy"), F.lit(d[2]).alias("dx")) for d in shifts))).alias("d")
    own = voxels.select(*keys, "v", moved).select(*keys, "v", *((F.col(a) + F.col(f"d.d{a}")).alias(f"n{a}") for a in "zyx"))
    other = voxels.select(*fixed, *(F.col(a).alias(f"n{a}") for a in "zyx"), F.col("v").alias("nv"))
    return own.join(other, [*fixed, "nz", "ny", "nx"])


def rank_filter(voxels: DataFrame, connectivity: int, dimensions: int, how: str) -> DataFrame:
    """Dilation (max), erosion (min) or median over a voxel and its neighbours; edges use the voxels there are."""
    keys = [k for k in KEYS if k in voxels.columns]
    pairs = neighbour_pairs(voxels, [(0, 0, 0), *offsets(connectivity, dimensions)])
    return pairs.groupBy(*keys).agg({"dilate": F.max("nv"), "erode": F.min("nv"), "median": F.median("nv")}[how].alias("v"))


def majority(voxels: DataFrame, connectivity: int, dimensions: int, least: int) -> DataFrame:
    """1 where at least so many neighbours are above 0."""
    keys = [k for k in KEYS if k in voxels.columns]
    counts = neighbour_pairs(voxels, offsets(connectivity, dimensions)).groupBy(*keys).agg(F.sum((F.col("nv") > 0).cast("int")).alias("_n"))
    return voxels.join(counts, keys, "left").withColumn("v", (F.coalesce("_n", F.lit(0)) >= least).cast("bigint")).drop("_n")


def squared_distances(voxels: DataFrame, spacing: Mapping[str, float] | None = None, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Squared Euclidean distance of every voxel to the nearest one that is 0, exactly: one pass of lower envelopes per axis over whole lines. Without such a voxel: infinity."""
    spacing = spacing or {}
    out = voxels.withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(float("inf")))
    for axis in axes:
        rest = lines(out, axis)
        line = F.sort_array(F.collect_list(F.struct(F.col(axis).cast("bigint").alias("at"), "v"))).alias("_line")
        schema = ", ".join(f"{k} long" for k in rest) + ", _line array<struct<at:long,v:double>>"
        whole = out.groupBy(*(F.col(k).cast("bigint").alias(k) for k in rest)).agg(line)
        out = whole.mapInArrow(lower_envelopes(float(spacing.get(axis, 1.0))), schema).select(*rest, F.inline("_line")).select(*rest, F.col("at").alias(axis), "v")
    return out


#: Lines up to this long are compared point by point, many at once; longer ones by their envelope of parabolas.
SHORT_LINE = 128


def lower_envelopes(step: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The least of squared gap plus value over each line; many lines a batch, one in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            edges, flat = lists.offsets.to_numpy(), lists.values
            at, f = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = np.empty(len(f))
            for a, b in zip(edges, edges[1:], strict=False):
                own, value = at[a:b] * step, f[a:b]
                out[a:b] = np.min((own[:, None] - own[None, :]) ** 2 + value[None, :], axis=1) if b - a <= SHORT_LINE else envelope(own, value)
            done = pa.ListArray.from_arrays(lists.offsets, pa.StructArray.from_arrays([pa.array(at), pa.array(out)], ["at", "v"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], done], batch.schema.names)

    return run


def envelope(at: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The same for one long line, in a single pass: the parabolas that are lowest somewhere, and where each begins to be."""
    own = np.flatnonzero(np.isfinite(f))
    if not len(own):
        return np.full(len(f), np.inf)
    lowest, begins = [int(own[0])], [-np.inf]
    for k in own[1:].tolist():
        while True:
            j = lowest[-1]
            meets = ((f[k] + at[k] ** 2) - (f[j] + at[j] ** 2)) / (2 * (at[k] - at[j]))
            if meets > begins[-1]:
                break
            lowest.pop()
            begins.pop()
        lowest.append(k)
        begins.append(meets)
    chosen = np.array(lowest)[np.searchsorted(np.array(begins), at, side="right") - 1]
    return (at - at[chosen]) ** 2 + f[chosen]


def signed_distances(voxels: DataFrame, spacing: Mapping[str, float] | None = None, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Distance of every voxel to the nearest one of the other side: negative inside (v other than 0), positive outside; infinite without another side."""
    inside = squared_distances(voxels, spacing, axes).withColumnRenamed("v", "_in")
    outside = squared_distances(voxels.withColumn("v", (F.col("v") == 0).cast("double")), spacing, axes).withColumnRenamed("v", "_out")
    keys = [k for k in KEYS if k in voxels.columns]
    return inside.join(outside, keys).select(*keys, (F.sqrt("_out") - F.sqrt("_in")).alias("v"))


def correlation_at(a: DataFrame, b: DataFrame, shifts: Sequence[tuple[int, int, int]], least: int = 2) -> DataFrame:
    """dz, dy, dx, n, ncc: normalised cross-correlation of b moved by each offset against a, over the n voxels where they overlap."""
    both = line_pairs(a.select("z", "y", "x", "v"), b.select("z", "y", "x", F.col("v").alias("_b")), [(-z, -y, -x) for z, y, x in shifts], "_b")
    found = both.select(*((F.col(k) - F.col(f"n{k}")).alias(f"d{k}") for k in "zyx"), "v", "_b")
    return found.groupBy("dz", "dy", "dx").agg(F.count("*").alias("n"), F.corr(F.col("v").cast("double"), F.col("_b").cast("double")).alias("ncc")).where(F.col("n") >= least)


def spectrum(voxels: DataFrame) -> DataFrame:
    """Two-dimensional Fourier transform of each image (re, im), a task an image."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        height, width = int(own["y"].max()) + 1, int(own["x"].max()) + 1
        plane = np.zeros((height, width))
        plane[own["y"], own["x"]] = own["v"]
        out = np.fft.fft2(plane)[own["y"], own["x"]]
        return own[["image_id", "y", "x"]].assign(re=out.real, im=out.imag)

    return voxels.select("image_id", "y", "x", F.col("v").cast("double").alias("v")).groupBy("image_id").applyInPandas(run, "image_id long, y long, x long, re double, im double")
