"""Automatic thresholds. Images are reduced to histograms by Spark; the rules run over bins (bin, n), whose number the voxel type bounds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import aggregate, blocks
from voxloom.operators.graph import voxel_components
from voxloom.operators.neighborhood import KEYS


def regional_extrema(voxels: DataFrame, size: dict[str, int], connectivity: int = 0, low: float = 0, high: float = 255, greatest: bool = True) -> DataFrame:
    """voxels with v = 1 on plateaus without a higher (lower) neighbour, otherwise 0; a plateau at the end of the data range is none."""
    keys = [k for k in KEYS if k in voxels.columns]
    marked = blocks.parts(voxels.select(*keys, "v"), size, connectivity, "plateaus", greatest)
    end = F.lit(low if greatest else high)
    return marked.withColumn("v", F.when(F.col("v").isNotNull(), ~F.col("_lost") & (F.col("v") != end)).cast("bigint")).select(*keys, "v")


def counts(histogram: DataFrame, bins: int) -> np.ndarray:
    """The counts of one histogram (at most 65,536 bins) as an array."""
    out = np.zeros(bins, dtype=np.int64)
    for x in histogram.select("bin", "n").collect():
        out[x.bin] = x.n
    return out


def triangle(n: np.ndarray) -> int:
    """The bin that minimises scaled height plus position, between the highest bin and the lowest used bin right of it."""
    used = np.flatnonzero(n)
    if len(used) < 2:
        return int(used[0]) if len(used) else 0
    low, high = used[0], used[-1]
    top = low + int(np.argmax(n[low:high]))
    tail = np.flatnonzero(n[top : high + 1]) + top
    least = tail[np.flatnonzero(n[tail] == n[tail].min())[0]]  # found scanning down: the tie nearest to the top
    a, b = min(top, least), max(top, least)
    own = np.arange(a, b + 1)
    own = own[n[own] > 0]
    height = n[own] * (len(n) - 1) / n[top] + own
    return int(own[np.argmin(height)])


def two_centroids(n: np.ndarray) -> int:
    """Midway between the means below (with it) and above the threshold, until it stays; an empty side counts as the middle of its range."""
    used = np.flatnonzero(n)
    if not len(used):
        return 0
    low, high = int(used[0]), int(used[-1])
    at = np.arange(len(n))
    now, seen = (low + high) // 2, set()
    while now not in seen:
        seen.add(now)
        under, over = n[: now + 1], n[now + 1 :]
        c1 = (under * at[: now + 1]).sum() / under.sum() if under.sum() else (low + now) / 2
        c2 = (over * at[now + 1 :]).sum() / over.sum() if over.sum() else (now + high) / 2
        now = int((c1 + c2) // 2)
    return now


def after_lower_mode(n: np.ndarray) -> int:
    """The bin after the highest one of the lower half of the used range."""
    used = np.flatnonzero(n)
    if not len(used):
        return 0
    low, high = int(used[0]), int(used[-1])
    return low + int(np.argmax(n[low : (low + high) // 2 + 1])) + 1


RULES = {"triangle": triangle, "two_centroids": two_centroids, "after_lower_mode": after_lower_mode}


def automatic(voxels: DataFrame, rule: str, bins: int = 256, by: Sequence[str] = ()) -> int | DataFrame:
    """The rule's threshold of all voxels, or one per group: a task folds the histogram of its group."""
    if not by:
        return RULES[rule](counts(aggregate.histogram(voxels, 0, bins - 1, bins), bins))
    keys = [(k, voxels.schema[k].dataType.simpleString()) for k in by]

    def fold(own):  # noqa: ANN001, ANN202
        n = np.zeros(bins, dtype=np.int64)
        n[own["bin"]] = own["n"]
        return own[list(by)].head(1).assign(threshold=RULES[rule](n))

    return aggregate.histogram(voxels, 0, bins - 1, bins, by=by).groupBy(*by).applyInPandas(fold, ", ".join(f"{k} {t}" for k, t in keys) + ", threshold long")


def local_maximum_threshold(voxels: DataFrame, size: dict[str, int], bins: int = 256) -> int:
    """Triangle threshold of the values at regional maxima, each plateau counted once."""
    maxima = regional_extrema(voxels, size, 18, 0, bins - 1)
    keys = [k for k in KEYS if k in voxels.columns]
    seeds = voxel_components(maxima, size, 18).groupBy("image_id", "t", "c", "label").agg(F.min(F.struct("z", "y", "x")).alias("p")).select("image_id", "t", "c", "p.*")
    values = voxels.join(seeds, keys, "left_semi")
    return triangle(counts(aggregate.histogram(values, 0, bins - 1, bins), bins))


def subtract_background(voxels: DataFrame, by: Sequence[str] = ("image_id",), rounds: int = 3, least: float = 0.5) -> DataFrame:
    """Subtracts each group's most frequent value (clamped at 0) while at least a share of its voxels is at or above it, up to some rounds."""
    for _ in range(rounds):
        modes = voxels.groupBy(*by, "v").agg(F.count("*").alias("_n")).groupBy(*by).agg(F.max_by("v", F.struct("_n", -F.col("v"))).alias("_mode"), F.sum("_n").alias("_all"))
        kept = voxels.join(modes, list(by)).where("v >= _mode").groupBy(*by).agg((F.count("*") / F.max("_all")).alias("_share"))
        rule = modes.join(kept, list(by)).withColumn("_mode", F.when(F.col("_share") >= least, F.col("_mode")).otherwise(0)).select(*by, "_mode")
        voxels = voxels.join(rule, list(by)).withColumn("v", F.greatest(F.col("v") - F.col("_mode"), F.lit(0))).drop("_mode")
    return voxels


def fill_holes(voxels: DataFrame, size: dict[str, int]) -> DataFrame:
    """Background components that don't touch the border become 1."""
    keys = [k for k in KEYS if k in voxels.columns]
    flat = size["z"] == 1
    ground = voxel_components(voxels, size, 4 if flat else 6, F.col("v") == 0)
    axes = ("y", "x") if flat else ("z", "y", "x")
    edge = F.lit(False)
    for a in axes:
        edge = edge | (F.col(a) == 0) | (F.col(a) == size[a] - 1)
    groups = [k for k in keys if k not in ("z", "y", "x")]
    open_ = ground.where(edge).select(*groups, "label").distinct()
    holes = ground.join(open_, [*groups, "label"], "left_anti").select(*keys, F.lit(True).alias("_hole"))
    return voxels.join(holes, keys, "left").withColumn("v", F.when(F.col("_hole"), 1).otherwise(F.col("v"))).drop("_hole")
