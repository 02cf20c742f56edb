"""Aggregations: ranges, histograms, projections, combined images, blocks, moments, object and punctum statistics."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.region import AXES

MODES = ("max", "min", "mean", "median", "first")
# Fixed value: the chi-squared quantile of 95 percent with three degrees of freedom.
CHI2_95_3 = 7.814727903251179


def statistic(mode: str, order: Column, whole: bool = True) -> Column:
    """Aggregate of v; mean and median of whole numbers are cut toward zero, first is the value of the smallest order."""
    v = F.col("v")
    out = {"max": F.max(v), "min": F.min(v), "mean": F.avg(v), "median": F.median(v), "first": F.min_by(v, order)}[mode]
    return out.cast("bigint") if whole and mode in ("mean", "median") else out


def min_max(voxels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return voxels.groupBy(*by).agg(F.min("v").alias("min_v"), F.max("v").alias("max_v"))


def total(voxels: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return voxels.groupBy(*by).agg(F.sum(F.col("v").cast("double")).alias("sum_v"))


def bin_of(v: Column, low: float, high: float, bins: int, whole: bool = True) -> Column:
    """Bin of a value of [low, high]; null outside. Whole numbers share hi + 1 - lo values out; the top of a float range is in the last bin."""
    if not high > low:
        raise ValueError("a histogram needs low < high")
    if whole:
        at = v - int(low) if int(high) - int(low) + 1 == bins else F.floor((v - int(low)) * bins / (int(high) + 1 - int(low)))
    else:
        at = F.least(F.floor((v - float(low)) * bins / (float(high) - float(low))), F.lit(bins - 1))
    return F.when((v >= low) & (v <= high), at.cast("bigint"))


def bin_range(low: float, high: float, bins: int, index: Column, whole: bool = True) -> tuple[Column, Column]:
    """Ends of a bin, the inverse of bin_of()."""
    width = (high + 1 - low if whole else high - low) / bins
    return index * width + low, (index + 1) * width + low


def histogram(voxels: DataFrame, low: float, high: float, bins: int, mask: DataFrame | None = None, by: Sequence[str] = (), whole: bool = True, keys: Sequence[str] = ("image_id", *AXES)) -> DataFrame:
    """by, bin, n: all bins, empty ones too. Counts combine before the shuffle, so what moves is bins, not voxels."""
    if mask is not None:
        voxels = voxels.join(mask.where("v > 0").select(*keys), list(keys), "left_semi")
    counts = voxels.select(*by, bin_of(F.col("v"), low, high, bins, whole).alias("bin")).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    groups = voxels.select(*by).distinct().select(*by, every) if by else voxels.sparkSession.range(1).select(every)
    return groups.join(counts, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def project(voxels: DataFrame, axis: str, mode: str, start: int | None = None, end: int | None = None, whole: bool = True) -> DataFrame:
    """One value per line along the axis; the range from start to end includes end."""
    if start is not None:
        voxels = voxels.where(F.col(axis) >= start)
    if end is not None:
        voxels = voxels.where(F.col(axis) <= end)
    rest = [k for k in ("image_id", *AXES) if k != axis and k in voxels.columns]
    return voxels.groupBy(*rest).agg(statistic(mode, F.col(axis), whole).alias("v"))


def combine(images: Sequence[DataFrame] | DataFrame, mode: str, order: str = "image_order", keys: Sequence[str] = AXES, whole: bool = True) -> DataFrame:
    """One image from many of one size, voxel by voxel; first: of the lowest order."""
    if not isinstance(images, DataFrame):
        images = functools.reduce(DataFrame.unionByName, (x.withColumn(order, F.lit(i)) for i, x in enumerate(images)))
    return images.groupBy(*keys).agg(statistic(mode, F.col(order), whole).alias("v"))


def block_downsample(voxels: DataFrame, block: dict[str, int], mode: str, whole: bool = True) -> DataFrame:
    """One value per block; blocks at the edge use the voxels they have."""
    keys = [k for k in ("image_id", *AXES) if k in voxels.columns]
    order = F.struct(*(F.col(k) for k in ("z", "y", "x") if k in keys))
    return voxels.groupBy(*((F.floor(F.col(k) / block[k]).alias(k) if k in block else F.col(k)) for k in keys)).agg(statistic(mode, order, whole).alias("v"))


def arg_max(voxels: DataFrame, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """All voxels that hold their group's maximum."""
    best = voxels.groupBy(*by).agg(F.max("v").alias("_best"))
    return voxels.join(best, list(by)).where("v = _best").drop("_best")


def moments(values: DataFrame, value: str = "v", by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return values.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.var_pop(v).alias("variance"), F.var_samp(v).alias("sample_variance"),
        F.stddev_pop(v).alias("sd"), F.stddev_samp(v).alias("sample_sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"),
    )


def percentile_window(values: DataFrame, value: str, shares: Sequence[float] = (0.01, 0.99), by: Sequence[str] = ()) -> DataFrame:
    """Exact percentiles (with interpolation) as columns p0, p1, ..."""
    return values.groupBy(*by).agg(*(F.percentile(value, share).alias(f"p{i}") for i, share in enumerate(shares)))


def integer_histogram(voxels: DataFrame, limit: int, by: Sequence[str] = ()) -> DataFrame:
    """min, max, length, count, sum, mode (the smallest of the most frequent values) and the count above a limit, from counts by value."""
    counts = voxels.groupBy(*by, "v").agg(F.count("*").alias("n"))
    most = F.max_by("v", F.struct("n", -F.col("v")))
    return counts.groupBy(*by).agg(
        F.min("v").alias("min"), F.max("v").alias("max"), (F.max("v") - F.min("v") + 1).alias("length"), F.sum("n").alias("count"),
        F.sum(F.col("v") * F.col("n")).alias("sum"), most.alias("mode"), F.sum(F.when(F.col("v") > limit, F.col("n")).otherwise(0)).alias("upper"),
    )


def weighted_moments(points: DataFrame, weight: str, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Weighted means and covariances of the columns."""
    w = F.col(weight)
    means = points.groupBy(*by).agg(F.sum(w).alias("w"), *((F.sum(w * F.col(c)) / F.sum(w)).alias(f"mean_{c}") for c in columns), *((F.sum(w * F.col(a) * F.col(b)) / F.sum(w)).alias(f"_{a}{b}") for i, a in enumerate(columns) for b in columns[i:]))
    cov = [(F.col(f"_{a}{b}") - F.col(f"mean_{a}") * F.col(f"mean_{b}")).alias(f"cov_{a}{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return means.select(*by, "w", *(f"mean_{c}" for c in columns), *cov)


def puncta(voxels: DataFrame, by: Sequence[str] = ("pid",), chi2: float = CHI2_95_3) -> DataFrame:
    """A punctum from its voxels (x, y, z, v): size, mass, mean, maximum, intensity-weighted centre and radius.

    sd_intensity holds the sample variance (no root is taken). The radius is sqrt(chi2) * sqrt(trace of the covariance / 3), 0.5 for one voxel.
    """
    m = weighted_moments(voxels, "v", ("x", "y", "z"), by)
    basic = voxels.groupBy(*by).agg(F.count("*").alias("vol_size"), F.sum("v").alias("mass"), F.avg("v").alias("mean_intensity"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("sd_intensity"), F.max("v").alias("max_intensity"))
    trace = F.greatest(F.col("cov_xx") + F.col("cov_yy") + F.col("cov_zz"), F.lit(0.0))
    radius = F.when(F.col("vol_size") == 1, 0.5).otherwise(F.sqrt(F.lit(chi2)) * F.sqrt(trace / 3))
    return basic.join(m, list(by)).select(*by, "vol_size", "mass", "mean_intensity", "sd_intensity", "max_intensity", F.col("mean_x").alias("x"), F.col("mean_y").alias("y"), F.col("mean_z").alias("z"), radius.alias("radius"))


def merge_puncta(points: DataFrame, by: str) -> DataFrame:
    """Puncta merged without their voxels: centre weighted by size, summed mass and size, largest maximum."""
    w = F.col("vol_size")
    return points.groupBy(by).agg(
        *((F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in ("x", "y", "z")), F.sum("mass").alias("mass"), F.sum(w).alias("vol_size"),
        F.max("max_intensity").alias("max_intensity"), (F.sum("mass") / F.sum(w)).alias("mean_intensity"), F.lit(1.0).alias("score"),
    )


def label_boxes(voxels: DataFrame, label: str = "label", axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Size and bounding box (ends exclusive) of each object."""
    return voxels.groupBy(label).agg(F.count("*").alias("size"), *(e for a in axes for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))))


def remove_small(voxels: DataFrame, size: int, label: str = "label") -> DataFrame:
    """Objects of more than size voxels; size 0 removes everything."""
    if size == 0:
        return voxels.where("false")
    kept = voxels.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    return voxels.join(kept.select(label), label, "left_semi")


def cumulative_sum(voxels: DataFrame, axis: str, low: int, high: int) -> DataFrame:
    """Running sum along an axis that saturates. Without negative values the clamp can come last; otherwise the scan clamps at each step."""
    rest = [k for k in ("image_id", *AXES) if k != axis and k in voxels.columns]
    if low >= 0:
        line = Window.partitionBy(*rest).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        return voxels.withColumn("v", F.least(F.sum("v").over(line), F.lit(high)))
    lines = voxels.groupBy(*rest).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).alias("k"), F.col("v").cast("bigint").alias("v")))).alias("own"))
    scan = f"aggregate(own, cast(array() AS array<struct<k:bigint,v:bigint>>), (acc, e) -> concat(acc, array(struct(e.k AS k, greatest({low}L, least({high}L, coalesce(element_at(acc, -1).v, 0L) + e.v)) AS v))))"
    return lines.select(*rest, F.explode(F.expr(scan.replace("element_at(acc, -1)", "try_element_at(acc, -1)"))).alias("e")).select(*rest, F.col("e.k").alias(axis), F.col("e.v").alias("v"))
