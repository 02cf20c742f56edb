"""Operators on single voxels and pairs of images: thresholds, casts, flips, arithmetic, paste, concatenation."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import saturate
from voxloom.operators.region import AXES

KEYS = ("image_id", *AXES)
V = F.col


def fill(voxels: DataFrame, value: float) -> DataFrame:
    return voxels.withColumn("v", F.lit(value))


def fill_random(voxels: DataFrame, kind: str, seed: int) -> DataFrame:
    """Uniform values of the type's data range, fixed by seed and coordinates, whatever the partitioning."""
    low, high = saturate.DATA_RANGE[kind]
    share = F.pmod(F.xxhash64(F.lit(seed), *KEYS), F.lit(1 << 53)) / float(1 << 53)
    return voxels.withColumn("v", share * (high - low) + low if kind in saturate.FLOATS else F.floor(share * (high - low + 1) + low))


def matches(limit: float, side: str, include: bool) -> Column:
    v = F.col("v")
    return {("above", True): v >= limit, ("above", False): v > limit, ("below", True): v <= limit, ("below", False): v < limit}[side, include]


def threshold(voxels: DataFrame, limit: float, side: str = "above", include: bool = True, outside: float = 0, kind: str = "uint8") -> DataFrame:
    """Voxels above (below) the limit become outside; limit and outside are cast to the voxel type first."""
    limit, outside = (float(x) if kind in saturate.FLOATS else min(max(int(x + 0.5 * (1 if x >= 0 else -1)), saturate.RANGES[kind][0]), saturate.RANGES[kind][1]) for x in (limit, outside))
    return voxels.withColumn("v", F.when(matches(limit, side, include), F.lit(outside)).otherwise(F.col("v")).cast(voxels.schema["v"].dataType))


def binarized(voxels: DataFrame, predicate: Column | None = None) -> DataFrame:
    """1 where the predicate holds (by default: the foreground, above 0), otherwise 0."""
    return voxels.withColumn("v", F.coalesce((F.col("v") > 0 if predicate is None else predicate).cast("bigint"), F.lit(0).cast("bigint")))


def normalize(voxels: DataFrame, kind: str, by: Sequence[str] = ("image_id",)) -> DataFrame:
    """Each image's own range (minimum to maximum) mapped onto the type's data range. The ranges are one small row per image."""
    ranges = voxels.groupBy(*by).agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    return voxels.join(ranges, list(by)).withColumn("v", saturate.rescale(F.col("v"), (F.col("_low"), F.col("_high")), kind)).drop("_low", "_high")


def cast_to(voxels: DataFrame, kind: str) -> DataFrame:
    return voxels.withColumn("v", saturate.saturate_cast(F.col("v"), kind))


def convert_to(voxels: DataFrame, source: str, target: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Maps the source type's data range (or low to high) onto the target type's."""
    own = saturate.DATA_RANGE[source]
    low, high = own[0] if low is None else low, own[1] if high is None else high
    return voxels.withColumn("v", saturate.rescale(F.col("v"), (F.lit(float(low)), F.lit(float(high))), target))


def flip(voxels: DataFrame, size: Mapping[str, int], axes: Sequence[str]) -> DataFrame:
    return voxels.withColumns({axis: F.lit(size[axis] - 1) - F.col(axis) for axis in axes})


def transpose(voxels: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    return voxels.withColumns({a: F.col(b), b: F.col(a)})


def unary(voxels: DataFrame, f: Callable[[Column], Column], kind: str | None = None) -> DataFrame:
    value = f(F.col("v"))
    return voxels.withColumn("v", saturate.saturate_cast(value, kind) if kind else value)


def with_scalar(voxels: DataFrame, op: str, number: float, kind: str = "uint8") -> DataFrame:
    """image op number, saturating; a fraction is worked out in doubles and rounded."""
    if kind in saturate.FLOATS or float(number).is_integer():
        value = saturate.OPERATIONS[op](F.col("v"), F.lit(number if kind in saturate.FLOATS else int(number)), kind)
    else:
        v = F.col("v").cast("double")
        value = saturate.saturate_cast({"+": v + number, "-": v - number, "*": v * number, "/": v / number}[op], kind)
    return voxels.withColumn("v", value)


def binary(a: DataFrame, b: DataFrame, f: Callable[[Column, Column], Column], keys: Sequence[str] = KEYS) -> DataFrame:
    """f of the values of two images of one size, joined on coordinates; rows without a partner are an error of size."""
    both = a.withColumnRenamed("v", "_a").join(b.select(*keys, F.col("v").alias("_b")), list(keys), "full")
    guard = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("images of different size")).cast("bigint"))
    return both.withColumn("v", F.coalesce(guard, f(F.col("_a"), F.col("_b")))).drop("_a", "_b")


def image_op(a: DataFrame, b: DataFrame, op: str, kind: str = "uint8", keys: Sequence[str] = KEYS) -> DataFrame:
    return binary(a, b, lambda x, y: saturate.OPERATIONS[op](x, y, kind), keys)


def equal(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> bool:
    """Whether two images have the same voxels."""
    columns = [*keys, "v"]
    return a.select(*columns).exceptAll(b.select(*columns)).isEmpty() and b.select(*columns).exceptAll(a.select(*columns)).isEmpty()


def paste(into: DataFrame, patch: DataFrame, start: Mapping[str, int], combine: Callable[[Column, Column], Column] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """patch put at start: its voxels replace those below (combine(below, above): are combined with them), and what lies outside is cut off."""
    moved = patch.select(*((F.col(k) + start[k]).alias(k) if k in start else F.col(k) for k in keys), F.col("v").alias("_p"))
    above = F.col("_p") if combine is None else combine(F.col("v"), F.col("_p"))
    return into.join(moved, list(keys), "left").withColumn("v", F.when(F.col("_p").isNull(), F.col("v")).otherwise(above)).drop("_p")


def edit(voxels: DataFrame, edits: DataFrame, kind: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """voxels with the values of an edits table (keys, v), cast to the type."""
    return paste(voxels, edits.withColumn("v", saturate.saturate_cast(F.col("v"), kind)), {}, keys=keys)


def masked(voxels: DataFrame, mask: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The voxels where the mask is above 0."""
    return voxels.join(mask.where("v > 0").select(*keys), list(keys), "left_semi")


def unpremultiplied(voxels: DataFrame, alpha: int, kind: str = "uint8") -> DataFrame:
    """Each channel divided by the alpha channel (as a share of its range), 0 where alpha is 0; the alpha channel itself is kept."""
    scale = 1.0 if kind in saturate.FLOATS else float(saturate.RANGES[kind][1])
    alphas = voxels.where(F.col("c") == alpha).select(*(k for k in KEYS if k != "c"), F.col("v").alias("_alpha"))
    share = F.col("_alpha") / scale
    value = F.when(F.col("c") == alpha, F.col("v")).when(F.col("_alpha") == 0, F.lit(0)).otherwise(saturate.saturate_cast(F.col("v") / F.when(share != 0, share), kind))
    return voxels.join(alphas, [k for k in KEYS if k != "c"]).withColumn("v", value).drop("_alpha")


def cat(images: Sequence[tuple[DataFrame, Mapping[str, int]]], axis: str) -> tuple[DataFrame, dict[str, int]]:
    """Images (voxels, size) one behind the other on an axis; all other sizes must be equal."""
    if any({k: v for k, v in size.items() if k != axis} != {k: v for k, v in images[0][1].items() if k != axis} for _, size in images):
        raise ValueError("images differ in another axis")
    at, parts = 0, []
    for voxels, size in images:
        parts.append(voxels.withColumn(axis, F.col(axis) + at))
        at += size[axis]
    return functools.reduce(DataFrame.unionByName, parts), {**images[0][1], axis: at}


def interleave(channels: int, c: str = "c", p: str = "position") -> tuple[Column, Column]:
    """Position of voxel p of channel c in interleaved order, and back: (position, channel)."""
    return F.col(p) * channels + F.col(c), F.pmod(F.col(p), F.lit(channels))
