"""Sampling between voxels, line enhancement and thinning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.neighborhood import KEYS, lines


def sample_linear(points: DataFrame, voxels: DataFrame, key: str, axes: Sequence[str] = ("z", "y", "x"), by: Sequence[str] = ("image_id",)) -> DataFrame:
    """key, v: values at points between voxels, linear on every axis; null where a corner is missing. Each point meets its corners in one join."""
    rows = points.withColumn("_w", F.lit(1.0))
    for a in axes:
        low, share = F.floor(F.col(a)), F.col(a) - F.floor(F.col(a))
        corner = F.explode(F.when(share == 0, F.array(F.struct(low.alias("at"), F.lit(1.0).alias("w")))).otherwise(F.array(F.struct(low.alias("at"), (1 - share).alias("w")), F.struct((low + 1).alias("at"), share.alias("w")))))
        rows = rows.withColumn("_c", corner).withColumns({f"_{a}": F.col("_c.at"), "_w": F.col("_w") * F.col("_c.w")}).drop("_c")
    cells = voxels.select(*by, *(F.col(a).alias(f"_{a}") for a in axes), F.col("v").alias("_v"))
    return rows.join(cells, [*by, *(f"_{a}" for a in axes)], "left").groupBy(key).agg(F.when(F.sum(F.col("_v").isNull().cast("int")) == 0, F.sum(F.col("_w") * F.col("_v"))).alias("v"))


def cubic_weights(share: float) -> list[float]:
    """Weights of the four samples around a place between the middle two."""
    t = share
    return [(-t + 2 * t * t - t**3) / 2, (2 - 5 * t * t + 3 * t**3) / 2, (t + 4 * t * t - 3 * t**3) / 2, (-t * t + t**3) / 2]


def enhance_lines(voxels: DataFrame) -> DataFrame:
    """v: strength of bright lines in a plane, the negated smaller eigenvalue of the second differences where it is positive; 0 at the border."""
    own = voxels
    for axis, name in (("x", "xx"), ("y", "yy")):
        order = Window.partitionBy(*lines(voxels, axis)).orderBy(axis)
        own = own.withColumns({f"_{name}": F.lag("v").over(order) - 2 * F.col("v") + F.lead("v").over(order), f"_d{axis}": (F.lead("v").over(order) - F.lag("v").over(order)) / 2})
    order = Window.partitionBy(*lines(voxels, "y")).orderBy("y")
    own = own.withColumn("_xy", (F.lead("_dx").over(order) - F.lag("_dx").over(order)) / 2)
    mean, half = (F.col("_xx") + F.col("_yy")) / 2, (F.col("_xx") - F.col("_yy")) / 2
    least = mean - F.sqrt(half * half + F.col("_xy") * F.col("_xy"))
    return own.withColumn("v", F.greatest(F.coalesce(-least, F.lit(0.0)), F.lit(0.0))).select(*voxels.columns)


def thinned_plane(plane: np.ndarray) -> np.ndarray:
    """Thins a binary plane to lines of one voxel: border voxels go in two alternating passes as long as that keeps the shape connected."""
    p = np.pad(plane.astype(bool), 1)
    while True:
        before = p.copy()
        for first in (True, False):
            n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
            ring = np.stack([n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]]).astype(np.int8)
            count = ring.sum(axis=0)
            rises = ((np.roll(ring, -1, axis=0) == 1) & (ring == 0)).sum(axis=0)
            open_ = ~(n & e & s) & ~(e & s & w) if first else ~(n & e & w) & ~(n & s & w)
            gone = p[1:-1, 1:-1] & (count >= 2) & (count <= 6) & (rises == 1) & open_
            p[1:-1, 1:-1] &= ~gone
        if (p == before).all():
            return p[1:-1, 1:-1]


def thin(voxels: DataFrame) -> DataFrame:
    """Binary images thinned, a plane in a task."""
    keys = [k for k in KEYS if k in voxels.columns]
    groups = [k for k in keys if k not in ("y", "x")]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        plane = np.zeros((int(own["y"].max()) + 1, int(own["x"].max()) + 1), dtype=bool)
        plane[own["y"], own["x"]] = own["v"] > 0
        return own.assign(v=thinned_plane(plane)[own["y"], own["x"]].astype("int64"))[[*keys, "v"]]

    return voxels.select(*keys, "v").groupBy(*groups).applyInPandas(run, ", ".join(f"{k} long" for k in keys) + ", v long")
