"""Watershed: blobs cut where their brightness falls between peaks.

A flood from above takes the voxels in order of brightness (ties: the smaller number, x fastest) and gives each the basin of its first
taken neighbour, the brightest one; a voxel without any begins a basin. So every voxel points to its brightest brighter neighbour, and a
voxel's basin is where its pointers end. They are followed within blocks; where they leave one, those of the voxels at borders double their
length each round, which takes a few rounds whatever the size of a blob.

Basins are many where brightness is noisy or flat. Two that touch are one if the lower peak rises no more than depth above the highest way
between them (a plateau is always one), and so are basins joined by others: within a block at once, across borders as components of a table
with a row per pair of touching basins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.storage import written


def ends(up: DataFrame) -> DataFrame:
    """id, root: where the pointers (id, up) of a forest end."""
    now = written(up, "pointers")
    while True:
        twice = now.join(now.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up"), (F.col("up") != F.col("_next")).alias("moved"))
        now = written(twice, "pointers")
        if now.where("moved").isEmpty():
            return now.select("id", F.col("up").alias("root"))
        now = now.select("id", "up")


def basins(voxels: DataFrame, size: dict[str, int], connectivity: int = 0, depth: float = 0.0, predicate: Column | None = None) -> DataFrame:
    """The foreground voxels with label: basins of each (image, t, c), numbered from 1 in the order of their first voxel (x fastest)."""
    front = voxels.where(F.col("v") > 0 if predicate is None else predicate).drop("label")
    return blocks.parts(front, size, connectivity, "basins", depth=depth).drop("_lost")
