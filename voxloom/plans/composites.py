"""Jobs made of several operators: detection of puncta, stitching of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators import aggregate, graph, matching, watershed


def detect_puncta(voxels: DataFrame, size: dict[str, int], limit: float, least: int = 1, connectivity: int = 0, depth: float | None = None) -> DataFrame:
    """image_id, t, c, label and the statistics of every component above limit with at least so many voxels; with a depth, of every part that a watershed cuts them into."""
    front = F.col("v") > limit
    labelled = graph.voxel_components(voxels, size, connectivity, front) if depth is None else watershed.basins(voxels, size, connectivity, depth, front)
    return aggregate.puncta(labelled, ["image_id", "t", "c", "label"]).where(F.col("vol_size") >= least)


def without_overlaps(puncta: DataFrame, by: list[str], share: float) -> DataFrame:
    """puncta without those that a heavier one of the same group covers by more than a share of their radius (ties: the lower label stays)."""
    a = puncta.select(*by, "label", "x", "y", "z", "radius", "mass")
    b = puncta.select(*by, *(F.col(k).alias(f"o_{k}") for k in ("label", "x", "y", "z", "radius", "mass")))
    reach = puncta.agg(F.max("radius")).first()[0] or 1.0
    cell = float(max(reach, 1e-6) * 2)
    for k in "xyz":
        a = a.withColumn(f"_{k}", F.floor(F.col(k) / cell))
        b = b.withColumn(f"_{k}", F.explode(F.sequence(F.floor((F.col(f"o_{k}") - cell) / cell), F.floor((F.col(f"o_{k}") + cell) / cell))))
    gap = F.sqrt(sum(((F.col(k) - F.col(f"o_{k}")) * (F.col(k) - F.col(f"o_{k}")) for k in "xyz"), F.lit(0.0)))
    heavier = F.struct(F.col("o_mass"), -F.col("o_label")) > F.struct(F.col("mass"), -F.col("label"))
    covered = a.join(b, [*by, "_x", "_y", "_z"]).where(heavier & (F.col("o_radius") + F.col("radius") - gap > share * F.col("radius")))
    return puncta.join(covered.select(*by, "label").distinct(), [*by, "label"], "left_anti")


def pair_offsets(tiles: DataFrame, pairs: DataFrame, reach: tuple[int, int, int], least: int) -> DataFrame:
    """a, b, dz, dy, dx, cost: for every pair of tiles with an expected offset (a, b, ez, ey, ex) the one within reach of it that correlates best; cost is 1 - ncc.

    All pairs and offsets are one grouped correlation; a pair's voxels meet only at the offsets tried.
    """
    near = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{k}") for k, v in zip("zyx", d, strict=True))) for d in [(z, y, x) for z in range(-reach[0], reach[0] + 1) for y in range(-reach[1], reach[1] + 1) for x in range(-reach[2], reach[2] + 1)]))).alias("d")
    moves = pairs.select("a", "b", "ez", "ey", "ex", near).select("a", "b", *((F.col(f"e{k}") + F.col(f"d.d{k}")).alias(f"d{k}") for k in "zyx"))
    right = moves.join(tiles.withColumnRenamed("tile_id", "b"), "b").select("a", "b", "dz", "dy", "dx", *((F.col(k) + F.col(f"d{k}")).alias(k) for k in "zyx"), F.col("v").alias("_b"))
    both = right.join(tiles.withColumnRenamed("tile_id", "a"), ["a", "z", "y", "x"])
    scored = both.groupBy("a", "b", "dz", "dy", "dx").agg(F.count("*").alias("n"), F.corr(F.col("v").cast("double"), F.col("_b").cast("double")).alias("ncc")).where((F.col("n") >= least) & F.col("ncc").isNotNull() & ~F.isnan("ncc"))
    best = F.max_by(F.struct("dz", "dy", "dx"), F.struct("ncc", -F.col("dz"), -F.col("dy"), -F.col("dx")))
    return scored.groupBy("a", "b").agg(best.alias("m"), (1 - F.max("ncc")).alias("cost")).select("a", "b", "m.dz", "m.dy", "m.dx", "cost")


def stitch(tiles: DataFrame, pairs: DataFrame, reach: tuple[int, int, int], least: int, anchor: int, mode: str = "mean") -> DataFrame:
    """One image of the tiles, placed along the most reliable pairwise offsets."""
    places = matching.resolve_offsets(pair_offsets(tiles, pairs, reach, least), anchor)
    table = tiles.sparkSession.createDataFrame([(k, *map(int, p)) for k, p in sorted(places.items())], "tile_id long, oz long, oy long, ox long")
    return matching.merge_tiles(tiles, F.broadcast(table), mode)
