"""Chunked images as partitioned parquet: level and time are partition columns, so a region of one level reads only its own files and row groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.aggregate import block_downsample
from voxloom.operators.region import Box, check


def to_chunks(voxels: DataFrame, chunk: Mapping[str, int], level: int = 0, ratio: int = 1) -> DataFrame:
    """A row per brick: image_id, level, ratio, t, c, cz, cy, cx, z0, y0, x0, d, h, w, data (x fastest)."""
    keys = ["image_id", "t", "c"]
    rows = voxels.withColumns({f"c{a}": F.floor(F.col(a) / chunk[a]) for a in "zyx"})
    order = F.sort_array(F.collect_list(F.struct("z", "y", "x", "v")))
    out = rows.groupBy(*keys, "cz", "cy", "cx").agg(*(F.min(a).alias(f"{a}0") for a in "zyx"), *((F.max(a) - F.min(a) + 1).alias(n) for a, n in zip("zyx", "dhw", strict=True)), F.transform(order, lambda e: e["v"]).alias("data"))
    return out.withColumns({"level": F.lit(level), "ratio": F.lit(ratio)})


def to_voxels(chunks: DataFrame) -> DataFrame:
    rows = chunks.select("image_id", "t", "c", "z0", "y0", "x0", "h", "w", F.posexplode("data").alias("p", "v"))
    p = F.col("p").cast("bigint")
    return rows.select("image_id", "t", "c", (F.col("z0") + F.expr("p div (h * w)")).alias("z"), (F.col("y0") + F.expr("(p div w) % h")).alias("y"), (F.col("x0") + p % F.col("w")).alias("x"), "v")


def pyramid(voxels: DataFrame, levels: int, mode: str = "mean") -> list[DataFrame]:
    """The image and its halvings in z, y and x."""
    out = [voxels]
    for _ in range(levels - 1):
        out.append(block_downsample(out[-1], {"z": 2, "y": 2, "x": 2}, mode))
    return out


def write(chunks: DataFrame, path: str, compression: str = "zstd") -> None:
    """Rows are laid out by place, so that row groups have narrow ranges of chunk numbers."""
    ordered = chunks.repartition("level", "t").sortWithinPartitions("level", "t", "image_id", "c", "cz", "cy", "cx")
    ordered.write.mode("overwrite").partitionBy("level", "t").option("compression", compression).parquet(path)


def read(spark: SparkSession, path: str, level: int = 0, box: Box | None = None, columns: list[str] | None = None) -> DataFrame:
    """The chunks of a level that meet the box (base coordinates of that level): comparisons on plain columns, which prune partitions and row groups."""
    chunks = spark.read.parquet(path).where(F.col("level") == level)
    if box:
        check(box)
        size = {"z": "d", "y": "h", "x": "w"}
        for axis, (start, end) in box.items():
            low, extent = (f"{axis}0", F.col(size[axis])) if axis in size else (axis, F.lit(1))
            if end != -1:
                chunks = chunks.where(F.col(low) < end)
            chunks = chunks.where(F.col(low) + extent > start)
    return chunks.select(*columns) if columns else chunks


def read_region(spark: SparkSession, path: str, level: int, box: Box) -> DataFrame:
    """Voxels of the box, coordinates from 0."""
    from voxloom.operators.region import crop

    return crop(to_voxels(read(spark, path, level, box)), box)


def read_block(spark: SparkSession, path: str, level: int, index: int, counts: Mapping[str, int]) -> DataFrame:
    """The chunks of one index (x fastest) in a grid of so many chunks an axis: comparisons on the chunk numbers, which prune row groups."""
    if not 0 <= index < counts["z"] * counts["y"] * counts["x"]:
        raise ValueError(f"no chunk {index}")
    at = {"cx": index % counts["x"], "cy": index // counts["x"] % counts["y"], "cz": index // (counts["x"] * counts["y"])}
    chunks = read(spark, path, level)
    for name, number in at.items():
        chunks = chunks.where(F.col(name) == number)
    return chunks


def thumbnail(voxels: DataFrame, size: Mapping[str, int], most: int) -> DataFrame:
    """The images' mean blocks in y and x, of one side such that neither axis keeps more than most."""
    block = max(1, -(-max(size["y"], size["x"]) // most))
    return block_downsample(voxels, {"y": block, "x": block}, "mean")


def read_sequence(spark: SparkSession, paths: list[str], axis: str, fill: str = "min") -> DataFrame:
    """Images of several files one behind the other on an axis, in natural order of the names; smaller ones are padded with their own least (or greatest) value.

    Sizes are a row per file, and offsets are running sums of them.
    """
    from pyspark.sql import Window

    from voxloom.functions.text import natural_key
    from voxloom.operators.region import AXES

    rows = spark.read.parquet(*paths).withColumn("_file", F.input_file_name())
    own = rows.groupBy("_file").agg(*((F.max(a) + 1).alias(f"n_{a}") for a in AXES), (F.min if fill == "min" else F.max)("v").alias("_fill"))
    order = Window.orderBy(natural_key(F.col("_file")))
    own = own.withColumn("_at", F.sum(f"n_{axis}").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"n_{axis}"))
    most = own.agg(*(F.max(f"n_{a}").alias(f"m_{a}") for a in AXES))
    whole = own.crossJoin(F.broadcast(most))  # one row
    for a in AXES:
        whole = whole.withColumn(a, F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(f"n_{a}") if a == axis else F.col(f"m_{a}")) - 1)))
    out = whole.join(rows.select("_file", *AXES, "v"), ["_file", *AXES], "left")
    return out.select(*((F.col(a) + F.col("_at")).alias(a) if a == axis else F.col(a) for a in AXES), F.coalesce("v", "_fill").alias("v"))
