"""The star-schema test tables seen as images, points, trees, boxes and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def images(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """Voxels (image_id, t, c, z, y, x, v) of 8 x 8 images in uint8, one per embedding; side 4: volumes of 4 x 4 x 4. label is kept."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "label", F.posexplode("embedding").alias("p", "e"))
    level = F.least(F.greatest(F.round((F.col("e").cast("double") + 1) * 127.5), F.lit(0.0)), F.lit(255.0)).cast("bigint")
    z = F.lit(0) if side == 8 else F.expr("p div 16")
    return cells.select(
        "image_id", "label", F.lit(0).cast("bigint").alias("t"), F.lit(0).cast("bigint").alias("c"), z.cast("bigint").alias("z"),
        F.expr(f"(p div {side}) % {side}").cast("bigint").alias("y"), F.expr(f"p % {side}").cast("bigint").alias("x"), level.alias("v"),
    )


def puncta_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of puncta (pid, x, y, z, v): the lines of an order."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pid"), "l_linenumber", F.col("l_suppkey").alias("set_id"), F.col("l_quantity").cast("double").alias("x"),
        F.round(F.col("l_discount") * 100).cast("double").alias("y"), F.round(F.col("l_tax") * 100).cast("double").alias("z"), F.col("l_extendedprice").cast("double").alias("v"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest (id, parent_id, x, y, z, radius): regions, their nations, customers and suppliers. Roots have parent -1."""
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), F.col("r_regionkey").cast("double").alias("x"))
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("id"), F.col("n_regionkey").cast("bigint").alias("parent_id"), F.col("n_nationkey").cast("double").alias("x"))
    customer = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).cast("bigint").alias("id"), (F.col("c_nationkey") + 100).cast("bigint").alias("parent_id"), (F.col("c_acctbal") / 100).alias("x"))
    nodes = region.union(nation).union(customer)
    return nodes.select("id", "parent_id", "x", (F.col("id") % 17).cast("double").alias("y"), (F.col("id") % 5).cast("double").alias("z"), ((F.col("id") % 7) + 1).cast("double").alias("radius"))
