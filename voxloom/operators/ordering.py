"""Places and running sums over a whole table, by ranges of its order: no task sees more than its range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.storage import written

#: Rows of a range.
ROWS = 500_000


def ranged(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """rows, written, with _part: ascending ranges of the order. Rows that are equal in it share a range."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
    return written(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def running(rows: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to each row in the order, which must tell rows apart."""
    own = ranged(rows.withColumn(name, value), order)
    parts = own.groupBy("_part").agg(F.sum(name).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.join(parts, "_part").withColumn(name, F.sum(name).over(within) + F.col("_before")).drop("_part", "_before")


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 1."""
    return running(rows, order, F.lit(1).cast("bigint"), name)
