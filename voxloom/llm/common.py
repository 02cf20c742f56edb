"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.storage import shared_dir, written

__all__ = ["arrow", "documents", "looked_up", "shared_dir", "table", "text_of", "written"]

#: A key of more rows than HOT is hot, and HOT_KEYS are the most hot keys that are sent to all tasks.
HOT, HOT_KEYS = 2048, 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id (long) and text (null: empty) of docs, with the named further columns; whatever else docs carries is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"), *more)


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def arrow(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names)


def looked_up(rows: DataFrame, found: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows with the other columns of found (null where it lacks the key), which has one row per key and in n how many of rows share it.

    Hot keys are few: no more than HOT_KEYS keys can have more than the rows' number / HOT_KEYS rows each. Those are sent to all tasks and
    their rows spread at random; the rest is an ordinary join, in which no key is hot. found is read three times: a written table.
    """
    more = [c for c in found.columns if c not in keys and c != n]
    total = found.agg(F.sum(n)).first()[0] or 0
    heavy = found.where(F.col(n) > max(HOT, total // HOT_KEYS)).select(*keys, F.struct(*more).alias("_hot"))
    spread = F.when(F.col("_hot").isNotNull(), 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30))).otherwise(F.lit(0))
    left = rows.join(F.broadcast(heavy), keys, "left").withColumn("_spread", spread.cast("long"))
    light = found.select(*keys, F.struct(*more).alias("_light"), F.lit(0).cast("long").alias("_spread"))
    both = left.join(light, [*keys, "_spread"], "left").withColumn("_found", F.coalesce("_hot", "_light"))
    return both.select(*(F.col(c) for c in rows.columns), *(F.col("_found")[c].alias(c) for c in more))
