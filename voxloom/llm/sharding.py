"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in logical partitions (a hash of their key). How many rows of each partition go to each shard is drawn exactly: row p of the
matrix is a multivariate hypergeometric draw without replacement from what the shards still have room for. Each partition permutes its
rows and deals them out in those numbers, rows are exchanged, and each shard permutes what it received. Any assignment of rows to places
is then equally likely, and shard sizes differ by one at most.

Two things keep this parallel at any size. The matrix is never built in one place: a task finds its own row by walking down a binary tree
over the partitions, where each node's draw is seeded by the node, so all tasks that pass it draw the same. And shards consist of cells of
known size, which are dealt to and permuted on their own, so that no task holds a whole shard; a cell's first slot follows from its number.

Keys and seeds alone decide the result. Rows of equal keys are told apart by an occurrence number, given out once: rows are written with a
number each, and those whose keys repeat are counted through in that order, by ranges, so that a third of all rows may share their keys. A
lost task reads what was written and deals the same rows to the same cells.

Defined cases: null keys and repeated rows are rows like any other (rows of equal keys lie in places of their own, which of them where is
decided by the order in which they were first read); fewer rows than shards leave shards empty; an empty table gives no rows; columns of the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import looked_up, written
from voxloom.operators.ordering import numbered

#: Rows that a partition and a cell aim at, and the most of either: the driver keeps a number per partition, each task one per cell.
PARTITION_ROWS, CELL_ROWS, MOST_PARTITIONS, MOST_CELLS = 4000, 2000, 16_384, 65_536
#: Populations from here on are beyond NumPy's sampler.
LARGE = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    return rows // shards + (np.arange(shards) < rows % shards)


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """How many of sample draws without replacement are good; inversion over twelve standard deviations where NumPy's sampler ends."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, sample))
    low, high, total = max(0, sample - bad), min(sample, good), good + bad
    centre, spread = sample * (good / total), np.sqrt(sample * (good / total) * (bad / total) * ((total - sample) / (total - 1)))
    low, high = max(low, int(centre - 12 * spread) - 1), min(high, int(centre + 12 * spread) + 1)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    log_p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(log_p - log_p.max())
    return low + int(np.searchsorted(np.cumsum(p) / p.sum(), rng.random()))


def draw(room: np.ndarray, sample: int, rng: np.random.Generator) -> np.ndarray:
    """How many of sample rows go to each column, drawn without replacement from the columns' room."""
    out, left = np.zeros_like(room), int(room.sum())
    for k, own in enumerate(room.tolist()):
        if not sample:
            break
        left -= own
        out[k] = hypergeometric(own, left, sample, rng) if left else sample
        sample -= int(out[k])
    return out


def matrix_row(partition: int, counts: np.ndarray, room: np.ndarray, seed: int) -> np.ndarray:
    """Row of the communication matrix for one partition: the walk from the root to it."""
    low, high, before = 0, len(counts), np.concatenate([[0], np.cumsum(counts)])
    while high - low > 1:
        middle = (low + high) // 2
        left = draw(room, int(before[middle] - before[low]), np.random.default_rng([seed, low, high]))
        low, high, room = (low, middle, left) if partition < middle else (middle, high, room - left)
    return room


def random_key(seed: int, salt: int, keys: list[Column]) -> Column:
    return F.xxhash64(F.lit(seed * 16 + salt), *keys)


def told_apart(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, written, with _copy: 0, or for rows of equal keys their occurrence number from 1."""
    of = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    own = written(rows.withColumns({"_same": F.xxhash64(*of), "_row": F.monotonically_increasing_id()}), "rows")
    repeated = written(own.groupBy("_same").agg(F.count("*").alias("n")).where("n > 1").withColumn("_repeated", F.lit(True)), "repeated")
    if repeated.isEmpty():
        return own.withColumn("_copy", F.lit(0).cast("long")).drop("_same", "_row")
    marked = looked_up(own.select("_same", "_row"), repeated, ["_same"]).where("_repeated").drop("_repeated")
    placed = written(numbered(marked, [F.col("_same"), F.col("_row")], "_place"), "places")
    firsts = written(placed.groupBy("_same").agg(F.min("_place").alias("_first"), F.count("*").alias("n")), "firsts")
    copies = looked_up(placed, firsts, ["_same"]).select("_row", (F.col("_place") - F.col("_first") + 1).alias("_copy"))
    return own.join(copies, "_row", "left").withColumn("_copy", F.coalesce("_copy", F.lit(0))).drop("_same", "_row")


def shuffle_into_shards(rows: DataFrame, keys: list[str], shards: int = 40, seed: int = 0) -> DataFrame:
    """rows with shard (0 to shards - 1) and slot (place in the shard, gapless from 0). keys name the columns that tell rows apart."""
    rows = written(told_apart(rows.drop("shard", "slot"), keys), "told-apart")
    keys = [*keys, "_copy"]
    of = [c for k in keys for c in (rows[k].isNull(), rows[k])]
    total = rows.count()
    partitions = int(min(MOST_PARTITIONS, max(8, total // PARTITION_ROWS)))
    per_shard = int(max(1, min(MOST_CELLS // shards, total // (shards * CELL_ROWS))))
    part = F.pmod(random_key(seed, 0, of), F.lit(partitions)).cast("int")
    counts = np.zeros(partitions, dtype=np.int64)
    for p, n in rows.groupBy(part.alias("part")).count().collect():  # at most MOST_PARTITIONS numbers
        counts[p] = n
    room = np.concatenate([shard_sizes(int(n), per_shard) for n in shard_sizes(total, shards)]).astype(np.int64)
    dealt = rows.withColumns({"_part": part, "_key": random_key(seed, 1, of)}).repartition(partitions, "_part").sortWithinPartitions("_part", "_key", *keys)
    schema = dealt.drop("_key").schema.add("_cell", T.IntegerType())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, dealt_out, ends = -1, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("_part")).to_numpy(zero_copy_only=False)
            cells = np.empty(len(own), dtype=np.int32)
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
            for a, b in zip(edges, edges[1:], strict=False):
                if own[a] != now:
                    now, dealt_out = int(own[a]), 0
                    ends = np.cumsum(matrix_row(now, counts, room, seed))
                cells[a:b] = np.searchsorted(ends, np.arange(dealt_out, dealt_out + b - a), side="right")
                dealt_out += b - a
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_key"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(cells)], [batch.schema.names[i] for i in kept] + ["_cell"])

    out = dealt.mapInArrow(deal, schema)
    size = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    cell = F.col("_cell") % per_shard
    first = cell * F.expr(f"_size div {per_shard}") + F.least(cell, F.col("_size") % per_shard)
    order = Window.partitionBy("_cell").orderBy(random_key(seed, 2, [c for k in keys for c in (F.col(k).isNull(), F.col(k))]), *keys)
    return (
        out.withColumn("shard", F.expr(f"_cell div {per_shard}").cast("int"))
        .withColumn("_size", size)
        .withColumn("slot", (first + F.row_number().over(order) - 1).cast("long"))
        .drop("_cell", "_size", "_part", "_copy")
    )
