"""Multi-scale volumes in sharded files: raw chunks by compressed Morton code, packed into shard files with two levels of index.

A shard file begins with the places of its minishard indices, then come the chunks, then the indices: for each minishard the chunk numbers,
starts and sizes, as differences. Which shard and minishard hold a chunk follows from a hash of its number, so a box knows its shards, and a
read touches those files alone, and of them the indices and the chunks that it needs, by byte ranges. Tasks are shards: a shard is made in
the memory of one task, and the number of shard bits sets its size. Files go through the file systems that Arrow knows.
"""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.geometry import morton
from voxloom.functions.hashing import murmur3_128
from voxloom.storage import written


@dataclass(frozen=True)
class Sharding:
    """How chunk numbers are spread: bits left out, bits of the minishard, bits of the shard, hash (identity or murmurhash3_x86_128), encodings (raw or gzip)."""

    preshift_bits: int = 0
    minishard_bits: int = 2
    shard_bits: int = 3
    hash: str = "murmurhash3_x86_128"
    minishard_index_encoding: str = "gzip"
    data_encoding: str = "raw"

    def file(self, shard: int) -> str:
        return f"{shard:0{-(-self.shard_bits // 4)}x}.shard"


@dataclass(frozen=True)
class Volume:
    """One scale: voxels and chunk voxels an axis, NumPy type of a voxel, sharding."""

    size: Mapping[str, int]
    chunk: Mapping[str, int]
    dtype: str
    sharding: Sharding

    def grid(self) -> dict[str, int]:
        return {a: -(-self.size[a] // self.chunk[a]) for a in "xyz"}

    def extent(self, axis: str, index: int) -> int:
        """Voxels of a chunk on an axis; the last one ends with the volume."""
        return min(self.chunk[axis], self.size[axis] - index * self.chunk[axis])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a lost task leaves no half of it."""
    system, own = opened(path)
    system.create_dir(own.rsplit("/", 1)[0])
    part = f"{own}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, own)


def chunk_number(volume: Volume) -> Column:
    grid = volume.grid()
    return morton([F.col(f"c{a}") for a in "xyz"], [(grid[a] - 1).bit_length() for a in "xyz"]) if max(grid.values()) > 1 else F.lit(0).cast("long")


def located(rows: DataFrame, volume: Volume) -> DataFrame:
    """rows (cz, cy, cx) with their chunk number, shard and minishard."""
    s = volume.sharding
    key = F.shiftrightunsigned(F.col("number"), s.preshift_bits)
    key = murmur3_128(key) if s.hash == "murmurhash3_x86_128" else key
    part = lambda low, n: F.shiftrightunsigned(key, low).bitwiseAND(F.lit((1 << n) - 1))
    return rows.withColumn("number", chunk_number(volume)).withColumns({"minishard": part(0, s.minishard_bits), "shard": part(s.minishard_bits, s.shard_bits)})


def packed(minishards: Mapping[int, list[tuple[int, bytes]]], sharding: Sharding) -> bytes:
    """A shard file of chunks (number, payload) by minishard, in ascending order of numbers."""
    squeeze = {"raw": bytes, "gzip": lambda x: gzip.compress(x, mtime=0)}
    data, indices, at = [], {}, 0
    for minishard, chunks in minishards.items():
        payloads = [squeeze[sharding.data_encoding](x) for _, x in chunks]
        index = np.zeros((3, len(chunks)), dtype="<u8")
        numbers = np.array([n for n, _ in chunks], dtype=np.uint64)
        index[0] = np.diff(numbers, prepend=np.uint64(0))
        index[1, 0], index[2] = at, [len(x) for x in payloads]  # each chunk begins where the one before ends
        indices[minishard] = squeeze[sharding.minishard_index_encoding](index.tobytes())
        data += payloads
        at += sum(map(len, payloads))
    places = np.zeros((1 << sharding.minishard_bits, 2), dtype="<u8")
    for minishard, index in indices.items():
        places[minishard] = at, at + len(index)
        at += len(index)
    return b"".join([places.tobytes(), *data, *indices.values()])


def write_volume(chunks: DataFrame, path: str, volume: Volume) -> DataFrame:
    """Writes chunks (cz, cy, cx, data: array, x fastest) as shard files beside an info file; a row per shard: shard, chunks, bytes."""
    sharding, dtype = volume.sharding, np.dtype(volume.dtype).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True))
        for shard, group in groupby(rows, key=lambda row: row[0]):
            own: dict[int, list[tuple[int, bytes]]] = {}
            for _, minishard, number, data in group:
                own.setdefault(minishard, []).append((number, data.values.to_numpy(zero_copy_only=False).astype(dtype).tobytes()))
            file = packed(own, sharding)
            put(f"{path}/{sharding.file(shard)}", file)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, sum(map(len, own.values())), len(file))], ["shard", "chunks", "bytes"])

    info = {"size": dict(volume.size), "chunk": dict(volume.chunk), "dtype": volume.dtype, "sharding": asdict(sharding)}
    put(f"{path}/info", json.dumps(info).encode())
    dealt = located(chunks, volume).select("shard", "minishard", "number", "data").repartition("shard").sortWithinPartitions("shard", "minishard", "number")
    return written(dealt.mapInArrow(run, "shard long, chunks long, bytes long"), "shards")


def read_info(path: str) -> Volume:
    system, own = opened(path)
    with system.open_input_stream(f"{own}/info") as file:
        info = json.loads(file.read())
    return Volume(info["size"], info["chunk"], info["dtype"], Sharding(**info["sharding"]))


def chunks_of(spark: SparkSession, volume: Volume, box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """cz, cy, cx, number, minishard, shard of the chunks that meet a box (half-open; -1: to the end)."""
    span = {a: (s // volume.chunk[a], -(-min(volume.size[a], volume.size[a] if e == -1 else e) // volume.chunk[a])) for a, (s, e) in ({a: (0, -1) for a in "zyx"} | dict(box)).items()}
    n = {a: max(0, high - low) for a, (low, high) in span.items()}
    i = F.col("id")
    rows = spark.range(n["z"] * n["y"] * n["x"]).select(
        (F.floor(i / (n["y"] * n["x"] or 1)) + span["z"][0]).alias("cz"), (F.floor(i / (n["x"] or 1)) % (n["y"] or 1) + span["y"][0]).alias("cy"), (i % (n["x"] or 1) + span["x"][0]).alias("cx")
    )
    return located(rows, volume)


def read_chunks(spark: SparkSession, path: str, box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """cz, cy, cx, data (array of doubles or longs, x fastest) of the stored chunks that meet a box."""
    volume = read_info(path)
    sharding, dtype = volume.sharding, np.dtype(volume.dtype).newbyteorder("<")
    kind, arrow = ("double", pa.float64()) if dtype.kind == "f" else ("long", pa.int64())
    open_up = {"raw": bytes, "gzip": gzip.decompress}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for shard, group in groupby(rows, key=lambda row: row[0]):
            system, own = opened(f"{path}/{sharding.file(shard)}")
            if system.get_file_info(own).type == fs.FileType.NotFound:
                continue
            with system.open_input_file(own) as file:
                head = 16 << sharding.minishard_bits
                places = np.frombuffer(file.read_at(head, 0), dtype="<u8").reshape(-1, 2)
                for minishard, chunks in groupby(group, key=lambda row: row[1]):
                    start, end = map(int, places[minishard])
                    if start == end:
                        continue
                    index = np.frombuffer(open_up[sharding.minishard_index_encoding](file.read_at(end - start, head + start)), dtype="<u8").reshape(3, -1)
                    sizes = index[2]
                    numbers, starts = np.cumsum(index[0]), np.cumsum(index[1]) + np.cumsum(sizes) - sizes
                    found = {int(n): k for k, n in enumerate(numbers)}
                    for _, _, number, cz, cy, cx in chunks:
                        if number in found:
                            k = found[number]
                            data = np.frombuffer(open_up[sharding.data_encoding](file.read_at(int(sizes[k]), head + int(starts[k]))), dtype=dtype)
                            columns = [pa.array([x], pa.int64()) for x in (cz, cy, cx)]
                            yield pa.RecordBatch.from_arrays([*columns, pa.array([data.tolist()], pa.list_(arrow))], ["cz", "cy", "cx", "data"])

    asked = chunks_of(spark, volume, box).select("shard", "minishard", "number", "cz", "cy", "cx")
    return asked.repartition("shard").sortWithinPartitions("shard", "minishard", "number").mapInArrow(run, f"cz long, cy long, cx long, data array<{kind}>")


def read_box(spark: SparkSession, path: str, box: Mapping[str, tuple[int, int]]) -> DataFrame:
    """z, y, x, v of the voxels in a box; chunks that are not stored have none."""
    volume = read_info(path)
    rows = read_chunks(spark, path, box)
    for a, n in zip("zyx", ("_d", "_h", "_w"), strict=True):
        rows = rows.withColumn(n, F.least(F.lit(volume.chunk[a]), F.lit(volume.size[a]) - F.col(f"c{a}") * volume.chunk[a]))
    rows = rows.select("cz", "cy", "cx", "_h", "_w", F.posexplode("data").alias("p", "v"))
    at = {"z": F.expr("p div (_h * _w)"), "y": F.expr("(p div _w) % _h"), "x": F.expr("p % _w")}
    rows = rows.select(*((F.col(f"c{a}") * volume.chunk[a] + at[a]).cast("long").alias(a) for a in "zyx"), "v")
    for a, (start, end) in box.items():
        rows = rows.where((F.col(a) >= start) & (F.lit(end == -1) | (F.col(a) < end)))
    return rows
