"""Sharded volumes: the hash against a plain version, round trips, and reads that touch their shards only."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import hashing
from voxloom.sources import chunks, precomputed


def murmur(n):
    """The hash of eight bytes in plain integers."""
    m = 0xFFFFFFFF
    turn = lambda x, r: (x << r | x >> 32 - r) & m

    def mix(h):
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * by & m
        return h

    h = [turn((n & m) * 0x239B961B & m, 15) * 0xAB0E9789 & m ^ 8, turn((n >> 32) * 0xAB0E9789 & m, 16) * 0x38B34AE5 & m ^ 8, 8, 8]
    for _ in range(2):
        h[0] = sum(h) & m
        h[1:] = [(h[0] + x) & m for x in h[1:]]
        if _ == 0:
            h = [mix(x) for x in h]
    return h[0] | h[1] << 32


def test_murmur(spark):
    rng = random.Random(1)
    numbers = [0, 1, 2**32 - 1, 2**32, 2**63 - 1, *(rng.randrange(2**63) for _ in range(200))]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    assert [r[0] % 2**64 for r in df.select(hashing.murmur3_128(F.col("n"))).collect()] == [murmur(n) for n in numbers]


@pytest.mark.parametrize(("encoding", "how", "dtype"), [("raw", "identity", "uint16"), ("gzip", "murmurhash3_x86_128", "float32")])
def test_round_trip_reads_its_shards_only(spark, tmp_path, encoding, how, dtype):
    rng = np.random.default_rng(2)
    z, y, x = shape = (11, 9, 14)
    image = (rng.integers(0, 60_000, shape) / (4 if dtype == "float32" else 1)).astype(dtype)
    image[:4, :4, :4] = 0
    rows = [(0, 0, 0, *map(int, at), v.item()) for at, v in np.ndenumerate(image) if max(at) >= 4]  # the first chunk is not stored
    voxels = spark.createDataFrame(rows, f"image_id long, t long, c long, z long, y long, x long, v {'double' if dtype == 'float32' else 'long'}")
    volume = precomputed.Volume({"z": z, "y": y, "x": x}, {"z": 4, "y": 4, "x": 4}, dtype, precomputed.Sharding(1, 1, 3, how, encoding, encoding))
    path = f"{tmp_path}/volume"
    done = precomputed.write_volume(chunks.to_chunks(voxels, volume.chunk), path, volume).collect()
    assert sum(r.chunks for r in done) == 3 * 3 * 4 - 1 and all(os.path.getsize(f"{path}/{volume.sharding.file(r.shard)}") == r.bytes for r in done)
    assert precomputed.read_info(path) == volume
    got = {(r.z, r.y, r.x): r.v for r in precomputed.read_box(spark, path, {}).collect()}
    assert got == {at: v.item() for at, v in np.ndenumerate(image) if max(at) >= 4}
    box = {"z": (4, 7), "y": (2, 5), "x": (9, -1)}
    needed = {r.shard for r in precomputed.chunks_of(spark, volume, box).select("shard").distinct().collect()}
    for r in done:
        if r.shard not in needed:
            os.remove(f"{path}/{volume.sharding.file(r.shard)}")
    assert len(needed) < len(done)
    got = {(r.z, r.y, r.x): r.v for r in precomputed.read_box(spark, path, box).collect()}
    assert got == {(a, b, c): image[a, b, c].item() for a in range(4, 7) for b in range(2, 5) for c in range(9, x)}
    assert precomputed.read_box(spark, path, {"z": (40, 50)}).count() == 0
