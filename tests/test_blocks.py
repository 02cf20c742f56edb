"""Parts of images found block by block: the same across borders, and no table of neighbours on the way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_detection import flood, frame, sized
from voxloom.operators import blocks, graph, threshold, watershed


@pytest.fixture
def wrote(monkeypatch):
    """Rows that the operators write on the way."""
    import voxloom.storage as storage

    rows, plain = [], storage.written

    def counted(df, name):
        out = plain(df, name)
        rows.append(out.count())
        return out

    for module in (blocks, graph, watershed):
        monkeypatch.setattr(module, "written", counted, raising=False)
    return rows


def images(shape, top, seed=1, n=3):
    rng = np.random.default_rng(seed)
    return [rng.integers(0, top, shape) for _ in range(n)] + [np.full(shape, top)]


def found(out, shape, column="label"):
    return {(r.image_id, int(np.ravel_multi_index((r.z, r.y, r.x), shape))): r[column] for r in out.collect()}


@pytest.mark.parametrize(("shape", "top", "limit", "depth", "side"), [((1, 9, 13), 5, 0, 0, 2), ((1, 12, 10), 60, 8, 9, 5), ((4, 5, 6), 40, 4, 5, 2), ((1, 1, 40), 9, 0, 2, 7)])
def test_basins_go_on_across_blocks(spark, monkeypatch, shape, top, limit, depth, side):
    monkeypatch.setattr(blocks, "SIDE", {2: side, 3: side})
    volumes = images(shape, top)
    got = found(watershed.basins(frame(spark, volumes), sized(shape), 0, depth, F.col("v") > limit), shape)
    assert got == {(k, i): label for k, volume in enumerate(volumes) for i, label in flood(volume, limit, depth).items()}


def test_basins_write_no_pairs_of_neighbours(spark, wrote):
    shape = (1, 8, 8)
    volumes = images(shape, 90, n=20)
    got = found(watershed.basins(frame(spark, volumes), sized(shape), 8, 9, F.col("v") > 20), shape)
    assert got == {(k, i): label for k, volume in enumerate(volumes) for i, label in flood(volume, 20, 9).items()}
    assert sum(wrote) <= 21  # a row per image at most


def plateaus(volume, least):
    """1 on plateaus without a higher neighbour, unless they are as low as least."""
    near = list(zip(*np.nonzero(np.ones((3, 3, 3))), strict=True))
    out, seen = np.zeros(volume.shape, int), set()
    for start in np.ndindex(volume.shape):
        if start in seen:
            continue
        own, todo, beaten = {start}, [start], False
        while todo:
            at = todo.pop()
            for d in near:
                p = tuple(int(a + b - 1) for a, b in zip(at, d, strict=True))
                if all(0 <= a < n for a, n in zip(p, volume.shape, strict=True)):
                    beaten |= volume[p] > volume[start]
                    if volume[p] == volume[start] and p not in own:
                        own.add(p)
                        todo.append(p)
        seen |= own
        for p in own:
            out[p] = int(not beaten and volume[start] != least)
    return out.ravel()


@pytest.mark.parametrize(("shape", "side"), [((1, 11, 9), 3), ((4, 5, 3), 2)])
def test_plateaus_and_components_go_on_across_blocks(spark, monkeypatch, shape, side):
    monkeypatch.setattr(blocks, "SIDE", {2: side, 3: side})
    volumes = images(shape, 4)
    voxels = frame(spark, volumes)
    got = found(threshold.regional_extrema(voxels, sized(shape)), shape, "v")
    assert got == {(k, i): v for k, volume in enumerate(volumes) for i, v in enumerate(plateaus(volume, 0))}
    labels = found(graph.voxel_components(voxels, sized(shape), 0, F.col("v") > 2), shape)
    assert labels == {(k, i): label for k, volume in enumerate(volumes) for i, label in flood(volume, 2, 9).items()}


def test_plateaus_write_no_pairs_of_neighbours(spark, wrote):
    shape = (1, 8, 8)
    volumes = images(shape, 4, n=20)
    got = found(threshold.regional_extrema(frame(spark, volumes), sized(shape)), shape, "v")
    assert got == {(k, i): v for k, volume in enumerate(volumes) for i, v in enumerate(plateaus(volume, 0))}
    assert sum(wrote) <= 21


def test_nulls_beat_nothing_and_stay(spark):
    rows = [(1, 0, 0, 0, 0, x, v) for x, v in enumerate([5, None, 7, 7, 9, 2])] + [(1, 0, 0, 0, 0, None, 9)]
    voxels = spark.createDataFrame(rows, "image_id long, t long, c long, z long, y long, x long, v long")
    got = {r.x: r.v for r in threshold.regional_extrema(voxels, {"z": 1, "y": 1, "x": 6}).collect()}
    assert got == {0: 1, 1: None, 2: 0, 3: 0, 4: 1, 5: 0}
    low = {r.x: r.v for r in threshold.regional_extrema(voxels, {"z": 1, "y": 1, "x": 6}, greatest=False).collect()}
    assert low == {0: 1, 1: None, 2: 1, 3: 1, 4: 0, 5: 1}


def test_masks_make_pixels_without_shuffling_them(spark, monkeypatch):
    from voxloom.operators import mesh

    monkeypatch.setattr(mesh, "TILE", 5, raising=False)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for roi in range(6):
        image = np.zeros((40, 40), bool)
        for k in range(5):
            add, kind = bool(rng.integers(0, 3)), ("rect", "ellipse")[k % 2]
            (x0, x1), (y0, y1) = (np.sort(rng.integers(1, 39, 2)) + 0.5 * (k % 2) for _ in range(2))
            rows.append((roi, 0, k // 2, k % 2, add, kind, [{"x": float(x1), "y": float(y0)}, {"x": float(x0), "y": float(y1)}]))
            y, x = np.mgrid[:40, :40]
            if kind == "rect":
                hit = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
            else:
                hit = np.zeros_like(image) if x0 == x1 or y0 == y1 else ((x - (x0 + x1) / 2) / ((x1 - x0) / 2)) ** 2 + ((y - (y0 + y1) / 2) / ((y1 - y0) / 2)) ** 2 <= 1 + 1e-12
            image[hit] = add
        want[roi] = {(int(a), int(b)) for a, b in zip(*np.nonzero(image), strict=True)}
    ops = spark.createDataFrame(rows, "roi_id long, slice long, shape_id long, op_idx long, is_add boolean, type string, pts array<struct<x:double,y:double>>")
    out = mesh.roi_mask(ops)
    got = [(r.roi_id, r.y, r.x) for r in out.collect()]
    assert len(got) == len(set(got)) and {roi: {p[1:] for p in got if p[0] == roi} for roi in want} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.rindex("Generate explode(sequence(greatest(array_min")  # pixels come after the grouping
