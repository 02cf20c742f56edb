"""Watershed and ellipse overlap against plain versions; joins along one line at the size of a range."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators import joins, matching, watershed
from voxloom.plans import composites


def flood(volume, limit, depth):
    """Labels by a priority flood from above, then by joining shallow basins; volume: z, y, x."""
    near = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]
    order = sorted((-int(v), i) for i, v in enumerate(volume.ravel()) if v > limit)
    basin, rank = {}, {i: k for k, (_, i) in enumerate(order)}
    shape, flat = volume.shape, volume.ravel()

    def around(i):
        at = np.unravel_index(i, shape)
        for d in near:
            p = [a + b for a, b in zip(at, d, strict=True)]
            if all(0 <= a < n for a, n in zip(p, shape, strict=True)):
                yield int(np.ravel_multi_index(p, shape))

    for _, i in order:
        taken = [j for j in around(i) if j in basin]
        basin[i] = basin[min(taken, key=rank.get)] if taken else i
    label = {b: b for b in basin.values()}
    saddle = {}
    for i in basin:
        for j in around(i):
            if j in basin and basin[i] != basin[j]:
                k = (basin[i], basin[j])
                saddle[k] = max(saddle.get(k, 0), min(flat[i], flat[j]))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for (a, b), s in saddle.items():
        if min(flat[a], flat[b]) - s <= depth:
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    found, numbers = {}, {}
    for i in sorted(basin):
        found[i] = numbers.setdefault(find(basin[i]), len(numbers) + 1)
    return found


def frame(spark, volumes):
    rows = [(k, 0, 0, *(int(a) for a in at), int(v)) for k, volume in enumerate(volumes) for at, v in np.ndenumerate(volume)]
    return spark.createDataFrame(rows, "image_id long, t long, c long, z long, y long, x long, v long")


def sized(shape):
    return dict(zip("tczyx", (1, 1, *shape), strict=True))


@pytest.mark.parametrize(("shape", "top", "limit", "depth"), [((1, 12, 14), 5, 1, 0), ((5, 6, 7), 40, 8, 3)])
def test_basins_equal_a_priority_flood(spark, shape, top, limit, depth):
    rng = np.random.default_rng(top)
    volumes = [rng.integers(0, top, shape) for _ in range(3)] + [np.full(shape, top), np.zeros(shape, dtype=int)]
    out = watershed.basins(frame(spark, volumes), sized(shape), 0, depth, F.col("v") > limit)
    got = {(r.image_id, int(np.ravel_multi_index((r.z, r.y, r.x), shape))): r.label for r in out.collect()}
    assert got == {(k, i): label for k, volume in enumerate(volumes) for i, label in flood(volume, limit, depth).items()}
    assert watershed.basins(frame(spark, volumes).where("false"), sized(shape)).count() == 0


def test_touching_blobs_are_split(spark):
    """Two round blobs that touch are one component and two puncta."""
    y, x = np.mgrid[:20, :40]
    image = np.maximum(*(np.clip(200 - 4 * ((y - 10) ** 2 + (x - c) ** 2), 0, 255) for c in (13, 24)))
    voxels = frame(spark, [image[None]])
    size = sized((1, 20, 40))
    assert composites.detect_puncta(voxels, size, 50).count() == 1
    two = sorted((round(r.x), round(r.y)) for r in composites.detect_puncta(voxels, size, 50, depth=20).collect())
    assert two == [(13, 10), (24, 10)]
    assert composites.detect_puncta(voxels, size, 50, depth=200).count() == 1


def test_ellipse_overlap(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        pair = []
        for _ in range(2):
            a, b, c = rng.uniform(0.5, 2), rng.uniform(0.5, 2), rng.uniform(-0.9, 0.9)
            pair += [rng.uniform(0, 4), rng.uniform(0, 4), a * a, a * b * c, b * b]
        rows.append(pair)
    rows += [[0.0, 0.0, 1.0, 0.0, 1.0, 9.0, 0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0], [0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0, 0.0, 0.0, 0.0]]
    k = geometry.confidence_radius(0.6)
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(10)))
    got = [r[0] for r in df.select(geometry.ellipse_overlap([F.col(f"c{i}") for i in range(5)], [F.col(f"c{i}") for i in range(5, 10)], k)).collect()]
    py, px = np.mgrid[-6:10:1601j, -6:10:1601j]

    def inside(e, x, y):
        dx, dy, det = x - e[0], y - e[1], e[2] * e[4] - e[3] ** 2
        return e[4] * dx * dx - 2 * e[3] * dx * dy + e[2] * dy * dy <= k * k * det

    for row, value in zip(rows[:60], got, strict=False):
        a, b = row[:5], row[5:]
        if inside(a, b[0], b[1]) or inside(b, a[0], a[1]):
            assert value == 1.0
        else:
            one, other = inside(a, px, py), inside(b, px, py)
            assert value == pytest.approx((one & other).sum() / min(one.sum(), other.sum()), abs=0.01)
    assert got[60:] == [0.0, 1.0, 0.0]


def test_nearest_of_many_rows_in_one_range(spark):
    """200,000 rows in one range: a frame that is worked out anew for each row would take minutes."""
    left = spark.range(200_000).selectExpr("id AS k", "pmod(xxhash64(id), 1000000) / 7.0 AS a")
    right = spark.range(500).selectExpr("id AS t", "pmod(xxhash64(id + 900000), 1000000) / 7.0 AS b")
    got = joins.nearest(left, right, "k", "t", "a", "b").select(F.sum("gap"), F.count("nearest")).first()
    ends = np.sort(np.array([r.b for r in right.collect()]))
    values = np.array([r.a for r in left.collect()])
    at = np.clip(np.searchsorted(ends, values), 1, len(ends) - 1)
    assert got[1] == 200_000 and got[0] == pytest.approx(np.minimum(np.abs(values - ends[at - 1]), np.abs(values - ends[at])).sum())
    probes = left.selectExpr("0 AS g", "k", "a AS time")
    found = joins.as_of(probes, right.selectExpr("0 AS g", "b AS time", "cast(t AS double) AS value"), ["g"], "time", "value")
    assert found.where("t0 > time OR t1 <= time").count() == 0 and found.where("t0 IS NULL").count() == int((values < ends[0]).sum())


def test_missing_and_broken_sources_are_told_apart(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from voxloom.sources import readers
    from voxloom.streaming.progressive import Session

    (tmp_path / "a.xyz").write_text("no numbers here\n")
    with pytest.raises(ValueError, match="no reader for"):
        readers.read(spark, f"{tmp_path}/a.xyz")
    with pytest.raises(ValueError, match="unknown extension"):
        readers.read(spark, f"{tmp_path}/a.unknown")
    with pytest.raises(AnalysisException):
        readers.read(spark, f"{tmp_path}/missing.parquet")
    session = Session(spark, f"{tmp_path}/session", {"core": 16})
    assert session.load() == (0, {}, {})
    session.commit({"nodes": spark.range(3).toDF("id")}, {"index": 7})
    second = session.commit({"nodes": spark.range(5).toDF("id")}, {"index": 8})
    assert session.load()[1]["nodes"].count() == 5
    (tmp_path / "session" / "tables").rename(tmp_path / "moved")
    assert session.load() == (0, {}, {}) and second == 2


def test_pairs_of_branches_equal_enumeration(spark):
    rng = random.Random(11)
    rows, want = [], {}

    def pairings(names):
        if len(names) < 2:
            yield ()
            return
        if len(names) % 2:
            for k in range(len(names)):
                yield from pairings(names[:k] + names[k + 1 :])
            return
        for k in range(1, len(names)):
            for rest in pairings(names[1:k] + names[k + 1 :]):
                yield ((names[0], names[k]), *rest)

    for g in range(12):
        n = rng.randint(2, 7)
        cost = {(a, b): rng.randint(0, 9) for a in range(n) for b in range(a + 1, n)}
        rows += [(g, a, b, c) for (a, b), c in cost.items()]
        want[g] = min((sum(cost[p] for p in x), tuple(sorted(x))) for x in pairings(list(range(n))))
    out = matching.pair_branches(spark.createDataFrame(rows, "g long, a long, b long, cost long"), "g").collect()
    for g, (total, pairs) in want.items():
        own = [r for r in out if r.g == g]
        assert sum(r.cost for r in own) == total and tuple(sorted((r.a, r.b) for r in own)) == pairs
    lonely = spark.createDataFrame([(1, i, 99, 1) for i in range(1, 22)], "g long, a long, b long, cost long")
    with pytest.raises(Exception, match="junction of 22"):
        matching.pair_branches(lonely, "g").collect()


def test_drawn_centres_find_separate_clusters(spark):
    rng = np.random.default_rng(12)
    middles = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [30.0, 30.0]])
    points = np.concatenate([m + rng.normal(size=(50, 2)) for m in middles])
    rows = spark.createDataFrame([(p.tolist(), 1.0) for p in points], "v array<double>, w double")
    centres, total = matching.best_k_means(rows, "v", 4, attempts=3, seed=5)
    near = np.abs(np.array(centres)[:, None] - middles[None]).sum(axis=2)
    assert sorted(near.argmin(axis=1)) == [0, 1, 2, 3] and near.min(axis=1).max() < 1
    assert total == pytest.approx(((points[:, None] - np.array(centres)) ** 2).sum(axis=2).min(axis=1).sum())
    assert matching.plus_plus_centres(rows, "v", 4, 5) == matching.plus_plus_centres(rows.repartition(5), "v", 4, 5)
    assert len(matching.plus_plus_centres(rows.where("v[0] > 29").limit(1), "v", 4)) == 1
    assert matching.best_k_means(rows.where("false"), "v", 4) == ([], float("inf"))
