"""Operators on small fixtures with known results."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import geometry, saturate, text
from voxloom.functions.units import unit_factor
from voxloom.operators import aggregate, graph, joins, matching, mesh, neighborhood, region, sampling, threshold, tree, voxel
from voxloom.plans import composites, levels
from voxloom.sources import chunks, readers
from voxloom.sources import text as sources
from voxloom.streaming import progressive

SIZE = {"t": 1, "c": 1, "z": 1, "y": 10, "x": 10}


def image(spark, plane):
    rows = [(0, 0, 0, 0, y, x, int(v)) for (y, x), v in np.ndenumerate(np.asarray(plane))]
    return spark.createDataFrame(rows, "image_id long, t long, c long, z long, y long, x long, v long")


def plane_of(df, shape=(10, 10)):
    out = np.full(shape, -1.0)
    for r in df.select("y", "x", "v").collect():
        out[r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def img10(spark):
    p = np.full((10, 10), 10)
    p[1:4, 1:4], p[5:8, 5:8] = 22, 33
    p[6, 1], p[7, 2], p[8, 3] = 44, 45, 44
    return p, image(spark, p)


def test_thresholds_and_regional_extrema(spark, img10):
    p, img = img10
    assert voxel.threshold(img, 33, "above", True, 33).agg(F.max("v")).first()[0] == 33
    assert voxel.threshold(img, 33, "below", True, 33).agg(F.min("v")).first()[0] == 33
    want = np.zeros((10, 10))
    want[1:4, 1:4] = want[5:8, 5:8] = want[7, 2] = 1
    assert (plane_of(threshold.regional_extrema(img, SIZE)) == want).all()
    low = np.full((10, 10), 10)
    low[1:4, 1:4], low[5:8, 5:8] = 2, 7
    want[7, 2] = 0
    assert (plane_of(threshold.regional_extrema(image(spark, low), SIZE, greatest=False)) == want).all()
    assert plane_of(voxel.with_scalar(img, "+", 5)).sum() == p.sum() + 500 and plane_of(voxel.with_scalar(img, "*", 5.5)).max() == round(45 * 5.5)


def test_components_are_numbered_in_scan_order(spark, img10):
    p, img = img10
    got = graph.voxel_components(img, SIZE, 8, F.col("v") > 20).groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()
    assert [(x.label, x.n) for x in got] == [(1, 9), (2, 9), (3, 3)]
    assert graph.voxel_components(img, SIZE, 4, F.col("v") > 40).select("label").distinct().count() == 3
    assert aggregate.remove_small(graph.voxel_components(img, SIZE, 8, F.col("v") > 20), 3).count() == 18
    assert aggregate.remove_small(img.withColumn("label", F.lit(1)), 0).count() == 0


def test_holes_and_distances(spark):
    ring = np.zeros((10, 10), int)
    ring[2:7, 2:7] = 1
    ring[4, 4] = 0
    filled = plane_of(threshold.fill_holes(image(spark, ring), SIZE))
    assert filled[4, 4] == 1 and filled.sum() == 25 and filled[0, 0] == 0
    d = plane_of(neighborhood.squared_distances(image(spark, ring), axes=("x", "y")))
    zeros = np.argwhere(ring == 0)
    assert all(d[y, x] == ((zeros - (y, x)) ** 2).sum(axis=1).min() for y in range(10) for x in range(10))


SAT_INT = ["uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64"]


@pytest.mark.parametrize("kind", SAT_INT)
def test_saturating_arithmetic_at_the_bounds(spark, kind):
    low, high = saturate.RANGES[kind]
    values = sorted({low, low + 1, -1 if low < 0 else 0, 0, 1, 2, 3, high // 2, high - 1, high})
    rows = [(str(a), str(b)) for a, b in itertools.product(values, values)]
    df = spark.createDataFrame(rows, "a string, b string").select(F.col("a").cast("decimal(20,0)").alias("a"), F.col("b").cast("decimal(20,0)").alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = {"add": saturate.add, "sub": saturate.sub, "mul": saturate.mul, "div": saturate.div, "secure": saturate.div_secure}

    def want(op, x, y):
        if op == "div" or op == "secure":
            if y == 0:
                return 0 if op == "secure" or x == 0 else (high if x > 0 else low)
            value = abs(x) // abs(y) * (1 if (x < 0) == (y < 0) else -1)
        else:
            value = {"add": x + y, "sub": x - y, "mul": x * y}[op]
        return min(max(value, low), high)

    for r in df.select("a", "b", *(f(a, b, kind).cast("decimal(20,0)").alias(n) for n, f in ops.items())).collect():
        for op in ops:
            assert int(r[op]) == want(op, int(r.a), int(r.b)), (op, r.a, r.b)


def test_saturating_casts(spark):
    rows = [(v,) for v in (-1e30, -300.0, -2.5, -0.5, 0.5, 2.5, 300.7, 1e30, float("nan"))]
    df = spark.createDataFrame(rows, "v double")
    got = [x.u for x in df.select(saturate.saturate_cast(F.col("v"), "uint8").alias("u")).collect()]
    assert got == [0, 0, 0, 0, 1, 3, 255, 255, 0]
    got = [int(x.u) for x in df.select(saturate.saturate_cast(F.col("v"), "int64").alias("u")).collect()]
    assert got == [-(2**63), -300, -3, -1, 1, 3, 301, 2**63 - 1, 0]


def test_tubes(spark):
    def nodes(r):
        return spark.createDataFrame([(1, -1, 0.0, 0.0, 0.0, 2.0), (2, 1, 10.0, 0.0, 0.0, r)], "id long, parent_id long, x double, y double, z double, radius double")

    def hits(points, r):
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "k long, x double, y double, z double")
        return {x.k for x in joins.in_tubes(df, "k", joins.segments(nodes(r)), 4.0).collect()}

    assert hits([(0, 0, 0), (5, 0, 0), (10, 0, 0), (5, 1.9, 0), (5, 2.1, 0)], 2.0) == {0, 1, 2, 3}
    assert hits([(1, 3, 0), (9, 3, 0)], 4.0) == {1}
    p = spark.createDataFrame([(5.0, 3.0, 0.0)], "x double, y double, z double")
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert p.select(geometry.frustum_distance([F.col(x) for x in "xyz"], lit(0, 0, 0), lit(10, 0, 0), F.lit(1.0), F.lit(3.0))).first()[0] == pytest.approx(1.0)
    branch = joins.assign_to_branches(spark.createDataFrame([(7, 5.0, 3.0, 0.0, 0.5), (8, 5.0, 40.0, 0.0, 0.5)], "pid long, x double, y double, z double, radius double"), "pid", joins.segments(nodes(2.0)), 2.0, 4.0).collect()
    assert [(x.pid, x.id, x.distance) for x in branch] == [(7, 2, 1.0)]


def chain(n, start, first):
    return [(first + i, first + i - 1 if i else -1, float(i), float(start), 0.0, 1.0) for i in range(n + 1)]


TREE = "id long, parent_id long, x double, y double, z double, radius double"


def test_orphan_trees(spark):
    rows = [r for k in range(1, 11) for r in chain(k, k, 100 * k)]
    got = tree.orphan_roots(spark.createDataFrame(rows, TREE), 0, 10).collect()
    assert [x.length for x in got] == [10, 9, 8, 7, 6]


def test_tree_edits_and_long_chains(spark):
    df = spark.createDataFrame([(1, -1, 0.0, 0.0, 0.0, 5.0), (2, 1, 1.0, 0.0, 0.0, 2.0), (3, 2, 2.0, 0.0, 0.0, 1.0), (4, 2, 1.0, 1.0, 0.0, 1.0), (5, 4, 1.0, 2.0, 0.0, 1.0)], TREE)
    parents = lambda t: {x.id: x.parent_id for x in t.collect()}
    assert parents(tree.delete_nodes(df, df.where("id = 1"))) == {2: -1, 3: 2, 4: 2, 5: 4}
    assert parents(tree.erase_nodes(df, df.where("id IN (2, 4)"))) == {1: -1, 3: 1, 5: 1}
    assert parents(tree.erase_subtrees(df, df.where("id = 4"))) == {1: -1, 2: 1, 3: 2}
    assert parents(tree.set_as_root(df, 4)) == {4: -1, 2: 4, 1: 2, 3: 2, 5: 4}
    assert {x.id: x.branch_id for x in tree.branches(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    table = {x.branch_id: (x.nodes, x.length) for x in tree.branch_table(df).collect()}
    assert table[4] == (2, 2.0) and parents(tree.remove_small_leaf_branches(df, 2, 1.5)) == {1: -1, 2: 1, 4: 2, 5: 4}
    assert {x.id: x.type for x in tree.label_soma(df, 1.0).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}
    assert {x.type for x in tree.label_soma(df, 9.0).collect()} == {0}
    assert sorted(x.id for x in tree.selection(df, df.where("id = 4"), "neighbours").collect()) == [2, 4, 5]
    long = tree.depths(spark.createDataFrame(chain(300, 0, 1), TREE)).orderBy("id").collect()
    assert [x.depth for x in long] == list(range(301)) and long[-1].dist_to_root == 300
    bent = spark.createDataFrame([(1, -1, 0.0, 0.0, 0.0, 1.0), (2, 1, 2.0, 0.0, 0.0, 1.0), (3, 2, 1.0, 0.1, 0.0, 1.0), (4, 3, 0.0, 0.2, 0.0, 1.0)], TREE)
    assert [x.id for x in tree.turns(bent).collect()] == [2]


def test_segment_properties_and_annotations(spark):
    doc = {"inline": {"ids": ["1", "2"], "properties": [{"id": "label", "type": "label", "values": ["a", "b"]}, {"id": "d", "type": "description", "values": ["da", "db"]}, {"id": "tags", "type": "tags", "tags": ["foo", "bar"], "values": [[0, 1], None]}, {"id": "n", "type": "number", "data_type": "int32", "values": [5, 6]}]}}
    for own in (doc, doc["inline"]):
        got = sources.segment_properties(spark.createDataFrame([(json.dumps(own),)], "value string")).orderBy("id").collect()
        assert [(int(x.id), x.label, x.description, x.tags, x.numbers) for x in got] == [(1, "a", "da", ["foo", "bar"], {"n": 5.0}), (2, "b", "db", [], {"n": 6.0})]
    notes = json.dumps([{"id": "18446744073709551615", "type": "point", "point": [1, 2, 3], "props": {"w": 2}}, {"id": "5", "type": "line", "pointA": [0, 0, 0], "pointB": [1, 1, 1]}])
    got = sources.annotations(spark.createDataFrame([(notes,)], "value string")).orderBy("id").collect()
    assert [(int(x.id), x.type, len(x.pts)) for x in got] == [(5, "line", 2), (2**64 - 1, "point", 1)]


def test_annotation_stream_gives_each_id_once(spark, tmp_path):
    schema = "id long, x double, y double, z double"
    for rows in ([(11, 10.0, 20.0, 30.0)], [(11, 10.0, 20.0, 30.0), (22, 150.0, 50.0, 50.0), (33, 250.0, 50.0, 50.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/cells")
    seen = []
    stream = progressive.unique_stream(spark, f"{tmp_path}/cells", schema, "id", "x >= 0 AND x < 200 AND y < 100 AND z < 100")
    progressive.run_to_end(stream, lambda batch, _: seen.append(sorted(x.id for x in batch.collect())), f"{tmp_path}/state")
    assert sorted(i for batch in seen for i in batch) == [11, 22] and len(seen) >= 2


def test_session_loads_the_newest_readable_commit(spark, tmp_path):
    import shutil

    own = progressive.Session(spark, f"{tmp_path}/s", {"dataset": [100, 80, 60], "core": 16, "halo": 2, "ratio": 2.5})
    assert own.load() == (0, {}, {})
    nodes = spark.createDataFrame([(1, -1, 2.0), (2, 1, 1.0)], "id long, parent_id long, radius double")
    assert own.commit({"nodes": nodes}, {"next": 7}) == 1
    assert own.commit({"nodes": nodes.where("id = 1")}, {"next": 8}) == 2
    again = progressive.Session(spark, f"{tmp_path}/s", {"dataset": [100, 80, 60], "core": 16, "halo": 2, "ratio": 2.5})
    number, tables, state = again.load()
    assert (number, tables["nodes"].count(), state) == (2, 1, {"next": 8})
    shutil.rmtree(f"{tmp_path}/s/commits/2")
    assert again.load()[0] == 1 and again.load()[2] == {"next": 7}
    with pytest.raises(ValueError, match="another session"):
        progressive.Session(spark, f"{tmp_path}/s", {"dataset": [1, 1, 1]})
    blocks = spark.createDataFrame([(0, False), (1, True), (2, False), (3, False)], "block long, visited boolean")
    pending = spark.createDataFrame([(1,), (1,), (2,), (3,)], "block long")
    assert progressive.next_block(blocks, pending).first().block == 2


@pytest.mark.parametrize("shape", [(4, 4), (3, 5), (5, 3), (1, 4)])
def test_assignment_is_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(30):
        cost = rng.integers(0, 30, shape).astype(float)
        n, m = shape
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(cost[p[j], j] for j in range(m)) for p in itertools.permutations(range(n), m))
        found = matching.assignment(cost)
        assert sum(cost[i, j] for i, j in found) == best and len({i for i, _ in found}) == len({j for _, j in found}) == min(shape)
    cost = np.array([[1.0, np.inf], [np.inf, np.inf]])
    with pytest.raises(ValueError):
        matching.assignment(cost)
    assert matching.assignment(cost, limit=2.0) == [(0, 0)]


def test_assignment_with_a_limit_saves_the_most():
    cost = np.array([[1000.0, 2, 11], [6, 1000, 1], [5, 12, 1000]])
    assert matching.assignment(cost, limit=4.99) == [(0, 1), (1, 2)]
    assert matching.assignment(np.array([[1.0, 10.0], [10.0, np.inf]]), limit=10.0) == [(0, 0)]
    assert matching.assignment(np.array([[1.0, 2.0], [2.0, 1.0]]), limit=1.0) == [(0, 0), (1, 1)]
    rng = np.random.default_rng(4)
    for _ in range(40):
        n, m, limit = *rng.integers(1, 5, 2), float(rng.integers(1, 9))
        own = rng.integers(0, 12, (n, m)).astype(float)
        saved = sum(limit - own[r, c] for r, c in matching.assignment(own, limit=limit))
        best = max(sum(max(0.0, limit - own[r, c]) for r, c in zip(rows, cols, strict=True)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert saved == pytest.approx(best) and all(own[r, c] <= limit for r, c in matching.assignment(own, limit=limit))


def test_assignment_groups_and_limit(spark):
    rows = [(1, 0, 0, 5.0), (1, 0, 1, 1.0), (1, 1, 1, 2.0), (2, 0, 0, 9.0)]
    df = spark.createDataFrame(rows, "g long, row long, col long, cost double")
    got = sorted((x.g, x.row, x.col) for x in matching.linear_assignment(df, limit=5.0).collect())
    assert got == [(1, 0, 1)]  # saves 4, the two others save 0 and 3
    assert sorted((x.g, x.row, x.col) for x in matching.linear_assignment(df, maximize=True).collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 0)]


def test_statistics(spark):
    for values in ([1.0, 2.0, 3.0, 4.0], [5.0, 1.0, 9.0]):
        x = aggregate.moments(spark.createDataFrame([(v,) for v in values], "v double")).first()
        assert (x.mean, x.variance, x.sample_variance, x.median) == pytest.approx((np.mean(values), np.var(values), np.var(values, ddof=1), np.median(values)))


def test_weighted_k_means_equals_replicated_rows(spark):
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (40, 2))])
    weight = np.ones(80, int)
    weight[[6, 26]] = 20, 30
    rows = [(p.tolist(), int(w)) for p, w in zip(points, weight, strict=True)]
    one = spark.createDataFrame(rows, "e array<double>, w long")
    many = one.select("e", F.explode(F.sequence(F.lit(1), F.col("w")))).select("e")
    start = [points[0].tolist(), points[50].tolist()]
    a, b = matching.k_means(one, "e", start, "w"), matching.k_means(many, "e", start)
    assert np.allclose(a, b) and np.allclose(sorted(a), [[points[:40, 0] @ weight[:40] / weight[:40].sum(), points[:40, 1] @ weight[:40] / weight[:40].sum()], b[1]], atol=0.5)
    w, mean, _ = matching.gaussian_mixture(one, "e", start)
    assert np.allclose(sorted(mean[:, 0]), [0, 6], atol=0.6) and abs(w[0] - 0.5) < 0.1
    far = matching.gonzales_centres(one, "e", start[0], 2)
    assert np.allclose(far[1], max(points.tolist(), key=lambda p: (sum((np.array(p) - start[0]) ** 2))))


def test_shortest_paths_and_forest(spark):
    edges = [(0, 1, 4.0), (0, 2, 1.0), (2, 1, 2.0), (1, 3, 5.0), (4, 5, 1.0)]
    df = spark.createDataFrame(edges, "s long, d long, w double")
    got = {x.id: (x.distance, x.previous) for x in graph.shortest_distances(df, 0).collect()}
    assert got == {0: (0.0, None), 2: (1.0, 0), 1: (3.0, 2), 3: (8.0, 1)}
    assert sorted(x.w for x in graph.minimum_spanning_forest(df).collect()) == [1.0, 1.0, 2.0, 5.0]
    regions = df.withColumns({"region": F.lit(1).cast("long"), "source": F.lit(0), "target": F.lit(3)})
    assert graph.path_costs(regions).first().cost == 8.0
    cost = spark.range(1).select(graph.weight_inverse(F.lit(2.0), F.lit(1.0), F.lit(3.0)), graph.weight_guarded(F.lit(1.0), F.lit(1.0), F.lit(9.0), 5.0, 1.0)).first()
    assert cost[0] == 2 * (1 / 2 + 1 / 4) and cost[1] == 1000.0


def test_threshold_rules():
    n = np.zeros(256, int)
    n[10], n[11:40], n[200] = 1000, 20, 5
    assert 10 < threshold.triangle(n) < 40
    two = np.zeros(256, int)
    two[50], two[150] = 100, 100
    assert threshold.two_centroids(two) == 100 and threshold.after_lower_mode(two) == 51 and threshold.triangle(np.zeros(256, int)) == 0


def test_kernels_windows_and_padding(spark, img10):
    p, img = img10
    k = np.array([[1.0, 2, 1], [0, 0, 0], [-1, -2, -1]])
    want = sum(k[i, j] * np.pad(p, 1, "edge")[i : i + 10, j : j + 10] for i in range(3) for j in range(3))
    assert np.allclose(plane_of(neighborhood.correlate(img, k, SIZE, "replicate")), want) and neighborhood.separable(k) is not None
    k[0, 0] = 7
    want = sum(k[i, j] * np.pad(p, 1)[i : i + 10, j : j + 10] for i in range(3) for j in range(3))
    assert np.allclose(plane_of(neighborhood.correlate(img, k, SIZE)), want) and neighborhood.separable(k) is None
    out = neighborhood.block_sum(img.select("image_id", "y", "x", "v"), SIZE, {"y": 3, "x": 2})
    full = np.zeros((12, 11))
    for dy, dx in itertools.product(range(3), range(2)):
        full[dy : dy + 10, dx : dx + 10] += p
    assert (plane_of(out, (12, 11)) == full).all()
    f = neighborhood.spectrum(img)
    ft = np.fft.fft2(p)
    assert all(abs(complex(r.re, r.im) - ft[r.y, r.x]) < 1e-6 for r in f.collect())
    with pytest.raises(ValueError, match="invalid region"):
        region.crop(img, {"x": (5, 2)})
    assert region.crop(img, {"x": (5, 5)}).count() == 0 and region.crop(img, {"x": (7, -1)}).agg(F.max("x")).first()[0] == 2
    assert region.resolve({"x": (2, -1)}, SIZE) == {"x": (2, 10)}


def test_pyramid_chunks_and_sequences(spark, img10, tmp_path):
    p, img = img10
    for level, own in enumerate(chunks.pyramid(img, 2)):
        chunks.to_chunks(own, {"z": 1, "y": 4, "x": 4}, level, 2**level).write.mode("append").partitionBy("level", "t").parquet(f"{tmp_path}/pyramid")
    got = plane_of(chunks.read_region(spark, f"{tmp_path}/pyramid", 0, {"y": (2, 8), "x": (3, 9)}), (6, 6))
    assert (got == p[2:8, 3:9]).all()
    plan = chunks.read(spark, f"{tmp_path}/pyramid", 0, {"y": (0, 4)})._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(level" in plan and "PushedFilters: [" in plan
    chunks.write(chunks.to_chunks(img, {"z": 1, "y": 5, "x": 5}), f"{tmp_path}/one")
    assert chunks.to_voxels(chunks.read(spark, f"{tmp_path}/one")).count() == 100
    for n, k in ((2, 10), (1, 2)):
        image(spark, np.full((n + 1, 3), k)).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/seq{k}")
    out = chunks.read_sequence(spark, [f"{tmp_path}/seq2", f"{tmp_path}/seq10"], "x")
    assert (plane_of(out, (3, 6)) == np.array([[2, 2, 2, 10, 10, 10]] * 3)).all()


def test_text_formats(spark, tmp_path):
    (tmp_path / "t.swc").write_text("# a tree\n1 1 0 0 0 2 -1\n2 3 1 0 0 1 1 # note\n7 3 1 1 1 1 99\nbroken line\n")
    got = {x.id: (x.type, x.parent_id) for x in readers.read(spark, f"{tmp_path}/t.swc").collect()}
    assert got == {1: (1, -1), 2: (3, 1), 7: (3, -1)}
    sources.write_swc(sources.read_swc(spark, f"{tmp_path}/t.swc"), f"{tmp_path}/out")
    assert {x.id for x in sources.read_swc(spark, f"{tmp_path}/out").collect()} == {1, 2, 7}
    (tmp_path / "p.marker").write_text("#x,y,z\n1, 2,3,4,1,a,b\n\n5,6,7\n")
    assert [(x.x, x.z, x.radius) for x in readers.read(spark, f"{tmp_path}/p.marker").orderBy("x").collect()] == [(1, 3, 4), (5, 7, None)]
    (tmp_path / "a.csv").write_text('a, b ,"c, ""d"""\n1,2\n')
    assert [x.cells for x in sources.read_table(spark, f"{tmp_path}/a.csv").collect()] == [["a", "b", 'c, "d"'], ["1", "2"]]
    with pytest.raises(ValueError, match="unknown extension"):
        readers.read(spark, f"{tmp_path}/x.unknown")
    onto = json.dumps({"id": 1, "name": "root", "acronym": "r", "children": [{"id": 2, "name": "a", "parent_structure_id": 1, "children": [{"id": 3}]}]})
    regions = sources.ontology(spark, onto)
    assert {(x.id, x.parent_id) for x in regions.collect()} == {(1, -1), (2, 1), (3, 2)}
    assert {x.id for x in tree.closure(regions).where("ancestor = 2").collect()} == {2, 3}
    with pytest.raises(ValueError, match="twice"):
        sources.ontology(spark, json.dumps([{"id": 1}, {"id": 1}]))


def test_text_functions(spark):
    names = ["img10.tif", "img9.tif", "img 2", "a1b2", "a1b10"]
    df = spark.createDataFrame([(x,) for x in names], "n string")
    assert [x.n for x in df.orderBy(text.natural_key(F.col("n"))).collect()] == ["a1b2", "a1b10", "img 2", "img9.tif", "img10.tif"]
    x = df.where("n = 'a1b10'").select(text.last_integer(F.col("n")), text.replace_last_integer(F.col("n"), F.lit(7)), text.without_comment(F.lit("1.#INF 2 # note")), text.number(F.lit("x")), text.number(F.lit(" 2.5 "))).first()
    assert tuple(x) == (10, "a1b7", "1.#INF 2", None, 2.5)
    assert unit_factor("inch", "mm") == 25.4
    with pytest.raises(ValueError, match="no length"):
        unit_factor("none", "mm")


def test_levels_jobs_and_masks(spark):
    own = [(1, 1, 1), (2, 2, 1), (4, 4, 2)]
    assert levels.local_level(own, 0.3) == (2, 2, 1) and levels.local_level(own, 2.0) == (1, 1, 1) and levels.remote_level(own, 0.3) == (4, 4, 2)
    job = levels.Job("detect", ["a"], "b", {"radius": 2.5})
    assert levels.Job.load(job.save()) == job
    assert joins.chunks_of_box({"x": 10}, {"x": 33}, {"x": 2}, {"x": 8}, {"x": 0}, {"x": 100}) == {"x": (0, 3)}
    pts = [{"x": 0.0, "y": 0.0}, {"x": 6.0, "y": 0.0}, {"x": 0.0, "y": 6.0}]
    ops = spark.createDataFrame([(1, 0, 0, 0, True, "polygon", pts), (1, 0, 0, 1, False, "ellipse", [{"x": 0.0, "y": 0.0}, {"x": 2.0, "y": 2.0}])], "roi_id long, slice long, shape_id long, op_idx long, is_add boolean, type string, pts array<struct<x:double,y:double>>")
    got = {(x.y, x.x) for x in mesh.roi_mask(ops).collect()}
    assert (1, 1) not in got and (0, 3) in got and (5, 5) not in got and (3, 1) in got
    assert mesh.roi_mask(mesh.moved_roi(ops, 10, 0)).agg(F.min("x")).first()[0] >= 10


def test_meshes(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 1.0)], "mesh_id long, vid long, x double, y double, z double")
    t = spark.createDataFrame([(1, 0, 0, 2, 1), (1, 1, 0, 1, 3), (1, 2, 0, 3, 2), (1, 3, 1, 2, 3)], "mesh_id long, tid long, a long, b long, c long")
    x = mesh.properties(v, t).first()
    assert x.volume == pytest.approx(1 / 6) and x.area == pytest.approx(1.5 + math.sqrt(3) / 2)
    both = mesh.merged([(v, t), (mesh.transformed(v, [[2, 0, 0, 5], [0, 2, 0, 0], [0, 0, 2, 0]]), t)], 9)
    assert mesh.properties(*both).first().volume == pytest.approx(1 / 6 + 8 / 6)
    n = mesh.normals(v, t).where("vid = 0").first()
    assert (n.nx, n.ny, n.nz) == pytest.approx((-1 / math.sqrt(3),) * 3)
    inverse = geometry.inverse_affine([[2, 0, 0, 5], [0, 2, 0, 0], [0, 0, 2, 0]])
    assert np.allclose(inverse, [[0.5, 0, 0, -2.5], [0, 0.5, 0, 0], [0, 0, 0.5, 0]])


def test_registration(spark):
    rng = np.random.default_rng(1)
    big = rng.integers(0, 255, (14, 14))
    a, b = image(spark, big[:10, :10]), image(spark, big[2:12, 3:13])
    best = matching.best_offset(a, b, (0, 4, 4), 20).first()
    assert (best.dy, best.dx) == (2, 3) and best.ncc == pytest.approx(1.0)
    pairs = spark.createDataFrame([(0, 1, 0, 0, 8, 0.1), (1, 2, 0, 8, 0, 0.2), (0, 2, 0, 7, 7, 0.9)], "a long, b long, dz long, dy long, dx long, cost double")
    place = matching.resolve_offsets(pairs, 0)
    assert place[2].tolist() == [0, 8, 8]
    scores = matching.aligned_score(spark.createDataFrame([(1, [1.0, 2.0, 3.0], [1.0, 3.0])], "pair long, left array<double>, right array<double>"), 0.5)
    assert scores.first().score == 0.5


def test_thinning_keeps_a_line():
    bar = np.zeros((9, 15), bool)
    bar[3:6, 2:13] = True
    thin = sampling.thinned_plane(bar)
    assert 0 < thin.sum() <= 11 and thin.sum(axis=0).max() == 1 and thin[4].sum() == thin.sum()
    assert np.allclose(sampling.cubic_weights(0.5), [-0.0625, 0.5625, 0.5625, -0.0625])


def test_stitching_and_overlaps(spark):
    rng = np.random.default_rng(4)
    big = rng.integers(0, 255, (16, 26))
    tiles = [(0, 0, 0), (1, 1, 9), (2, 3, 16)]
    rows = [(k, 0, y, x, int(big[oy + y, ox + x])) for k, oy, ox in tiles for y in range(10) for x in range(10)]
    df = spark.createDataFrame(rows, "tile_id long, z long, y long, x long, v long")
    pairs = spark.createDataFrame([(0, 1, 0, 0, 8), (1, 2, 0, 1, 8)], "a long, b long, ez long, ey long, ex long")
    got = composites.pair_offsets(df, pairs, (0, 2, 2), 5)
    assert {(x.a, x.b): (x.dy, x.dx) for x in got.collect()} in ({(0, 1): (1, 9), (1, 2): (2, 7)},)
    out = composites.stitch(df, pairs, (0, 2, 2), 5, 0)
    assert all(x.v == big[x.y, x.x] for x in out.collect())
    puncta = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0, 2.0, 10.0), (0, 2, 1.0, 0.0, 0.0, 1.0, 5.0), (0, 3, 9.0, 0.0, 0.0, 1.0, 1.0)], "image_id long, label long, x double, y double, z double, radius double, mass double")
    assert sorted(x.label for x in composites.without_overlaps(puncta, ["image_id"], 0.5).collect()) == [1, 3]


def test_reconnected_forest(spark):
    rows = [*chain(2, 0, 1), (10, -1, 3.0, 0.5, 0.0, 1.0), (11, 10, 4.0, 0.5, 0.0, 1.0), (20, -1, 90.0, 0.0, 0.0, 1.0)]
    got = {x.id: x.parent_id for x in tree.reconnected(spark.createDataFrame(rows, TREE), 2.0).collect()}
    assert got[10] == 3 and got[1] == -1 and got[20] == -1


def test_long_chains_and_wide_trees_by_tours(spark):
    """A chain of 20,000 nodes with a leaf on every tenth one: no table of nodes and ancestors, a few joins."""
    n = 20_000
    rows = spark.range(n).selectExpr("id", "id - 1 AS parent_id").union(spark.range(0, n, 10).selectExpr(f"id + {n} AS id", "id AS parent_id"))
    forest = rows.selectExpr("id", "parent_id", "CAST(id AS DOUBLE) AS x", "0D AS y", "0D AS z", "1D AS radius")
    found = {x.id: x for x in tree.counts(forest).where("id < 12 OR id IN (5000, 19999, 25000)").collect()}
    assert found[0].descendants == n + n // 10 - 1 and found[5000].descendants == (n - 5001) + (n - 5000) // 10 and found[19999].descendants == 0
    assert found[5000].ancestors == 5000 and found[25000].ancestors == 5001 and found[0].leaves == n // 10 + 1 and found[19999].leaves == 1
    places = {x.id: x.place for x in tree.preorder(forest).where("id IN (0, 1, 9, 19999, 20000, 39990)").collect()}
    assert places[0] == 1 and places[1] == 2 and places[19999] == n and places[20000] == n + n // 10
    assert tree.subtree(forest, forest.where("id = 19990")).count() == 11
    assert tree.selection(forest, forest.where("id = 20100"), "upstream").count() == 102


def test_saturation_is_exact_in_64_bits_and_with_fractions(spark):
    from voxloom.functions import saturate

    big = 2**53 + 1
    row = spark.range(1).select(
        saturate.saturate_cast(F.lit(big), "int64").alias("a"), saturate.saturate_cast(F.lit(-big), "int64").alias("b"), saturate.saturate_cast(F.lit(2.5), "int8").alias("c"),
        saturate.saturate_cast(F.lit(float("nan")), "uint8").alias("d"), saturate.saturate_cast(F.lit(float("inf")), "int64").alias("e"), saturate.saturate_cast(F.lit(-3), "uint64").alias("f"),
        saturate.mul(F.lit(5), F.lit(2.5), "uint8").alias("g"), saturate.div(F.lit(5), F.lit(2.5), "uint8").alias("h"), saturate.add(F.lit(250), F.lit(9.5), "uint8").alias("i"),
        saturate.sub(F.lit(1), F.lit(3.5), "int8").alias("j"), saturate.div(F.lit(7), F.lit(2), "uint8").alias("k"), saturate.div(F.lit(1.5), F.lit(0), "int16").alias("l"),
        saturate.mul(F.lit(2**62), F.lit(2), "int64").alias("m"), saturate.add(F.lit(2**63 - 1), F.lit(-1), "int64").alias("n"),
    ).first()
    assert list(row) == [big, -big, 3, 0, 2**63 - 1, 0, 13, 2, 255, -3, 3, 2**15 - 1, 2**63 - 1, 2**63 - 2]


def test_long_lines_of_distances_by_envelopes():
    from voxloom.operators import neighborhood

    rng = np.random.default_rng(9)
    for n in (1, 5, 400):
        at, f = np.cumsum(rng.random(n) + 0.1), np.where(rng.random(n) < 0.6, np.inf, rng.random(n) * 50)
        want = np.min((at[:, None] - at[None, :]) ** 2 + f[None, :], axis=1)
        assert neighborhood.envelope(at, f) == pytest.approx(want)


def test_signed_distances(spark):
    from voxloom.operators import neighborhood

    rows = [(0, x, 1.0 if 2 <= x < 5 else 0.0) for x in range(8)]
    out = neighborhood.signed_distances(spark.createDataFrame(rows, "image_id long, x long, v double"), axes=("x",))
    assert [r.v for r in out.orderBy("x").collect()] == [2.0, 1.0, -1.0, -2.0, -1.0, 1.0, 2.0, 3.0]


def test_nearest_across_ranges(spark, monkeypatch):
    from voxloom.operators import joins, ordering

    monkeypatch.setattr(ordering, "ROWS", 3)
    rng = np.random.default_rng(3)
    a, b = [(i, float(x)) for i, x in enumerate(rng.integers(0, 60, 25))], [(i, float(x)) for i, x in enumerate(rng.integers(0, 60, 12))]
    out = joins.nearest(spark.createDataFrame(a, "k long, v double"), spark.createDataFrame(b, "t long, o double"), "k", "t", "v", "o")
    got = {x.k: (x.nearest, x.gap) for x in out.collect()}
    for k, v in a:
        o, t = min(((abs(v - o), o, t) for t, o in b))[1:]
        assert got[k] == (t, abs(v - o))


def test_nearest_on_tree_widens_and_takes_ids_as_keys(spark):
    from voxloom.operators import joins

    tree = spark.createDataFrame([(1, -1, 0.0, 0.0, 0.0, 1.0), (2, 1, 10.0, 0.0, 0.0, 1.0), (3, 1, 0.0, 10.0, 0.0, 1.0)], "id long, parent_id long, x double, y double, z double, radius double")
    points = spark.createDataFrame([(1, 5.0, 2.0, 0.0), (2, 0.0, 500.0, 0.0), (3, None, 0.0, 0.0), (4, 0.0, 0.0, 0.0)], "id long, x double, y double, z double")
    found = {r["_key"]: r for r in joins.nearest_on_tree(points, "id", joins.segments(tree), 1.0).collect()}
    assert set(found) == {1, 2, 4}
    assert (found[1].id, found[1].distance, found[1].px, found[1].share) == (2, 2.0, 5.0, 0.5)
    assert (found[2].id, found[2].distance, found[2].share) == (3, 490.0, 0.0)
    assert found[4].id == 1  # all three touch it
    assert joins.nearest_on_tree(points, "id", joins.segments(tree.where("false")), 1.0).count() == 0
    assert [r.id for r in joins.subtract_tree(tree, tree.where("id = 1"), 4.0).orderBy("id").collect()] == [2, 3]


def test_points_as_wide_as_their_gap_meet_a_branch(spark):
    from voxloom.operators import joins

    tree = spark.createDataFrame([(1, -1, 0.0, 0.0, 0.0, 1.0), (2, 1, 10.0, 0.0, 0.0, 1.0)], "id long, parent_id long, x double, y double, z double, radius double")
    points = spark.createDataFrame([(7, 5.0, 9.0, 0.0, 8.0), (8, 5.0, 12.0, 0.0, 8.0)], "id long, x double, y double, z double, radius double")
    assert [(r.id, r.distance) for r in joins.assign_to_branches(points.withColumnRenamed("id", "spot"), "spot", joins.segments(tree), 1.0, 1.0).collect()] == [(2, 8.0)]


def test_rerooted_and_merged_soma(spark):
    from voxloom.operators import tree

    rows = [(1, -1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 1), (5, 4, 3), (6, 3, 1)]
    own = spark.createDataFrame([(i, p, float(i), 0.0, 0.0, 1.0, t) for i, p, t in rows], "id long, parent_id long, x double, y double, z double, radius double, type int")
    parents = lambda t: {r.id: r.parent_id for r in t.collect()}
    assert parents(tree.merge_soma(own)) == {1: -1, 3: 1, 5: 1, 6: 3}
    assert parents(tree.set_as_root(own, 5)) == {1: 2, 2: 4, 3: 2, 4: 5, 5: -1, 6: 3}
    assert parents(tree.set_as_root(own, 99)) == {i: p for i, p, _ in rows}
    gone = spark.createDataFrame([(1,), (2,), (4,)], "id long")
    assert parents(tree.erase_nodes(own, gone)) == {3: -1, 5: -1, 6: 3}


def test_colour_map_ends(spark):
    from pyspark.sql import functions as F

    from voxloom.functions import colours

    keys = [(1.0, (1, 2, 3, 4), (0, 0, 0, 0)), (3.0, (101, 0, 0, 255), (9, 8, 7, 6))]
    rows = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (3.5,), (None,)], "v double").select(colours.mapped(F.col("v"), keys).alias("c")).collect()
    assert [tuple(r.c) if r.c else None for r in rows] == [(1, 2, 3, 4), (1, 2, 3, 4), (50, 0, 0, 127), (101, 0, 0, 255), (9, 8, 7, 6), None]
    assert tuple(spark.range(1).select(colours.mapped(F.lit(1.0), []).alias("c")).first().c) == (0, 0, 0, 0)
