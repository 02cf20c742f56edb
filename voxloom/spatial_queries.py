"""Further operators on trees, points, objects, colours and meshes as queries, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import mapping
from voxloom.functions import colours, complexes
from voxloom.operators import graph, joins, mesh, neighborhood, ordering, tree
from voxloom.queries import PTS, SHARE, SIZE, TREE, TUBES, VOX, Query, cubes, plane
from voxloom.source_queries import container, images, scratch
from voxloom.sources import chunks, text

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Trees of long chains: 50 events each, some of which hang on the one three before.
CHAIN = """chain AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN -1 WHEN event_id % 7 = 3 AND event_id % 50 >= 3 THEN event_id - 3 ELSE event_id - 1 END AS parent_id,
  CAST(value AS DOUBLE) AS x, CAST(user_id % 100 AS DOUBLE) AS y, CAST(event_id % 10 AS DOUBLE) AS z, CAST(event_id % 7 + 1 AS DOUBLE) AS radius, CASE WHEN event_id % 50 < 9 AND event_id % 4 < 3 THEN 1 ELSE 3 END AS type FROM events)"""
ALONG = """e AS (SELECT c.*, p.parent_id IS NULL AS top, coalesce(p.parent_id = -1, false) AS below_top, coalesce(sqrt((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) + (c.z-p.z)*(c.z-p.z)), 0) AS edge FROM chain c LEFT JOIN chain p ON c.parent_id = p.id),
  k AS (SELECT parent_id AS id, count(*) AS n FROM chain GROUP BY 1),
  w AS (SELECT id, id AS branch_id, CAST(0 AS DOUBLE) AS start, CAST(0 AS DOUBLE) AS total FROM e WHERE parent_id = -1
    UNION ALL SELECT e.id, CASE WHEN e.below_top OR k.n >= 2 THEN e.id ELSE w.branch_id END, CASE WHEN e.below_top OR k.n >= 2 THEN e.edge ELSE w.start + e.edge END, w.total + e.edge FROM w JOIN e ON e.parent_id = w.id JOIN k ON k.id = w.id),
  b AS (SELECT w.*, e.edge, e.parent_id, CASE WHEN e.parent_id = -1 THEN 1 WHEN k.n >= 2 THEN 2 WHEN k.n IS NULL THEN 3 ELSE 0 END AS topology FROM w JOIN e USING (id) LEFT JOIN k USING (id)),
  t AS (SELECT branch_id, count(*) AS nodes, max(start) AS length, arg_max(topology, start) AS ends FROM b GROUP BY 1)"""


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def chains(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    parent = F.when(n % 50 == 0, -1).when((n % 7 == 3) & (n % 50 >= 3), n - 3).otherwise(n - 1)
    kind = F.when((n % 50 < 9) & (n % 4 < 3), 1).otherwise(3)
    rows = mapping.table(spark, sf, "events")
    return rows.select(n.alias("id"), parent.cast("bigint").alias("parent_id"), F.col("value").cast("double").alias("x"), (F.col("user_id") % 100).cast("double").alias("y"), (n % 10).cast("double").alias("z"), (n % 7 + 1).cast("double").alias("radius"), kind.alias("type"))


def spots(spark: SparkSession, sf: str) -> DataFrame:
    """The places of puncta, each once."""
    return mapping.puncta_voxels(spark, sf).select("x", "y", "z").distinct().withColumn("key", F.struct("x", "y", "z"))


def rounded(rows: DataFrame, digits: int, *names: str) -> DataFrame:
    return rows.withColumns({n: F.round(n, digits) for n in names})


# --- trees ------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {CHAIN}, {ALONG} SELECT id, branch_id, round(edge, 6) AS dist_to_parent, round(start, 5) AS dist_to_branch_start, round(total, 5) AS dist_to_root, CAST(topology AS BIGINT) AS topology FROM b")
def t08_branches_of_chains(spark, sf):
    out = tree.branches(chains(spark, sf)).drop("parent_branch")
    return rounded(rounded(out, 6, "dist_to_parent"), 5, "dist_to_branch_start", "dist_to_root")


@query(f"WITH RECURSIVE {CHAIN}, {ALONG} SELECT branch_id, nodes, round(length, 5) AS length, CAST(ends AS BIGINT) AS ends FROM t")
def a19_branch_table(spark, sf):
    return rounded(tree.branch_table(chains(spark, sf)), 5, "length")


@query(f"WITH RECURSIVE {CHAIN}, {ALONG}, gone AS (SELECT t.branch_id FROM t JOIN b h ON h.id = t.branch_id JOIN b j ON j.id = h.parent_id WHERE t.nodes < 3 AND t.length < 200 AND t.ends = 3 AND j.topology = 2) SELECT id, parent_id FROM b WHERE branch_id NOT IN (SELECT branch_id FROM gone)")
def t09_small_branches(spark, sf):
    return tree.remove_small_leaf_branches(chains(spark, sf), 3, 200.0).select("id", "parent_id")


@query(f"WITH RECURSIVE {CHAIN}, w AS (SELECT id, id AS head, type = 1 AS held FROM chain WHERE parent_id = -1 UNION ALL SELECT c.id, CASE WHEN w.held AND c.type = 1 THEN w.head ELSE c.id END, w.held AND c.type = 1 FROM w JOIN chain c ON c.parent_id = w.id) SELECT c.id, CASE WHEN c.parent_id = -1 THEN -1 ELSE p.head END AS parent_id FROM chain c JOIN w o ON o.id = c.id LEFT JOIN w p ON p.id = c.parent_id WHERE o.head = c.id")
def t10_merge_soma(spark, sf):
    return tree.merge_soma(chains(spark, sf)).select("id", "parent_id")


@query(f"WITH RECURSIVE {CHAIN}, w AS (SELECT id, id AS kept, id % 5 <> 2 AS stays FROM chain WHERE parent_id = -1 UNION ALL SELECT c.id, CASE WHEN c.id % 5 <> 2 THEN c.id ELSE w.kept END, w.stays OR c.id % 5 <> 2 FROM w JOIN chain c ON c.parent_id = w.id) SELECT c.id, CASE WHEN p.stays THEN p.kept ELSE -1 END AS parent_id FROM chain c LEFT JOIN w p ON p.id = c.parent_id WHERE c.id % 5 <> 2")
def t04_erase_on_chains(spark, sf):
    own = chains(spark, sf)
    return tree.erase_nodes(own, own.where("id % 5 = 2").select("id")).select("id", "parent_id")


@query(f"WITH {TREE}, l AS (SELECT c.z, least(c.z, coalesce(p.z, 0)) AS low, greatest(c.z, coalesce(p.z, 0)) AS high FROM tree c LEFT JOIN tree p ON p.id = c.parent_id) SELECT t.id, t.z, (SELECT count(*) FROM l WHERE low <= t.z + 0.5 AND high >= t.z - 0.5) AS n FROM tree t")
def a24_layer_features(spark, sf):
    return tree.layer_features(mapping.tree(spark, sf), 0.5)


LIKE = "CASE WHEN a.n < b.n THEN sqrt(a.n) * a.n / b.n ELSE sqrt(b.n) * b.n / a.n END / (abs(a.z - b.z) / 10.0 + 1.5)"


@query(f"WITH {CHAIN}, l AS (SELECT c.id, c.parent_id, c.z, least(c.z, coalesce(p.z, 0)) AS low, greatest(c.z, coalesce(p.z, 0)) AS high FROM chain c LEFT JOIN chain p ON p.id = c.parent_id), h AS (SELECT DISTINCT z FROM l), m AS (SELECT h.z, count(*) AS n FROM h JOIN l ON low <= h.z + 1 AND high >= h.z - 1 GROUP BY 1), f AS (SELECT l.id, l.parent_id, l.z, n FROM l JOIN m USING (z)) SELECT a.id, round(CAST({LIKE} AS DOUBLE), 6) AS likeness FROM f a JOIN f b ON b.id = a.parent_id")
def a24_layer_similarity(spark, sf):
    """Every node against its parent."""
    own = chains(spark, sf)
    rows = own.select("id", "parent_id").join(tree.layer_features(own, 1.0), "id")
    parent = rows.select(F.col("id").alias("parent_id"), F.col("z").alias("z2"), F.col("n").alias("n2"))
    return rows.join(parent, "parent_id").select("id", F.round(tree.layer_similarity(F.col("z"), F.col("n"), F.col("z2"), F.col("n2"), 10.0, 1.5), 6).alias("likeness"))


SMALL = """tree AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(-1 AS BIGINT) AS parent_id, CAST(r_regionkey * 4 AS DOUBLE) AS x, CAST(r_regionkey % 3 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z, CAST(3 AS DOUBLE) AS radius FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey, CAST(n_nationkey AS DOUBLE), CAST(n_nationkey % 11 AS DOUBLE), CAST(n_nationkey % 4 AS DOUBLE), CAST(n_nationkey % 2 + 1 AS DOUBLE) FROM nation)"""


@query(f"WITH {SMALL}, {TUBES}, g AS (SELECT CAST(gz.range AS DOUBLE) AS z, CAST(gy.range AS DOUBLE) AS y, CAST(gx.range AS DOUBLE) AS x FROM range(-8, 12) gz CROSS JOIN range(-10, 25) gy CROSS JOIN range(-10, 40) gx), c AS (SELECT g.*, e.*, least(greatest({SHARE}, 0), 1) AS t FROM g CROSS JOIN e) SELECT CAST(z AS BIGINT) AS z, CAST(y AS BIGINT) AS y, CAST(x AS BIGINT) AS x, min(id) AS label FROM c WHERE ar + t*(br-ar) > 0 AND (x-ax-t*(bx-ax))*(x-ax-t*(bx-ax)) + (y-ay-t*(\"by\"-ay))*(y-ay-t*(\"by\"-ay)) + (z-az-t*(bz-az))*(z-az-t*(bz-az)) <= (ar+t*(br-ar))*(ar+t*(br-ar)) GROUP BY 1, 2, 3")
def t18_label_volume(spark, sf):
    """The regions and nations as a forest, drawn."""
    region, nation = mapping.table(spark, sf, "region"), mapping.table(spark, sf, "nation")
    n = F.col("n_nationkey")
    small = region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), (F.col("r_regionkey") * 4).cast("double").alias("x"), (F.col("r_regionkey") % 3).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(3.0).alias("radius"))
    small = small.union(nation.select((n + 100).cast("bigint"), F.col("n_regionkey").cast("bigint"), n.cast("double"), (n % 11).cast("double"), (n % 4).cast("double"), (n % 2 + 1).cast("double")))
    return tree.label_volume(small, 4.0).select("z", "y", "x", "label")


# --- points and trees ---------------------------------------------------------------------------------------------------------------------

AXIS = f"c AS (SELECT p.*, e.*, least(greatest({SHARE}, 0), 1) AS t FROM p CROSS JOIN e), d AS (SELECT *, sqrt((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax))) + (y-(ay+t*(\"by\"-ay)))*(y-(ay+t*(\"by\"-ay))) + (z-(az+t*(bz-az)))*(z-(az+t*(bz-az)))) AS d FROM c)"
SPOTS = f"p AS (SELECT DISTINCT x, y, z FROM (WITH {PTS} SELECT * FROM pts))"


@query(f"WITH {TREE}, {TUBES}, {SPOTS}, {AXIS} SELECT x, y, z, arg_min(id, (round(d, 6), id)) AS id, round(min(d), 4) AS distance FROM d GROUP BY 1, 2, 3")
def j11_nearest_on_tree(spark, sf):
    out = joins.nearest_on_tree(spots(spark, sf), "key", joins.segments(mapping.tree(spark, sf)), 2.0)
    return out.select("_key.*", "id", F.round("distance", 4).alias("distance"))


@query(f"WITH RECURSIVE {CHAIN}, {ALONG}, s AS (SELECT c.id, c.parent_id, c.x ax, c.y ay, c.z az, coalesce(p.x, c.x) bx, coalesce(p.y, c.y) AS \"by\", coalesce(p.z, c.z) bz FROM chain c LEFT JOIN chain p ON c.parent_id = p.id), p AS (SELECT s_suppkey AS key, CAST(s_acctbal / 20 AS DOUBLE) AS x, CAST(s_suppkey % 90 AS DOUBLE) AS y, CAST(s_nationkey % 9 AS DOUBLE) AS z FROM supplier), q AS (SELECT p.*, s.*, least(greatest({SHARE}, 0), 1) AS t FROM p CROSS JOIN s), d AS (SELECT *, sqrt((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax))) + (y-(ay+t*(\"by\"-ay)))*(y-(ay+t*(\"by\"-ay))) + (z-(az+t*(bz-az)))*(z-(az+t*(bz-az)))) AS d FROM q), m AS (SELECT key, arg_min(id, (round(d, 6), id)) AS id, arg_min(t, (round(d, 6), id)) AS t FROM d GROUP BY 1) SELECT m.key, b.id, b.branch_id, round(b.start - t * b.edge, 4) AS dist_to_branch_start, round(b.total - t * b.edge, 4) AS dist_to_root FROM m JOIN b ON b.id = m.id")
def t11_point_on_branch(spark, sf):
    rows = mapping.table(spark, sf, "supplier")
    points = rows.select(F.col("s_suppkey").alias("key"), (F.col("s_acctbal") / 20).alias("x"), (F.col("s_suppkey") % 90).cast("double").alias("y"), (F.col("s_nationkey") % 9).cast("double").alias("z"))
    out = tree.on_branches(points, "key", chains(spark, sf), 8.0)
    return rounded(out.select(F.col("_key").alias("key"), "id", "branch_id", "dist_to_branch_start", "dist_to_root"), 4, "dist_to_branch_start", "dist_to_root")


SQUARE = "(x-ax)*(x-ax) + (y-ay)*(y-ay) + (z-az)*(z-az)"
AWAY, LENGTH = "((x-ax)*(bx-ax) + (y-ay)*(\"by\"-ay) + (z-az)*(bz-az))", "((bx-ax)*(bx-ax) + (\"by\"-ay)*(\"by\"-ay) + (bz-az)*(bz-az))"
FRUSTUM = f"CASE WHEN s < 0 THEN sqrt({SQUARE}) - ar WHEN s > 1 THEN sqrt((x-bx)*(x-bx) + (y-\"by\")*(y-\"by\") + (z-bz)*(z-bz)) - br ELSE sqrt(greatest({SQUARE} - coalesce({AWAY} * {AWAY} / nullif({LENGTH}, 0), 0), 0)) - ((1 - s) * ar + s * br) END"


@query(f"WITH {TREE}, {TUBES}, {SPOTS}, s AS (SELECT p.*, e.*, {SHARE} AS s FROM p CROSS JOIN e WHERE e.parent_id <> -1), d AS (SELECT *, {FRUSTUM} AS d FROM s) SELECT x, y, z, arg_min(id, (round(d, 6), id)) AS id, round(min(d), 4) AS distance, count(*) AS in_range FROM d WHERE d < 2.03 GROUP BY 1, 2, 3")
def j07_assign_puncta(spark, sf):
    points = spots(spark, sf).withColumn("radius", F.lit(1.03))
    out = joins.assign_to_branches(points, "key", joins.segments(mapping.tree(spark, sf)), 1.0, 6.0)
    return out.select("key.*", "id", F.round("distance", 4).alias("distance"), "in_range")


OTHER = SMALL.replace("tree AS", "other AS")


@query(f"WITH {TREE}, {OTHER}, {TUBES.replace('FROM tree c LEFT JOIN tree p', 'FROM other c LEFT JOIN other p')}, c AS (SELECT n.id AS node, n.x, n.y, n.z, e.*, least(greatest({SHARE.replace('(x-', '(n.x-').replace('(y-', '(n.y-').replace('(z-', '(n.z-')}, 0), 1) AS t FROM tree n CROSS JOIN e), hit AS (SELECT DISTINCT node FROM c WHERE ar + t*(br-ar) > 0 AND (x-ax-t*(bx-ax))*(x-ax-t*(bx-ax)) + (y-ay-t*(\"by\"-ay))*(y-ay-t*(\"by\"-ay)) + (z-az-t*(bz-az))*(z-az-t*(bz-az)) <= (ar+t*(br-ar))*(ar+t*(br-ar))) SELECT id, CASE WHEN parent_id IN (SELECT node FROM hit) THEN -1 ELSE parent_id END AS parent_id FROM tree WHERE id NOT IN (SELECT node FROM hit)")
def j10_subtract_tree(spark, sf):
    region, nation = mapping.table(spark, sf, "region"), mapping.table(spark, sf, "nation")
    n = F.col("n_nationkey")
    other = region.select(F.col("r_regionkey").cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("parent_id"), (F.col("r_regionkey") * 4).cast("double").alias("x"), (F.col("r_regionkey") % 3).cast("double").alias("y"), F.lit(0.0).alias("z"), F.lit(3.0).alias("radius"))
    other = other.union(nation.select((n + 100).cast("bigint"), F.col("n_regionkey").cast("bigint"), n.cast("double"), (n % 11).cast("double"), (n % 4).cast("double"), (n % 2 + 1).cast("double")))
    return joins.subtract_tree(mapping.tree(spark, sf), other, 4.0).select("id", "parent_id")


@query("WITH a AS (SELECT o_orderkey AS id, o_custkey AS k FROM orders UNION SELECT o_orderkey, o_orderkey % 50 FROM orders) SELECT id, k AS object_id FROM a WHERE k IN (SELECT s_suppkey FROM supplier)")
def j16_related_annotations(spark, sf):
    rows = mapping.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array("o_custkey", F.col("o_orderkey") % 50).alias("related"))
    return joins.related(rows, "related", mapping.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "object_id")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem")
def o05_seed_order(spark, sf):
    """Lines as seeds, the best price first."""
    rows = mapping.table(spark, sf, "lineitem")
    order = [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))]
    return ordering.numbered(rows, order, "place").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "place")


# --- images -------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX}, g AS (SELECT image_id, ry.range AS y, rx.range AS x FROM (SELECT DISTINCT image_id FROM vox) CROSS JOIN range(2, 6) ry CROSS JOIN range(0, 5) rx) SELECT g.image_id, g.y - 2 AS y, g.x, CAST(coalesce(sum(v), 0) AS BIGINT) AS v FROM g LEFT JOIN vox s ON s.image_id = g.image_id AND s.y BETWEEN g.y - 2 AND g.y AND s.x BETWEEN g.x - 2 AND g.x GROUP BY 1, 2, 3")
def w03_block_sum_part(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", "v")
    return plane(neighborhood.block_sum_part(own, SIZE, {"y": 3, "x": 3}, {"y": (2, 6), "x": (0, 5)}))


@query(f"WITH {VOX}, o AS (SELECT *, v > 120 AS front FROM vox) SELECT a.image_id, a.y, a.x, round(CASE WHEN a.front THEN -1 ELSE 1 END * sqrt(min((a.y-b.y)*(a.y-b.y)*4.0 + (a.x-b.x)*(a.x-b.x))), 6) AS v FROM o a LEFT JOIN o b ON b.image_id = a.image_id AND b.front <> a.front GROUP BY a.image_id, a.y, a.x, a.front")
def w11_signed_distance_map(spark, sf):
    """Rows lie twice as far apart as columns; null without another side."""
    own = mapping.images(spark, sf).withColumn("v", (F.col("v") > 120).cast("double")).drop("label")
    out = plane(neighborhood.signed_distances(own, {"y": 2.0, "x": 1.0}, ("x", "y")))
    return out.withColumn("v", F.when(F.abs("v") < float("inf"), F.round("v", 6)))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, count(*) AS n, sum(CASE WHEN abs(a.y - b.y) + abs(a.x - b.x) = 1 THEN b.v ELSE 0 END)::BIGINT AS four FROM vox a JOIN vox b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (a.y, a.x) <> (b.y, b.x) GROUP BY 1, 2, 3")
def w07_neighbours(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    pairs = neighborhood.neighbour_pairs(own, neighborhood.offsets(8, 2))
    near = F.abs(F.col("y") - F.col("ny")) + F.abs(F.col("x") - F.col("nx")) == 1
    return pairs.groupBy("image_id", "y", "x").agg(F.count("*").alias("n"), F.sum(F.when(near, F.col("nv")).otherwise(0)).alias("four"))


OBJECTS = f"{VOX}, f AS (SELECT image_id, y, x FROM vox WHERE v > 140), r AS (SELECT image_id, y, x, y * 8 + x AS m FROM f UNION SELECT f.image_id, f.y, f.x, r.m FROM r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) + abs(f.x - r.x) <= 1), c AS (SELECT image_id, y, x, min(m) AS m FROM r GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {OBJECTS}, s AS (SELECT image_id, m, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, m) AS label FROM c GROUP BY 1, 2 HAVING count(*) >= 4) SELECT image_id, y, x, label FROM c JOIN s USING (image_id, m)")
def g02_large_objects(spark, sf):
    labelled = graph.voxel_components(mapping.images(spark, sf).drop("label"), SIZE, 4, F.col("v") > 140)
    return graph.large_objects(labelled, 4).select("image_id", "y", "x", "label")


@query(f"WITH RECURSIVE {OBJECTS}, s AS (SELECT image_id, m, min(y * 10 + x) AS label FROM c WHERE (y + x) % 5 = 0 GROUP BY 1, 2) SELECT image_id, y, x, label FROM c JOIN s USING (image_id, m)")
def g02_seeded_objects(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    seeds = own.where("(y + x) % 5 = 0").withColumn("seed", F.col("y") * 10 + F.col("x"))
    return graph.seeded_objects(graph.voxel_components(own, SIZE, 4, F.col("v") > 140), seeds).select("image_id", "y", "x", "label")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity * l_linenumber - l_discount * -l_tax, 6) AS re, round(l_quantity * -l_tax + l_discount * l_linenumber, 6) AS im, round(sqrt(l_quantity * l_quantity + l_discount * l_discount), 6) AS size FROM lineitem")
def m17_complex(spark, sf):
    """(quantity + discount i) times the conjugate of (line number + tax i)."""
    rows = mapping.table(spark, sf, "lineitem")
    a, b = complexes.number(F.col("l_quantity"), F.col("l_discount")), complexes.number(F.col("l_linenumber"), F.col("l_tax"))
    rows = rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), complexes.multiply(a, complexes.conjugate(b)).alias("p"), complexes.magnitude(a).alias("size"))
    return rows.select("l_orderkey", "l_linenumber", F.round("p.re", 6).alias("re"), F.round("p.im", 6).alias("im"), F.round("size", 6).alias("size"))


HEAT = [(40.0, (0, 0, 0, 255), (10, 0, 90, 255)), (120.0, (250, 20, 0, 255), (0, 200, 30, 128)), (200.0, (255, 100, 60, 0), (255, 255, 255, 255))]


def _heat(i: int) -> str:
    (k0, l0, r0), (k1, l1, r1), (k2, l2, r2) = HEAT
    part = lambda low, high, a, b: f"{a} + CAST(trunc((v - {low}) / CAST({high - low} AS DOUBLE) * {b - a}) AS INT)"
    return f"CAST(CASE WHEN v <= {k0} THEN {l0[i]} WHEN v <= {k1} THEN {part(k0, k1, r0[i], l1[i])} WHEN v <= {k2} THEN {part(k1, k2, r1[i], l2[i])} ELSE {r2[i]} END AS INT)"


@query(f"WITH {VOX}, h AS (SELECT image_id, y, x, v, {', '.join(f'{_heat(i)} AS {k}' for i, k in enumerate(colours.CHANNELS))} FROM vox) SELECT image_id, y, x, {', '.join(f'{k} AS {k}, greatest({k}, CAST(v AS INT)) AS max_{k}, CAST(trunc(CAST(0.75 AS DOUBLE) * {k} + CAST(0.25 AS DOUBLE) * v) AS INT) AS mix_{k}' for k in colours.CHANNELS)} FROM h")
def m19_colours(spark, sf):
    """Levels by a colour map; the brighter of that and grey; a quarter of grey mixed in."""
    v = F.col("v")
    grey = F.struct(*(v.cast("int").alias(k) for k in colours.CHANNELS))
    rows = mapping.images(spark, sf).select("image_id", "y", "x", colours.mapped(v, HEAT).alias("c"), grey.alias("g"))
    rows = rows.select("image_id", "y", "x", "c", colours.brighter(F.col("c"), F.col("g")).alias("b"), colours.mixed(F.col("c"), F.col("g"), F.lit(0.25)).alias("m"))
    return rows.select("image_id", "y", "x", *(e for k in colours.CHANNELS for e in (F.col(f"c.{k}").alias(k), F.col(f"b.{k}").alias(f"max_{k}"), F.col(f"m.{k}").alias(f"mix_{k}"))))


# --- sources ------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT image_id, y // 3 AS y, x // 3 AS x, CAST(trunc(avg(v)) AS BIGINT) AS v FROM vox GROUP BY 1, 2, 3")
def s07_thumbnail(spark, sf):
    return plane(chunks.thumbnail(images(spark, sf), SIZE, 3)).withColumn("v", F.col("v").cast("bigint"))


@query(f"WITH {VOX} SELECT image_id, y, x, v FROM vox WHERE y >= 4 AND x < 4")
def s08_block_by_index(spark, sf):
    found = chunks.read_block(spark, container(spark, sf), 0, 2, {"z": 1, "y": 2, "x": 2})
    return chunks.to_voxels(found).select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS mesh_id, CAST(8 AS BIGINT) AS vertices, CAST(12 AS BIGINT) AS triangles, round(CAST(6 * (s_suppkey % 9 + 1) * (s_suppkey % 9 + 1) AS DOUBLE), 6) AS area FROM supplier")
def s17_obj(spark, sf):
    """Cubes written as mesh texts and read again."""
    v, t = cubes(mapping.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("mesh_id"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("side")))
    path = scratch(spark, "meshes")
    text.write_obj(v, t, path)
    v, t = (x.withColumn("mesh_id", F.col("mesh_id").cast("bigint")) for x in text.read_obj(spark, path))
    counts = v.groupBy("mesh_id").agg(F.count("*").alias("vertices"))
    return mesh.properties(v, t).join(counts, "mesh_id").select("mesh_id", "vertices", "triangles", F.round("area", 6).alias("area"))
