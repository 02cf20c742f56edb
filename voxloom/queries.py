"""The operators as queries over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom import mapping
from voxloom.functions import geometry, saturate, text
from voxloom.functions.units import unit_factor
from voxloom.operators import aggregate, graph, joins, matching, mesh, neighborhood, ordering, region, sampling, threshold, tree, voxel
from voxloom.plans import composites
from voxloom.storage import shared_dir
from voxloom.streaming import progressive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIZE = {"t": 1, "c": 1, "z": 1, "y": 8, "x": 8}

# Images, volumes, puncta, forest and time series as SQL.
LEVEL = "CAST(least(greatest(round((CAST(e AS DOUBLE) + 1) * 127.5), 0), 255) AS BIGINT)"
VOX = f"vox AS (SELECT vec_id AS image_id, CAST(label AS BIGINT) AS label, (p - 1) // 8 AS y, (p - 1) % 8 AS x, {LEVEL} AS v FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings))"
VOL = f"vol AS (SELECT vec_id AS image_id, (p - 1) // 16 AS z, (p - 1) // 4 % 4 AS y, (p - 1) % 4 AS x, {LEVEL} AS v FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(1, 65)) AS p FROM embeddings))"
PTS = "pts AS (SELECT l_orderkey AS pid, l_suppkey AS set_id, CAST(l_quantity AS DOUBLE) AS x, round(l_discount * 100) AS y, round(l_tax * 100) AS z, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem)"
TREE = """tree0 AS (SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(-1 AS BIGINT) AS parent_id, CAST(r_regionkey AS DOUBLE) AS x FROM region
  UNION ALL SELECT n_nationkey + 100, n_regionkey, CAST(n_nationkey AS DOUBLE) FROM nation
  UNION ALL SELECT c_custkey + 1000, c_nationkey + 100, c_acctbal / 100 FROM customer),
tree AS (SELECT id, parent_id, x, CAST(id % 17 AS DOUBLE) AS y, CAST(id % 5 AS DOUBLE) AS z, CAST(id % 7 + 1 AS DOUBLE) AS radius FROM tree0)"""
UP = "up AS (SELECT id, id AS ancestor, CAST(0 AS BIGINT) AS steps, parent_id FROM tree UNION ALL SELECT u.id, t.id, u.steps + 1, t.parent_id FROM up u JOIN tree t ON t.id = u.parent_id)"
EDGE = "edge AS (SELECT c.*, coalesce(sqrt((c.x-p.x)*(c.x-p.x) + (c.y-p.y)*(c.y-p.y) + (c.z-p.z)*(c.z-p.z)), 0) AS edge FROM tree c LEFT JOIN tree p ON c.parent_id = p.id)"
SERIES = "series AS (SELECT user_id, event_id, ts, value AS v FROM events)"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def plane(voxels: DataFrame) -> DataFrame:
    return voxels.select("image_id", "y", "x", "v")


# --- addressing -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT image_id, y - 2 AS y, x - 2 AS x, v FROM vox WHERE y >= 2 AND y < 6 AND x >= 2 AND x < 6")
def v01_crop(spark, sf):
    return plane(region.crop(mapping.images(spark, sf), {"y": (2, 6), "x": (2, 6)}))


@query("WITH i AS (SELECT CAST(range AS BIGINT) AS idx FROM range(-300, 700)) SELECT idx, CAST(floor(idx / 240.0) AS BIGINT) AS t, ((idx % 240 + 240) % 240) // 120 AS c, ((idx % 120 + 120) % 120) // 20 AS z, ((idx % 20 + 20) % 20) // 5 AS y, (idx % 5 + 5) % 5 AS x, idx AS back FROM i")
def v02_index_coord(spark, sf):
    size = {"t": 1, "c": 2, "z": 6, "y": 4, "x": 5}
    rows = spark.range(-300, 700).withColumnRenamed("id", "idx").withColumns(region.coordinates(F.col("idx"), size))
    return rows.withColumn("back", region.linear_index(size))


PADS = {
    "replicate": "least(greatest({0} - 2, 0), 7)",
    "circular": "({0} - 2 + 8) % 8",
    "symmetric": "CASE WHEN ({0} - 2 + 16) % 16 < 8 THEN ({0} - 2 + 16) % 16 ELSE 15 - ({0} - 2 + 16) % 16 END",
    "constant": "CASE WHEN {0} - 2 BETWEEN 0 AND 7 THEN {0} - 2 END",
}
for _pad, _rule in PADS.items():

    @query(
        f"WITH {VOX}, g AS (SELECT image_id, ry.range AS y, rx.range AS x FROM (SELECT DISTINCT image_id FROM vox) CROSS JOIN range(12) ry CROSS JOIN range(12) rx) SELECT g.image_id, g.y, g.x, coalesce(s.v, 7) AS v FROM g LEFT JOIN vox s ON s.image_id = g.image_id AND s.y = {_rule.format('g.y')} AND s.x = {_rule.format('g.x')}",
        f"v03_pad_{_pad}",
    )
    def _padded(spark, sf, pad=_pad):
        out = region.crop_with_pad(mapping.images(spark, sf).select("image_id", "t", "c", "z", "y", "x", "v"), SIZE, {"y": (-2, 10), "x": (-2, 10)}, pad, 7)
        return out.select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


@query(f"WITH {VOX} SELECT image_id, x, v FROM vox WHERE y = 3")
def v04_extract_row(spark, sf):
    return region.extract(mapping.images(spark, sf), y=3, z=0).select("image_id", "x", "v")


@query(f"WITH {VOX}, e AS (SELECT image_id, 0 AS y, 0 AS x, CAST(300 AS DOUBLE) AS n FROM vox WHERE y = 0 AND x = 0) SELECT a.image_id, a.y, a.x, CASE WHEN e.n IS NULL THEN a.v ELSE CAST(least(greatest(round(e.n), 0), 255) AS BIGINT) END AS v FROM vox a LEFT JOIN e ON a.image_id = e.image_id AND a.y = e.y AND a.x = e.x")
def v06_set_value(spark, sf):
    own = mapping.images(spark, sf)
    edits = own.where("y = 0 AND x = 0").withColumn("v", F.lit(300.0))
    return plane(voxel.edit(own, edits, "uint8")).withColumn("v", F.col("v").cast("bigint"))


@query("SELECT row_number() OVER (ORDER BY ry.range, rx.range) - 1 AS tile_id, CAST(rx.range AS BIGINT) AS x0, least(CAST(rx.range AS BIGINT) + 16, 50) AS x1, CAST(ry.range AS BIGINT) AS y0, least(CAST(ry.range AS BIGINT) + 16, 40) AS y1, greatest(CAST(rx.range AS BIGINT) - 4, 0) AS hx0, least(CAST(rx.range AS BIGINT) + 20, 50) AS hx1, greatest(CAST(ry.range AS BIGINT) - 4, 0) AS hy0, least(CAST(ry.range AS BIGINT) + 20, 40) AS hy1 FROM range(0, 40, 16) ry CROSS JOIN range(0, 50, 16) rx")
def v09_split_tiles(spark, sf):
    names = ["tile_id", "x0", "x1", "y0", "y1", "hx0", "hx1", "hy0", "hy1"]
    return spark.createDataFrame([tuple(t[n] for n in names) for t in region.tiles(50, 40, 16, 4)], ", ".join(f"{n} long" for n in names))


@query(f"WITH {PTS}, k AS (SELECT pid, x, y, unnest(range(CAST(floor((x - 2) / 16) AS BIGINT), CAST(floor((x + 2) / 16) AS BIGINT) + 1)) AS tile_x FROM pts), l AS (SELECT *, unnest(range(CAST(floor((y - 2) / 16) AS BIGINT), CAST(floor((y + 2) / 16) AS BIGINT) + 1)) AS tile_y FROM k) SELECT pid, x, y, tile_x, tile_y, CAST(floor(x / 16) = tile_x AND floor(y / 16) = tile_y AS BIGINT) AS core FROM l WHERE tile_x >= 0 AND tile_y >= 0")
def v09_halo_points(spark, sf):
    return region.with_tiles(mapping.puncta_voxels(spark, sf), 16, 2).select("pid", "x", "y", "tile_x", "tile_y", F.col("core").cast("bigint").alias("core"))


# --- voxel algebra --------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT image_id, y, x, CAST(CASE WHEN v >= 140 THEN 33 ELSE v END AS BIGINT) AS above, CAST(CASE WHEN v < 120 THEN 0 ELSE v END AS BIGINT) AS below FROM vox")
def v11_threshold(spark, sf):
    own = mapping.images(spark, sf)
    below = F.when(voxel.matches(120, "below", False), 0).otherwise(F.col("v"))
    return voxel.threshold(own.withColumn("below", below.cast("bigint")), 140, "above", True, 33).select("image_id", "y", "x", F.col("v").alias("above"), "below")


@query(f"WITH {VOX} SELECT image_id, sum(CASE WHEN v > 130 THEN 1 ELSE 0 END)::BIGINT AS front, count(*) AS n FROM vox GROUP BY image_id")
def v12_binarize(spark, sf):
    return voxel.binarized(mapping.images(spark, sf), F.col("v") > 130).groupBy("image_id").agg(F.sum("v").alias("front"), F.count("*").alias("n"))


@query(f"WITH {VOX}, r AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY image_id) SELECT image_id, y, x, CAST(round(CASE WHEN hi > lo THEN (CAST(v AS DOUBLE) - lo) / (hi - lo) ELSE 0 END * 255.0) AS BIGINT) AS v FROM vox JOIN r USING (image_id)")
def v13_normalize(spark, sf):
    return plane(voxel.normalize(mapping.images(spark, sf), "uint8")).withColumn("v", F.col("v").cast("bigint"))


@query(f"WITH {VOX} SELECT image_id, y, x, CAST(least(greatest(round(v * 2.5 - 300), -128), 127) AS BIGINT) AS v FROM vox")
def v14_cast(spark, sf):
    return plane(voxel.unary(mapping.images(spark, sf), lambda v: v * 2.5 - 300, "int8")).withColumn("v", F.col("v").cast("bigint"))


@query(f"WITH {VOX} SELECT image_id, y, x, CAST(round(CAST(v AS DOUBLE) / 255 * 65535.0) AS BIGINT) AS v FROM vox")
def v15_convert(spark, sf):
    return plane(voxel.convert_to(mapping.images(spark, sf), "uint8", "uint16")).withColumn("v", F.col("v").cast("bigint"))


@query(f"WITH {VOX} SELECT image_id, y, 7 - x AS x, v FROM vox")
def v16_flip(spark, sf):
    return plane(voxel.flip(mapping.images(spark, sf), SIZE, ["x"]))


@query(f"WITH {VOX} SELECT image_id, 7 - y AS y, 7 - x AS x, v FROM vox")
def v16_reflect(spark, sf):
    return plane(voxel.flip(mapping.images(spark, sf), SIZE, list(SIZE)))


@query(f"WITH {VOX} SELECT image_id, x AS y, y AS x, v FROM vox")
def v17_transpose(spark, sf):
    return plane(voxel.transpose(mapping.images(spark, sf)))


@query(f"WITH {VOX} SELECT image_id, y, x, CAST(least(round(sqrt(v) * 10), 255) AS BIGINT) AS v FROM vox")
def v19_unary(spark, sf):
    return plane(voxel.unary(mapping.images(spark, sf), lambda v: F.sqrt(v) * 10, "uint8")).withColumn("v", F.col("v").cast("bigint"))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, CASE WHEN b.v = 0 THEN 0 ELSE CAST(least(round(a.v / (b.v / 255.0)), 255) AS BIGINT) END AS v FROM vox a JOIN vox b ON b.image_id = a.image_id + 1 AND a.y = b.y AND a.x = b.x WHERE a.image_id % 2 = 0")
def v20_unpremultiply(spark, sf):
    own = mapping.images(spark, sf).withColumn("c", F.col("image_id") % 2).withColumn("image_id", F.col("image_id") - F.col("image_id") % 2)
    return voxel.unpremultiplied(own, 1).where("c = 0").select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


# --- saturating arithmetic --------------------------------------------------------------------------------------------------------------

PAIRS = "p AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 5 AS a, CAST(l_linenumber AS BIGINT) * 40 - 40 AS b, CAST(l_quantity AS BIGINT) * 5 - 128 AS sa, CAST(l_linenumber AS BIGINT) * 40 - 160 AS sb FROM lineitem)"


def pairs(spark, sf):
    q, n = F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")
    return mapping.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (q * 5).alias("a"), (n * 40 - 40).alias("b"), (q * 5 - 128).alias("sa"), (n * 40 - 160).alias("sb"))


def _clamped(op: str) -> str:
    return f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(least(greatest(a {op} b, 0), 255) AS BIGINT) AS u, CAST(least(greatest(sa {op} sb, -128), 127) AS BIGINT) AS s FROM p"


def _both(rows, f):
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), f(F.col("a"), F.col("b"), "uint8").cast("bigint").alias("u"), f(F.col("sa"), F.col("sb"), "int8").cast("bigint").alias("s"))


for _name, _op, _f in (("m02_sat_add", "+", saturate.add), ("m03_sat_sub", "-", saturate.sub), ("m04_sat_mul", "*", saturate.mul)):

    @query(f"WITH {PAIRS} {_clamped(_op)}", _name)
    def _saturating(spark, sf, f=_f):
        return _both(pairs(spark, sf), f)


QUOTIENT = "CASE WHEN {b} = 0 THEN {zero} ELSE least(greatest(CAST(trunc(CAST({a} AS DOUBLE) / {b}) AS BIGINT), {lo}), {hi}) END"


@query(f"WITH {PAIRS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({QUOTIENT.format(a='a', b='b', lo=0, hi=255, zero='CASE WHEN a = 0 THEN 0 ELSE 255 END')} AS BIGINT) AS u, CAST({QUOTIENT.format(a='sa', b='sb', lo=-128, hi=127, zero='CASE WHEN sa = 0 THEN 0 WHEN sa > 0 THEN 127 ELSE -128 END')} AS BIGINT) AS s FROM p")
def m05_sat_div(spark, sf):
    return _both(pairs(spark, sf), saturate.div)


@query(f"WITH {PAIRS} SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST({QUOTIENT.format(a='a', b='b', lo=0, hi=255, zero=0)} AS BIGINT) AS u, CAST({QUOTIENT.format(a='sa', b='sb', lo=-128, hi=127, zero=0)} AS BIGINT) AS s FROM p")
def m06_sat_div_secure(spark, sf):
    return _both(pairs(spark, sf), saturate.div_secure)


@query(f"WITH {VOX} SELECT image_id, y, x, least(v + 130, 255) AS plus, greatest(v - 130, 0) AS minus, least(v * 2, 255) AS times, v // 3 AS over FROM vox")
def m07_image_scalar(spark, sf):
    own = mapping.images(spark, sf)
    v = F.col("v")
    return own.select("image_id", "y", "x", *(saturate.OPERATIONS[o](v, F.lit(n), "uint8").cast("bigint").alias(k) for o, n, k in (("+", 130, "plus"), ("-", 130, "minus"), ("*", 2, "times"), ("/", 3, "over"))))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, least(a.v + b.v, 255) AS v FROM vox a JOIN vox b ON b.image_id = a.image_id AND b.y = a.y AND b.x = 7 - a.x")
def m08_image_image(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return plane(voxel.image_op(own, voxel.flip(own, SIZE, ["x"]), "+")).withColumn("v", F.col("v").cast("bigint"))


M09 = "(SELECT image_id, y, x, v FROM vox) , o AS (SELECT image_id, y, x, CASE WHEN k = 1 AND image_id = 7 AND y = 3 AND x = 4 THEN v + 1 ELSE v END AS v, k FROM vox CROSS JOIN (SELECT unnest([0, 1]) AS k)), t AS (SELECT image_id, y, 7 - x AS x, v, 2 AS k FROM vox)"


@query(f"WITH {VOX}, s AS {M09}, u AS (SELECT * FROM o UNION ALL SELECT image_id, y, x, v, k FROM t) SELECT CAST(k AS BIGINT) AS k, CAST((SELECT count(*) FROM ((SELECT image_id, y, x, v FROM u WHERE u.k = g.k EXCEPT SELECT * FROM s) UNION ALL (SELECT * FROM s EXCEPT SELECT image_id, y, x, v FROM u WHERE u.k = g.k))) = 0 AS BIGINT) AS same FROM (SELECT unnest([0, 1, 2]) AS k) g")
def m09_image_equality(spark, sf):
    """The images against themselves, against a copy with one other voxel, and against their mirror images."""
    own = mapping.images(spark, sf)
    other = own.withColumn("v", F.when(F.expr("image_id = 7 AND y = 3 AND x = 4"), F.col("v") + 1).otherwise(F.col("v")))
    return spark.createDataFrame([(k, int(voxel.equal(own, x))) for k, x in enumerate((own, other, voxel.flip(own, SIZE, ["x"])))], "k long, same long")


@query("SELECT p_partkey, round(CAST(p_size AS DOUBLE) * CAST(25.4 AS DOUBLE), 6) AS mm, round(CAST(p_size AS DOUBLE) * CAST(0.0254 AS DOUBLE), 6) AS m FROM part")
def m10_units(spark, sf):
    part = mapping.table(spark, sf, "part")
    return part.select("p_partkey", F.round(F.col("p_size") * unit_factor("inch", "mm"), 6).alias("mm"), F.round(F.col("p_size") * unit_factor("inch", "m"), 6).alias("m"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY n, c_custkey) AS place, n AS last_number FROM (SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS n FROM customer)")
def m11_natural_sort(spark, sf):
    rows = mapping.table(spark, sf, "customer").select("c_custkey", text.last_integer(F.col("c_name")).alias("last_number"), F.regexp_replace("c_name", "#0*", "#").alias("_n"))
    return ordering.numbered(rows.withColumn("_k", text.natural_key(F.col("_n"))), [F.col("_k"), F.col("c_custkey")], "place").select("c_custkey", "place", "last_number")


@query("SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS brand, TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) AS size FROM part")
def m12_numbers(spark, sf):
    return mapping.table(spark, sf, "part").select("p_partkey", text.number(F.col("p_brand")).alias("brand"), text.number(F.col("p_size").cast("string")).alias("size"))


@query("SELECT p_partkey, CAST(" + " + ".join(f"(((p_size >> {k}) & 1) << {2 * k}) + (((p_partkey >> {k}) & 1) << {2 * k + 1})" for k in range(6)) + " AS BIGINT) AS code FROM part")
def m13_morton(spark, sf):
    return mapping.table(spark, sf, "part").select("p_partkey", geometry.morton([F.col("p_size"), F.col("p_partkey")], [6, 6]).alias("code"))


@query(f"WITH {PTS} SELECT pid, x, y, z, round(sqrt((x-5)*(x-5) + y*y + z*z), 6) AS to_point, round(CASE WHEN x <= 10 THEN sqrt((x-10)*(x-10) + y*y + z*z) WHEN x >= 40 THEN sqrt((x-40)*(x-40) + y*y + z*z) ELSE sqrt(y*y + z*z) END, 6) AS to_segment FROM pts")
def m14_distances(spark, sf):
    p, lit = [F.col(x) for x in "xyz"], lambda *v: [F.lit(float(x)) for x in v]
    return mapping.puncta_voxels(spark, sf).select("pid", *"xyz", F.round(geometry.distance(p, lit(5, 0, 0)), 6).alias("to_point"), F.round(geometry.segment_distance(p, lit(10, 0, 0), lit(40, 0, 0)), 6).alias("to_segment"))


@query(f"WITH {PTS} SELECT pid, round(2*x - y + 3, 6) AS x, round(x + y, 6) AS y, round(z * 0.5 - 1, 6) AS z FROM pts")
def m15_affine(spark, sf):
    moved = geometry.affine([F.col(x) for x in "xyz"], [[2, -1, 0, 3], [1, 1, 0, 0], [0, 0, 0.5, -1]])
    return mapping.puncta_voxels(spark, sf).select("pid", *(F.round(v, 6).alias(x) for v, x in zip(moved, "xyz", strict=True)))


# --- aggregations -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT image_id, min(v) AS min_v, max(v) AS max_v FROM vox GROUP BY image_id")
def a01_minmax(spark, sf):
    return aggregate.min_max(mapping.images(spark, sf), ["image_id"])


@query(f"WITH {VOX} SELECT image_id, CAST(sum(v) AS DOUBLE) AS sum_v FROM vox GROUP BY image_id")
def a02_sum(spark, sf):
    return aggregate.total(mapping.images(spark, sf), ["image_id"])


@query(f"WITH {VOX} SELECT CAST(b.range AS BIGINT) AS bin, count(v) AS n FROM range(16) b LEFT JOIN vox ON (v - 60) * 16 // 141 = b.range AND v BETWEEN 60 AND 200 GROUP BY 1")
def a03_histogram(spark, sf):
    return aggregate.histogram(mapping.images(spark, sf), 60, 200, 16)


@query(f"WITH {VOX} SELECT CAST(b.range AS BIGINT) AS bin, count(v) AS n FROM range(16) b LEFT JOIN (SELECT * FROM vox WHERE label >= 5) ON (v - 60) * 16 // 141 = b.range AND v BETWEEN 60 AND 200 GROUP BY 1")
def a03_histogram_mask(spark, sf):
    own = mapping.images(spark, sf)
    return aggregate.histogram(own, 60, 200, 16, own.withColumn("v", (F.col("label") >= 5).cast("int")))


@query("SELECT CAST(range AS BIGINT) AS bin, CAST(range * 8.8125 + 60 AS DOUBLE) AS low, CAST((range + 1) * 8.8125 + 60 AS DOUBLE) AS high FROM range(16)")
def a04_bin_range(spark, sf):
    low, high = aggregate.bin_range(60, 200, 16, F.col("bin"))
    return spark.range(16).withColumnRenamed("id", "bin").select("bin", low.alias("low"), high.alias("high"))


for _mode, _sql in {"max": "max(v)", "min": "min(v)", "mean": "CAST(trunc(avg(v)) AS BIGINT)", "median": "CAST(trunc(quantile_cont(v, 0.5)) AS BIGINT)", "first": "arg_min(v, {0})"}.items():

    @query(f"WITH {VOX} SELECT image_id, x, {_sql.format('y')} AS v FROM vox WHERE y BETWEEN 1 AND 6 GROUP BY image_id, x", f"a05_project_{_mode}")
    def _projected(spark, sf, mode=_mode):
        return aggregate.project(mapping.images(spark, sf), "y", mode, 1, 6).select("image_id", "x", "v")

    @query(f"WITH {VOX} SELECT label, y, x, {_sql.format('image_id')} AS v FROM vox GROUP BY label, y, x", f"a06_combine_{_mode}")
    def _combined(spark, sf, mode=_mode):
        own = mapping.images(spark, sf).withColumn("label", F.col("label").cast("bigint"))
        return aggregate.combine(own, mode, "image_id", ["label", "y", "x"])

    @query(f"WITH {VOX} SELECT image_id, y // 3 AS y, x // 3 AS x, {_sql.format('y * 8 + x')} AS v FROM vox GROUP BY 1, 2, 3", f"a07_block_{_mode}")
    def _blocks(spark, sf, mode=_mode):
        return plane(aggregate.block_downsample(mapping.images(spark, sf), {"y": 3, "x": 3}, mode))


@query(f"WITH {VOX} SELECT image_id, y, x, v FROM (SELECT *, max(v) OVER (PARTITION BY image_id) AS m FROM vox) WHERE v = m")
def a08_argmax(spark, sf):
    return plane(aggregate.arg_max(mapping.images(spark, sf)))


@query("SELECT l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS variance, round(var_samp(l_quantity), 6) AS sample_variance, round(stddev_pop(l_quantity), 6) AS sd, round(stddev_samp(l_quantity), 6) AS sample_sd, min(l_quantity) AS min, max(l_quantity) AS max, round(quantile_cont(l_quantity, 0.5), 6) AS median FROM lineitem GROUP BY l_suppkey")
def a09_stats(spark, sf):
    out = aggregate.moments(mapping.table(spark, sf, "lineitem"), "l_quantity", ["l_suppkey"])
    return out.select("l_suppkey", "n", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "sample_variance", "sd", "sample_sd")), "min", "max", F.round("median", 6).alias("median"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY event_type")
def a10_median(spark, sf):
    return aggregate.moments(mapping.table(spark, sf, "events"), "value", ["event_type"]).select("event_type", "median")


@query("SELECT event_type, round(quantile_cont(value, 0.01), 6) AS p0, round(quantile_cont(value, 0.99), 6) AS p1 FROM events GROUP BY event_type")
def a11_percentile_window(spark, sf):
    return aggregate.percentile_window(mapping.table(spark, sf, "events"), "value", by=["event_type"]).select("event_type", F.round("p0", 6).alias("p0"), F.round("p1", 6).alias("p1"))


@query(f"WITH {VOX}, c AS (SELECT image_id, v, count(*) AS n FROM vox GROUP BY 1, 2) SELECT image_id, min(v) AS min, max(v) AS max, max(v) - min(v) + 1 AS length, CAST(sum(n) AS BIGINT) AS count, CAST(sum(v * n) AS BIGINT) AS sum, arg_max(v, (n, -v)) AS mode, CAST(sum(CASE WHEN v > 130 THEN n ELSE 0 END) AS BIGINT) AS upper FROM c GROUP BY image_id")
def a12_integer_histogram(spark, sf):
    return aggregate.integer_histogram(mapping.images(spark, sf), 130, ["image_id"])


MOMENTS = "m AS (SELECT pid, count(*) AS n, sum(v) AS w, sum(v*x)/sum(v) AS x, sum(v*y)/sum(v) AS y, sum(v*z)/sum(v) AS z, sum(v*x*x)/sum(v) AS xx, sum(v*y*y)/sum(v) AS yy, sum(v*z*z)/sum(v) AS zz, sum(v*x*y)/sum(v) AS xy, avg(v) AS mean, var_samp(v) AS var, max(v) AS top FROM pts GROUP BY pid)"


@query(f"WITH {PTS}, {MOMENTS} SELECT pid, round(w, 2) AS w, round(x, 4) AS mean_x, round(y, 4) AS mean_y, round(xx - x*x, 3) AS cov_xx, round(xy - x*y, 3) AS cov_xy FROM m")
def a13_weighted_moments(spark, sf):
    out = aggregate.weighted_moments(mapping.puncta_voxels(spark, sf), "v", ("x", "y", "z"), ["pid"])
    return out.select("pid", F.round("w", 2).alias("w"), *(F.round(c, n).alias(c) for c, n in (("mean_x", 4), ("mean_y", 4), ("cov_xx", 3), ("cov_xy", 3))))


@query(f"WITH {PTS}, {MOMENTS} SELECT pid, n AS vol_size, round(w, 2) AS mass, round(mean, 5) AS mean_intensity, round(coalesce(var, 0) / 1e6, 4) AS sd_intensity, round(top, 2) AS max_intensity, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(CASE WHEN n = 1 THEN 0.5 ELSE sqrt({aggregate.CHI2_95_3}) * sqrt(greatest(xx - x*x + yy - y*y + zz - z*z, 0) / 3) END, 3) AS radius FROM m")
def a14_punctum(spark, sf):
    out = aggregate.puncta(mapping.puncta_voxels(spark, sf))
    return out.select("pid", "vol_size", F.round("mass", 2).alias("mass"), F.round("mean_intensity", 5).alias("mean_intensity"), F.round(F.col("sd_intensity") / 1e6, 4).alias("sd_intensity"), F.round("max_intensity", 2).alias("max_intensity"), *(F.round(c, 4).alias(c) for c in "xyz"), F.round("radius", 3).alias("radius"))


@query(f"WITH {PTS}, {MOMENTS} SELECT pid % 100 AS g, round(sum(x * n) / sum(n), 4) AS x, round(sum(w), 2) AS mass, CAST(sum(n) AS BIGINT) AS vol_size, round(max(top), 2) AS max_intensity, round(sum(w) / sum(n), 5) AS mean_intensity, CAST(1 AS DOUBLE) AS score FROM m GROUP BY 1")
def a15_punctum_merge(spark, sf):
    out = aggregate.merge_puncta(aggregate.puncta(mapping.puncta_voxels(spark, sf)).withColumn("g", F.col("pid") % 100), "g")
    return out.select("g", F.round("x", 4).alias("x"), F.round("mass", 2).alias("mass"), "vol_size", F.round("max_intensity", 2).alias("max_intensity"), F.round("mean_intensity", 5).alias("mean_intensity"), "score")


@query(f"WITH {VOX} SELECT label, count(*) AS size, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1 FROM vox WHERE v > 150 GROUP BY label")
def a16_label_bbox(spark, sf):
    return aggregate.label_boxes(mapping.images(spark, sf).where("v > 150").withColumn("label", F.col("label").cast("bigint")), axes=("x", "y"))


@query(f"WITH {TREE}, {EDGE} SELECT count(*) AS nodes, round(sum(edge), 4) AS length FROM edge")
def a18_tree_length(spark, sf):
    out = tree.total_length(mapping.tree(spark, sf))
    return out.select("nodes", F.round("length", 4).alias("length"))


@query(f"WITH {VOX}, n AS (SELECT image_id, count(*) AS n FROM vox WHERE v > 140 GROUP BY 1) SELECT image_id, y, x, v FROM vox JOIN n USING (image_id) WHERE v > 140 AND n > 15")
def a22_remove_small(spark, sf):
    return plane(aggregate.remove_small(mapping.images(spark, sf).where("v > 140"), 15, "image_id"))


# --- windows and neighbourhoods -----------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT image_id, y, x, CAST(least(sum(v) OVER (PARTITION BY image_id, y ORDER BY x), 1000) AS BIGINT) AS v FROM vox")
def w01_cumsum(spark, sf):
    return plane(aggregate.cumulative_sum(mapping.images(spark, sf), "x", 0, 1000))


@query(f"WITH RECURSIVE {VOX}, s AS (SELECT image_id, y, x, v - 128 AS v FROM vox), r AS (SELECT image_id, y, x, greatest(least(v, 40), -40) AS v FROM s WHERE x = 0 UNION ALL SELECT s.image_id, s.y, s.x, greatest(least(r.v + s.v, 40), -40) FROM r JOIN s ON s.image_id = r.image_id AND s.y = r.y AND s.x = r.x + 1) SELECT image_id, y, x, CAST(v AS BIGINT) AS v FROM r")
def w01_cumsum_signed(spark, sf):
    own = mapping.images(spark, sf).withColumn("v", F.col("v") - 128)
    return plane(aggregate.cumulative_sum(own, "x", -40, 40))


@query(f"WITH {VOX}, g AS (SELECT image_id, ry.range AS y, rx.range AS x FROM (SELECT DISTINCT image_id FROM vox) CROSS JOIN range(10) ry CROSS JOIN range(10) rx) SELECT g.image_id, g.y, g.x, CAST(coalesce(sum(v), 0) AS BIGINT) AS v FROM g LEFT JOIN vox s ON s.image_id = g.image_id AND s.y BETWEEN g.y - 2 AND g.y AND s.x BETWEEN g.x - 2 AND g.x GROUP BY 1, 2, 3")
def w02_block_sum(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", "v")
    return plane(neighborhood.block_sum(own, SIZE, {"y": 3, "x": 3}))


@query(f"WITH {SERIES} SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM series")
def w04_mean_smooth(spark, sf):
    return neighborhood.mean_smooth(mapping.table(spark, sf, "events"), 5, "event_id", ["user_id"], "value").select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {SERIES}, w AS (SELECT event_id, v, list_sort(list(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS a FROM series) SELECT event_id, CASE WHEN len(a) % 2 = 0 AND a[len(a) // 2] = v THEN v ELSE a[len(a) // 2 + 1] END AS smooth FROM w")
def w04_median_filter(spark, sf):
    return neighborhood.median_filter(mapping.table(spark, sf, "events"), 5, "event_id", ["user_id"], "value").select("event_id", "smooth")


KERNEL = np.array([[1, 2, 0], [-1, 3, 1], [0, 1, -2]])
KERNEL_SQL = ", ".join(f"({dy - 1}, {dx - 1}, {w})" for (dy, dx), w in np.ndenumerate(KERNEL))


@query(f"WITH {VOX}, k(dy, dx, w) AS (VALUES {KERNEL_SQL}) SELECT a.image_id, a.y, a.x, round(CAST(sum(b.v * w) AS DOUBLE), 6) AS v FROM vox a CROSS JOIN k JOIN vox b ON b.image_id = a.image_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY 1, 2, 3")
def w05_convolve(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", "v")
    return plane(neighborhood.correlate(own, KERNEL, SIZE, "replicate")).withColumn("v", F.round("v", 6))


_G = neighborhood.gaussian(1.0, 2)
GAUSS_SQL = ", ".join(f"({i - 2}, {w!r})" for i, w in enumerate(_G.tolist()))


@query(f"WITH {VOX}, k(d, w) AS (VALUES {GAUSS_SQL}) SELECT a.image_id, a.y, a.x, round(sum(b.v * CAST(ky.w AS DOUBLE) * kx.w), 4) AS v FROM vox a CROSS JOIN k ky CROSS JOIN k kx JOIN vox b ON b.image_id = a.image_id AND b.y = a.y + ky.d AND b.x = a.x + kx.d GROUP BY 1, 2, 3")
def w06_gaussian(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", "v")
    return plane(neighborhood.correlate(own, np.outer(_G, _G), SIZE)).withColumn("v", F.round("v", 4))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, max(b.v) AS v FROM vox a JOIN vox b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3")
def w09_dilate(spark, sf):
    return plane(neighborhood.rank_filter(mapping.images(spark, sf), 8, 2, "dilate"))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, round(CAST(quantile_cont(b.v, 0.5) AS DOUBLE), 6) AS v FROM vox a JOIN vox b ON b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 GROUP BY 1, 2, 3")
def w09_median(spark, sf):
    return plane(neighborhood.rank_filter(mapping.images(spark, sf), 8, 2, "median")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query(f"WITH {VOX}, b AS (SELECT image_id, y, x, CAST(v > 130 AS INT) AS v FROM vox) SELECT a.image_id, a.y, a.x, CAST(coalesce(sum(n.v), 0) >= 4 AS BIGINT) AS v FROM b a LEFT JOIN b n ON n.image_id = a.image_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1 AND (n.y, n.x) <> (a.y, a.x) GROUP BY 1, 2, 3")
def w09_majority(spark, sf):
    own = voxel.binarized(mapping.images(spark, sf), F.col("v") > 130)
    return plane(neighborhood.majority(own, 8, 2, 4))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, CAST(coalesce(min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x)), -1) AS DOUBLE) AS v FROM vox a LEFT JOIN vox b ON b.image_id = a.image_id AND b.v <= 120 GROUP BY 1, 2, 3")
def w11_distance_map(spark, sf):
    own = mapping.images(spark, sf).withColumn("v", (F.col("v") > 120).cast("double")).drop("label")
    return plane(neighborhood.squared_distances(own, axes=("x", "y"))).withColumn("v", F.when(F.col("v") == float("inf"), -1.0).otherwise(F.col("v")))


RESIZE_SQL = ", ".join(f"({i}, {k}, CAST({w!r} AS DOUBLE))" for i, k, w in neighborhood.contributions(8, 5))


@query(f"WITH {VOX}, k(o, i, w) AS (VALUES {RESIZE_SQL}) SELECT image_id, CAST(ky.o AS BIGINT) AS y, CAST(kx.o AS BIGINT) AS x, round(sum(v * ky.w * kx.w), 6) AS v FROM vox JOIN k ky ON ky.i = y JOIN k kx ON kx.i = x GROUP BY 1, 2, 3")
def w14_resize_linear(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", "v")
    return plane(neighborhood.resize(own, SIZE, {"y": 5, "x": 5})).withColumn("v", F.round("v", 6))


# --- joins --------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, abs(a.v - b.v) AS v FROM vox a JOIN vox b ON b.image_id = a.image_id AND b.y = a.y AND b.x = 7 - a.x")
def j01_binary_op(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return plane(voxel.binary(own, voxel.flip(own, SIZE, ["x"]), lambda a, b: F.abs(a - b)))


@query(f"WITH {VOX} SELECT a.image_id, a.y, a.x, a.v FROM vox a WHERE EXISTS (SELECT 1 FROM vox m WHERE m.image_id = a.image_id + 1 AND m.y = a.y AND m.x = a.x AND m.v > 140)")
def j02_mask_semi(spark, sf):
    own = mapping.images(spark, sf)
    mask = voxel.binarized(own, F.col("v") > 140).withColumn("image_id", F.col("image_id") - 1)
    return plane(voxel.masked(own, mask))


PATCH = "p AS (SELECT image_id, y + 5 AS y, x + 6 AS x, v FROM vox)"


@query(f"WITH {VOX}, {PATCH} SELECT a.image_id, a.y, a.x, coalesce(p.v, a.v) AS v FROM vox a LEFT JOIN p USING (image_id, y, x)")
def j03_paste(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return plane(voxel.paste(own, own, {"y": 5, "x": 6}))


@query(f"WITH {VOX}, {PATCH} SELECT a.image_id, a.y, a.x, greatest(coalesce(p.v, a.v), a.v) AS v FROM vox a LEFT JOIN p USING (image_id, y, x)")
def j04_paste_max(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return plane(voxel.paste(own, own, {"y": 5, "x": 6}, F.greatest))


@query("WITH b AS (SELECT s_suppkey, s_acctbal AS x0, s_acctbal + 700 AS x1, CAST(s_nationkey * 15000 AS DOUBLE) AS y0, CAST(s_nationkey * 15000 + 9000 AS DOUBLE) AS y1 FROM supplier), p AS (SELECT o_orderkey, o_totalprice AS y, CAST(o_custkey AS DOUBLE) AS x FROM orders) SELECT o_orderkey, s_suppkey FROM p JOIN b ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def j05_tile_intersect(spark, sf):
    boxes = mapping.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 700).alias("x1"), (F.col("s_nationkey") * 15000).cast("double").alias("y0"), (F.col("s_nationkey") * 15000 + 9000).cast("double").alias("y1"))
    points = mapping.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"), F.col("o_custkey").cast("double").alias("x"))
    return joins.points_in_boxes(points, boxes, ["x", "y"], {"x": 500.0, "y": 10000.0}).select("o_orderkey", "s_suppkey")


EVENT_KEYS = "k AS (SELECT user_id, epoch_us(ts) / 1e6 AS time, value FROM events WHERE event_id % 2 = 0), p AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS time FROM events WHERE event_id % 2 = 1)"


@query(f"WITH {EVENT_KEYS}, a AS (SELECT p.*, (SELECT max((k.time, k.value)) FROM k WHERE k.user_id = p.user_id AND k.time <= p.time) AS a, (SELECT min((k.time, k.value)) FROM k WHERE k.user_id = p.user_id AND k.time > p.time) AS b FROM p), u AS (SELECT event_id, time, a[1] AS t0, a[2] AS v0, b[1] AS t1, b[2] AS v1 FROM a) SELECT event_id, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t1 - t0 < 1e-4 THEN v0 ELSE v0 + (time - t0) / (t1 - t0) * (v1 - v0) END, 4) AS value FROM u")
def j08_asof_keys(spark, sf):
    rows = mapping.table(spark, sf, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"), "value")
    found = joins.as_of(rows.where("event_id % 2 = 1").drop("value"), rows.where("event_id % 2 = 0"), ["user_id"], "time", "value")
    return found.select("event_id", F.round(joins.interpolated(found, "time"), 4).alias("value"))


TUBES = "e AS (SELECT c.id, c.parent_id, c.x ax, c.y ay, c.z az, c.radius ar, coalesce(p.x, c.x) bx, coalesce(p.y, c.y) AS \"by\", coalesce(p.z, c.z) bz, coalesce(p.radius, c.radius) br FROM tree c LEFT JOIN tree p ON c.parent_id = p.id)"
SHARE = "CASE WHEN (bx-ax)*(bx-ax)+(\"by\"-ay)*(\"by\"-ay)+(bz-az)*(bz-az) > 0 THEN ((x-ax)*(bx-ax)+(y-ay)*(\"by\"-ay)+(z-az)*(bz-az)) / ((bx-ax)*(bx-ax)+(\"by\"-ay)*(\"by\"-ay)+(bz-az)*(bz-az)) ELSE 0 END"


@query(f"WITH {TREE}, {TUBES}, p AS (SELECT DISTINCT x, y, z FROM (WITH {PTS} SELECT * FROM pts)), c AS (SELECT p.*, e.*, least(greatest({SHARE}, 0), 1) AS t FROM p CROSS JOIN e) SELECT DISTINCT x, y, z FROM c WHERE ar + t*(br-ar) > 0 AND (x-ax-t*(bx-ax))*(x-ax-t*(bx-ax)) + (y-ay-t*(\"by\"-ay))*(y-ay-t*(\"by\"-ay)) + (z-az-t*(bz-az))*(z-az-t*(bz-az)) <= (ar+t*(br-ar))*(ar+t*(br-ar))")
def j09_tube_contains(spark, sf):
    points = mapping.puncta_voxels(spark, sf).select("x", "y", "z").distinct().withColumn("_id", F.struct("x", "y", "z"))
    tubes = joins.segments(mapping.tree(spark, sf))
    return joins.in_tubes(points, "_id", tubes, 8.0).select("x", "y", "z")


@query("WITH d AS (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS gap, s_acctbal FROM customer CROSS JOIN supplier) SELECT c_custkey, arg_min(s_suppkey, (round(gap, 6), s_acctbal, s_suppkey)) AS nearest, round(min(gap), 4) AS gap FROM d GROUP BY 1")
def j11_nearest(spark, sf):
    out = joins.nearest(mapping.table(spark, sf, "customer"), mapping.table(spark, sf, "supplier"), "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal")
    return out.select("c_custkey", "nearest", F.round("gap", 4).alias("gap"))


@query(f"WITH {TREE} SELECT c.id, p.id AS parent, round(c.radius - p.radius, 6) AS change FROM tree c LEFT JOIN tree p ON c.parent_id = p.id")
def j12_parent_join(spark, sf):
    out = joins.segments(mapping.tree(spark, sf))
    return out.select("id", F.when(F.col("parent_id") != -1, F.col("parent_id")).alias("parent"), F.when(F.col("parent_id") != -1, F.round(F.col("ar") - F.col("br"), 6)).alias("change"))


BOXES = "b AS (SELECT s_suppkey, s_acctbal AS x0, s_acctbal + 400 AS x1, CAST(s_nationkey * 10 AS DOUBLE) AS y0, CAST(s_nationkey * 10 + 25 AS DOUBLE) AS y1 FROM supplier)"


@query(f"WITH {BOXES} SELECT l.s_suppkey AS a, r.s_suppkey AS b, round(least(l.x1, r.x1) - greatest(l.x0, r.x0), 4) AS dx, least(l.y1, r.y1) - greatest(l.y0, r.y0) AS dy FROM b l JOIN b r ON l.s_suppkey < r.s_suppkey AND greatest(l.x0, r.x0) < least(l.x1, r.x1) AND greatest(l.y0, r.y0) < least(l.y1, r.y1)")
def j14_overlaps(spark, sf):
    boxes = mapping.table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 400).alias("x1"), (F.col("s_nationkey") * 10).cast("double").alias("y0"), (F.col("s_nationkey") * 10 + 25).cast("double").alias("y1"))
    return joins.overlapping_boxes(boxes, "s_suppkey", ["x", "y"], 200.0).select("a", "b", F.round(F.col("x1") - F.col("x0"), 4).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, p_name AS label, p_type AS tag FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def j15_property_lookup(spark, sf):
    lines = mapping.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_partkey")
    table = mapping.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("tag"))
    return joins.properties(lines, "l_partkey", table, ["label", "tag"]).drop("l_partkey")


@query("SELECT event_id, user_id, value FROM events WHERE value >= 20 AND value < 60 AND user_id >= 3 AND user_id < 40")
def j17_box_dedup(spark, sf):
    events = mapping.table(spark, sf, "events").select("event_id", "user_id", "value")
    indexed = events.withColumn("cell", F.explode(F.array(F.floor(F.col("value") / 10), F.floor(F.col("value") / 10) + 1)))  # an annotation is listed in every cell it touches
    return indexed.where("cell BETWEEN 2 AND 6 AND value >= 20 AND value < 60 AND user_id >= 3 AND user_id < 40").dropDuplicates(["event_id"]).drop("cell")


# --- order and sets -----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {PTS}, {MOMENTS} SELECT pid, round(w, 2) AS mass FROM m ORDER BY round(w, 2) DESC, pid LIMIT 100")
def o01_top_k(spark, sf):
    out = aggregate.puncta(mapping.puncta_voxels(spark, sf)).select("pid", F.round("mass", 2).alias("mass"))
    return out.orderBy(F.desc("mass"), "pid").limit(100)


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_brand), 'an') OR contains(lower(p_type), 'an')")
def o02_any_column_search(spark, sf):
    return joins.search(mapping.table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], "AN").select("p_partkey", "p_name")


@query(f"WITH {TREE} SELECT parent_id, arg_max(id, (radius, -id)) AS id, max(radius) AS radius FROM tree WHERE parent_id <> -1 GROUP BY 1")
def o06_thickest(spark, sf):
    return tree.thickest(mapping.tree(spark, sf).where("parent_id <> -1"), "parent_id")


@query("SELECT event_id FROM (SELECT event_id, sum(value) OVER (ORDER BY ts DESC, event_id DESC) AS held FROM events) WHERE held > 5000")
def o07_lru_eviction(spark, sf):
    events = mapping.table(spark, sf, "events")
    return ordering.running(events, [F.desc("ts"), F.desc("event_id")], F.col("value"), "held").where("held > 5000").select("event_id")


@query(f"WITH {VOX} SELECT image_id, CAST(t AS BIGINT) AS t, y, x, v FROM (SELECT image_id, 0 AS t, y, x, v FROM vox UNION ALL SELECT image_id, 1, y, 7 - x, v FROM vox UNION ALL SELECT image_id, 2, x, y, v FROM vox)")
def u01_cat_time(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    out, _ = voxel.cat([(own, SIZE), (voxel.flip(own, SIZE, ["x"]), SIZE), (voxel.transpose(own), SIZE)], "t")
    return out.select("image_id", "t", "y", "x", "v")


@query(f"WITH {BOXES}, n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.x0 ax0, a.x1 ax1, b.x0 bx0, b.x1 bx1 FROM b a JOIN b b ON b.s_suppkey = a.s_suppkey + 1) SELECT a, b, round(least(ax0, bx0), 4) AS u0, round(greatest(ax1, bx1), 4) AS u1, round(greatest(ax0, bx0), 4) AS i0, round(least(ax1, bx1), 4) AS i1 FROM n")
def u02_box_algebra(spark, sf):
    s = mapping.table(spark, sf, "supplier").select("s_suppkey", F.struct(F.col("s_acctbal").alias("x0"), (F.col("s_acctbal") + 400).alias("x1")).alias("p"))
    both = s.select(F.col("s_suppkey").alias("a"), F.col("p").alias("p")).join(s.select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b"), F.col("p").alias("q")), "a")
    u, i = region.box_union("p", "q", ["x"]), region.box_intersection("p", "q", ["x"])
    return both.select("a", "b", *(F.round(c, 4).alias(n) for c, n in zip([*u, *i], ("u0", "u1", "i0", "i1"), strict=True)))


# --- trees --------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {TREE}, {UP}, k AS (SELECT parent_id AS id, count(*) AS n FROM tree GROUP BY 1), d AS (SELECT ancestor AS id, count(*) - 1 AS n FROM up GROUP BY 1), a AS (SELECT id, count(*) - 1 AS n FROM up GROUP BY 1), l AS (SELECT ancestor AS id, count(*) AS n FROM up WHERE id NOT IN (SELECT parent_id FROM tree) GROUP BY 1) SELECT t.id, coalesce(k.n, 0) AS children, d.n AS descendants, a.n AS ancestors, coalesce(l.n, 0) AS leaves FROM tree t LEFT JOIN k USING (id) JOIN d USING (id) JOIN a USING (id) LEFT JOIN l USING (id)")
def t02_counts(spark, sf):
    return tree.counts(mapping.tree(spark, sf))


@query(f"WITH {TREE}, k AS (SELECT parent_id AS id, count(*) AS n FROM tree GROUP BY 1) SELECT t.id, CAST(CASE WHEN parent_id = -1 THEN 1 WHEN coalesce(n, 0) >= 2 THEN 2 WHEN coalesce(n, 0) = 0 THEN 3 ELSE 0 END AS BIGINT) AS topology FROM tree t LEFT JOIN k USING (id)")
def t03_kinds(spark, sf):
    return tree.with_degree(mapping.tree(spark, sf)).select("id", "topology")


@query(f"WITH {TREE} SELECT c.id, CASE WHEN c.parent_id >= 100 THEN p.parent_id ELSE c.parent_id END AS parent_id FROM tree c LEFT JOIN tree p ON c.parent_id = p.id WHERE NOT (c.id >= 100 AND c.id < 1000)")
def t04_erase_nodes(spark, sf):
    own = mapping.tree(spark, sf)
    return tree.erase_nodes(own, own.where("id >= 100 AND id < 1000")).select("id", "parent_id")


@query(f"WITH {TREE} SELECT id, CASE id WHEN 1001 THEN -1 WHEN (SELECT parent_id FROM tree WHERE id = 1001) THEN 1001 WHEN (SELECT parent_id FROM tree WHERE id = (SELECT parent_id FROM tree WHERE id = 1001)) THEN (SELECT parent_id FROM tree WHERE id = 1001) ELSE parent_id END AS parent_id FROM tree")
def t04_set_as_root(spark, sf):
    return tree.set_as_root(mapping.tree(spark, sf), 1001).select("id", "parent_id")


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT id, CAST(0 AS BIGINT) AS depth, [id] AS path FROM tree WHERE parent_id = -1 UNION ALL SELECT t.id, w.depth + 1, list_append(w.path, t.id) FROM w JOIN tree t ON t.parent_id = w.id), n AS (SELECT id, row_number() OVER (ORDER BY depth, path) AS new_id FROM w) SELECT t.id, n.new_id, coalesce(p.new_id, -1) AS new_parent FROM tree t JOIN n ON n.id = t.id LEFT JOIN n p ON p.id = t.parent_id")
def t07_bfs_ids(spark, sf):
    return tree.breadth_first_ids(mapping.tree(spark, sf))


@query(f"WITH RECURSIVE {TREE}, w AS (SELECT id, [id] AS path FROM tree WHERE parent_id = -1 UNION ALL SELECT t.id, list_append(w.path, t.id) FROM w JOIN tree t ON t.parent_id = w.id) SELECT id, row_number() OVER (ORDER BY path) AS place FROM w")
def t01_preorder(spark, sf):
    return tree.preorder(mapping.tree(spark, sf))


# every nation branches, and so each node is a branch of its own: its start is its parent
@query(f"WITH RECURSIVE {TREE}, {EDGE}, w AS (SELECT id, edge AS total FROM edge WHERE parent_id = -1 UNION ALL SELECT e.id, w.total + e.edge FROM w JOIN edge e ON e.parent_id = w.id), k AS (SELECT parent_id AS id, count(*) AS n FROM tree GROUP BY 1), b AS (SELECT e.id, CASE WHEN e.parent_id = -1 OR p.parent_id = -1 OR k.n >= 2 THEN e.id ELSE e.parent_id END AS branch_id FROM edge e LEFT JOIN edge p ON p.id = e.parent_id LEFT JOIN k ON k.id = e.parent_id) SELECT b.id, b.branch_id, round(e.edge, 6) AS dist_to_parent, round(w.total, 6) AS dist_to_root FROM b JOIN edge e USING (id) JOIN w USING (id)")
def t08_branch_labels(spark, sf):
    out = tree.branches(mapping.tree(spark, sf))
    return out.select("id", "branch_id", F.round("dist_to_parent", 6).alias("dist_to_parent"), F.round("dist_to_root", 6).alias("dist_to_root"))


@query(f"WITH RECURSIVE {TREE}, {UP} SELECT id, ancestor, steps FROM up")
def t12_closure(spark, sf):
    return tree.closure(mapping.tree(spark, sf))


@query(f"WITH {TREE}, {EDGE}, k AS (SELECT parent_id AS id, count(*) AS n FROM tree GROUP BY 1) SELECT t.id FROM tree t WHERE t.id NOT IN (SELECT parent_id FROM tree) AND t.parent_id IN (SELECT k.id FROM k JOIN tree p ON p.id = k.id WHERE n >= 2 AND p.parent_id <> -1)")
def t13_spurs(spark, sf):
    return tree.spurs(mapping.tree(spark, sf))


@query(f"WITH RECURSIVE {TREE}, {UP} SELECT DISTINCT ancestor AS id FROM up WHERE id IN (1001, 1005, 1007)")
def t15_upstream(spark, sf):
    own = mapping.tree(spark, sf)
    return tree.selection(own, own.where("id IN (1001, 1005, 1007)"), "upstream")


@query(f"WITH {TREE}, {EDGE}, n AS (SELECT *, greatest(1, CAST(ceil(edge / 10) AS BIGINT)) AS n FROM edge WHERE parent_id <> -1), k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n) SELECT k.id, k.k, round(p.x + k.k / CAST(k.n AS DOUBLE) * (k.x - p.x), 9) AS x, round(p.radius + k.k / CAST(k.n AS DOUBLE) * (k.radius - p.radius), 9) AS radius FROM k JOIN tree p ON p.id = k.parent_id")
def t16_resample(spark, sf):
    out = tree.resample(mapping.tree(spark, sf), 10.0)
    return out.select("id", F.col("k").cast("bigint").alias("k"), F.round("x", 9).alias("x"), F.round("radius", 9).alias("radius"))


# --- graphs, thresholds, estimators ---------------------------------------------------------------------------------------------------------

LINKS = "l AS (SELECT o_custkey AS a, 1000000000 + o_orderkey AS b FROM orders)"


@query(f"WITH RECURSIVE {LINKS}, e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS id, a AS m FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id), c AS (SELECT id, min(m) AS label FROM r GROUP BY id) SELECT label, count(*) AS size FROM c GROUP BY label")
def g01_components(spark, sf):
    return graph.component_sizes(mapping.table(spark, sf, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") + 1_000_000_000).alias("b")))


@query(f"WITH RECURSIVE {VOX}, f AS (SELECT image_id, y, x FROM vox WHERE v > 140), r AS (SELECT image_id, y, x, y * 8 + x AS m FROM f UNION SELECT f.image_id, f.y, f.x, r.m FROM r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1), c AS (SELECT image_id, y, x, min(m) AS m FROM r GROUP BY 1, 2, 3) SELECT image_id, y, x, dense_rank() OVER (PARTITION BY image_id ORDER BY m) AS label FROM c")
def g01_voxel_components(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return graph.voxel_components(own, SIZE, 8, F.col("v") > 140).select("image_id", "y", "x", "label")


@query(f"WITH RECURSIVE {VOX}, s AS (SELECT * FROM vox), f AS (SELECT a.*, EXISTS (SELECT 1 FROM s b WHERE b.image_id = a.image_id AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND b.v > a.v) AS beaten FROM s a), r AS (SELECT image_id, y, x, v, beaten FROM f WHERE beaten UNION SELECT f.image_id, f.y, f.x, f.v, f.beaten OR r.beaten FROM r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1 AND f.v = r.v) SELECT image_id, y, x, CAST(NOT EXISTS (SELECT 1 FROM r WHERE r.image_id = s.image_id AND r.y = s.y AND r.x = s.x) AND v <> 0 AS BIGINT) AS v FROM s")
def w08_regional_max(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    return plane(threshold.regional_extrema(own, SIZE, 8))


# all edges are nation pairs with distinct weights, so the forest is unique: an edge is in it unless a path of lighter edges joins its ends
@query("WITH RECURSIVE e AS (SELECT a.n_nationkey AS s, b.n_nationkey AS d, CAST((a.n_nationkey * 37 + b.n_nationkey * 101) % 613 AS DOUBLE) * 1000 + a.n_nationkey * 25 + b.n_nationkey AS w FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey), u AS (SELECT s, d, w FROM e UNION ALL SELECT d, s, w FROM e), r AS (SELECT w, s AS node FROM e UNION SELECT r.w, u.d FROM r JOIN u ON u.s = r.node AND u.w < r.w) SELECT CAST(s AS BIGINT) AS s, CAST(d AS BIGINT) AS d, w FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.w = e.w AND r.node = e.d)")
def g04_mst(spark, sf):
    n = mapping.table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    a, b = F.col("s"), F.col("d")
    edges = n.withColumnRenamed("k", "s").join(n.withColumnRenamed("k", "d"), a < b)
    weight = ((a * 37 + b * 101) % 613).cast("double") * 1000 + a * 25 + b
    return graph.minimum_spanning_forest(edges.withColumn("w", weight))


@query(None)
def g06_triangle(spark, sf):
    return threshold.automatic(mapping.images(spark, sf), "triangle", by=["image_id"])


NEXT = """u AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1),
  nx AS (SELECT image_id, now, CAST(floor((coalesce(avg(v) FILTER (WHERE v <= now), (any_value(lo) + now) / 2) + coalesce(avg(v) FILTER (WHERE v > now), (now + any_value(hi)) / 2)) / 2) AS BIGINT) AS later FROM vox JOIN u USING (image_id) CROSS JOIN range(256) t(now) WHERE now BETWEEN lo AND hi GROUP BY 1, 2),
  r AS (SELECT image_id, (lo + hi) // 2 AS now, CAST([] AS BIGINT[]) AS seen FROM u UNION ALL SELECT r.image_id, later, list_append(seen, r.now) FROM r JOIN nx ON nx.image_id = r.image_id AND nx.now = r.now WHERE NOT list_contains(seen, r.now))"""


@query(f"WITH RECURSIVE {VOX}, {NEXT} SELECT image_id, now AS threshold FROM r WHERE list_contains(seen, now)")
def g08_two_centroids(spark, sf):
    return threshold.automatic(mapping.images(spark, sf), "two_centroids", by=["image_id"])


@query(f"WITH {VOX}, u AS (SELECT label, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1), h AS (SELECT label, v, count(*) AS n FROM vox GROUP BY 1, 2) SELECT label, arg_max(v, (n, -v)) + 1 AS threshold FROM h JOIN u USING (label) WHERE v <= (lo + hi) // 2 GROUP BY label")
def g09_after_lower_mode(spark, sf):
    own = mapping.images(spark, sf).withColumn("label", F.col("label").cast("bigint"))
    return threshold.automatic(own, "after_lower_mode", by=["label"])


@query(f"WITH {VOX}, m AS (SELECT image_id, arg_max(v, (n, -v)) AS mode FROM (SELECT image_id, v, count(*) AS n FROM vox GROUP BY 1, 2) GROUP BY 1), s AS (SELECT image_id, avg(CASE WHEN v >= mode THEN 1.0 ELSE 0.0 END) AS share FROM vox JOIN m USING (image_id) GROUP BY 1) SELECT image_id, y, x, greatest(v - CASE WHEN share >= 0.5 THEN mode ELSE 0 END, 0) AS v FROM vox JOIN m USING (image_id) JOIN s USING (image_id)")
def g12_subtract_background(spark, sf):
    return plane(threshold.subtract_background(mapping.images(spark, sf), rounds=1))


@query(f"WITH RECURSIVE {VOX}, b AS (SELECT image_id, y, x, v > 115 AS held FROM vox), o AS (SELECT image_id, y, x FROM b WHERE NOT held AND (y IN (0, 7) OR x IN (0, 7)) UNION SELECT b.image_id, b.y, b.x FROM o JOIN b ON b.image_id = o.image_id AND abs(b.y - o.y) + abs(b.x - o.x) = 1 WHERE NOT b.held) SELECT b.image_id, b.y, b.x, CAST(o.image_id IS NULL AS BIGINT) AS v FROM b LEFT JOIN o USING (image_id, y, x)")
def w10_fill_holes(spark, sf):
    own = voxel.binarized(mapping.images(spark, sf).drop("label"), F.col("v") > 115)
    return plane(threshold.fill_holes(own, SIZE)).withColumn("v", F.col("v").cast("bigint"))


# a line has one supplier, so of those that share one the cheapest is matched
@query("SELECT l_orderkey AS g, arg_min(CAST((l_partkey * 16 + l_linenumber) * 16 + l_suppkey % 9 AS BIGINT), (round(CAST(l_extendedprice AS DOUBLE), 2), (l_partkey * 16 + l_linenumber) * 16 + l_suppkey % 9)) AS row, CAST(l_suppkey % 9 AS BIGINT) AS col, min(round(CAST(l_extendedprice AS DOUBLE), 2)) AS cost FROM lineitem GROUP BY 1, 3")
def j19_assignment(spark, sf):
    rows = mapping.table(spark, sf, "lineitem")
    links = rows.select(F.col("l_orderkey").alias("g"), ((F.col("l_partkey") * 16 + F.col("l_linenumber")) * 16 + F.col("l_suppkey") % 9).alias("row"), (F.col("l_suppkey") % 9).alias("col"), F.round(F.col("l_extendedprice").cast("double"), 2).alias("cost"))
    return matching.linear_assignment(links, limit=1e9).select("g", "row", F.col("col").cast("bigint").alias("col"), "cost")


@query("WITH c AS (SELECT vec_id AS k, embedding AS e FROM embeddings WHERE vec_id < 5), d AS (SELECT v.vec_id, c.k, list_sum(list_transform(list_zip(v.embedding, c.e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS gap FROM embeddings v CROSS JOIN c) SELECT vec_id, arg_min(k, (round(gap, 9), k)) AS cluster, round(min(gap), 6) AS gap FROM d GROUP BY vec_id")
def k01_nearest_centre(spark, sf):
    rows = mapping.table(spark, sf, "embeddings").select("vec_id", "embedding")
    centres = [x.embedding for x in rows.where("vec_id < 5").orderBy("vec_id").collect()]
    return matching.nearest_centre(rows, "embedding", centres).select("vec_id", "cluster", F.round("gap", 6).alias("gap"))


GAPS = "SELECT v.vec_id, c.k, list_sum(list_transform(list_zip(v.embedding, c.e), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2]))) AS gap FROM embeddings v CROSS JOIN c{0} c"
MEANS = "SELECT k, list(s ORDER BY d) AS e FROM (SELECT k, d, avg(CAST(embedding[d] AS DOUBLE)) AS s FROM a{0} JOIN embeddings USING (vec_id) CROSS JOIN range(1, 65) t(d) GROUP BY 1, 2) GROUP BY 1"
ROUNDS = ", ".join(f"a{i} AS MATERIALIZED (SELECT vec_id, arg_min(k, (round(gap, 9), k)) AS k FROM ({GAPS.format(i)}) GROUP BY 1), c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN ({MEANS.format(i)}) m USING (k))" for i in range(5))


@query(f"WITH c0 AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id < 5), {ROUNDS} SELECT vec_id, arg_min(k, (round(gap, 9), k)) AS cluster FROM ({GAPS.format(5)}) GROUP BY 1")
def k01_kmeans(spark, sf):
    rows = mapping.table(spark, sf, "embeddings").select("vec_id", "embedding")
    centres = [x.embedding for x in rows.where("vec_id < 5").orderBy("vec_id").collect()]
    return matching.nearest_centre(rows, "embedding", matching.k_means(rows, "embedding", centres, rounds=5)).select("vec_id", "cluster")


@query(f"WITH {VOX}, a AS (SELECT image_id * 8 + y AS y, x, v FROM vox), b AS (SELECT y - 1 AS y, x + 2 AS x, v FROM a), c AS (SELECT dy, dx, count(*) AS n, corr(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS ncc FROM b CROSS JOIN range(-3, 4) s(dy) CROSS JOIN range(-3, 4) t(dx) JOIN a ON a.y = b.y + dy AND a.x = b.x + dx GROUP BY 1, 2 HAVING count(*) >= 20) SELECT dy, dx, n, round(ncc, 6) AS ncc FROM c ORDER BY ncc DESC, dy, dx LIMIT 1")
def q01_best_offset(spark, sf):
    a = mapping.images(spark, sf).withColumn("y", F.col("image_id") * 8 + F.col("y"))  # all images, one below the other
    return matching.best_offset(a, a.withColumns({"y": F.col("y") - 1, "x": F.col("x") + 2}), (0, 3, 3), 20).select("dy", "dx", "n", F.round("ncc", 6).alias("ncc"))


@query(f"WITH {VOX}, t AS (SELECT image_id AS tile_id, y + (image_id // 4) * 6 AS y, x + (image_id % 4) * 6 AS x, v FROM vox) SELECT y, x, CAST(trunc(avg(v)) AS BIGINT) AS v FROM t GROUP BY 1, 2")
def q05_merge_tiles(spark, sf):
    tiles = mapping.images(spark, sf).select(F.col("image_id").alias("tile_id"), "z", "y", "x", "v")
    places = tiles.select("tile_id").distinct().select("tile_id", F.lit(0).alias("oz"), (F.floor(F.col("tile_id") / 4) * 6).alias("oy"), (F.col("tile_id") % 4 * 6).alias("ox"))
    return matching.merge_tiles(tiles, places, "mean").select("y", "x", "v")


# --- meshes, masks, streams -----------------------------------------------------------------------------------------------------------------


@query("SELECT CAST(s_suppkey AS BIGINT) AS mesh_id, CAST(12 AS BIGINT) AS triangles, round(CAST(6 * (s_suppkey % 9 + 1) * (s_suppkey % 9 + 1) AS DOUBLE), 6) AS area, round(CAST((s_suppkey % 9 + 1) * (s_suppkey % 9 + 1) * (s_suppkey % 9 + 1) AS DOUBLE), 6) AS volume FROM supplier")
def a17_mesh_properties(spark, sf):
    v, t = cubes(mapping.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("mesh_id"), (F.col("s_suppkey") % 9 + 1).cast("double").alias("side")))
    out = mesh.properties(v, t)
    return out.select("mesh_id", "triangles", F.round("area", 6).alias("area"), F.round("volume", 6).alias("volume"))


def cubes(sides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A cube (mesh_v, mesh_t) per row of mesh_id, side."""
    corner = [(i, i & 1, i >> 1 & 1, i >> 2 & 1) for i in range(8)]
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    v = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(c, ("vid", "i", "j", "k"), strict=True))) for c in corner))).alias("c")
    t = F.explode(F.array(*(F.struct(F.lit(i).alias("tid"), *(F.lit(x).alias(n) for x, n in zip(f, "abc", strict=True))) for i, f in enumerate(faces)))).alias("f")
    vertices = sides.select("mesh_id", "side", v).select("mesh_id", "c.vid", *((F.col(f"c.{n}") * F.col("side")).alias(x) for n, x in zip("ijk", "xyz", strict=True)))
    return vertices, sides.select("mesh_id", t).select("mesh_id", "f.*")


@query("WITH r AS (SELECT s_suppkey AS roi_id, s_suppkey % 11 AS o FROM supplier), g AS (SELECT roi_id, o, CAST(y.range AS BIGINT) AS y, CAST(x.range AS BIGINT) AS x FROM r CROSS JOIN range(0, 30) y CROSS JOIN range(0, 30) x) SELECT roi_id, y, x FROM g WHERE x BETWEEN o AND o + 12 AND y BETWEEN o AND o + 8 AND NOT (x BETWEEN o + 3 AND o + 6 AND y BETWEEN o + 2 AND o + 5)")
def r01_roi_mask(spark, sf):
    o = (F.col("s_suppkey") % 11).cast("double")
    box = lambda *v: F.array(F.struct((o + v[0]).alias("x"), (o + v[1]).alias("y")), F.struct((o + v[2]).alias("x"), (o + v[3]).alias("y")))
    ops = F.array(F.struct(F.lit(0).alias("op_idx"), F.lit(True).alias("is_add"), box(0, 0, 12, 8).alias("pts")), F.struct(F.lit(1).alias("op_idx"), F.lit(False).alias("is_add"), box(3, 2, 6, 5).alias("pts")))
    rows = mapping.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("roi_id"), F.lit(0).alias("slice"), F.lit(0).alias("shape_id"), F.lit("rect").alias("type"), F.explode(ops).alias("o")).select("roi_id", "slice", "shape_id", "type", "o.*")
    return mesh.roi_mask(rows).select("roi_id", "y", "x")


@query("WITH k AS (SELECT event_type, CAST(date_part('day', ts) AS DOUBLE) * 10 AS time, value FROM (SELECT event_type, ts, value, row_number() OVER (PARTITION BY event_type, date_part('day', ts) ORDER BY event_id) AS r FROM events) WHERE r = 1), p AS (SELECT e.event_type, CAST(f.range AS BIGINT) AS frame, CAST(f.range AS DOUBLE) * 5 AS time FROM (SELECT DISTINCT event_type FROM k) e CROSS JOIN range(0, 61) f), a AS (SELECT p.*, (SELECT max((k.time, k.value)) FROM k WHERE k.event_type = p.event_type AND k.time <= p.time) AS a, (SELECT min((k.time, k.value)) FROM k WHERE k.event_type = p.event_type AND k.time > p.time) AS b FROM p) SELECT event_type, frame, time, round(CASE WHEN a IS NULL THEN b[2] WHEN b IS NULL THEN a[2] ELSE a[2] + (time - a[1]) / (b[1] - a[1]) * (b[2] - a[2]) END, 6) AS value FROM a")
def st05_timeline(spark, sf):
    events = mapping.table(spark, sf, "events").withColumn("time", F.dayofmonth("ts").cast("double") * 10)
    keys = events.groupBy("event_type", "time").agg(F.min_by("value", "event_id").alias("value"))
    out = progressive.timeline(spark, keys, 0.0, 300.0, 5.0, ["event_type"])
    return out.select("event_type", F.col("frame").cast("bigint").alias("frame"), "time", F.round("value", 6).alias("value"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st06_windowed_counts(spark, sf):
    out = progressive.windowed_counts(mapping.table(spark, sf, "events"), "ts", "1 hour", "1 hour", ["event_type"])
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {VOX} SELECT a.image_id * 100 + a.y * 10 + a.x AS k, round(0.75 * 0.5 * a.v + 0.75 * 0.5 * b.v + 0.25 * 0.5 * c.v + 0.25 * 0.5 * d.v, 6)::DOUBLE AS v FROM vox a JOIN vox b ON b.image_id = a.image_id AND b.y = a.y AND b.x = a.x + 1 JOIN vox c ON c.image_id = a.image_id AND c.y = a.y + 1 AND c.x = a.x JOIN vox d ON d.image_id = a.image_id AND d.y = a.y + 1 AND d.x = a.x + 1")
def m16_sample_linear(spark, sf):
    own = mapping.images(spark, sf)
    points = own.where("y < 7 AND x < 7").select("image_id", (F.col("image_id") * 100 + F.col("y") * 10 + F.col("x")).alias("k"), (F.col("y") + 0.25).alias("y"), (F.col("x") + 0.5).alias("x"))
    return sampling.sample_linear(points, own, "k", ("y", "x")).select("k", F.round("v", 6).alias("v"))


@query(f"WITH {VOX}, h AS (SELECT image_id, y, x, lag(v) OVER wx - 2 * v + lead(v) OVER wx AS xx, lag(v) OVER wy - 2 * v + lead(v) OVER wy AS yy, (lead(v) OVER wx - lag(v) OVER wx) / 2.0 AS dx FROM vox WINDOW wx AS (PARTITION BY image_id, y ORDER BY x), wy AS (PARTITION BY image_id, x ORDER BY y)), g AS (SELECT *, (lead(dx) OVER wy - lag(dx) OVER wy) / 2.0 AS xy FROM h WINDOW wy AS (PARTITION BY image_id, x ORDER BY y)) SELECT image_id, y, x, round(CASE WHEN xx IS NULL OR yy IS NULL OR xy IS NULL THEN 0.0 ELSE greatest(-((xx + yy) / 2.0 - sqrt((xx - yy) / 2.0 * ((xx - yy) / 2.0) + xy * xy)), 0.0) END, 6)::DOUBLE AS v FROM g")
def w13_enhance_lines(spark, sf):
    own = mapping.images(spark, sf).select("image_id", "y", "x", F.col("v").cast("double").alias("v"))
    return plane(sampling.enhance_lines(own)).withColumn("v", F.round("v", 6))


@query(None)
def w12_thin(spark, sf):
    own = voxel.binarized(mapping.images(spark, sf), F.col("v") > 120)
    return plane(sampling.thin(own.select("image_id", "z", "y", "x", "v")))


@query(f"WITH RECURSIVE {VOX}, f AS (SELECT image_id, y, x, v FROM vox WHERE v > 140), r AS (SELECT image_id, y, x, v, y * 8 + x AS m FROM f UNION SELECT f.image_id, f.y, f.x, f.v, r.m FROM r JOIN f ON f.image_id = r.image_id AND abs(f.y - r.y) <= 1 AND abs(f.x - r.x) <= 1), c AS (SELECT image_id, y, x, v, min(m) AS m FROM r GROUP BY 1, 2, 3, 4), l AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY m) AS label FROM c) SELECT image_id, label, count(*) AS vol_size, CAST(sum(v) AS DOUBLE) AS mass, round(sum(CAST(v AS DOUBLE) * x) / sum(v), 6) AS x, round(sum(CAST(v AS DOUBLE) * y) / sum(v), 6) AS y FROM l GROUP BY 1, 2 HAVING count(*) >= 3")
def g14_detect_puncta(spark, sf):
    own = mapping.images(spark, sf).drop("label")
    found = composites.detect_puncta(own, SIZE, 140, 3, 8)
    return found.select("image_id", "label", "vol_size", F.col("mass").cast("double").alias("mass"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"WITH RECURSIVE {TREE}, {UP} SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey + 100 IN (SELECT id FROM up WHERE ancestor = 2)")
def j18_region_members(spark, sf):
    own = mapping.tree(spark, sf)
    inside = tree.subtree(own, own.where("id = 2")).select((F.col("id") - 100).alias("c_nationkey"))
    return mapping.table(spark, sf, "customer").join(inside, "c_nationkey", "left_semi").select("c_custkey", "c_acctbal")


@query(f"WITH {TREE}, k AS (SELECT c.id FROM tree c JOIN tree p ON c.parent_id = p.id WHERE p.parent_id = -1 AND c.y > p.y) SELECT id, CAST(CASE WHEN parent_id = -1 THEN 1 WHEN id IN (SELECT id FROM k) OR parent_id IN (SELECT id FROM k) THEN 4 ELSE 3 END AS BIGINT) AS type FROM tree")
def t06_resort_pyramidal(spark, sf):
    own = mapping.tree(spark, sf).withColumn("type", F.when(F.col("parent_id") == -1, 1).otherwise(2))
    return tree.resort_pyramidal(own).select("id", F.col("type").cast("bigint").alias("type"))


@query("SELECT event_id, user_id, value FROM events WHERE value < 50")
def st01_stream_unique(spark, sf):
    """The events as a stream of files, each id once, batch by batch into a table."""
    import uuid

    at = f"{shared_dir(spark)}/voxloom/stream-{uuid.uuid4().hex}"
    schema = mapping.table(spark, sf, "events").schema
    stream = progressive.unique_stream(spark, f"{sf}/events.parque*", schema, "event_id", "value < 50").select("event_id", "user_id", "value")
    progressive.run_to_end(stream, lambda batch, _: batch.write.mode("append").parquet(f"{at}/rows"), f"{at}/state")
    return spark.read.parquet(f"{at}/rows")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Crop, threshold, projection and histogram of the images."""
    own = voxel.threshold(region.crop(mapping.images(spark, sf), {"y": (1, 7), "x": (1, 7)}), 100, "below", True, 0)
    return aggregate.histogram(aggregate.project(own, "y", "max"), 0, 255, 16)


QUERIES["flagship"] = flagship
SQL["flagship"] = f"WITH {VOX}, p AS (SELECT image_id, x, max(CASE WHEN v <= 100 THEN 0 ELSE v END) AS v FROM vox WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 GROUP BY 1, 2) SELECT CAST(b.range AS BIGINT) AS bin, count(v) AS n FROM range(16) b LEFT JOIN p ON v * 16 // 256 = b.range GROUP BY 1"
