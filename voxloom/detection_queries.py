"""Watershed, split puncta and overlapping ellipses as queries, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom import mapping
from voxloom.functions import geometry
from voxloom.operators import matching, watershed
from voxloom.plans import composites
from voxloom.queries import SIZE, VOX, Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Basins of voxels over 90: pointers to the brightest earlier neighbour, their ends, and basins joined whose lower peak rises no more than 40 above the way between.
BASINS = f"""{VOX}, f AS (SELECT image_id, y, x, v, y * 8 + x AS i FROM vox WHERE v > 90),
  n AS (SELECT a.image_id, a.i, a.v, b.i AS j, b.v AS w FROM f a JOIN f b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.i <> b.i),
  best AS (SELECT image_id, i, arg_max(j, (w, -j)) AS u FROM n WHERE w > v OR (w = v AND j < i) GROUP BY 1, 2),
  up AS (SELECT f.image_id, f.i, coalesce(u, f.i) AS u FROM f LEFT JOIN best USING (image_id, i)),
  walk AS (SELECT image_id, i, u AS r FROM up UNION SELECT w.image_id, w.i, up.u FROM walk w JOIN up ON up.image_id = w.image_id AND up.i = w.r),
  root AS (SELECT w.image_id, w.i, w.r FROM walk w JOIN up ON up.image_id = w.image_id AND up.i = w.r WHERE up.u = up.i),
  s AS (SELECT n.image_id, a.r AS p, b.r AS q, max(least(n.v, n.w)) AS saddle FROM n JOIN root a ON a.image_id = n.image_id AND a.i = n.i JOIN root b ON b.image_id = n.image_id AND b.i = n.j WHERE a.r <> b.r GROUP BY 1, 2, 3),
  m AS (SELECT s.image_id, p, q FROM s JOIN f a ON a.image_id = s.image_id AND a.i = p JOIN f b ON b.image_id = s.image_id AND b.i = q WHERE least(a.v, b.v) - saddle <= 40),
  reach AS (SELECT DISTINCT image_id, r AS id, r AS l FROM root UNION SELECT m.image_id, m.q, reach.l FROM reach JOIN m ON m.image_id = reach.image_id AND m.p = reach.id),
  class AS (SELECT image_id, id, min(l) AS l FROM reach GROUP BY 1, 2),
  region AS (SELECT root.image_id, root.i, class.l FROM root JOIN class ON class.image_id = root.image_id AND class.id = root.r),
  numbered AS (SELECT image_id, l, row_number() OVER (PARTITION BY image_id ORDER BY min(i)) AS label FROM region GROUP BY 1, 2),
  basins AS (SELECT f.image_id, f.y, f.x, f.v, k.label FROM f JOIN region USING (image_id, i) JOIN numbered k ON k.image_id = f.image_id AND k.l = region.l)"""


@query(f"WITH RECURSIVE {BASINS} SELECT image_id, y, x, label FROM basins")
def g13_watershed(spark: SparkSession, sf: str) -> DataFrame:
    own = mapping.images(spark, sf).drop("label")
    return watershed.basins(own, SIZE, 8, 40, F.col("v") > 90).select("image_id", "y", "x", "label")


@query(f"WITH RECURSIVE {BASINS} SELECT image_id, label, count(*) AS vol_size, CAST(sum(v) AS DOUBLE) AS mass, round(sum(CAST(v AS DOUBLE) * x) / sum(v), 6) AS x, round(sum(CAST(v AS DOUBLE) * y) / sum(v), 6) AS y, max(v) AS max_intensity FROM basins GROUP BY 1, 2 HAVING count(*) >= 3")
def g14_split_puncta(spark: SparkSession, sf: str) -> DataFrame:
    """Puncta of blobs that are split where they touch."""
    found = composites.detect_puncta(mapping.images(spark, sf).drop("label"), SIZE, 90, 3, 8, depth=40)
    return found.select("image_id", "label", "vol_size", F.col("mass").cast("double").alias("mass"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.col("max_intensity").cast("bigint").alias("max_intensity"))


HELD = "(o.det > 0 AND o.yy * (e.x - o.x) * (e.x - o.x) - 2 * o.xy * (e.x - o.x) * (e.y - o.y) + o.xx * (e.y - o.y) * (e.y - o.y) <= rr * o.det)"
MIDDLE, HALF = "{0}.x + {0}.xy / {0}.yy * (y0 - {0}.y)", "sqrt(greatest(({0}.xx - {0}.xy * {0}.xy / {0}.yy) * (rr - (y0 - {0}.y) * (y0 - {0}.y) / {0}.yy), 0))"
ELLIPSES = f"""e AS (SELECT l_orderkey AS pid, avg(CAST(l_quantity AS DOUBLE)) AS x, avg(CAST(l_partkey % 50 AS DOUBLE)) AS y, var_pop(CAST(l_quantity AS DOUBLE)) AS xx, covar_pop(CAST(l_quantity AS DOUBLE), CAST(l_partkey % 50 AS DOUBLE)) AS xy, var_pop(CAST(l_partkey % 50 AS DOUBLE)) AS yy FROM lineitem GROUP BY 1 HAVING count(*) >= 4),
  g AS (SELECT *, xx * yy - xy * xy AS det FROM e),
  pairs AS (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders),
  met AS (SELECT a, b, e, o, -2 * ln(0.5) AS rr, greatest(e.y - sqrt(-2 * ln(0.5) * e.yy), o.y - sqrt(-2 * ln(0.5) * o.yy)) AS low, least(e.y + sqrt(-2 * ln(0.5) * e.yy), o.y + sqrt(-2 * ln(0.5) * o.yy)) AS high FROM pairs JOIN g e ON e.pid = a JOIN g o ON o.pid = b),
  lines AS (SELECT *, low + (k + 0.5) * (high - low) / 256 AS y0 FROM met CROSS JOIN range(256) t(k) WHERE high > low AND e.det > 0 AND o.det > 0),
  common AS (SELECT a, b, sum(greatest(least({MIDDLE.format("e")} + {HALF.format("e")}, {MIDDLE.format("o")} + {HALF.format("o")}) - greatest({MIDDLE.format("e")} - {HALF.format("e")}, {MIDDLE.format("o")} - {HALF.format("o")}), 0)) * any_value(high - low) / 256 AS area FROM lines GROUP BY 1, 2)"""


@query(f"WITH {ELLIPSES} SELECT a, b, round(CASE WHEN {HELD} OR {HELD.replace('o.', 'w.').replace('e.', 'o.').replace('w.', 'e.')} THEN 1.0 ELSE CASE WHEN area IS NULL THEN 0.0 ELSE least(1.0, area / (pi() * rr * sqrt(least(e.det, o.det)))) END END, 5) AS overlap FROM met LEFT JOIN common USING (a, b)")
def g15_ellipse_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's lines as a punctum of the plane, against the customer's next order."""
    rows = mapping.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_quantity").cast("double").alias("px"), (F.col("l_partkey") % 50).cast("double").alias("py"))
    moments = rows.groupBy("pid").agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.var_pop("px").alias("xx"), F.covar_pop("px", "py").alias("xy"), F.var_pop("py").alias("yy"), F.count("*").alias("n")).where("n >= 4").drop("n")
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    pairs = mapping.table(spark, sf, "orders").select(F.col("o_orderkey").alias("a"), following.alias("b"))
    side = lambda k: moments.select(F.col("pid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("x", "y", "xx", "xy", "yy")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    own, other = ([F.col(f"{k}_{c}") for c in ("x", "y", "xx", "xy", "yy")] for k in "ab")
    return both.select("a", "b", F.round(geometry.ellipse_overlap(own, other, geometry.confidence_radius(0.5)), 5).alias("overlap"))


@query("""WITH one AS (SELECT o_custkey * 1000 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS g, o_orderkey AS m, CAST(round(o_totalprice * 100) AS BIGINT) AS price FROM orders),
  p AS (SELECT x.g, x.m AS a, y.m AS b, abs(x.price - y.price) AS cost FROM one x JOIN one y ON x.g = y.g AND x.m < y.m),
  n AS (SELECT g, count(*) AS n FROM one GROUP BY 1),
  two AS (SELECT x.g, x.a, x.b, x.cost, y.a AS c, y.b AS d, y.cost AS more FROM p x JOIN p y ON x.g = y.g AND x.a < y.a AND x.b <> y.a AND x.b <> y.b),
  best AS (SELECT g, arg_min({'a': a, 'b': b, 'cost': cost, 'c': c, 'd': d, 'more': more}, (cost + more, a, b, c, d)) AS k FROM two JOIN n USING (g) WHERE n = 4 GROUP BY 1)
  SELECT g, arg_min(a, (cost, a, b)) AS a, arg_min(b, (cost, a, b)) AS b, min(cost) AS cost FROM p JOIN n USING (g) WHERE n < 4 GROUP BY 1
  UNION ALL SELECT g, k.a, k.b, k.cost FROM best UNION ALL SELECT g, k.c, k.d, k.more FROM best""")
def j20_pair_branches(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's orders, four by four, as the branches of a junction, paired by price."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("bigint") - 1
    rows = mapping.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("m"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("price"), place.alias("_place"))
    rows = rows.select((F.col("o_custkey") * 1000 + F.expr("_place div 4")).alias("g"), "m", "price")
    other = rows.withColumnsRenamed({"m": "b", "price": "_price"})
    links = rows.join(other, "g").where("m < b").select("g", F.col("m").alias("a"), "b", F.abs(F.col("price") - F.col("_price")).alias("cost"))
    return matching.pair_branches(links, "g")
