"""Spatial and ordered joins: boxes, nearest neighbours, tubes, branches, key frames, properties.

A distance or overlap predicate becomes an equi-join on grid cells with the exact test behind it, so a join shuffles by cell; cells of
about the search radius keep candidates few. Where points crowd in a cell, they are dealt to parts of it, and what they are held against is
repeated for each part.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators.ordering import numbered, ranged
from voxloom.operators.sweep import ENDS, bound, sweep
from voxloom.storage import written


#: Points of a cell that stay together: what they meet is repeated once for so many, which is little beside their pairs.
CROWD = 100
#: Boxes of a cell that stay together; they overlap each other often, so a task takes more of them.
BOXES = 2_000


def cells(low: Column, high: Column, cell: float | Column) -> Column:
    """All cells that the closed interval meets."""
    return F.sequence(F.floor(low / cell), F.floor(high / cell))


def points_in_boxes(points: DataFrame, boxes: DataFrame, axes: Sequence[str], cell: Mapping[str, float]) -> DataFrame:
    """Rows of points with each box (columns x0, x1, ..., half-open) that holds them."""
    own, other = points, boxes
    for a in axes:
        own = own.withColumn(f"_{a}", F.floor(F.col(a) / cell[a]))
        other = other.withColumn(f"_{a}", F.explode(cells(F.col(f"{a}0"), F.col(f"{a}1"), cell[a])))
    exact = functools.reduce(operator.and_, ((F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1")) for a in axes))
    return own.join(other, [f"_{a}" for a in axes]).where(exact).drop(*(f"_{a}" for a in axes))


def overlapping_boxes(boxes: DataFrame, key: str, axes: Sequence[str], cell: float) -> DataFrame:
    """a < b and the intersection (x0, x1, ...) of every two boxes that share volume. A pair that shares several cells counts in its first."""
    rows = boxes
    for axis in axes:
        rows = rows.withColumn(f"_{axis}", F.explode(cells(F.col(f"{axis}0"), F.col(f"{axis}1"), cell)))
    left = rows.select(F.col(key).alias("a"), *(F.col(f"_{x}") for x in axes), *(F.col(f"{x}{k}").alias(f"a{x}{k}") for x in axes for k in (0, 1)))
    right = rows.select(F.col(key).alias("b"), *(F.col(f"_{x}") for x in axes), *(F.col(f"{x}{k}").alias(f"b{x}{k}") for x in axes for k in (0, 1)))
    both = met(left, right, [f"_{x}" for x in axes], BOXES).where("a < b")
    cut = both.select("a", "b", *(F.col(f"_{x}") for x in axes), *(e for x in axes for e in (F.greatest(f"a{x}0", f"b{x}0").alias(f"{x}0"), F.least(f"a{x}1", f"b{x}1").alias(f"{x}1"))))
    real = functools.reduce(operator.and_, (F.col(f"{x}0") < F.col(f"{x}1") for x in axes))
    first = functools.reduce(operator.and_, (F.col(f"_{x}") == F.floor(F.col(f"{x}0") / cell) for x in axes))
    return cut.where(real & first).drop(*(f"_{x}" for x in axes))


def chunks_of_box(start: Mapping[str, int], end: Mapping[str, int], level: Mapping[str, int], chunk: Mapping[str, int], offset: Mapping[str, int], size: Mapping[str, int]) -> dict[str, tuple[int, int]]:
    """Range of chunk numbers (end exclusive) of a scale that meets a base box: ratios round outward, then the volume cuts."""
    out = {}
    for a in start:
        low, high = (start[a] + offset[a]) // level[a], -(-(end[a] + offset[a]) // level[a])
        low, high = max(low, offset[a]), min(high, offset[a] + size[a])
        out[a] = ((low - offset[a]) // chunk[a], -(-(high - offset[a]) // chunk[a])) if high > low else (0, 0)
    return out


def nearest(left: DataFrame, right: DataFrame, key: str, target: str, value: str, other: str, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """left with the row of right whose other is nearest to value (ties to so many digits of the last one before and the first one after:
    the smaller other; then the smaller target), as nearest and gap, the lesser of both gaps.

    Both sides are ordered on one line; the nearest is the last one before or the first one after, so nothing is compared pairwise.
    """
    probe = left.select(key, *by, F.col(value).alias("_v"), F.lit(None).cast(right.schema[target].dataType).alias("_t"))
    keys = right.select(F.lit(None).cast(left.schema[key].dataType).alias(key), *by, F.col(other).alias("_v"), F.col(target).alias("_t"))
    at = F.when(F.col("_t").isNotNull(), F.struct("_v", "_t"))
    both = probe.unionByName(keys)
    if not by:
        both, by = ranged(both, [F.col("_v")]), ["_part"]
    # two orders, the second downward: frames that only grow at their end are worked out in one pass
    forward, backward = Window.partitionBy(*by).orderBy(F.col("_v"), F.col("_t").desc_nulls_last()), Window.partitionBy(*by).orderBy(F.col("_v").desc(), F.col("_t").desc_nulls_last())
    both = both.withColumns({name: F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for name, order in (("_p", forward), ("_n", backward))})
    if by == ["_part"]:  # what lies beyond a range: the last key before it and the first after it, a row per range
        both = both.withColumn("_i", F.row_number().over(forward)).withColumn("_j", F.row_number().over(backward))
        ends = both.groupBy("_part").agg(F.max_by("_p", "_i").alias("_hi"), F.max_by("_n", "_j").alias("_lo"))
        up, down = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("_part"), F.col("_part").desc()))
        ends = ends.select("_part", F.last("_hi", True).over(up).alias("_hi"), F.last("_lo", True).over(down).alias("_lo"))
        both = both.join(ends, "_part").withColumn("_p", F.coalesce("_p", "_hi")).withColumn("_n", F.coalesce("_n", "_lo"))
    both = both.where(F.col(key).isNotNull())
    before, after = F.col("_v") - F.col("_p._v"), F.col("_n._v") - F.col("_v")
    first = F.col("_n").isNull() | (F.round(before, digits) <= F.round(after, digits))
    return left.join(both.select(key, F.when(first, F.col("_p._t")).otherwise(F.col("_n._t")).alias("nearest"), F.least(before, after).alias("gap")), key)


def within(left: DataFrame, right: DataFrame, radius: float, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of points (prefixes a_ and b_) at most radius apart, with their distance."""
    a = left.select(*(F.col(c).alias(f"a_{c}") for c in left.columns))
    b = right.select(*(F.col(c).alias(f"b_{c}") for c in right.columns))
    for x in axes:
        a = a.withColumn(f"_{x}", F.floor(F.col(f"a_{x}") / radius))
        b = b.withColumn(f"_{x}", F.explode(cells(F.col(f"b_{x}") - radius, F.col(f"b_{x}") + radius, radius)))
    apart = geometry.distance([F.col(f"a_{x}") for x in axes], [F.col(f"b_{x}") for x in axes])
    return a.join(b, [f"_{x}" for x in axes]).drop(*(f"_{x}" for x in axes)).withColumn("distance", apart).where(F.col("distance") <= radius)


def segments(tree: DataFrame, z_ratio: float = 1.0) -> DataFrame:
    """The edge of every node to its parent: id, ax.. (node), bx.. (parent), ar, br; a root is a sphere."""
    node = tree.select("id", "parent_id", F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("z") * z_ratio).alias("az"), F.col("radius").alias("ar"))
    parent = tree.select(F.col("id").alias("parent_id"), F.col("x").alias("bx"), F.col("y").alias("by"), (F.col("z") * z_ratio).alias("bz"), F.col("radius").alias("br"))
    out = node.join(parent, "parent_id", "left")
    return out.select("id", "parent_id", "ax", "ay", "az", "ar", *(F.coalesce(f"b{x}", f"a{x}").alias(f"b{x}") for x in "xyzr"))


def point(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{x}") for x in "xyz"]


def pieces(tubes: DataFrame, cell: float | Column, margin: float | Column = 0.0) -> DataFrame:
    """A row per piece of about a cell's length of each tube, with the piece's box (_low_x, _high_x, ...), grown by the larger radius and margin."""
    n = F.greatest(F.lit(1), F.ceil(geometry.distance(point("a"), point("b")) / cell)).cast("int")
    rows = tubes.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    wide = F.greatest("ar", "br") + (margin + cell * 1e-6)  # and the rounding of the pieces' ends
    for x in "xyz":
        from_, to = (F.col(f"a{x}") + k / F.col("_n") * (F.col(f"b{x}") - F.col(f"a{x}")) for k in (F.col("_k") - 1, F.col("_k")))
        rows = rows.withColumn(f"_low_{x}", F.least(from_, to) - wide).withColumn(f"_high_{x}", F.greatest(from_, to) + wide)
    return rows.drop("_n", "_k")


def met(points: DataFrame, others: DataFrame, keys: Sequence[str], crowd: int = CROWD) -> DataFrame:
    """Join of both on their cells (keys). A cell of more than crowd points is split into parts of about so many.

    Few rows may meet in many pairs, so the rows are dealt to all the session's shuffle partitions, however small they are.
    """
    crowded = points.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*keys, F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = points.join(crowded, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts).cast("int")).drop("_parts")
    right = others.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, *keys, "_part").join(right.repartition(tasks, *keys, "_part"), [*keys, "_part"]).drop("_part")


CELL = ["_x", "_y", "_z"]


def tube_candidates(points: DataFrame, tubes: DataFrame, cell: float, margin: float = 0.0) -> DataFrame:
    """points with the tubes (by id) that come within margin of their cell, each pair once. A long thin tube lies in the cells along it, not in all of its box."""
    own, at = points, pieces(tubes, cell, margin)
    for x in "xyz":
        own = own.withColumn(f"_{x}", F.floor(F.col(x) / cell))
        at = at.withColumn(f"_{x}", F.explode(cells(F.col(f"_low_{x}"), F.col(f"_high_{x}"), cell))).drop(f"_low_{x}", f"_high_{x}")
    used = own.select(*CELL).distinct()
    return met(own, at.join(used, CELL, "left_semi").dropDuplicates(["id", *CELL]), CELL).drop(*CELL)


def level_of(length: Column, cell: float) -> Column:
    """The least level whose cells, of cell * 2^level, are as long."""
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(cell)) / cell))).cast("int")


def size_of(level: str, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(2.0), F.col(level))


def reached(points: DataFrame, tubes: DataFrame, cell: float) -> DataFrame:
    """points (with _reach) with the tubes (by id) that may come so near, each pair once.

    A point lies in one cell, of a size not under its reach; a tube lies in the cells near it, in each size that some point needs.
    """
    own = points.withColumn("_level", level_of(F.col("_reach"), cell))
    levels = [r[0] for r in own.select("_level").distinct().collect()]  # at most one per power of two
    at = tubes.withColumn("_level", F.explode(F.array(*map(F.lit, levels)) if levels else F.expr("cast(array() as array<int>)")))
    sizes = size_of("_level", cell)
    at = pieces(at, sizes, sizes)
    for x in "xyz":
        own = own.withColumn(f"_{x}", F.floor(F.col(x) / sizes))
        at = at.withColumn(f"_{x}", F.explode(cells(F.col(f"_low_{x}"), F.col(f"_high_{x}"), sizes))).drop(f"_low_{x}", f"_high_{x}")
    keys = ["_level", *CELL]
    used = own.select(*keys).distinct()
    return met(own, at.join(used, keys, "left_semi").dropDuplicates(["id", *keys]), keys).drop(*keys)


def some_distance(points: DataFrame, axes: DataFrame, cell: float, top: int) -> DataFrame:
    """points with _reach: the distance to a place of the axes that is not much further than the nearest, found in cells of all sizes up to level top.

    Each used cell of a size keeps one place and shows it to its neighbours.
    """
    n = F.greatest(F.lit(1), F.ceil(geometry.distance(point("a"), point("b")) / cell)).cast("int")
    marks = axes.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    marks = marks.select(*((F.col(f"a{x}") + F.col("_k") / F.col("_n") * (F.col(f"b{x}") - F.col(f"a{x}"))).alias(f"m{x}") for x in "xyz"))
    sizes, every = size_of("_level", cell), F.explode(F.sequence(F.lit(0), F.lit(top)))
    marks = marks.withColumn("_level", every).withColumns({f"_{x}": F.floor(F.col(f"m{x}") / sizes) for x in "xyz"})
    marks = marks.groupBy("_level", *CELL).agg(F.min(F.struct("mx", "my", "mz")).alias("_m")).select("_level", *CELL, "_m.*")
    for x in CELL:
        marks = marks.withColumn(x, F.explode(F.array(*(F.col(x) + k for k in (-1, 0, 1)))))
    own = points.withColumn("_level", every).withColumns({f"_{x}": F.floor(F.col(x) / sizes) for x in "xyz"})
    near = met(own, marks, ["_level", *CELL]).groupBy("_key").agg(F.min(geometry.distance(point(), point("m"))).alias("_reach"))
    return points.join(near, "_key")


def once(value: Column) -> Column:
    """value, worked out once for each row: a filter on a plain column would become the join's condition, and work out each use anew."""
    return F.explode(F.array(value))


def finite(columns: Sequence[str]) -> Column:
    """Whether all are there and finite."""
    return functools.reduce(operator.and_, (F.abs(F.col(c)) < float("inf") for c in columns))


def nearest_on_tree(points: DataFrame, key: str, tubes: DataFrame, cell: float, digits: int = 6) -> DataFrame:
    """_key (of points), id, share, distance, px, py, pz: the point of the tubes' axes nearest to each point (ties to so many digits: the smallest id).

    share is 0 at the node id, 1 at its parent. Passes over samples find how far each point need look at most, and one exact pass looks so far.
    Of tubes with the same axis only the smallest id can count, and points of one place share their answer. Points or tubes without finite
    coordinates take no part; without tubes there are no rows.
    """
    ids = F.min(F.col("id").cast("bigint")).alias("id")
    axes = tubes.select("id", *(F.col(c).cast("double").alias(c) for c in ENDS)).where(finite(ENDS)).groupBy(*ENDS).agg(ids)
    axes = written(axes.select("id", *ENDS, F.lit(0.0).alias("ar"), F.lit(0.0).alias("br")), "axes")
    left = numbered_points(points.select(F.col(key).alias("_key"), *(F.col(x).cast("double").alias(x) for x in "xyz")).where(finite("xyz")))
    if axes.isEmpty():
        left = left.where("false")
    places = left.groupBy(*"xyz").agg(F.min("_n").alias("_n"), F.lit(0.0).alias("_reach"))
    best = sweep(places, axes, cell, "axis", digits, sample=bound(axes, cell, digits)).join(places, "_n")
    best = best.withColumn("id", F.col("id").cast(tubes.schema["id"].dataType))
    return left.select("_key", *"xyz").join(best, [*"xyz"]).select("_key", "id", "share", "distance", "px", "py", "pz")


def tasks(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_points(points: DataFrame) -> DataFrame:
    """points, written, with a number _n of their own."""
    return written(points.withColumn("_n", F.monotonically_increasing_id()), "points")


def in_tubes(points: DataFrame, key: str, tubes: DataFrame, cell: float) -> DataFrame:
    """The points that lie in some tube, each once."""
    own = numbered_points(points.select(F.col(key).alias("_key"), *"xyz", F.lit(0.0).alias("_reach")).where(finite("xyz")))
    hit = sweep(own, thick(tubes), cell, "tube", few=256)
    inside = own.join(hit, "_n", "left_semi").select(F.col("_key").alias(key)).distinct()
    return points.join(inside, key, "left_semi")


def thick(tubes: DataFrame) -> DataFrame:
    """Tubes with finite ends and radii, dealt evenly."""
    columns = [*ENDS, "ar", "br"]
    return tubes.select("id", *columns).where(finite(columns)).repartition(tasks(tubes))


def subtract_tree(tree: DataFrame, other: DataFrame, cell: float) -> DataFrame:
    """tree without the nodes inside the other tree's tubes; children of what goes become roots."""
    hit = in_tubes(tree, "id", segments(other), cell).select("id")
    kept = tree.join(hit, "id", "left_anti")
    return reparented(kept)


def reparented(kept: DataFrame) -> DataFrame:
    """Nodes whose parent is missing become roots (parent -1)."""
    alive = kept.select(F.col("id").alias("parent_id"), F.lit(True).alias("_alive"))
    return kept.join(alive, "parent_id", "left").withColumn("parent_id", F.when(F.col("_alive"), F.col("parent_id")).otherwise(F.lit(-1))).select(*kept.columns)


def assign_to_branches(points: DataFrame, key: str, tubes: DataFrame, most: float, cell: float, digits: int = 6) -> DataFrame:
    """key, id, distance: the tube nearest to each point by frustum distance, within most plus the point's radius (ties to so many digits: the smallest id), and how many tubes are in range."""
    own = points.select(F.col(key).alias("_key"), *"xyz", "radius").withColumn("_reach", most + F.col("radius")).where(finite(["x", "y", "z", "_reach"]) & (F.col("_reach") > 0))
    own = numbered_points(own)
    best = sweep(own, thick(tubes.where("parent_id <> -1")), cell, "frustum", digits, few=256)
    best = best.withColumn("id", F.col("id").cast(tubes.schema["id"].dataType))
    return own.select("_n", F.col("_key").alias(key)).join(best, "_n").select(key, "id", "distance", "in_range")


def ambiguous(costs: DataFrame, key: str, cost: str, factor: float) -> DataFrame:
    """key, ambiguous: whether the second cheapest path costs less than factor times the cheapest."""
    own = costs.groupBy(key).agg(F.array_sort(F.collect_list(cost)).alias("c"))
    return own.select(key, F.coalesce(F.try_element_at("c", F.lit(2)) < factor * F.element_at("c", 1), F.lit(False)).alias("ambiguous"))


def as_of(probes: DataFrame, keys: DataFrame, by: Sequence[str], time: str, value: str) -> DataFrame:
    """probes with the last key at or before their time (t0, v0) and the first after it (t1, v1), by one ordered pass over both."""
    rows = probes.select(*by, F.col(time).alias("_t"), *(F.col(c).alias(f"_p_{c}") for c in probes.columns if c not in (*by, time)), F.lit(1).alias("_probe"), F.lit(None).cast("double").alias("_v"))
    known = keys.select(*by, F.col(time).alias("_t"), F.lit(0).alias("_probe"), F.col(value).cast("double").alias("_v"))
    key = F.when(F.col("_probe") == 0, F.struct("_t", "_v"))
    upward, downward = Window.partitionBy(*by).orderBy("_t", "_probe", "_v"), Window.partitionBy(*by).orderBy(F.col("_t").desc(), F.col("_probe").desc(), F.col("_v").desc())
    both = rows.unionByName(known, allowMissingColumns=True)
    both = both.withColumn("_a", F.last(key, True).over(upward.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.last(key, True).over(downward.rowsBetween(Window.unboundedPreceding, -1)))
    found = both.where("_probe = 1")
    return found.select(*by, F.col("_t").alias(time), *(F.col(f"_p_{c}").alias(c) for c in probes.columns if c not in (*by, time)), F.col("_a._t").alias("t0"), F.col("_a._v").alias("v0"), F.col("_b._t").alias("t1"), F.col("_b._v").alias("v1"))


EASINGS = {
    "linear": lambda p: p,
    "switch": lambda p: F.lit(0.0),
    "in_quad": lambda p: p * p,
    "out_quad": lambda p: p * (2 - p),
    "in_out_cubic": lambda p: F.when(p < 0.5, 4 * p * p * p).otherwise(1 - F.pow(2 - 2 * p, F.lit(3.0)) / 2),
}


def interpolated(rows: DataFrame, time: str, easing: str = "linear") -> Column:
    """Value between two keys; the earlier value where there is no later key, the gap is under 1e-4 or nothing has passed."""
    gap = F.col("t1") - F.col("t0")
    share = EASINGS[easing](F.when(gap > 0, (F.col(time) - F.col("t0")) / gap))
    return F.when(F.col("t0").isNull(), F.col("v1")).when(F.col("t1").isNull() | (gap < 1e-4), F.col("v0")).otherwise(F.col("v0") + share * (F.col("v1") - F.col("v0")))


def related(annotations: DataFrame, relation: str, ids: DataFrame) -> DataFrame:
    """id of an object and the annotations whose list of related objects (column relation) names it, each once."""
    links = annotations.withColumn("object_id", F.explode(F.array_distinct(relation))).drop(relation)
    return links.join(ids.select(F.col("id").alias("object_id")).distinct(), "object_id", "left_semi")


def properties(rows: DataFrame, key: str, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with the named properties of their id (null for an unknown one). Spark picks the join from the table's size."""
    return rows.join(table.select(F.col("id").alias(key), *columns), key, "left")


def search(table: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows any of whose columns contains the text, whatever the case."""
    tests = [F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())) for c in columns]
    return table.where(functools.reduce(operator.or_, (F.coalesce(t, F.lit(False)) for t in tests)))


def zip_trees(a: DataFrame, b: DataFrame, order: str, most: float = 1.0) -> DataFrame:
    """Nodes of two trees paired by their place in the order; a pair further apart than most is an error."""
    place = lambda t, p: numbered(t, [F.col(order)], "place").select("place", *(F.col(c).alias(f"{p}_{c}") for c in t.columns))
    both = place(a, "a").join(place(b, "b"), "place", "full")
    apart = geometry.distance([F.col(f"a_{x}") for x in "xyz"], [F.col(f"b_{x}") for x in "xyz"])
    return both.withColumn("apart", F.coalesce(apart, F.lit(float("inf")))).withColumn("apart", F.when(F.col("apart") > most, F.raise_error(F.lit("trees differ")).cast("double")).otherwise(F.col("apart")))
