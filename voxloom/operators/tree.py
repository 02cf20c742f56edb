"""Forests of nodes (id, parent_id, x, y, z, radius): walks, counts, branches, edits. Roots have parent -1.

Walks to the root and tours around a tree double their length each round, so a chain of n nodes takes log n joins.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators.joins import nearest_on_tree, pieces, reparented, segments
from voxloom.operators.ordering import numbered, running
from voxloom.storage import written

ROOT, BRANCH, LEAF, OTHER = 1, 2, 3, 0


def with_degree(tree: DataFrame) -> DataFrame:
    """tree with children (their number) and topology (1 root, 2 branch of two children or more, 3 leaf, 0 other)."""
    counts = tree.where("parent_id <> -1").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    out = tree.join(counts, "id", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("bigint")))
    kind = F.when(F.col("parent_id") == -1, ROOT).when(F.col("children") >= 2, BRANCH).when(F.col("children") == 0, LEAF).otherwise(OTHER)
    return out.withColumn("topology", kind.cast("bigint"))


def with_edges(tree: DataFrame) -> DataFrame:
    """tree with edge, the distance of a node to its parent (0 for roots)."""
    parent = tree.select(F.col("id").alias("parent_id"), *(F.col(a).alias(f"_p{a}") for a in "xyz"))
    length = geometry.distance([F.col(a) for a in "xyz"], [F.col(f"_p{a}") for a in "xyz"])
    return tree.join(parent, "parent_id", "left").withColumn("edge", F.coalesce(length, F.lit(0.0))).select(*tree.columns, "edge")


def walks(tree: DataFrame, stop: str = "parent_id = -1") -> DataFrame:
    """id, head, steps, length: from every node up to the first node (itself counts) where stop holds, and on to a root without one.

    head is that node, steps and length the edges between. One join a round; each round doubles what has been walked.
    """
    edged = with_edges(tree).withColumn("_stop", F.expr(stop) | (F.col("parent_id") == -1))
    return climbed(edged.select("id", *first_steps("_stop", "edge")))


def first_steps(stop: str, edge: str) -> list[Column]:
    """head, steps, length and _done of nodes that stay where stop holds and go to their parent elsewhere."""
    at = F.col(stop)
    return [F.when(at, F.col("id")).otherwise(F.col("parent_id")).alias("head"), F.when(at, 0).otherwise(1).cast("bigint").alias("steps"), F.when(at, 0.0).otherwise(F.col(edge)).alias("length"), at.alias("_done")]


def climbed(rows: DataFrame) -> DataFrame:
    """rows (id, head, steps, length, _done and others) walked on to their ends, without _done. A row is written once it is done; only the others go on."""
    kept = [c for c in rows.columns if c not in ("head", "steps", "length", "_done")]
    parts = [written(rows, "walk")]
    while True:
        known = functools.reduce(DataFrame.union, (x.where("_done") for x in parts[:-1]), parts[-1])
        on = known.select(F.col("id").alias("head"), F.col("head").alias("_h"), F.col("steps").alias("_s"), F.col("length").alias("_l"), F.col("_done").alias("_d"))
        moved = parts[-1].where("NOT _done").join(on, "head")
        moved = moved.select(*kept, F.col("_h").alias("head"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("length") + F.col("_l")).alias("length"), F.col("_d").alias("_done"))
        parts.append(written(moved.select(*rows.columns), "walk"))
        if parts[-1].where("NOT _done").isEmpty():
            return functools.reduce(DataFrame.union, (x.where("_done") for x in parts)).drop("_done")


def depths(tree: DataFrame) -> DataFrame:
    """id, root, depth, dist_to_root."""
    return walks(tree).select("id", F.col("head").alias("root"), F.col("steps").alias("depth"), F.col("length").alias("dist_to_root"))


def closure(tree: DataFrame) -> DataFrame:
    """id, ancestor, steps of every node and each ancestor, itself included; as many rows as the depths add up to, so for shallow forests. No other operator needs such a table."""
    known = written(tree.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("steps")), "closure")
    reach = written(tree.where("parent_id <> -1").select("id", F.col("parent_id").alias("ancestor")), "reach")
    step = 1
    while not reach.isEmpty():  # ancestors up to 2 * step - 1 steps away, and who lies step away
        more = known.join(reach.select(F.col("id").alias("low"), F.col("ancestor").alias("id")), "id").select(F.col("low").alias("id"), "ancestor", (F.col("steps") + step).alias("steps"))
        known = written(known.union(more), "closure")
        reach = written(reach.join(reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("_a")), "ancestor").select("id", F.col("_a").alias("ancestor")), "reach")
        step *= 2
    return known


def subtree(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes below (and at) the ids: those whose walk up to the first of them doesn't end at another root."""
    marks = ids.select("id", F.lit(True).alias("_mark")).distinct()
    heads = walks(tree.join(marks, "id", "left"), "coalesce(_mark, false)").select("id", F.col("head").alias("_head"))
    return tree.join(heads.join(marks.withColumnRenamed("id", "_head"), "_head", "left_semi").select("id"), "id", "left_semi")


def tour(tree: DataFrame, **weights: Column) -> DataFrame:
    """id, root, depth, place (depth-first in its tree, children by id, from 1), size (nodes below, itself included), and of each weight the sum over those.

    Every node is entered and left once on the way around its tree. Each step of the way learns what lies ahead of it, twice as far each
    round, so a chain of n nodes takes log n joins of two rows a node, whatever the tree's depth.
    """
    names = ["size", *weights]
    siblings = Window.partitionBy("parent_id").orderBy("id")
    rows = tree.select("id", "parent_id", F.lit(1).cast("bigint").alias("size"), *(w.alias(n) for n, w in weights.items()))
    rows = rows.withColumn("_sibling", F.when(F.col("parent_id") != -1, F.lead("id").over(siblings)))
    first = tree.where("parent_id <> -1").groupBy(F.col("parent_id").alias("id")).agg(F.min("id").alias("_child"))
    rows = rows.join(first, "id", "left")
    into = F.struct((F.col("id") * 2).alias("step"), F.coalesce(F.col("_child") * 2, F.col("id") * 2 + 1).alias("next"), F.lit(-1).alias("rise"), *names)
    out = F.coalesce(F.col("_sibling") * 2, F.when(F.col("parent_id") != -1, F.col("parent_id") * 2 + 1))
    leave = F.struct((F.col("id") * 2 + 1).alias("step"), out.alias("next"), F.lit(1).alias("rise"), *((F.col(n) * 0).alias(n) for n in names))
    ahead = rows.select(F.inline(F.array(into, leave))).withColumn("last", F.coalesce("next", "step"))
    sums = ["rise", *names]
    ahead = written(ahead.select("step", "next", "last", F.col("rise").cast("bigint").alias("rise"), *names), "tour")
    while True:
        on = ahead.select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("last").alias("_last"), *(F.col(n).alias(f"_{n}") for n in sums))
        more = [(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in sums]
        ahead = written(ahead.join(on, "next", "left").select("step", F.col("_next").alias("next"), F.coalesce("_last", "last").alias("last"), *more), "tour")
        if ahead.where("next IS NOT NULL").isEmpty():
            break
    entered = F.col("step") % 2 == 0
    pick = lambda n, at: F.max(F.when(at, F.col(n)))
    found = ahead.groupBy(F.shiftright("step", 1).alias("id")).agg(
        F.shiftright(F.max("last"), 1).alias("root"), pick("rise", entered).alias("depth"), pick("size", entered).alias("_ahead"), *((pick(n, entered) - pick(n, ~entered)).alias(n) for n in names)
    )
    whole = found.where("id = root").select("root", F.col("_ahead").alias("_whole"))
    return found.join(whole, "root").select("id", "root", "depth", (F.col("_whole") - F.col("_ahead") + 1).alias("place"), *names)


def counts(tree: DataFrame) -> DataFrame:
    """id, children, descendants, ancestors, leaves below (a leaf is below itself)."""
    degree = with_degree(tree)
    found = tour(degree, leaves=(F.col("children") == 0).cast("bigint"))
    return degree.select("id", "children").join(found, "id").select("id", "children", (F.col("size") - 1).alias("descendants"), F.col("depth").alias("ancestors"), "leaves")


def preorder(tree: DataFrame) -> DataFrame:
    """id, place: depth-first order, roots and children by id, from 1."""
    found = tour(tree).select("id", "root", F.col("place").alias("_place"))
    return numbered(found, [F.col("root"), F.col("_place")], "place").select("id", "place")


def breadth_first_ids(tree: DataFrame) -> DataFrame:
    """id, new_id, new_parent: nodes numbered from 1 by depth, then by parent's number and id, which is the depth-first order of a depth."""
    order = numbered(tour(tree).select("id", "root", "depth", "place"), [F.col("depth"), F.col("root"), F.col("place")], "new_id").select("id", "new_id")
    found = written(order, "numbers")
    parent = found.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return tree.select("id", "parent_id").join(found, "id").join(parent, "parent_id", "left").select("id", "new_id", F.coalesce("new_parent", F.lit(-1).cast("bigint")).alias("new_parent"))


def branches(tree: DataFrame) -> DataFrame:
    """id, branch_id, parent_branch, dist_to_parent, dist_to_branch_start, dist_to_root, topology.

    A branch begins below a root or a branching node; branch_id is its first node. A root is its own branch.
    """
    return placed_branches(tree).drop("above")


def placed_branches(tree: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """branches() with above, the topology of the node that the branch hangs on; of the ids in only, where given.

    Nodes walk up to the beginning of their branch with what they need, and only the branches, which are fewer, walk on to the root.
    """
    kinds = with_degree(tree.select("id", "parent_id", *"xyz"))
    parents = kinds.select(F.col("id").alias("parent_id"), F.col("topology").alias("above"), *(F.col(a).alias(f"_p{a}") for a in "xyz"))
    own = kinds.join(parents, "parent_id", "left").withColumn("_starts", (F.col("parent_id") == -1) | F.coalesce(F.col("above").isin(ROOT, BRANCH), F.lit(False)))
    own = own.withColumn("edge", F.coalesce(geometry.distance([F.col(a) for a in "xyz"], [F.col(f"_p{a}") for a in "xyz"]), F.lit(0.0)))
    nodes = climbed(own.select("id", *first_steps("_starts", "edge"), "parent_id", "edge", "topology", "above"))
    heads = nodes.where("id = head").select(F.col("id").alias("branch_id"), F.col("parent_id").alias("_joint"), F.col("edge").alias("_first"), "above")
    joints = nodes.select(F.col("id").alias("_joint"), F.col("head").alias("parent_branch"), F.col("length").alias("_in"))
    heads = written(heads.join(joints, "_joint", "left").where("_joint = -1 OR parent_branch IS NOT NULL").withColumn("parent_branch", F.coalesce("parent_branch", F.lit(-1).cast("bigint"))), "branches")
    links = heads.select(F.col("branch_id").alias("id"), F.col("parent_branch").alias("parent_id"), (F.col("_first") + F.coalesce("_in", F.lit(0.0))).alias("_up"), (F.col("parent_branch") == -1).alias("_top"))
    totals = climbed(links.select("id", *first_steps("_top", "_up"))).select(F.col("id").alias("branch_id"), F.col("length").alias("_total"))
    begun = heads.select("branch_id", "parent_branch", "_first", "above").join(totals, "branch_id")
    asked = nodes if only is None else nodes.join(only, "id", "left_semi")
    out = asked.select("id", F.col("head").alias("branch_id"), F.col("edge").alias("dist_to_parent"), "length", "topology").join(begun, "branch_id")
    return out.select("id", "branch_id", "parent_branch", "dist_to_parent", (F.col("length") + F.col("_first")).alias("dist_to_branch_start"), (F.col("length") + F.col("_total")).alias("dist_to_root"), "topology", "above")


def branch_table(tree: DataFrame) -> DataFrame:
    """branch_id, nodes, length, end topology: length is the distance of the last node from the branch's start."""
    return summed(branches(tree))


def summed(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.groupBy("branch_id").agg(F.count("*").alias("nodes"), F.max("dist_to_branch_start").alias("length"), F.max_by("topology", "dist_to_branch_start").alias("ends"), *more)


def remove_small_leaf_branches(tree: DataFrame, nodes: int, length: float) -> DataFrame:
    """Without the branches that end in a leaf, hang on a branching node, and have fewer nodes and less length."""
    rows = written(placed_branches(tree).select("id", "branch_id", "dist_to_branch_start", "topology", "above"), "branches")
    small = summed(rows, F.max("above").alias("above")).where((F.col("nodes") < nodes) & (F.col("length") < length) & (F.col("ends") == LEAF) & (F.col("above") == BRANCH))
    return tree.join(rows.join(small.select("branch_id"), "branch_id", "left_semi").select("id"), "id", "left_anti")


def total_length(tree: DataFrame) -> DataFrame:
    return with_edges(tree).agg(F.count("*").alias("nodes"), F.sum("edge").alias("length"))


def thickest(tree: DataFrame, by: str) -> DataFrame:
    """The thickest node of each tree (ties: the smallest id)."""
    return tree.groupBy(by).agg(F.max_by("id", F.struct("radius", -F.col("id"))).alias("id"), F.max("radius").alias("radius"))


def delete_nodes(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the nodes; their children become roots."""
    return reparented(tree.join(ids.select("id"), "id", "left_anti"))


def erase_nodes(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the nodes; their children move to the nearest ancestor that stays."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    marked = written(tree.join(gone, "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False))), "marked")
    stays = walks(marked, "NOT _gone").join(marked.where("NOT _gone").select(F.col("id").alias("head")), "head", "left_semi")
    up = stays.select(F.col("id").alias("parent_id"), F.col("head").alias("_parent"))
    return marked.where("NOT _gone").join(up, "parent_id", "left").withColumn("parent_id", F.coalesce("_parent", F.lit(-1))).select(*tree.columns)


def erase_subtrees(tree: DataFrame, ids: DataFrame) -> DataFrame:
    return tree.join(subtree(tree, ids).select("id"), "id", "left_anti")


def rerooted(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """Every tree hung up at its node among the tops (id; at most one a tree): the parents on that node's path to the root are turned round."""
    path = tree.join(selection(tree, tops, "upstream"), "id", "left_semi")
    below = path.where("parent_id <> -1").select(F.col("parent_id").alias("id"), F.col("id").alias("_new"))
    turned = written(path.select("id").join(below, "id", "left").select("id", F.coalesce("_new", F.lit(-1)).alias("_new")), "turned")
    return tree.join(turned, "id", "left").withColumn("parent_id", F.coalesce("_new", "parent_id")).select(*tree.columns)


def set_as_root(tree: DataFrame, node: int) -> DataFrame:
    return rerooted(tree, tree.where(F.col("id") == node).select("id"))


def label_soma(tree: DataFrame, least_radius: float, soma: int = 1, other: int = 0) -> DataFrame:
    """Trees hung up at their thickest node are labelled: a node is soma if it is the root, or its parent is and 3 * radius >= the largest radius. Trees thinner than least_radius have none."""
    rooted = tree.join(depths(tree).select("id", "root"), "id")
    best = thickest(rooted, "root").select(F.col("root"), F.col("id").alias("_top"), F.col("radius").alias("_most"))
    hung = rerooted(rooted.join(best, "root"), best.select(F.col("_top").alias("id")))
    wide = (F.col("parent_id") == -1) | (F.col("radius") * 3 >= F.col("_most"))
    thin = hung.select(*tree.columns, "_most", (~wide).alias("_thin"))
    # a node is soma if no node on its way to the root, itself included, is thin
    cut = walks(thin, "_thin").join(thin.where("_thin").select(F.col("id").alias("head"), F.lit(True).alias("_cut")), "head", "left")
    kinds = cut.select("id", F.col("_cut").isNull().alias("_soma"))
    return thin.join(kinds, "id").withColumn("type", F.when(F.col("_soma") & (F.col("_most") >= least_radius), soma).otherwise(other)).drop("_thin", "_soma", "_most")


def merge_soma(tree: DataFrame, soma: int = 1) -> DataFrame:
    """tree (with type) whose soma roots take in the soma nodes that hang together with them; the children of those move to the root."""
    heads = walks(tree, f"type <> {soma}").select("id", F.col("head").alias("_head"))
    roots = tree.where((F.col("parent_id") == -1) & (F.col("type") == soma)).select(F.col("id").alias("_head"))
    taken = written(heads.join(roots, "_head", "left_semi"), "soma")
    rest = tree.join(taken.where("id <> _head").select("id"), "id", "left_anti")
    up = taken.select(F.col("id").alias("parent_id"), "_head")
    return rest.join(up, "parent_id", "left").withColumn("parent_id", F.coalesce("_head", "parent_id")).select(*tree.columns)


def on_branches(points: DataFrame, key: str, tree: DataFrame, cell: float) -> DataFrame:
    """_key (of points), id, branch_id, share, distance, dist_to_branch_start, dist_to_root: where the point of the tree nearest to each point lies on its branch.

    share is 0 at the node id and 1 at its parent. A tree of one node is the sphere around it. Points without coordinates have no row.
    """
    near = written(nearest_on_tree(points, key, segments(tree), cell), "near")
    at = near.join(placed_branches(tree, near.select("id")), "id")
    back = F.col("share") * F.col("dist_to_parent")
    return at.select("_key", "id", "branch_id", "share", "distance", (F.col("dist_to_branch_start") - back).alias("dist_to_branch_start"), (F.col("dist_to_root") - back).alias("dist_to_root"))


def layer_features(tree: DataFrame, margin: float) -> DataFrame:
    """id, z, n: how many edges (node to parent; a root's parent lies at z = 0) reach into z - margin to z + margin.

    Those are the edges that begin by z + margin without those that end before z - margin, so two running sums over distinct heights
    answer all nodes and no edge meets a node.
    """
    parent = tree.select(F.col("id").alias("parent_id"), F.col("z").alias("_pz"))
    edges = tree.join(parent, "parent_id", "left").select("z", F.coalesce("_pz", F.lit(0.0)).alias("_pz"))
    spans = written(edges.select("z", F.least("z", "_pz").alias("low"), F.greatest("z", "_pz").alias("high")), "spans")
    heights = spans.select("z").distinct()

    def upto(end: str, shift: float, first: int) -> DataFrame:
        ends = spans.groupBy(F.col(end).alias("at")).agg(F.count("*").alias("_n")).select("at", F.lit(0).alias("asks"), "_n", F.lit(None).cast("double").alias("z"))
        asks = heights.select((F.col("z") + shift).alias("at"), F.lit(first).alias("asks"), F.lit(0).cast("bigint").alias("_n"), "z")
        return running(ends.union(asks), [F.col("at"), F.col("asks"), F.col("z")], F.col("_n"), "upto").where("z IS NOT NULL").select("z", F.col("upto").alias(end))

    begun, ended = upto("low", margin, 1), upto("high", -margin, -1)
    counts = begun.join(ended, "z").select("z", (F.col("low") - F.col("high")).alias("n"))
    return tree.select("id", "z").join(counts, "z").select("id", "z", "n")


def layer_similarity(z1: Column, n1: Column, z2: Column, n2: Column, scale: float, base: float) -> Column:
    """How alike two layer features are: more for thick layers, for like counts and for near heights."""
    low, high = F.least(n1, n2), F.greatest(n1, n2)
    return F.sqrt(low) * low / high / (F.abs(z1 - z2) / scale + base)


def label_volume(tree: DataFrame, cell: float) -> DataFrame:
    """z, y, x, label of the voxels whose centres (whole coordinates) lie in a tube of the tree: the smallest id of those that hold it.

    A tube is cut into pieces of about a cell's length, and only the voxels of their boxes are tried.
    """
    tubes = segments(tree).where((F.col("ar") > 0) | (F.col("br") > 0))
    boxes = pieces(tubes, cell)
    for a in "xyz":
        low, high = F.ceil(F.col(f"_low_{a}")), F.floor(F.col(f"_high_{a}"))
        boxes = boxes.withColumn(a, F.explode(F.when(low <= high, F.sequence(low, high))))
    hit = geometry.in_tube([F.col(a).cast("double") for a in "xyz"], *([F.col(f"{k}{a}") for a in "xyz"] for k in "ab"), F.col("ar"), F.col("br"))
    return boxes.where(hit).groupBy("z", "y", "x").agg(F.min("id").alias("label"))


def turns(tree: DataFrame) -> DataFrame:
    """id of the nodes with one child where the way turns by a right angle or more."""
    kinds = with_degree(tree)
    one = kinds.where("children = 1 AND parent_id <> -1")
    child = tree.where("parent_id <> -1").select(F.col("parent_id").alias("id"), *(F.col(a).alias(f"c{a}") for a in "xyz"))
    parent = tree.select(F.col("id").alias("parent_id"), *(F.col(a).alias(f"p{a}") for a in "xyz"))
    rows = one.join(child, "id").join(parent, "parent_id")
    into = [F.col(f"p{a}") - F.col(a) for a in "xyz"]
    out = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    return rows.where(geometry.dot(into, out) <= 0).select("id")


def spurs(tree: DataFrame) -> DataFrame:
    """id of the leaves whose parent is a branching node."""
    kinds = with_degree(tree)
    return kinds.where(F.col("topology") == LEAF).join(kinds.where(F.col("topology") == BRANCH).select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id")


def orphan_roots(tree: DataFrame, least_length: float, least_count: int) -> DataFrame:
    """root, length of the trees kept: those whose longest way from the root is at least a limit, the mean of all where least_length is 0 and there are least_count trees or more."""
    trunks = depths(tree).groupBy("root").agg(F.max("dist_to_root").alias("length"))
    found = trunks.agg(F.count("*"), F.avg("length")).first()
    limit = found[1] if least_length == 0 and found[0] >= least_count and found[0] else least_length
    return trunks.where(F.col("length") >= limit).orderBy(F.col("root").desc())


def merge_close(tree: DataFrame, limit: float) -> DataFrame:
    """Without the nodes nearer than limit to their parent (not branching nodes); children move up."""
    near = with_edges(with_degree(tree)).where(f"parent_id <> -1 AND edge < {limit} AND topology <> {BRANCH}").select("id")
    return erase_nodes(tree, near)


def resample(tree: DataFrame, step: float) -> DataFrame:
    """Points every step along each edge (from the parent, its own end included), position and radius interpolated."""
    parent = tree.select(F.col("id").alias("parent_id"), *(F.col(a).alias(f"p_{a}") for a in ("x", "y", "z", "radius")))
    edged = with_edges(tree).join(parent, "parent_id")
    n = F.greatest(F.lit(1), F.ceil(F.col("edge") / step)).cast("int")
    points = edged.withColumn("_n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    share = F.col("k") / F.col("_n")
    return points.select("id", "k", *((F.col(f"p_{a}") + share * (F.col(a) - F.col(f"p_{a}"))).alias(a) for a in ("x", "y", "z", "radius")))


def selection(tree: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """ids of the nodes that a selection grows to: downstream, upstream, neighbours, branch, connected."""
    if how == "downstream":
        return subtree(tree, ids).select("id")
    if how == "upstream":
        chosen = tree.join(ids.select("id", F.lit(1).cast("bigint").alias("_chosen")).distinct(), "id", "left")
        return tour(chosen, chosen=F.coalesce("_chosen", F.lit(0).cast("bigint"))).where("chosen > 0").select("id")
    if how == "neighbours":
        edge = tree.where("parent_id <> -1").select(F.col("id").alias("a"), F.col("parent_id").alias("b"))
        both = edge.union(edge.select("b", "a"))
        return both.join(ids.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).union(ids.select("id")).distinct()
    if how in ("branch", "connected"):
        key, rows = ("branch_id", branches(tree)) if how == "branch" else ("root", depths(tree))
        return rows.join(rows.join(ids.select("id"), "id", "left_semi").select(key).distinct(), key, "left_semi").select("id")
    raise ValueError(f"unknown selection {how}")


def resort_pyramidal(tree: DataFrame, soma: int = 1, basal: int = 3, apical: int = 4) -> DataFrame:
    """tree (with type) whose nodes other than soma become basal, or apical below a child of a soma node that lies above it in y."""
    parents = tree.select(F.col("id").alias("parent_id"), F.col("type").alias("_pt"), F.col("y").alias("_py"))
    heads = tree.join(parents, "parent_id").where((F.col("_pt") == soma) & (F.col("type") != soma) & (F.col("y") > F.col("_py")))
    below = subtree(tree, heads.select("id")).select("id", F.lit(True).alias("_up"))
    kind = F.when(F.col("type") == soma, soma).when(F.col("_up"), apical).otherwise(basal)
    return tree.join(below, "id", "left").withColumn("type", kind).select(*tree.columns)


def reconnected(tree: DataFrame, limit: float) -> DataFrame:
    """Roots hung on the nearest node of another tree, where one is within limit: the lightest links that join trees without a ring."""
    from voxloom.operators.graph import minimum_spanning_forest
    from voxloom.operators.joins import within

    own = tree.join(depths(tree).select("id", "root"), "id")
    near = within(own.where("parent_id = -1").select("id", "root", "x", "y", "z"), own.select("id", "root", "x", "y", "z"), limit).where("a_root <> b_root")
    links = near.groupBy("a_root", "b_root").agg(F.min(F.struct("distance", "a_id", "b_id")).alias("m"))
    links = written(links.select("a_root", "b_root", "m.*"), "links")
    used = minimum_spanning_forest(links.select(F.col("a_root").alias("s"), F.col("b_root").alias("d"), F.col("distance").alias("w")))
    picked = links.join(used.select(F.col("s").alias("_s"), F.col("d").alias("_d"), F.col("w").alias("_w")), (F.least("a_root", "b_root") == F.col("_s")) & (F.greatest("a_root", "b_root") == F.col("_d")) & (F.col("distance") == F.col("_w")))
    # a root can take one parent only: of several links its lightest counts
    one = picked.groupBy(F.col("a_id").alias("id")).agg(F.min_by("b_id", F.struct("distance", "b_id")).alias("_new"), F.min("b_root").alias("_other"))
    free = one.join(one.select(F.col("id").alias("_other"), F.lit(True).alias("_both")), "_other", "left").where(F.col("_both").isNull() | (F.col("id") > F.col("_other"))).select("id", "_new")
    return tree.join(free, "id", "left").withColumn("parent_id", F.coalesce("_new", "parent_id")).select(*tree.columns)
