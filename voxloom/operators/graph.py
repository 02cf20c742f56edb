"""Graph operators: components of links, components of voxels, spanning forests, shortest paths."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import blocks
from voxloom.operators.neighborhood import KEYS, neighbour_pairs, offsets
from voxloom.storage import written


def components(links: DataFrame) -> DataFrame:
    """id, label (the smallest id of its component) for every id in links (a, b).

    Alternates two steps until nothing changes: every node ties its larger neighbours to its smallest neighbour, then its smaller
    ones. Each keeps components whole, and edges contract to stars around the smallest ids in a few rounds. Nodes with very many
    neighbours are only ever grouped by a minimum and joined.
    """
    edges = written(links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).where("high > low").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))  # node, neighbour
        least = both.groupBy("high").agg(F.min("low").alias("m")).select("high", F.least("high", "m").alias("m"))
        larger = both.where("low > high").join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low")).where("high > low").distinct()
        smallest = larger.groupBy("high").agg(F.min("low").alias("m"))
        smaller = larger.join(smallest, "high")
        edges = written(smaller.select(F.when(F.col("low") == F.col("m"), F.col("high")).otherwise(F.col("low")).alias("high"), F.col("m").alias("low")).where("high > low").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("high").agg(F.min("low").alias("label")).select(F.col("high").alias("id"), "label").union(edges.select(F.col("low").alias("id"), F.col("low").alias("label")).distinct())


def component_sizes(links: DataFrame) -> DataFrame:
    """label, size of the components, single nodes of self-links included."""
    nodes = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    found = components(links)
    return nodes.join(found, "id", "left").select(F.coalesce("label", "id").alias("label")).groupBy("label").agg(F.count("*").alias("size"))


def voxel_components(voxels: DataFrame, size: dict[str, int], connectivity: int = 0, predicate: Column | None = None) -> DataFrame:
    """The foreground voxels with label: components of each (image, t, c), numbered from 1 in the order of their first voxel (x fastest)."""
    front = voxels.where(F.col("v") > 0 if predicate is None else predicate).drop("label")
    return blocks.parts(front, size, connectivity, "components").drop("_lost")


def large_objects(labelled: DataFrame, least: int) -> DataFrame:
    """The voxels of objects of at least so many, numbered anew in each image from the largest (ties: the earlier label)."""
    groups = [k for k in KEYS if k in labelled.columns and k not in ("z", "y", "x")]
    sizes = labelled.groupBy(*groups, "label").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    order = Window.partitionBy(*groups).orderBy(F.col("_n").desc(), "label")
    return labelled.join(sizes.select(*groups, "label", F.row_number().over(order).cast("bigint").alias("_rank")), [*groups, "label"]).drop("label").withColumnRenamed("_rank", "label")


def seeded_objects(labelled: DataFrame, seeds: DataFrame) -> DataFrame:
    """The voxels of objects that hold a seed (keys of a voxel, seed), labelled by their smallest seed."""
    groups = [k for k in KEYS if k in labelled.columns and k not in ("z", "y", "x")]
    keys = [k for k in KEYS if k in labelled.columns]
    found = labelled.join(seeds.select(*keys, "seed"), keys).groupBy(*groups, "label").agg(F.min("seed").alias("seed"))
    return labelled.join(found, [*groups, "label"]).drop("label").withColumnRenamed("seed", "label")


def minimum_spanning_forest(edges: DataFrame) -> DataFrame:
    """s, d, w of a spanning forest of least weight (ties: the smallest nodes), by Boruvka rounds: every component takes its lightest edge out.

    A round is one grouped minimum and one merge of components; the number of components at least halves.
    """
    edges = written(edges.where("s <> d").select(F.least("s", "d").alias("s"), F.greatest("s", "d").alias("d"), "w").groupBy("s", "d").agg(F.min("w").alias("w")), "graph")
    label = written(edges.select(F.explode(F.array("s", "d")).alias("id")).distinct().withColumn("label", F.col("id")), "forest")
    chosen = None
    while True:
        own = edges.join(label.withColumnsRenamed({"id": "s", "label": "ls"}), "s").join(label.withColumnsRenamed({"id": "d", "label": "ld"}), "d").where("ls <> ld")
        out = own.select(F.explode(F.array("ls", "ld")).alias("label"), F.struct("w", "s", "d").alias("e"), "ls", "ld").groupBy("label").agg(F.min_by(F.struct("e", "ls", "ld"), "e").alias("x"))
        picked = written(out.select("x.e.s", "x.e.d", "x.e.w", F.col("x.ls").alias("a"), F.col("x.ld").alias("b")).distinct(), "picked")
        if picked.isEmpty():
            break
        chosen = picked.select("s", "d", "w") if chosen is None else chosen.union(picked.select("s", "d", "w"))
        merged = components(picked.select("a", "b")).select(F.col("id").alias("label"), F.col("label").alias("_new"))
        label = written(label.join(merged, "label", "left").select("id", F.coalesce("_new", "label").alias("label")), "forest")
    return edges.where("false").select("s", "d", "w") if chosen is None else chosen.distinct()


def shortest_distances(edges: DataFrame, source: int) -> DataFrame:
    """id, distance, previous: single-source shortest paths over an undirected graph (s, d, w >= 0), relaxed from the frontier that last improved."""
    both = written(edges.select("s", "d", "w").union(edges.select("d", "s", "w")), "graph")
    known = both.sparkSession.createDataFrame([(source, 0.0, None)], "id long, distance double, previous long")
    frontier = known
    while True:
        reached = frontier.join(both, frontier["id"] == both["s"]).select(F.col("d").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.col("s").alias("previous"))
        best = reached.groupBy("id").agg(F.min(F.struct("distance", "previous")).alias("n"))
        frontier = written(best.join(known.select("id", F.col("distance").alias("old")), "id", "left").where("old IS NULL OR n.distance < old").select("id", "n.distance", "n.previous"), "frontier")
        if frontier.isEmpty():
            return known
        known = written(known.join(frontier.select("id"), "id", "left_anti").unionByName(frontier), "known")


# Edge weights between neighbouring voxels of values a and b at a distance.
def weight_inverse(distance: Column, a: Column, b: Column) -> Column:
    return distance * (1 / (a + 1) + 1 / (b + 1))


def weight_sigmoid(distance: Column, a: Column, b: Column, centre: float, scale: float) -> Column:
    return distance * (1 / (1 + F.exp((a - centre) / scale)) + 1 / (1 + F.exp((b - centre) / scale)) + 1e-5)


def weight_guarded(distance: Column, a: Column, b: Column, centre: float, scale: float) -> Column:
    return F.when((a < centre) | (b < centre), F.lit(1000.0)).otherwise(weight_sigmoid(distance, a, b, centre, scale))


def voxel_edges(voxels: DataFrame, size: dict[str, int], weight: Callable[[Column, Column, Column], Column], connectivity: int = 0, spacing: dict[str, float] | None = None) -> DataFrame:
    """s, d, w between neighbouring voxels of one image, numbered x fastest."""
    spacing = spacing or {}
    pairs = neighbour_pairs(voxels, offsets(connectivity, 2 if size["z"] == 1 else 3))
    length = F.sqrt(sum((((F.col(k) - F.col(f"n{k}")) * float(spacing.get(k, 1.0))) ** 2 for k in "zyx"), F.lit(0.0)))
    number = lambda z, y, x: (F.col(z) * size["y"] + F.col(y)) * size["x"] + F.col(x)
    rows = pairs.select(number("z", "y", "x").alias("s"), number("nz", "ny", "nx").alias("d"), weight(length, F.col("v"), F.col("nv")).alias("w"))
    return rows.where("s < d")


def path_costs(regions: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """region, cost of the cheapest path between two nodes of each bounded region (region, s, d, w, source, target): Dijkstra, a task a region."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[tuple[int, float]]] = {}
        for s, d, w in own[["s", "d", "w"]].itertuples(index=False):
            near.setdefault(s, []).append((d, w))
            near.setdefault(d, []).append((s, w))
        start, end, best, heap = int(own[source].iloc[0]), int(own[target].iloc[0]), {}, [(0.0, int(own[source].iloc[0]))]
        while heap:
            cost, node = heapq.heappop(heap)
            if node in best:
                continue
            best[node] = cost
            if node == end:
                break
            for other, w in near.get(node, ()):
                if other not in best:
                    heapq.heappush(heap, (cost + w, other))
        return pd.DataFrame({"region": [own["region"].iloc[0]], "cost": [best.get(end, 0.0 if start == end else np.inf)]})

    return regions.groupBy("region").applyInPandas(run, "region long, cost double")
