"""Sources and sinks as queries: tables are written in a format, read back by its reader, and held against the SQL over the tables themselves."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom import mapping
from voxloom.functions import hashing
from voxloom.queries import PTS, TREE, VOX, Query
from voxloom.sources import arrays, chunks, precomputed, readers, text
from voxloom.storage import shared_dir

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voxloom/{uuid.uuid4().hex}/{name}"


def images(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.images(spark, sf).select("image_id", "t", "c", "z", "y", "x", "v")


def container(spark: SparkSession, sf: str) -> str:
    """Two levels of the images in chunks of 4 x 4."""
    path = scratch(spark, "image")
    size = {"z": 1, "y": 4, "x": 4}
    levels = [chunks.to_chunks(x, size, level, 2**level) for level, x in enumerate(chunks.pyramid(images(spark, sf), 2))]
    chunks.write(levels[0].unionByName(levels[1]), path)
    return path


@query(f"WITH {VOX} SELECT image_id, max(x) + 1 AS width, max(y) + 1 AS height, CAST(1 AS BIGINT) AS depth, min(v) AS min_v, max(v) AS max_v FROM vox GROUP BY image_id")
def s03_infos(spark, sf):
    return readers.infos(images(spark, sf)).select("image_id", "width", "height", "depth", "min_v", "max_v")


@query(f"WITH {VOX}, low AS (SELECT image_id, y // 2 AS y, x // 2 AS x, CAST(trunc(avg(v)) AS BIGINT) AS v FROM vox GROUP BY 1, 2, 3) SELECT image_id, y - 1 AS y, x AS x, v FROM low WHERE y BETWEEN 1 AND 2 AND x < 3")
def s04_region_of_a_level(spark, sf):
    return chunks.read_region(spark, container(spark, sf), 1, {"y": (1, 3), "x": (0, 3)}).select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


@query(f"WITH {VOX} SELECT DISTINCT image_id, y // 4 AS cy, x // 4 AS cx FROM vox")
def s05_columns_without_voxels(spark, sf):
    return chunks.read(spark, container(spark, sf), 0, columns=["image_id", "cy", "cx"])


@query(f"WITH {VOX} SELECT CASE image_id WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS z, y, x, v FROM vox WHERE image_id IN (1, 2, 10)")
def s06_sequence(spark, sf):
    """Three images of one file each, in the natural order of their names."""
    own, folder = images(spark, sf), scratch(spark, "sequence")
    paths = [f"{folder}/image{k}" for k in (10, 1, 2)]
    for k, path in zip((10, 1, 2), paths, strict=True):
        own.where(F.col("image_id") == k).coalesce(1).write.parquet(path)
    return chunks.read_sequence(spark, paths, "z").select("z", "y", "x", "v")


@query(f"WITH {VOX} SELECT image_id, y - 2 AS y, x - 3 AS x, v FROM vox WHERE y BETWEEN 2 AND 6 AND x BETWEEN 3 AND 5")
def s10_region_of_a_container(spark, sf):
    return chunks.read_region(spark, container(spark, sf), 0, {"y": (2, 7), "x": (3, 6)}).select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


@query(f"WITH {VOX} SELECT image_id, y, x, v FROM vox")
def s09_written_and_read(spark, sf):
    path = container(spark, sf)
    return chunks.to_voxels(chunks.read(spark, path, 0)).select("image_id", "y", "x", F.col("v").cast("bigint").alias("v"))


def forest(spark: SparkSession, sf: str, name: str) -> str:
    path = scratch(spark, name)
    text.write_swc(mapping.tree(spark, sf).withColumn("type", F.lit(3)).coalesce(1), path)  # a file is a forest of its own
    return path


@query(f"WITH {TREE} SELECT id, CAST(3 AS BIGINT) AS type, x, y, z, radius, parent_id FROM tree")
def s15_swc(spark, sf):
    return text.read_swc(spark, forest(spark, sf, "forest")).drop("tree_id")


@query(f"WITH {TREE} SELECT id, parent_id, radius FROM tree")
def s02_reader_by_extension(spark, sf):
    return readers.read(spark, forest(spark, sf, "forest.swc")).select("id", "parent_id", "radius")


@query(f"WITH {PTS} SELECT x, y, z, v AS radius, CAST(pid AS VARCHAR) AS name, count(*) AS n FROM pts GROUP BY ALL")
def s16_marker(spark, sf):
    path = scratch(spark, "points.marker")
    own = mapping.puncta_voxels(spark, sf)
    own.select(F.concat_ws(", ", "x", "y", "z", "v", F.lit("1"), F.col("pid").cast("string"), F.lit("")).alias("value")).write.text(path)
    return text.read_points(spark, path, "marker").groupBy("x", "y", "z", "radius", "name").agg(F.count("*").alias("n"))


@query(f"WITH {PTS} SELECT x, y, z, v AS mass, CAST(pid AS VARCHAR) AS name, count(*) AS n FROM pts GROUP BY ALL")
def s16_apo(spark, sf):
    path = scratch(spark, "points.apo")
    own = mapping.puncta_voxels(spark, sf)
    zero = [F.lit("0")] * 4
    own.select(F.concat_ws(",", F.lit("1"), F.lit(""), F.col("pid").cast("string"), F.lit(""), "z", "x", "y", *zero, "v").alias("value")).write.text(path)
    return text.read_points(spark, path, "apo").groupBy("x", "y", "z", "mass", "name").agg(F.count("*").alias("n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name || ', \"' || p_brand || '\"' AS name, CAST(3 AS BIGINT) AS cells FROM part")
def s18_csv(spark, sf):
    """Cells with delimiters and quotes in them."""
    path = scratch(spark, "parts.csv")
    own = mapping.table(spark, sf, "part").select("p_partkey", F.concat(F.lit('"'), F.col("p_name"), F.lit(', ""'), "p_brand", F.lit('"""')).alias("name"), "p_size")
    own.select(F.concat_ws(",", F.col("p_partkey").cast("string"), "name", F.col("p_size").cast("string")).alias("value")).write.text(path)
    cells = text.read_table(spark, path)
    return cells.select(F.col("cells")[0].cast("bigint").alias("id"), F.col("cells")[1].alias("name"), F.size("cells").cast("bigint").alias("cells"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS label, p_brand AS description, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS tag, CAST(p_size AS DOUBLE) AS size FROM part")
def s20_segment_properties(spark, sf):
    """Columnar documents of a brand, each of one range of 2,000 ids, however many parts a brand has."""
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_brand", "p_size")))
    own = mapping.table(spark, sf, "part").groupBy("p_brand", F.expr("p_partkey div 2000")).agg(rows.alias("r"))
    values = lambda f: F.transform("r", lambda x: f(x).cast("string"))
    none = F.lit(None).cast("string")
    prop = lambda id, kind, f, tags=None: F.struct(F.lit(id).alias("id"), F.lit(kind).alias("type"), none.alias("data_type"), (tags if tags is not None else F.lit(None).cast("array<string>")).alias("tags"), values(f).alias("values"))
    properties = F.array(
        prop("label", "label", lambda x: x["p_name"]), prop("description", "description", lambda x: x["p_brand"]), prop("size", "number", lambda x: x["p_size"]),
        prop("tags", "tags", lambda x: F.concat(F.lit("["), (x["p_size"] % 2).cast("string"), F.lit("]")), F.array(F.lit("even"), F.lit("odd"))),
    )
    document = F.to_json(F.struct(F.struct(values(lambda x: x["p_partkey"]).alias("ids"), properties.alias("properties")).alias("inline")))
    path = scratch(spark, "info")
    own.select(document.alias("value")).write.text(path)
    found = text.segment_properties(spark.read.text(path))
    return found.select(F.col("id").cast("bigint").alias("id"), "label", "description", F.col("tags")[0].alias("tag"), F.col("numbers")["size"].alias("size"))


@query(f"WITH {PTS} SELECT CAST(pid AS BIGINT) AS id, x, y, z, count(*) AS n FROM pts GROUP BY ALL")
def s21_annotations(spark, sf):
    path = scratch(spark, "annotations")
    own = mapping.puncta_voxels(spark, sf).select("set_id", F.struct(F.col("pid").cast("string").alias("id"), F.lit("point").alias("type"), F.array("x", "y", "z").alias("point")).alias("a"))
    own.groupBy("set_id").agg(F.to_json(F.collect_list("a")).alias("value")).select("value").write.text(path)
    found = text.annotations(spark.read.text(path)).select(F.col("id").cast("bigint").alias("id"), F.inline("pts"))
    return found.groupBy("id", "x", "y", "z").agg(F.count("*").alias("n"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(-1 AS BIGINT) AS parent_id, r_name AS name, substring(r_name, 1, 2) AS abbreviation FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey, n_name, substring(n_name, 1, 2) FROM nation")
def s22_ontology(spark, sf):
    """The five regions and their nations as one nested document."""
    regions, nations = (mapping.table(spark, sf, x).collect() for x in ("region", "nation"))  # 30 rows
    child = lambda n: {"id": n.n_nationkey + 100, "name": n.n_name, "acronym": n.n_name[:2], "parent_structure_id": n.n_regionkey}
    whole = [{"id": r.r_regionkey, "name": r.r_name, "acronym": r.r_name[:2], "children": [child(n) for n in nations if n.n_regionkey == r.r_regionkey]} for r in regions]
    return text.ontology(spark, json.dumps(whole))


@query("SELECT CAST(p_partkey AS VARCHAR) AS job, p_brand AS folder FROM part")
def s24_worklist(spark, sf):
    path = scratch(spark, "jobs")
    own = mapping.table(spark, sf, "part").select(F.col("p_partkey").alias("job"), F.lit("x").alias("unused"), F.concat(F.lit("  "), "p_brand").alias("folder"))
    own.write.csv(path, header=True, ignoreLeadingWhiteSpace=False)
    return text.worklist(spark, path, ["job", "folder"])


def murmur_sql(number: str) -> str:
    """The same hash in steps on numbers below 2^63."""
    times = lambda a, by: f"(({a}) * {by & 0xFFFF} + ({a}) * {by >> 16} % 65536 * 65536) % 4294967296"
    turned = lambda a, by: f"((({a}) << {by}) + (({a}) >> {32 - by})) % 4294967296"
    steps, at = [f"s0 AS (SELECT id, CAST({number} AS HUGEINT) & 4294967295 AS a, CAST({number} AS HUGEINT) >> 32 AS b, CAST(0 AS HUGEINT) AS c FROM events)"], 0

    def step(a: str, b: str, c: str = "c") -> None:
        nonlocal at
        at += 1
        steps.append(f"s{at} AS (SELECT id, {a} AS a, {b} AS b, {c} AS c FROM s{at - 1})")

    step(times("a", 0x239B961B), times("b", 0xAB0E9789))
    step(turned("a", 15), turned("b", 16))
    step(times("a", 0xAB0E9789), times("b", 0x38B34AE5))
    step("xor(a, 8)", "xor(b, 8)")
    step("(a + b + 16) % 4294967296", "b")
    step("a", "(a + b) % 4294967296", "(a + 8) % 4294967296")
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        step(*(f"xor({k}, {k} >> {shift})" for k in "abc"))
        step(*(times(k, by) for k in "abc"))
    step(*(f"xor({k}, {k} >> 16)" for k in "abc"))
    step("(a + b + c + c) % 4294967296", "b")
    step("a", "(a + b) % 4294967296")
    return ", ".join(steps) + f" SELECT id, CAST(a AS BIGINT) AS low, CAST(b AS BIGINT) AS high FROM s{at}"


@query("WITH " + murmur_sql("id * 1000003").replace("FROM events)", "FROM (SELECT event_id AS id FROM events))", 1))
def m13_murmur(spark, sf):
    h = hashing.murmur3_128(F.col("id") * 1000003)
    rows = mapping.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return rows.select("id", h.bitwiseAND(F.lit((1 << 32) - 1)).alias("low"), F.shiftrightunsigned(h, 32).alias("high"))


@query(f"WITH {VOX} SELECT image_id AS z, y, x, v FROM vox WHERE image_id >= 10 AND image_id < 75 AND y >= 2 AND x < 6")
def s19_sharded_box(spark, sf):
    """All images as the planes of one volume, written in shards; then a box of it."""
    planes = images(spark, sf).withColumns({"z": F.col("image_id"), "image_id": F.lit(0)})
    depth = int(planes.agg(F.max("z")).first()[0]) + 1
    volume = precomputed.Volume({"z": depth, "y": 8, "x": 8}, {"z": 16, "y": 4, "x": 4}, "uint8", precomputed.Sharding())
    path = scratch(spark, "volume")
    precomputed.write_volume(chunks.to_chunks(planes, volume.chunk), path, volume)
    return precomputed.read_box(spark, path, {"z": (10, 75), "y": (2, -1), "x": (0, 6)})


@query(f"WITH {VOX}, b AS (SELECT image_id, y, x, v, max(v) OVER (PARTITION BY image_id, y // 4, x // 4) AS top FROM vox) SELECT image_id, y, x, top - v AS v FROM b")
def s25_map_bricks(spark, sf):
    """Every brick of 4 x 4 as an array in its task, taken from its largest value."""
    bricks = chunks.to_chunks(images(spark, sf), {"z": 1, "y": 4, "x": 4})
    return chunks.to_voxels(arrays.map_bricks(bricks, lambda brick: brick.max() - brick)).select("image_id", "y", "x", "v")
