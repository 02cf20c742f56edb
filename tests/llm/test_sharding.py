import numpy as np
from pyspark.sql import functions as F

from voxloom.llm import queries, sharding
from voxloom.llm.common import written


def test_sizes_slots_and_determinism(spark, sf_dir):
    out = queries.op5_hypergeometric_shards(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    assert sorted(out.doc_id) == sorted(docs.doc_id)
    sizes = out.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("shard"))
    assert dict(zip(out.doc_id, out["size"], strict=True)) == {i: len(t.encode()) + 16 for i, t in zip(docs.doc_id, docs.text, strict=True)}
    again = queries.op5_hypergeometric_shards(spark, sf_dir).toPandas()
    both = [x.drop(columns="grown_shard").sort_values("doc_id").values.tolist() for x in (out, again)]
    assert both[0] == both[1]


def test_many_cells_are_uniform(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 50)
    monkeypatch.setattr(sharding, "PARTITION_ROWS", 100)
    rows = spark.range(10_007).select(F.col("id").alias("doc_id"))
    out = sharding.shuffle_into_shards(rows, ["doc_id"], shards=7, seed=3).toPandas()
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(x.slot) == list(range(len(x))) for _, x in out.groupby("shard"))
    out = out.sort_values("doc_id")
    assert abs(np.corrcoef(out.doc_id, out.slot)[0, 1]) < 0.05
    pairs = np.bincount(out.shard.values[:-1] * 7 + out.shard.values[1:], minlength=49)
    assert ((pairs - 10_006 / 49) ** 2 / (10_006 / 49)).sum() < 100


def test_matrix_has_exact_margins_and_the_right_law():
    counts, room = np.array([5, 0, 7, 3]), np.array([4, 4, 4, 3])
    for seed in range(50):
        m = np.array([sharding.matrix_row(p, counts, room, seed) for p in range(4)])
        assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == room).all()
    first = [sharding.matrix_row(0, counts, room, seed)[0] for seed in range(3000)]
    assert abs(np.mean(first) - 5 * 4 / 15) < 0.06


def test_large_populations_have_the_same_law(monkeypatch):
    monkeypatch.setattr(sharding, "LARGE", 0)
    rng = np.random.default_rng(1)
    mine = [sharding.hypergeometric(600, 400, 100, rng) for _ in range(4000)]
    monkeypatch.undo()
    theirs = rng.hypergeometric(600, 400, 100, 4000)
    assert abs(np.mean(mine) - np.mean(theirs)) < 0.5 and abs(np.std(mine) - np.std(theirs)) < 0.3


def test_rows_without_ids_spread_and_are_dealt_alike_again(spark, monkeypatch):
    """Half of all rows lack an id; some are equal in all columns. Partitions stay even, and a second computation from other partitions deals each row to its place."""
    rows = spark.range(20_000).selectExpr("if(id < 10000, null, id) AS doc_id", "16 + if(id < 3000, 1, id % 997) AS size", "if(id < 3000, 7, id * 31) AS text_crc32")
    keys = ["doc_id", "size", "text_crc32"]
    seen = []
    monkeypatch.setattr(sharding, "written", lambda df, name: seen.append((name, written(df, name))) or seen[-1][1])
    out = [sharding.shuffle_into_shards(rows.repartition(n), keys, shards=7, seed=3).toPandas() for n in (3, 8)]
    apart = next(df for name, df in seen if name == "told-apart")
    assert apart.select(*keys, "_copy").distinct().count() == 20_000 and apart.where("_copy > 0").count() == 3000
    of = [c for k in [*keys, "_copy"] for c in (F.col(k).isNull(), F.col(k))]
    counts = apart.groupBy(F.pmod(sharding.random_key(3, 0, of), F.lit(8))).count().toPandas()["count"]
    assert len(counts) == 8 and counts.max() < 1.1 * counts.min()
    first, again = (x.sort_values([*keys, "shard", "slot"]).fillna(-1).values.tolist() for x in out)
    assert first == again
    for x in out:
        sizes = x.groupby("shard").size()
        assert sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in x.groupby("shard"))


def test_odd_rows(odd, none):
    out = sharding.shuffle_into_shards(odd, ["doc_id"], shards=4)
    assert sorted(x["count"] for x in out.groupBy("shard").count().collect()) == [2, 2, 2, 3]
    assert set(out.columns) == {*odd.columns, "slot"} and out.where("doc_id is null").count() == 1
    assert sharding.shuffle_into_shards(odd, ["doc_id"], shards=40).select("shard").distinct().count() == 9
    assert sharding.shuffle_into_shards(none, ["doc_id"]).count() == 0
