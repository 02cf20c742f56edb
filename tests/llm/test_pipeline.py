import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_prob_minhash import classes
from voxloom.llm import quality, secrets
from voxloom.llm.tokens import default_vocabulary, encoder

SF = "/root/testdata/sf0.01"


def test_each_stage_against_a_plain_version(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x.text for x in docs.collect()}
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before
        if name != "packing":
            assert docs.columns == columns
            now = {x.doc_id: x.text for x in docs.collect()}
            assert len(now) == docs.count()
        if name == "quality":
            good = {x.doc_id for x in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
            bad = {x.doc_id for x in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
            assert len(good & set(now)) > 0.97 * len(good) and len(bad & set(now)) < 0.1 * len(bad)
            assert all(before[i] == t for i, t in now.items())
        if name == "near_copies":
            label = classes(before)
            assert now == {i: t for i, t in before.items() if label[i] == i}
        if name == "benchmark_leaks":
            gone = {i for i, _ in leaked(before, {x.item_id: x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})}
            assert gone and now == {i: t for i, t in before.items() if i not in gone}
        if name == "secrets":
            assert set(now) == set(before)
            for i, text in before.items():
                base = secrets.base_spans(text)
                assert bool(base) <= (corpus_pipeline.MASK in now[i]) and not any(text[a:b] in now[i] for a, b, _ in base)
            assert docs.where(F.char_length("text") != F.col("n_chars")).count() == 0
        if name == "packing":
            encode = encoder(default_vocabulary())
            out = docs.toPandas().sort_values("start")
            assert {i: [t for x in own.ids for t in x] for i, own in out.groupby("doc_id")} == {i: [*encode(t).tolist(), 1] for i, t in before.items()}
            assert out.sequence_id.nunique() * 2048 / out.length.sum() < 1.02


def test_run_and_odd_rows(spark, odd, none):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark_leaks", "secrets", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and np.all([c in out.columns for c in ("doc_id", "ids", "sequence_id", "offset")])
    rows = corpus_pipeline.drop_near_copies(spark, odd, "")
    assert sorted(str(x.doc_id) for x in rows.collect()) == ["1", "3", "5", "6", "7", "None"] and rows.columns == odd.columns
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        assert stage(spark, odd, sf).count() <= 200, name
    assert isinstance(quality.train(none, spark.read.parquet(f"{sf}/labels.parquet")), float)
