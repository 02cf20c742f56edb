import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import packing, queries, token_counts
from voxloom.llm.tokens import default_vocabulary, encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


def texts(spark, sf_dir):
    return [x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_both_files_of_the_vocabulary_give_the_same_ids(spark, sf_dir):
    fast, plain = encoder(default_vocabulary()), encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*texts(spark, sf_dir), "", "é漢字🙂 \x00\t tail", "<|endoftext|> x", "a\r\n\n  b c　d", "1234 it's 'S", "x" * 5000]:
        assert fast(text).tolist() == plain(text).tolist()


def test_pieces_tile_documents_and_sequences(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = packing.pack(docs).toPandas()
    encode = encoder(default_vocabulary())
    want = {x.doc_id: [*encode(x.text or "").tolist(), 1] for x in docs.collect()}
    assert set(out.doc_id) == set(want)
    for doc_id, own in out.sort_values("start").groupby("doc_id"):
        assert [i for x in own.ids for i in x] == want[doc_id]
        assert (own.doc_tokens == len(want[doc_id])).all()
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    padding = out.sequence_id.nunique() * 2048 / out.length.sum() - 1
    assert padding < 0.02
    lean = queries.op1_harmonic_packing(spark, sf_dir).toPandas()
    import zlib

    assert sorted(lean.ids_crc32) == sorted(zlib.crc32(np.array(x, dtype="<u4").tobytes()) for x in out.ids)


def test_classes_hold_a_fixed_number(spark):
    lengths = packing.class_lengths(2048)
    assert lengths[:3] == [1, 2, 3] and lengths[-2:] == [1024, 2048]
    for n in [1, 2, 45, 46, 47, 1000, 2047, 2048, 2049, 100_000]:
        got = packing.cuts(n, lengths)
        assert sum(got) == n and set(got) <= set(lengths) and len(got) <= n // 2048 + 6


def test_histogram_answers_every_limit(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    encode = encoder(default_vocabulary())
    sizes = np.array([len(encode(x)) for x in texts(spark, sf_dir)])
    histogram = token_counts.length_histogram(docs)
    sums = token_counts.suffix_sums(histogram)
    rows = sums.toPandas().sort_values("length")
    assert rows.length.tolist() == sorted(set(sizes.tolist()))
    for x in rows.itertuples():
        assert x.n_docs == (sizes == x.length).sum() and x.docs_at_least == (sizes >= x.length).sum() and x.tokens_at_least == sizes[sizes >= x.length].sum()
        assert x.truncated_tokens == np.minimum(sizes, x.length).sum() and abs(x.share_within - (sizes <= x.length).mean()) < 1e-12
    got = {x.context: (x.docs_over, x.truncated_tokens) for x in token_counts.truncated_totals(sums, [1, 512, 10**6]).collect()}
    assert got == {k: ((sizes > k).sum(), np.minimum(sizes, k).sum()) for k in (1, 512, 10**6)}
    every = queries.op9_token_histogram(spark, sf_dir).toPandas().sort_values("length")
    limits = np.arange(sizes.max() + 1)
    assert every.length.tolist() == limits.tolist() and (every.total_docs == len(sizes)).all() and (every.total_tokens == sizes.sum()).all()
    counts = np.bincount(sizes)
    assert every.n_docs.tolist() == counts.tolist() and every.n_tokens.tolist() == (counts * limits).tolist()
    assert every.docs_at_least.tolist() == [(sizes >= x).sum() for x in limits] and every.tokens_at_least.tolist() == [sizes[sizes >= x].sum() for x in limits]
    assert every.truncated_tokens.tolist() == [np.minimum(sizes, x).sum() for x in limits] and np.abs(every.share_within - [(sizes <= x).mean() for x in limits]).max() < 1e-12
    for x in token_counts.length_quantiles(sums, [0.5, 0.9, 1.0]).collect():
        assert x.length == np.sort(sizes)[int(np.ceil(x.share * len(sizes))) - 1]


def test_odd_rows(odd, none):
    out = packing.pack(odd, keep_ids=False)
    assert out.where("doc_id in (1, 2)").select("length", "doc_tokens").distinct().collect() == [(1, 1)]
    assert out.groupBy("doc_id").agg((F.sum("length") / F.max("doc_tokens")).alias("n")).where("n != if(doc_id = 3, 2, 1)").count() == 0
    assert out.where("doc_id is null").count() > 0
    assert packing.pack(none).count() == 0
    assert token_counts.length_histogram(odd).agg(F.sum("n_docs")).first()[0] == 9
    assert token_counts.every_limit(token_counts.suffix_sums(token_counts.length_histogram(none))).count() == 0
