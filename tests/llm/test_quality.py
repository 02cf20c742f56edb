import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import quality, queries


def test_held_out_documents_are_told_apart(spark):
    out = queries.op7_line_field_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in out.doc_id]).all()
    own = out[out.held_out]
    assert ((own.score >= 0.7) == (own.predicted == 1)).all()
    good, bad = own.score[own.quality == 1].to_numpy(), own.score[own.quality == 0].to_numpy()
    assert np.mean(good[:, None] > bad[None, :]) > 0.97 and np.mean(own.predicted == own.quality) > 0.93


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    counts, between = np.array([1, 4, 3]), rng.normal(size=(2, 2))
    good = rng.normal(size=8)
    p, expected = quality.marginals(good, counts, between)
    at, seen = 0, np.zeros((2, 2))
    for n in counts:
        weight, ones = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for labels in np.ndindex(*[2] * n):
            w = np.exp(sum(good[at + i] for i in range(n) if labels[i]) + sum(between[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            weight += w
            ones += w * np.array(labels)
            for a, b in zip(labels, labels[1:], strict=False):
                pairs[a, b] += w
        assert p[at : at + n] == pytest.approx(ones / weight)
        seen += pairs / weight
        at += n
    assert expected == pytest.approx(seen)


def test_neighbours_and_features():
    x, sizes, counts = quality.line_features(["ab!!\n\nab!!", "", "Ä b."])
    assert counts.tolist() == [3, 1, 1] and sizes.tolist() == [4, 0, 4, 0, 5] and x.shape == (5, quality.FEATURES)
    y = quality.with_neighbours(x, counts)
    n = quality.FEATURES
    assert (y[1, n : 2 * n] == x[0]).all() and (y[3, n : 3 * n] == 0).all() and (y[2, 2 * n : 3 * n] == 0).all()


def test_long_texts_go_by_products():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1000, 1, 129, 128, 4001])
    good, between = 5 * rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    p, expected = quality.marginals(good, counts, between)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "LONG", 10_000)
        q, wanted = quality.marginals(good, counts, between)
    assert p == pytest.approx(q, abs=1e-9) and expected == pytest.approx(wanted)


def test_potentials_and_slopes_without_the_wide_table():
    rng = np.random.default_rng(5)
    counts = np.array([1, 4, 1, 3, 1])
    first, x, w, r = np.cumsum(counts) - counts, rng.normal(size=(10, quality.FEATURES)), rng.normal(size=3 * quality.FEATURES + 1), rng.normal(size=10)
    wide = quality.with_neighbours(x, counts)
    assert quality.potentials(x, first, w) == pytest.approx(wide @ w) and quality.slopes(x, first, r) == pytest.approx(wide.T @ r)


def test_tails_of_long_texts_are_learned():
    """Bad documents differ from good ones after line 64 only."""
    head = [f"A plain line of a text, number {i}." for i in range(70)]
    good = ["\n".join(head + [f"And so it goes on for {i} of {k}." for i in range(60)]) for k in range(30)]
    bad = ["\n".join(head + ["buy!!! $$$ now | now"] * 60) for _ in range(30)]
    score = quality.score(quality.fit(good + bad, np.repeat([1, 0], 30)), [good[0], bad[0]])
    assert score[0] > 0.9 and score[1] < 0.1


def plain_score(field, text):
    """The score of one text by sums over its lines, forward and backward, in plain probabilities."""
    x, sizes, _ = quality.line_features([text])
    x = (x - field.mean) / field.scale
    n, zero, move = len(x), np.zeros(quality.FEATURES), np.exp(field.between)
    good = [float(np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < n else zero, [1.0]]) @ field.weights) for i in range(n)]
    state = [np.array([1.0, np.exp(g)]) / (1 + np.exp(g)) for g in good]
    ahead, back = [state[0] / state[0].sum()], [np.ones(2)]
    for i in range(1, n):
        f = state[i] * (ahead[-1] @ move)
        ahead.append(f / f.sum())
    for i in range(n - 1, 0, -1):
        b = move @ (state[i] * back[0])
        back.insert(0, b / b.sum())
    p = [f[1] * b[1] / (f @ b) for f, b in zip(ahead, back, strict=True)]
    mean = min(max(sum(w * x for w, x in zip(sizes + 1, p, strict=True)) / (sum(sizes) + n), 1e-6), 1 - 1e-6)
    return 1 / (1 + np.exp(-(field.slope * np.log(mean / (1 - mean)) + field.shift)))


def test_query_against_a_plain_scorer(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    field = quality.train(docs, labels)
    want = {x.doc_id: plain_score(field, x.text or "") for x in docs.collect()}
    got = {x.doc_id: x.score for x in queries.op7_line_field_quality(spark, sf_dir).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 100


def test_lines_of_one_document_may_differ():
    """Bad documents hold clean lines too; the field tells them from the junk, though it only ever sees document labels."""
    rng = np.random.default_rng(8)
    clean = lambda: f"A plain line of a text about matter {rng.integers(1000)}."
    junk = lambda: "buy!!! $$$ now | now " + "!" * int(rng.integers(1, 9))
    good = ["\n".join(clean() for _ in range(12)) for _ in range(60)]
    bad = ["\n".join([clean() for _ in range(6)] + [junk() for _ in range(6)]) for _ in range(60)]
    field = quality.fit(good + bad, np.repeat([1, 0], 60))
    x, _, counts = quality.line_features(bad[:5])
    p, _ = quality.marginals(quality.with_neighbours((x - field.mean) / field.scale, counts) @ field.weights, counts, field.between)
    p = p.reshape(5, 12)
    assert p[:, :5].mean() > 0.7 and p[:, 7:].mean() < 0.1
    score = quality.score(field, [good[0], bad[0]])
    assert score[0] > 0.9 and score[1] < 0.1


def test_the_sample_is_bounded_by_rows_and_characters(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a line of words. " * (1 + i % 7)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, quality: seen.append(texts) or 0.5)
    monkeypatch.setattr(quality, "LONGEST_TRAIN", 100)
    monkeypatch.setattr(quality, "TRAIN_CHARS", 900)
    quality.train(docs, labels)
    quality.train(docs, labels, limit=5)
    assert 5 < len(seen[0]) and sum(map(len, seen[0])) <= 900 and max(map(len, seen[0])) <= 100 and len(seen[1]) == 5


def test_pieces_of_a_long_text_score_as_the_whole(monkeypatch):
    rng = np.random.default_rng(9)
    words = ["word", "Other", "12", "!!", "#a|b", "Ä", "x.", ""]
    text = "\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(3000))
    field = quality.Field(rng.normal(size=quality.FEATURES), 1 + rng.random(quality.FEATURES), rng.normal(size=3 * quality.FEATURES + 1), rng.normal(size=(2, 2)), 0.7, 0.1)
    want = {t: quality.score(field, [t])[0] for t in (text, text.replace("\n", " "), "\n" * 2999, "a\n")}
    whole = quality.line_features([text])
    monkeypatch.setattr(quality, "BLOCK_LINES", 170)
    monkeypatch.setattr(quality, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(quality, "PAIR_LINES", 40)
    monkeypatch.setattr(quality, "PAIR_BYTES", 110)
    x, sizes = zip(*quality.line_pieces(text.encode()), strict=True)
    assert len(x) >= 18 and np.concatenate(x) == pytest.approx(whole[0]) and (np.concatenate(sizes) == whole[1]).all()
    for t, score in want.items():
        assert quality.score(field, [t])[0] == pytest.approx(score, abs=1e-9)
    good, between = 5 * rng.normal(size=1000), rng.normal(size=(2, 2))
    for n in (1, 2, 170, 171, 172, 341, 1000):
        assert quality.long_marginals(good[:n], between) == pytest.approx(quality.marginals(good[:n], np.array([n]), between)[0], abs=1e-9)
    assert [len(b) for b in quality.blocks(["a\n" * 100] * 3 + ["b" * 2000] * 2 + ["\n" * 500])] == [1, 1, 2, 1, 1]


def test_millions_of_lines_fit_in_memory():
    code = """
import resource
import numpy as np
from voxloom.llm import quality
field = quality.Field(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), np.full(3 * quality.FEATURES + 1, 0.01), np.zeros((2, 2)), 1.0, 0.0)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for text in ("\\n" * 5_000_000, "a\\n" * 2_000_000, "word " * 2_000_000):
    assert 0 < quality.score(field, [text])[0] < 1
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, cwd=Path(__file__).parents[2])
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 800_000  # kilobytes


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (4, None, None), (None, 1, 0), (6, 0, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd, labels).collect()
    assert len(out) == 9 and all(0 <= x.score <= 1 for x in out)
    assert len({x.score for x in out if x.doc_id in (1, 2)}) == 1 and len({x.score for x in out if x.doc_id in (3, 4)}) == 1
    assert quality.classify(none, labels).count() == 0
    assert quality.classify(odd, labels.where("quality = 1")).select("score").distinct().collect() == [(1.0,)]
    assert quality.classify(odd, labels.where(F.lit(False))).select("score").distinct().collect() == [(0.5,)]
