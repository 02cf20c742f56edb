import random

import numpy as np

from tests.llm.conftest import prose
from voxloom.llm import decontaminate as d
from voxloom.llm import queries


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute(docs, items):
    """(doc_id, item_id) of all documents with a passage within the allowed edits of an item."""
    out = set()
    for i, text in docs.items():
        h = d.hashed_words(text or "")
        for k, item in items.items():
            w = d.hashed_words(item)
            if len(w) and len(np.intersect1d(h, w)) and d.passage_distance(w, h)[0] <= d.most_edits(len(w)):
                out.add((i, k))
    return out


def test_passage_distance_is_the_best_of_all_passages():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, region = rng.integers(0, 4, rng.integers(1, 7)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 10)).astype(np.uint64)
        n = len(region)
        want = min(levenshtein(item.tolist(), region[a:b].tolist()) for a in range(n + 1) for b in range(a, n + 1))
        distance, start, end = d.passage(item, region)
        assert distance == want == levenshtein(item.tolist(), region[start:end].tolist())


def test_walks_bring_near_texts_together():
    rng = np.random.default_rng(2)
    a = rng.integers(1, 2**63, (200, 40)).astype(np.uint64)
    one, many = a.copy(), a.copy()
    one[:, 20] = 7
    many[:, ::2] = 7
    same = [(d.walk_keys(a, 32) == d.walk_keys(x, 32)).mean() for x in (a, one, many)]
    assert same[0] == 1 and same[1] > 0.5 > same[2]


def test_query_against_brute_force(spark, sf_dir):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {x.item_id: x.text for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    got = {(x.doc_id, x.item_id) for x in queries.op8_cgk_decontamination(spark, sf_dir).collect()}
    assert got == brute(docs, items) and got


def test_recall_on_edited_passages(spark):
    rng = random.Random(5)
    items = {k: " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randint(12, 60))) for k in range(30)}
    docs = {}
    for i in range(400):
        words = items[i % 30].split()
        for _ in range(rng.randint(0, d.most_edits(len(words)))):
            at = rng.randrange(len(words))
            words[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["other"]])
        docs[i] = f"{prose(rng, rng.randint(0, 60))} {' '.join(words).upper()}, {prose(rng, rng.randint(0, 60))}"
    docs |= {1000 + i: prose(rng, 200) for i in range(50)}
    got = {(x.doc_id, x.item_id) for x in d.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = brute(docs, items)
    assert got <= want and len(got) >= 0.98 * len(want) and {i for i, _ in want} == set(range(400))


def test_blocks_of_items_and_odd_rows(spark, odd, none, monkeypatch):
    items = spark.createDataFrame([(1, "some words of a text all rights reserved"), (2, None), (3, "two words"), (None, "a row without an id"), (1, "word word word word word word"), (4, "Tail"), (5, "...")], "item_id long, text string")
    want = {(3, 1), (4, 1), (None, None), (5, 1), (7, 4)}
    whole = d.leaks(odd, items).collect()
    assert {(x.doc_id, x.item_id) for x in whole} == want
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    assert sorted(map(str, d.leaks(odd, items).collect())) == sorted(map(str, whole))
    assert d.leaks(none, items).count() == 0 and d.leaks(odd, items.where("false")).count() == 0


def test_all_windows_are_verified_where_repetitions_do_not_reach_the_recall(monkeypatch):
    """With one repetition of a sparse sample allowed, every class falls back to verification and nothing is lost."""
    monkeypatch.setattr(d, "REPETITIONS", 1)
    d.coins.cache_clear()
    rng = random.Random(7)
    items = {k: [f"w{rng.randrange(3000)}" for _ in range(rng.randint(10, 60))] for k in range(40)}
    index = d.Index([(k, " ".join(w)) for k, w in items.items()])
    assert set(index.repetitions.values()) == {None}
    docs = []
    for w in items.values():
        own = list(w)
        for _ in range(d.most_edits(len(w))):
            own[rng.randrange(len(own))] = "new"
        docs.append(" ".join(own))
    got = {(t, index.ids[k]) for t, k, *_ in index.leaks(docs)}
    d.coins.cache_clear()
    assert got == {(k, k) for k in items}


def test_items_cut_at_their_heads():
    """At word 0 of a document, and right after a whole copy, where all windows start before the passage."""
    rng = random.Random(6)
    items = {k: [f"w{rng.randrange(3000)}" for _ in range(rng.randint(12, 60))] for k in range(40)}
    index = d.Index([(k, " ".join(w)) for k, w in items.items()])
    cut = {k: w[rng.randint(1, d.most_edits(len(w))) :] for k, w in items.items()}
    docs = {k: " ".join(w) + " " + prose(rng, 40) for k, w in cut.items()}
    got = {(t, index.ids[k]) for t, k, *_ in index.leaks(list(docs.values()))}
    assert got == brute(docs, {k: " ".join(w) for k, w in items.items()}) == {(k, k) for k in items}
    got = [x[1:] for x in index.leaks([" ".join(w + cut[k] + prose(rng, 40).split()) for k, w in items.items()])]
    assert got == [x for k, w in items.items() for x in ((k, 0, len(w), 0), (k, len(w), len(cut[k]), len(w) - len(cut[k])))]
