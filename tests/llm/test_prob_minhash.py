import random
from collections import defaultdict

import duckdb
import numpy as np

from tests.llm.conftest import prose
from voxloom.llm import prob_minhash as p
from voxloom.llm import queries


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def classes(texts, threshold=0.8):
    """doc_id -> class by comparing all pairs that share a shingle."""
    sets = {}
    for d, t in texts.items():
        w = p.words_of(t or "")
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in texts}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    by = defaultdict(set)
    first = {}
    for d, s in sorted(sets.items()):
        label[d] = first.setdefault(texts[d] or "", d)
        if label[d] == d:
            for x in s:
                by[x].add(d)
    for d, s in sets.items():
        if label[d] == d or find(d) != d:
            for o in {o for x in s for o in by[x] if o < d}:
                if jaccard(s, sets[o]) >= threshold:
                    a, b = find(d), find(o)
                    label[max(a, b)] = min(a, b)
    return {d: find(d) for d in texts}


def test_agreement_estimates_the_probability_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(3):
        n = 60
        a, b = rng.exponential(size=n) * (rng.random(n) < 0.8), rng.exponential(size=n) * (rng.random(n) < 0.8)
        both = (a > 0) & (b > 0)
        want = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in np.flatnonzero(both))
        got = []
        for seed in range(40):
            e = rng.integers(1, 2**63, n).astype(np.uint64)
            owner = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
            who = p.signatures(owner, np.concatenate([e[a > 0], e[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
            got.append((who[0] == who[1]).mean())
        assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (40 * 128)) + 0.01


def test_shingles():
    h, size = p.shingles("a bb ccc d e a bb ccc d e")
    assert len(h) == 5 and sorted(size) == [8] * 5
    assert len(p.shingles("one two")[0]) == 1 and len(p.shingles(" \n")[0]) == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {x.doc_id: x.class_id for x in queries.op4_prob_minhash_near_duplicates(spark, sf).collect()}
    assert got == classes(texts) and len(set(got.values())) < len({*texts.values()})
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {d: c for d, _, c in db.execute(queries.oracle_sql()["op4_prob_minhash_near_duplicates"]).fetchall()} == got


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Buckets far over SMALL, with chains whose ends are no candidates of the centre."""
    monkeypatch.setattr(p, "SMALL", 3)
    rng = random.Random(3)
    texts = {}
    for group in range(3):
        base = prose(rng, 120).split()
        now = list(base)
        for i in range(40):
            own = list(base if i % 2 else now)
            for _ in range(rng.choice([1, 1, 2, 3])):
                own[rng.randrange(120)] = f"w{rng.random()}"
            now = own if i % 2 == 0 else now
            texts[group * 100 + i] = " ".join(own)
    texts |= {400 + i: prose(rng, 60) for i in range(50)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    assert {x.doc_id: x.class_id for x in p.near_duplicates(df).collect()} == classes(texts)


def test_links_share_a_band_however_long_their_words_are():
    """Four isolated words of 4,000 bytes among 250 short ones: plain Jaccard similarity 0.85, far less if weighted by the root of the bytes."""
    rng = random.Random(4)
    for weight in p.WEIGHTS:
        texts = []
        for _ in range(40):
            base = [f"{rng.randrange(100_000):05}" for _ in range(250)]
            for side in "ab":
                texts.append(" ".join(f"{i}{side}{rng.random()}".ljust(4000, side) if i in (20, 80, 140, 200) else w for i, w in enumerate(base)))
        keys = p.band_keys(p.signed(texts, weight=weight)[0])
        assert all(0.8 < jaccard(*({*p.shingles(x)[0].tolist()} for x in texts[i : i + 2])) < 0.9 for i in range(0, 80, 2))
        assert (keys[::2] == keys[1::2]).any(axis=1).all()


def test_odd_rows(odd, none):
    out = p.near_duplicates(odd).collect()
    assert len(out) == 9
    got = {x.doc_id: (x.unit_id, x.class_id) for x in out}
    assert got[1] == got[2] == (1, 1) and got[3] == got[4] == (3, 3) and got[5] == (5, 5) and got[None] == (None, None)
    assert p.near_duplicates(none).count() == 0


def near(rng, text):
    words = text.split()
    words[rng.randrange(len(words))] = "changed"
    return " ".join(words)


def test_texts_under_one_doc_id_lose_no_link(spark):
    rng = random.Random(5)
    a, b, c = prose(rng, 120), prose(rng, 120), prose(rng, 120)
    rows = [(1, a), (7, near(rng, a)), (7, b), (9, near(rng, b)), (7, b), (12, c), (None, near(rng, c)), (12, c), (None, a)]
    for parts in (1, 5):
        random.Random(parts).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((str(x.doc_id), x.class_id) for x in p.near_duplicates(df).collect())
        assert got == sorted([("1", 1), ("7", 1), ("7", 1), ("7", 1), ("9", 1), ("12", 12), ("12", 12), ("None", None), ("None", None)])
    kept = sorted(((str(x.doc_id), x.text) for x in p.representatives(df).collect()))
    assert kept == sorted([("1", a), ("7", b), ("12", c), *((str(i), t) for i, t in rows if i is None)])
