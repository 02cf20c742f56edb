import hashlib
import random

import duckdb
import numpy as np

from tests.llm.conftest import prose
from voxloom.llm import hashing, queries, substrings


def brute(rows, width):
    """(doc_id, n_words, n_removed, kept_sha256) by comparing all windows."""
    least = {}
    split = [(d, hashing.words_of(t or "")) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - width + 1):
            if d is not None:
                least[tuple(w[i : i + width])] = min(d, least.get(tuple(w[i : i + width]), d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and least[tuple(w[i : i + width])] < d:
                gone |= set(range(i, i + width))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in df.collect()), key=str)


def test_rolling_hash_is_the_polynomial():
    h = np.random.default_rng(1).integers(0, 2**63, 120).astype(np.uint64)
    base = hashing.BASES[0]
    for width in (1, 7, 50):
        want = [sum(int(h[i + j]) * pow(base, width - 1 - j, 2**64) for j in range(width)) % 2**64 for i in range(120 - width + 1)]
        assert hashing.rolling(h, width, base).tolist() == want
    x = np.random.default_rng(2).integers(0, 1000, 300)
    for width in (1, 2, 3, 16, 26, 31):
        assert hashing.sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(301 - width)]


def test_against_brute_force(spark):
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (8, 9, 12, 30, 80)]
    rows = []
    for i in range(120):
        text = prose(rng, rng.randint(0, 40)) if rng.random() < 0.9 else ""
        for _ in range(rng.randint(0, 3)):
            text += rng.choice([" ", "\n", " \t"]) + rng.choice(passages) + " " + prose(rng, rng.randint(0, 12))
        rows.append((rng.choice([i, i, i, 5]), text))
    rows += [(200 + i, rows[i % 9][1]) for i in range(40)] + [(None, passages[4]), (None, None), (3, None), rows[2], rows[2]]
    for width in (8, 9, 20):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert got(substrings.removal_intervals(df, width)) == brute(rows, width)


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    mine = got(queries.op10_rabin_karp_passages(spark, sf_dir))
    assert mine == brute(rows, 50) and any(x[2] for x in mine)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert sorted(db.execute(queries.oracle_sql()["op10_rabin_karp_passages"]).fetchall(), key=str) == mine


def test_odd_rows(odd, none):
    out = {(x.doc_id, x.n_words, x.n_removed) for x in substrings.removal_intervals(odd).collect()}
    assert out >= {(1, 0, 0), (2, 0, 0), (5, 60_000, 0), (6, 1, 0), (None, 5, 0)}
    assert substrings.removal_intervals(odd).count() == 9
    assert {x.n_removed for x in substrings.removal_intervals(odd, 5).where("doc_id = 4").collect()} == {11}
    assert substrings.removal_intervals(none).count() == 0
