import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from voxloom.llm import order_minhash as o
from voxloom.llm import queries


def plain(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [x.signature for x in o.fingerprints(rows, ["id"]).orderBy("id").collect()]


def brute(text, element):
    """Signatures by their definition, given the hash of (k-mer, occurrence)."""
    import re

    t = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", text)
    kmers = [tuple((t + [None] * 3)[i : i + 3]) for i in range(max(1, len(t) - 2) if t else 0)]
    seen = {}
    out = []
    for i, x in enumerate(kmers):
        seen[x] = seen.get(x, 0) + 1
        out.append((i, element[x, seen[x]]))
    rows = []
    for seed in o.seeds()[1:]:
        least = sorted(((e - seed) % 2**64, i, e) for i, e in out)[:2]  # the next two round the circle from the seed
        if len(least) == 1 and out:
            least *= 2
        rows.append(tuple(e for _, _, e in sorted(least, key=lambda x: x[1])))
    return rows


def test_signatures_are_tuples_of_minima_in_text_order(spark):
    rng = random.Random(1)
    texts = ["", *(prose(rng, n) for n in (1, 2, 3, 4, 30, 90, 600)), "a b c a b c a b c", "c b a c b a", "averyveryverylongtokenofmanycharacters x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by = {}
    import re

    for x in o.elements(rows, ["id"], "text").where("marker is null").orderBy("id", "position").collect():
        t = re.findall(r"[^ \t\n\x0b\f\r]{1,12}", texts[x.id])
        kmer = tuple((t + [None] * 3)[x.position : x.position + 3])
        n = sum(tuple((t + [None] * 3)[i : i + 3]) == kmer for i in range(x.position + 1))
        assert by.setdefault((kmer, n), x.element) == x.element
    got, want = plain(spark, texts), [brute(t, by) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            same = [a == b for a, b in zip(want[i], want[j], strict=True)]
            assert [a == b for a, b in zip(got[i], got[j], strict=True)] == same


def test_order_and_repetition_matter(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    moved = base[100:] + base[:100]
    edited = list(base)
    for _ in range(4):
        edited[rng.randrange(200)] = "new"
    signatures = plain(spark, [" ".join(x) for x in (base, moved, edited, base * 3, [f"v{i}" for i in range(200)])])
    near = [np.mean(np.array(signatures[0]) == np.array(x)) for x in signatures]
    assert near[0] == 1 and near[2] > near[1] > near[4] == 0 and near[1] < 0.75 and near[3] < 0.5


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted(((x.doc_id, x.text or "") for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()))
    out = {x.doc_id: x for x in queries.op3_order_minhash(spark, sf_dir).collect()}
    edited = {}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited[i] = text[: len(text) - half] + after[:half]
        assert out[i].n_chars == len(text) and out[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
    assert len(out) == len(docs)
    prints = plain(spark, [t for _, t in docs] + [edited[i] for i, _ in docs])
    n = len(docs)
    for k, (i, _) in enumerate(docs):
        assert out[i].fingerprint == "".join(f"{x % 2**32:08x}" for x in prints[k]) and out[i].edited_fingerprint == "".join(f"{x % 2**32:08x}" for x in prints[n + k])
        assert out[i].near_edited == np.mean(np.array(prints[k]) == np.array(prints[n + k])) and out[i].near_next == np.mean(np.array(prints[k]) == np.array(prints[(k + 1) % n]))


def test_neighbours_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(o, "BUCKET_ROWS", 7)
    rng = random.Random(3)
    ids = [*rng.sample(range(10_000), 150), 3, 3, 3]
    rows = [(i, f"{i} {k}") for k, i in enumerate([*ids, *[77] * 60, *[None] * 60])]
    got = {x.text: x.next_text for x in o.neighbours(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).where("not ghost").collect()}
    tie = {x.text: x.h for x in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda x: (x[0] if x[0] is not None else -math.inf, tie[x[1]], x[1]))
    assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_neighbours_beyond_two_thousand_buckets(spark, monkeypatch):
    monkeypatch.setattr(o, "BUCKET_ROWS", 1)
    docs = spark.range(3000).select((F.col("id") * 5).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    near = o.neighbours(docs)
    got = {x.text: (x.next_text, x.bucket) for x in near.where("not ghost").collect()}
    assert {k: v[0] for k, v in got.items()} == {f"t{i}": f"t{(i + 1) % 3000}" for i in range(3000)}
    assert len({v[1] for v in got.values()}) > 2900


def test_odd_rows(odd, none):
    out = o.with_edits(odd).collect()
    assert len(out) == 9
    by = {x.doc_id: x for x in out}
    assert by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint and by[3].n_chars == by[4].n_chars
    assert by[1].n_chars == 0 and by[6].n_chars == 200_000 and all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in out)
    assert o.with_edits(odd.where(F.col("doc_id") == 7)).first().near_next == 1.0
    assert o.with_edits(none).count() == 0
