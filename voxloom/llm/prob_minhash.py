"""Near-duplicate documents: ProbMinHash signatures of weighted shingles, banding, exact verification, components.

Each shingle of WORDS words arrives as a Poisson process whose rate is its weight, every arrival at a random one of the SIZE registers;
a register keeps the shingle that comes first. Two documents agree in a register with their probability Jaccard similarity. A shingle
stops arriving once it is later than every register's first. Weights depend on the shingle alone (the root of its length in bytes by
default), so the similarity is a weighted Jaccard similarity that short function words sway less. Lengths count as the nearest of the
range LENGTHS, so that no weight is more than r = 1.23 times another (1.5 for the weight "length") and sets of plain Jaccard similarity J
have a weighted one of J / (J + (1 - J) r) at least, however long their words are.

Signatures are cut into BANDS bands. Documents that share a band are candidates. A candidate is a link if the plain Jaccard similarity of
the sets of shingles, computed exactly, is at least THRESHOLD; at plain 0.8 the weighted similarity is 0.765 or more, and with four
registers a band and 32 bands such a pair is missed with probability 1.5e-6 at most (5e-8 where the weights are equal). Classes are the
connected components of the links.

Equal texts form one unit, so copies meet no band; a unit has a number of its own, as rows of different texts may share a doc_id. Buckets of up to SMALL units are compared in full.
In a larger one each unit is compared with its centre, the unit that meets most others over all bands; a unit that this leaves outside
the centre's class is compared with all other classes of its bucket, in blocks of bounded size whose members are told apart by long
sketches of one bit a register first; a pair that shares several bands counts in the first. No bucket is dropped or cut, none is gathered
in one task, and no group emits all its pairs.

Defined cases: null and empty texts are equal texts, and link to nothing else; texts of fewer than WORDS words are one shingle; rows that
share a doc_id or lack one: see near_duplicates(); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import arrow, documents, looked_up, text_of, written
from voxloom.llm.hashing import BASES, mixed, rolling, word_hashes, words_of
from voxloom.operators.graph import components

WORDS, THRESHOLD = 5, 0.8
SIZE, BANDS = 128, 32
#: Buckets up to this size are compared in full.
SMALL = 16
#: Units of a block; bits of the sketches that its pairs are told apart by, and the estimate under which a pair is no candidate: at similarity 0.8 the estimate is lower with probability 1e-9.
BLOCK, BITS, APART = 512, 2048, 0.72
#: Shingles that one step of the arrivals holds.
STEP = 400_000
#: Bytes of a shingle's words, the least and the most that its weight tells apart.
LENGTHS = (20, 30)
WEIGHTS = {"root": np.sqrt, "length": lambda x: x, "one": np.ones_like}


def shingles(text: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, ascending, and the bytes of each one's words. A shorter text is one shingle; a blank one has none."""
    own = words_of(text)
    if not own:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    size = np.fromiter(map(len, own), dtype=np.float64, count=len(own))
    width = min(words, len(own))
    h, first = np.unique(mixed(rolling(word_hashes(own), width, BASES[0])), return_index=True)
    total = np.concatenate([[0], np.cumsum(size)])
    return h, (total[width:] - total[:-width])[first]


def signatures(owner: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """ProbMinHash of n weighted sets: for each (row) the element that arrives first at each register (column); zero for an empty set.

    owner, elements, weights: set, hash and rate of each element. All elements take their arrivals in step; one whose arrival is later
    than all registers of its set has no more that count.
    """
    first, who = np.full(n * size, np.inf), np.zeros(n * size, dtype=np.uint64)
    at, time, step = np.arange(len(elements)), np.zeros(len(elements)), 0
    while len(at):
        step += 1
        r = mixed(elements[at] + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weights[at]
        register = owner[at] * size + (mixed(r) % np.uint64(size)).astype(np.int64)
        sooner = time < first[register]
        np.minimum.at(first, register[sooner], time[sooner])
        wins = sooner & (time == first[register])
        who[register[wins]] = elements[at[wins]]
        alive = time < first.reshape(n, size).max(axis=1)[owner[at]]
        at, time = at[alive], time[alive]
    return who.reshape(n, size)


def band_keys(who: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band (column) of each signature (row)."""
    rows = who.shape[1] // bands
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(who), 1))
    for k in range(rows):
        key = mixed(key * np.uint64(BASES[1]) + who[:, k::rows])
    return key.view(np.int64)


def signed(texts: list[str], words: int = WORDS, weight: str = "root") -> tuple[np.ndarray, list[int]]:
    """Signature of every text, and how many distinct shingles it has."""
    own = [shingles(text, words) for text in texts]
    counts = [len(h) for h, _ in own]
    joined = [np.concatenate(x) if len(x) else np.zeros(0) for x in zip(*own, strict=True)] if own else [np.zeros(0, dtype=np.uint64), np.zeros(0)]
    return signatures(np.repeat(np.arange(len(own)), counts), joined[0], WEIGHTS[weight](np.clip(joined[1], *LENGTHS)), len(own)), counts


def sign(docs: DataFrame, words: int = WORDS, weight: str = "root") -> DataFrame:
    """doc_id, unit (hash of the text, in docs), size (distinct shingles) and the signature's bands of every document; none where a text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, units, texts = (batch.column(i).to_pylist() for i in range(3))
            edges, held = [0], 0
            for i, text in enumerate(texts):
                held += len(text) // 6 + 1
                if held > STEP:
                    edges.append(i + 1)
                    held = 0
            for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
                who, sizes = signed(texts[a:b], words, weight)
                keys = band_keys(who)
                rows = [(ids[a + k], units[a + k], sizes[k], keys[k] if sizes[k] else None) for k in range(b - a)]
                yield arrow(rows, [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())], ["doc_id", "unit", "size", "bands"])

    return docs.select("doc_id", "unit", "text").mapInArrow(run, "doc_id long, unit binary, size long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """id, shingles (array<long>) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, shingles(text, words)[0].view(np.int64)) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield arrow(rows, [pa.int64(), pa.list_(pa.int64())], ["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes can have that Jaccard similarity."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs (a, b) whose sets of shingles have at least that Jaccard similarity."""
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "sb"}), "b")
    shared = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return shared.select("a", "b", (F.col("shared") / (F.col("n") - F.col("shared"))).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def first_pairs(members: DataFrame, threshold: float) -> DataFrame:
    """a < b: all pairs of small buckets, and each unit of a larger one with its centre, if their sizes allow. members: key, id, size, n (units in the bucket)."""
    small = members.where(F.col("n") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("id", "size"))).alias("own"))
    small = small.select(F.explode("own").alias("one"), "own").select(F.col("one.id").alias("a"), F.explode(F.filter("own", lambda x: (x["id"] > F.col("one.id")) & alike(x["size"], F.col("one.size"), threshold))).alias("other"))
    large = members.where(F.col("n") > SMALL)
    reach = members.groupBy("id").agg(F.sum("n").alias("reach"))
    centres = large.join(reach, "id").groupBy("key").agg(F.max(F.struct("reach", (-F.col("id")).alias("id"), "size")).alias("c")).select("key", (-F.col("c.id")).alias("centre"), F.col("c.size").alias("of"))
    star = large.join(centres, "key").where((F.col("id") != F.col("centre")) & alike(F.col("size"), F.col("of"), threshold)).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    return small.select("a", F.col("other.id").alias("b")).union(star).distinct()


def sketches(sets: DataFrame) -> DataFrame:
    """id, sketch: a bit of each of BITS registers over the set of shingles, all of weight 1. Twice the share of equal bits, less 1, estimates the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_pylist(), batch.column(1)
            for a in range(0, len(ids), 64):
                part = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in own[a : a + 64]]
                counts = [len(x) for x in part]
                who = signatures(np.repeat(np.arange(len(part)), counts), np.concatenate(part), np.ones(sum(counts)), len(part), BITS)
                bits = np.packbits((mixed(who) & np.uint64(1)).astype(bool), axis=1)
                yield arrow([(i, row.tobytes()) for i, row in zip(ids[a : a + 64], bits, strict=True)], [pa.int64(), pa.binary()], ["id", "sketch"])

    return sets.select("id", "shingles").mapInArrow(run, "id long, sketch binary")


def later_pairs(members: DataFrame, labels: DataFrame, bands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a < b of larger buckets that no class spans: each unit outside the bucket's largest class with those of other classes, as far as their sizes and sketches agree. bands: id, bands."""
    large = members.where(F.col("n") > SMALL).join(labels.withColumnRenamed("label", "own"), "id", "left").withColumn("own", F.coalesce("own", "id"))
    classes = large.groupBy("key", "own").agg(F.count("*").alias("m"))
    mixed_buckets = classes.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("m", "own"))["own"].alias("main")).where("classes > 1").drop("classes")
    rows = written(large.join(mixed_buckets, "key").withColumn("outside", F.col("own") != F.col("main")), "mixed")
    marks = written(sketches(sets.join(rows.select("id").distinct(), "id", "left_semi")).join(bands, "id"), "sketches")
    # units get a block by their place within one of 64 parts of their bucket, so that numbering a large bucket is no single task either
    order = Window.partitionBy("key", "outside", "part").orderBy("id")
    blocked = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("block", F.floor((F.row_number().over(order) - 1) / F.greatest(F.lit(1), F.lit(BLOCK // 64))))
    most = blocked.groupBy("key").agg(F.max("block").alias("last"))
    blocked = blocked.join(most, "key").join(marks, "id").select("key", "id", "size", "own", "outside", "sketch", "bands", "block", F.expr("sequence(0, last)").alias("others"))
    left = blocked.where("outside").select("key", "id", "size", "own", "sketch", "bands", F.col("block").alias("i"), F.explode("others").alias("j"))
    right = blocked.select(F.col("key").alias("key2"), F.col("id").alias("id2"), F.col("size").alias("size2"), F.col("own").alias("own2"), F.col("sketch").alias("sketch2"), F.col("bands").alias("bands2"), F.col("block").alias("j2"), F.explode("others").alias("i2"))

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            theirs, ids, own, keys = np.frombuffer(b"".join(y["sketch2"]), dtype=np.uint64).reshape(len(y), -1), y["id2"].to_numpy(), y["own2"].to_numpy(), np.stack(y["bands2"].to_list())
            sizes = y["size2"].to_numpy()
            for key, one, a, n, c, mine in zip(x["key"], x["sketch"], x["id"], x["size"], x["own"], x["bands"], strict=True):
                apart = np.bitwise_count(theirs ^ np.frombuffer(one, dtype=np.uint64)).sum(axis=1, dtype=np.int64)
                near = (1 - 2 * apart / BITS >= APART) & (own != c) & (np.minimum(sizes, n) >= np.maximum(sizes, n) * (threshold - 1e-9))
                if near.any():
                    first = (keys[near] == np.asarray(mine)).argmax(axis=1)  # a pair counts in the first band that it shares
                    out += [(min(a, b), max(a, b)) for b in ids[near][np.asarray(mine)[first] == key]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return left.groupBy("key", "i", "j").cogroup(right.groupBy("key2", "i2", "j2")).applyInPandas(compare, "a long, b long").distinct()


def text_classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, weight: str = "root") -> DataFrame:
    """A row per row of docs: doc_id, unit (hash of the text), id (number of the unit), unit_id (the smallest doc_id with that text), label (the smallest id of the unit's class).

    Classes are of texts alone, whatever doc_ids they share. A text that only rows without doc_id have takes no part: its id, unit_id and label are null.
    """
    docs = documents(docs).withColumn("unit", F.unhex(F.sha2("text", 256)))
    marks = written(sign(docs, words, weight), "signatures")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "size", "bands"))).alias("least")
    units = marks.groupBy("unit").agg(least, F.count("*").alias("n")).select("unit", "n", "least.*").withColumnRenamed("doc_id", "unit_id")
    units = written(units.withColumn("id", F.when(F.col("unit_id").isNotNull(), F.monotonically_increasing_id())), "distinct")  # numbered as written
    owners = units.where("bands IS NOT NULL").select("id", "size", "bands")
    banded = owners.select("id", "size", F.explode(F.array_distinct("bands")).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "key"), "members")
    chosen = units.join(members.select("id").distinct(), "id").select("unit", F.col("unit_id").alias("doc_id"), "id")
    sets = written(shingle_sets(docs.join(chosen, ["unit", "doc_id"]), words).dropDuplicates(["id"]), "sets")
    links = written(verified(first_pairs(members, threshold), sets, threshold), "links")
    labels = written(components(links), "labels")
    more = verified(later_pairs(members, labels, owners.select("id", "bands"), sets, threshold), sets, threshold)
    labels = components(links.union(more).select("a", "b"))
    classes = units.select("unit", "n", "id", "unit_id").join(labels, "id", "left").select("unit", "n", "id", "unit_id", F.coalesce("label", "id").alias("label"))
    return looked_up(marks.select("doc_id", "unit"), written(classes, "classes"), ["unit"])


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, weight: str = "root") -> DataFrame:
    """doc_id, unit_id (the smallest doc_id with the same text) and class_id (the smallest doc_id of the class) of every row.

    Rows that share a doc_id are units by their texts, and their classes are one. A row without doc_id takes no part: unit_id and class_id are null.
    """
    rows = written(text_classes(docs, words, threshold, weight), "rows")
    own = rows.where("doc_id IS NOT NULL")
    tied = own.groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("doc_id", "a")  # several classes under one doc_id
    ties = own.join(tied, "doc_id").where("label > a").select("a", F.col("label").alias("b")).distinct()
    joined = components(ties).select(F.col("id").alias("label"), F.col("label").alias("class"))
    numbers = own.groupBy("label").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(joined, "label", "left").withColumn("class", F.coalesce("class", "label"))
    numbers = written(numbers, "numbers")
    firsts = numbers.groupBy("class").agg(F.min("least").alias("class_id"))
    out = looked_up(rows, written(numbers.join(firsts, "class").select("label", "n", "class_id"), "firsts"), ["label"])
    named = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(named, F.col("unit_id")).alias("unit_id"), F.when(named, F.col("class_id")).alias("class_id"))


def representatives(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are left when each class of texts keeps one: a row of its smallest doc_id (ties: the smallest hash of the text). Rows without doc_id stay."""
    rows = text_classes(docs, words, threshold).where("doc_id IS NOT NULL")
    own = rows.groupBy("label", "doc_id", "unit").agg(F.count("*").alias("n"))
    kept = own.groupBy("label").agg(F.min(F.struct("doc_id", "unit", "n")).alias("k")).select(F.col("k.doc_id").alias("_doc_id"), F.col("k.unit").alias("_unit"), F.col("k.n").alias("_n"))
    kept = written(kept, "kept")
    marked = docs.withColumns({"_doc_id": F.col("doc_id").cast("long"), "_unit": F.unhex(F.sha2(text_of(docs), 256))})
    chosen = marked.join(kept.where("_n = 1"), ["_doc_id", "_unit"], "left_semi")
    equal = kept.where("_n > 1")  # rows of one id and text, of which one stays
    if not equal.isEmpty():
        chosen = chosen.union(marked.join(equal, ["_doc_id", "_unit"], "left_semi").dropDuplicates(["_doc_id", "_unit"]))
    return chosen.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
