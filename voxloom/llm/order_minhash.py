"""Document fingerprints by order MinHash, in DataFrame operations alone.

The elements of a text are its k-mers: K consecutive tokens (runs of at most TOKEN characters that are not blank), each numbered by its
occurrence in the text, so that repetitions count. A signature of a fingerprint looks at the elements in an order of its own, takes the
two least, puts those back into the order they have in the text and hashes that pair. Two texts agree in a signature if they share the
elements and have them in the same order: moving a passage lowers the likeness, as it raises the edit distance, while a plain MinHash
would not notice.

The order of a signature begins at its seed and goes round the circle of the elements' 64-bit hashes. So the elements of a text are sorted
once, the seeds stand among them as markers, and each marker looks at the next two elements: no signature costs a pass of its own.

Defined cases: null and empty texts, and texts of blanks, share one fingerprint, that of no elements; a text of fewer than K tokens is one
k-mer; equal texts have equal fingerprints; a text of any length is read whole; documents follow each other by doc_id, those of one id (or
of none, which come first) by a hash of the text and by the text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import documents, written

K, TOKEN, SIGNATURES = 3, 12, 32
#: Rows of a bucket of neighbouring documents, rows of a task, and the most buckets: beyond that many rows of a bucket each, buckets grow.
BUCKET_ROWS, TASK_ROWS, MOST_BUCKETS = 256, 1024, 1 << 18
FIRST_KEY = -(2**63)
#: Most parts of a bucket whose rows all share an id.
PARTS = 1 << 20


def seeds(n: int = SIGNATURES) -> list[int]:
    """Where each signature's order begins, ascending, after the start of the circle itself."""
    rng = random.Random(19)
    return [FIRST_KEY, *sorted(rng.getrandbits(64) - 2**63 for _ in range(n))]


def longs(values: list[int]) -> Column:
    """The numbers as one literal array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def elements(texts: DataFrame, keys: list[str], text: str, carried: list[str] | None = None) -> DataFrame:
    """keys, position, element (hash of k-mer and occurrence) of every k-mer of every text, and a row per seed: marker (its number), element (the seed).

    carried: columns that the first marker's row has in a struct named held.
    """
    token = F.regexp_extract_all(F.col(text), F.lit(r"\S{1,%d}" % TOKEN), F.lit(0))
    held = [F.struct(*carried).alias("_held")] if carried else []
    own = texts.select(*keys, *held, token.alias("_t")).withColumn("_n", F.when(F.size("_t") == 0, 0).otherwise(F.greatest(F.lit(1), F.size("_t") - K + 1)))
    shifted = [F.slice("_t", i + 1, F.col("_n")).alias(f"w{i}") for i in range(K)]
    places = F.sequence(F.lit(0), F.col("_n") + SIGNATURES).alias("p")
    rows = own.select(*keys, *(["_held"] if held else []), "_n", F.explode(F.arrays_zip(*shifted, places)).alias("_w"))
    marker = F.when(F.col("_w.p") >= F.col("_n"), F.col("_w.p") - F.col("_n"))
    rows = rows.select(*keys, *(["_held"] if held else []), F.col("_w.p").alias("position"), marker.alias("marker"), F.xxhash64(*(F.col(f"_w.w{i}") for i in range(K))).alias("_g"))
    held = [F.when(F.col("marker") == 0, F.col("_held")).alias("held")] if held else []
    rows = rows.select(*keys, *held, "position", "marker", F.when(F.col("marker").isNull(), F.col("_g")).otherwise(F.element_at(longs(seeds()), F.col("marker") + 1)).alias("_g"))
    occurrence = F.row_number().over(Window.partitionBy(*keys, "_g").orderBy("position"))
    return rows.select(*keys, *(["held"] if carried else []), "position", "marker", F.when(F.col("marker").isNull(), F.xxhash64("_g", occurrence)).otherwise(F.col("_g")).alias("element"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """keys and signature (array<int> of SIGNATURES) of each row of texts; keys tell its rows apart. carried: further columns to keep, in a struct named held."""
    rows = elements(texts, keys, text, carried)
    before = Window.partitionBy(*keys).orderBy(F.col("element").desc(), F.col("position").desc()).rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("marker").isNull(), F.struct("position", "element"))
    rows = rows.withColumn("_one", F.last(own, ignorenulls=True).over(before))
    rows = rows.withColumn("_two", F.last(F.when(F.col("marker").isNull(), F.col("_one")), ignorenulls=True).over(before)).where(F.col("marker").isNotNull())
    held = [F.max("held").alias("held")] if carried else []
    found = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("marker", "_one", "_two"))).alias("_m"), *held)

    def signature(x: Column) -> Column:
        # past the last element the circle begins again, at the two elements of the first marker
        start = F.element_at("_m", 1)
        one = F.coalesce(x["_one"], start["_one"])
        two = F.when(x["_one"].isNull(), start["_two"]).otherwise(F.coalesce(x["_two"], start["_one"]))
        first, second = one["element"], two["element"]
        return F.when(two.isNull() | (one["position"] <= two["position"]), F.hash(first, second)).otherwise(F.hash(second, first))

    return found.select(*keys, *(["held"] if carried else []), F.transform(F.slice("_m", 2, SIGNATURES), signature).alias("signature"))


def likeness(a: str, b: str) -> Column:
    """Share of equal signatures of two fingerprints (0 to 1)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / SIGNATURES


def written_out(signature: str) -> Column:
    """The fingerprint as text: eight hexadecimal digits per signature."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, place, ghost, doc_id, text, next_text: each document with the text of the next by doc_id (after the last: the first).

    Quantiles of doc_id bound the buckets; an id that spans several quantiles gets as many parts, by a hash of the text. The document that
    begins a bucket is also the last, a ghost, of the bucket before, so that every real document has its next one at hand.
    """
    docs = documents(docs).withColumn("_key", F.coalesce("doc_id", F.lit(FIRST_KEY))).withColumn("_tie", F.xxhash64("text"))
    n = docs.count()
    buckets = min(MOST_BUCKETS, n // BUCKET_ROWS + 1)
    low, marks = docs.agg(F.min("_key"), F.percentile_approx("_key", F.split(F.lit(",".join(str(i / buckets) for i in range(buckets))), ",").cast("array<double>"), max(10_000, 4 * buckets))).first()
    starts = sorted(({low: 1} | Counter(marks or [])).items()) if n else [(0, 1)]  # at most MOST_BUCKETS numbers, and how many quantiles each spans
    side = math.isqrt(len(starts) - 1) + 1
    keys = longs([key for key, _ in starts])
    upto = lambda values: F.size(F.filter(values, lambda x: x <= F.col("_key")))
    docs = docs.withColumn("_g", upto(longs([key for key, _ in starts[::side]])))
    docs = docs.withColumn("_at", (F.col("_g") - 1) * side + upto(F.slice(keys, (F.col("_g") - 1) * side + 1, F.lit(side))))  # a literal array: nothing is parsed for a row
    parts = F.element_at(longs([min(PARTS, n) for _, n in starts]), F.col("_at"))
    part = F.shiftright(F.shiftrightunsigned(F.col("_tie").bitwiseXOR(F.lit(FIRST_KEY)), 24) * parts, 40)
    part = F.when(F.col("_key") == F.element_at(keys, F.col("_at")), part).otherwise(parts - 1)  # later ids follow the last part
    docs = docs.withColumn("bucket", F.col("_at").cast("long") * PARTS + part)
    heads = written(docs.groupBy("bucket").agg(F.min(F.struct("_key", "_tie")).alias("head")), "heads")
    # a row per bucket, at most MOST_BUCKETS of them: one task may number them, and Spark sends them to all tasks while they are small
    round_about = Window.orderBy("bucket")
    last = F.max("bucket").over(round_about.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = heads.select(F.col("head._key").alias("_key"), F.col("head._tie").alias("_tie"), F.coalesce(F.lag("bucket").over(round_about), last).alias("_before"))
    docs = docs.join(before, ["_key", "_tie"], "left")
    own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
    ghost = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("ghost"))
    dealt = docs.select("_key", "_tie", "text", F.explode(F.when(F.col("_before").isNotNull(), F.array(own, ghost)).otherwise(F.array(own))).alias("_b")).select("_key", "_tie", "text", "_b.*")
    dealt = dealt.repartition(n // TASK_ROWS + 1, "bucket")
    order = Window.partitionBy("bucket").orderBy("ghost", "_key", "_tie", "text")
    doc_id = F.when(F.col("_key") != FIRST_KEY, F.col("_key"))
    return dealt.select("bucket", F.row_number().over(order).alias("place"), "ghost", doc_id.alias("doc_id"), "text", F.lead("text").over(order).alias("next_text"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Its edited text has the last half of its code points replaced by the first as many (or all) of the next document.
    """
    near = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    near = near.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("own")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("own")))
    facts = ["ghost", "doc_id", "n_chars", "edited_sha256"]
    texts = near.select("bucket", "place", *facts, F.explode(F.when(F.col("ghost"), F.slice(kinds, 1, 1)).otherwise(kinds)).alias("_k")).select("bucket", "place", *facts, "_k.kind", F.col("_k.own").alias("own"))
    # what is known of a document travels with its first k-mer, so that the texts are dealt out once only
    found = fingerprints(texts, ["bucket", "place", "kind"], "own", facts)
    both = found.groupBy("bucket", "place").agg(*(F.max(F.when(F.col("kind") == k, F.col("signature"))).alias(name) for k, name in ((0, "signature"), (1, "edited_signature"))), F.max("held").alias("held"))
    rows = both.select("bucket", "place", "held.*", "signature", "edited_signature").withColumn("next_signature", F.lead("signature").over(Window.partitionBy("bucket").orderBy("place"))).where(~F.col("ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", written_out("signature").alias("fingerprint"), written_out("edited_signature").alias("edited_fingerprint"),
        likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "next_signature").alias("near_next"),
    )
