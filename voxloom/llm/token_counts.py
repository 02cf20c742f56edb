"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length; what any context limit asks for (documents and tokens that fit, totals after
truncation, quantiles) are sums over that histogram, so the corpus is encoded once whatever the number of limits.

Defined cases: a null or empty text has length 0 and counts; repeated rows count each; an empty table gives an empty histogram;
a text of any length is one row of the histogram; columns other than text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import text_of, written
from voxloom.llm.tokens import default_vocabulary, encoder

#: Histogram rows per block of the two-level suffix sums; context limits that one row is unfolded to at once.
BLOCK, LIMITS = 512, 1 << 16


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """length long, n_docs long: how many documents have that many tokens. Every batch is aggregated before the shuffle."""
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            sizes = [len(encode(text)) for text in batch.column(0).to_pylist()]
            length, n = np.unique(np.array(sizes, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n.astype(np.int64))], ["length", "n_docs"])

    parts = docs.select(text_of(docs).alias("text")).mapInArrow(count, "length long, n_docs long")
    return parts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length of the histogram, seen as a context limit L:

    n_docs, n_tokens           documents of exactly L tokens and their tokens
    docs_at_least, tokens_at_least   of L tokens or more (the suffix sums)
    total_docs, total_tokens   of all
    truncated_tokens           what is left when every document is cut to L tokens
    share_within               share of documents with at most L tokens: L is that quantile of length
    previous                   the next smaller length of the histogram (-1 for the least)

    Sums run in blocks of lengths and then over the blocks, so no task holds the whole histogram.
    """
    histogram = written(histogram, "histogram")  # read twice below, counted once
    rows = histogram.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("n_tokens").alias("block_tokens"), F.max("length").alias("longest"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per BLOCK lengths: bounded by the longest document
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    smaller = F.lead("longest", 1, -1).over(Window.orderBy(F.col("block").desc())).alias("smaller")
    blocks = blocks.select("block", smaller, *(F.coalesce(F.sum(f"block_{x}").over(later), F.lit(0)).alias(f"later_{x}") for x in ("docs", "tokens")), *(F.sum(f"block_{x}").over(every).alias(f"total_{x}") for x in ("docs", "tokens")))
    within = Window.partitionBy("block").orderBy(F.col("length").desc())
    at_least = rows.withColumns({x: F.sum(f"n_{x}").over(within) for x in ("docs", "tokens")} | {"own": F.lead("length").over(within)}).join(blocks, "block")
    docs, tokens = (F.col(x) + F.col(f"later_{x}") for x in ("docs", "tokens"))
    return at_least.select(
        "length", "n_docs", "n_tokens", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "total_docs", "total_tokens",
        (F.col("total_tokens") - tokens + docs * F.col("length")).alias("truncated_tokens"),
        ((F.col("total_docs") - docs + F.col("n_docs")) / F.col("total_docs")).alias("share_within"), F.coalesce("own", "smaller").alias("previous"),
    )


def every_limit(sums: DataFrame) -> DataFrame:
    """The columns of suffix_sums() for every context limit from 0 to the longest document, whether or not a document has that length.

    A limit between two lengths of the histogram has the suffix sums of the greater one. Gaps unfold LIMITS limits at a time.
    """
    start = F.explode(F.sequence(F.col("previous") + 1, F.col("length"), F.lit(LIMITS).cast("long"))).alias("start")
    limit = F.explode(F.sequence(F.col("start"), F.least(F.col("start") + (LIMITS - 1), F.col("length")))).alias("limit")
    rows = sums.select("*", start).select("*", limit)
    at = F.col("limit") == F.col("length")
    n_docs, n_tokens = (F.when(at, F.col(x)).otherwise(F.lit(0).cast("long")) for x in ("n_docs", "n_tokens"))
    return rows.select(
        F.col("limit").alias("length"), n_docs.alias("n_docs"), n_tokens.alias("n_tokens"), "docs_at_least", "tokens_at_least", "total_docs", "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("limit")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_at_least") + n_docs) / F.col("total_docs")).alias("share_within"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context long, docs_over long, truncated_tokens long for each limit asked, also beyond the longest document; from suffix_sums()."""
    asked = F.explode(F.array(*(F.lit(x).cast("long") for x in limits)))
    longer = F.min(F.when(F.col("length") > F.col("context"), F.struct("length", "docs_at_least", "tokens_at_least")))
    found = sums.select("*", asked.alias("context")).groupBy("context").agg(longer.alias("longer"), F.max("total_tokens").alias("total"))
    over = F.coalesce("longer.docs_at_least", F.lit(0))
    return found.select("context", over.cast("long").alias("docs_over"), (F.col("total") - F.coalesce("longer.tokens_at_least", F.lit(0)) + over * F.col("context")).alias("truncated_tokens"))


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share double, length long: the smallest length that at least this share of the documents keep within; from suffix_sums()."""
    asked = F.explode(F.array(*(F.lit(float(x)) for x in shares)))
    return sums.select("length", "share_within", asked.alias("share")).where("share_within >= share").groupBy("share").agg(F.min("length").alias("length"))
