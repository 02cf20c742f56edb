"""Removal of repeated passages: Rabin-Karp hashes of every window of WIDTH words, counted in Spark.

A window is repeated if its words also start somewhere in a document with a smaller doc_id. Repeated windows of a document merge into
maximal intervals of words, and those words go. Windows are judged on the input.

Hashes of 140 million windows need not all travel. Three steps keep what is counted small and lose nothing:

1. Documents of equal words are one unit, that of the smallest doc_id; the others are repeated from their first word to their last.
2. Each window has an anchor, the smallest hash among its GRAM-word substrings. Equal windows have equal anchors, and neighbouring
   windows mostly share theirs, so anchors are few. A window whose anchor lies in one document only can't be repeated.
3. The windows that remain are hashed over all their words (96 bits), counted by hash with their smallest doc_id, and joined to it.

Counts combine before each shuffle. A passage that a third of all documents share is a hot key of the joins back to its windows and
anchors; the counts tell which keys are hot, and these go to all tasks instead (looked_up()).

Defined cases: a null or empty text has no words; shorter documents than a window keep all words; equal rows get equal results; a row
without doc_id neither loses words nor makes others lose theirs; rows that share a doc_id are parts of one document and don't repeat each
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow, documents, looked_up, written
from voxloom.llm.hashing import BASES, mixed, rolling, sliding_min, word_hashes, words_of

WIDTH = 50
#: A place is a position below 2^36 and, above it, bits of the unit it belongs to.
POSITION_BITS = 36


def window_anchors(h: np.ndarray, width: int) -> np.ndarray:
    """The anchor of each window."""
    gram = (width + 1) // 2
    return sliding_min(mixed(rolling(h, gram, BASES[0])), width - gram + 1) if len(h) >= width else np.zeros(0, dtype=np.uint64)


def window_hashes(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each window's hash."""
    return mixed(rolling(h, width, BASES[0])).view(np.int64), (rolling(mixed(h), width, BASES[1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def unit_bits(key: bytes) -> int:
    return int.from_bytes(key[:3], "big") << POSITION_BITS


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def mask_of(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """True for each of n words that a window from one of the starts covers."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, n), -1)
    return np.cumsum(edges[:-1]) > 0


def intervals(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal intervals (start, end exclusive) of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def removal_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and spans, the maximal intervals of removed words (start, end exclusive)."""
    docs = documents(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                anchors = np.unique(window_anchors(word_hashes(words), width)) if len(words) >= width else np.zeros(0, dtype=np.uint64)
                rows.append((doc_id, digest(words), len(words), anchors.view(np.int64)))
            yield arrow(rows, [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())], ["doc_id", "unit", "n_words", "anchors"])

    def hash_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, anchors in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = words_of(text.as_py())
                h = word_hashes(words)
                at = np.flatnonzero(np.isin(window_anchors(h, width), anchors.values.to_numpy(zero_copy_only=False).view(np.uint64)))
                if len(at):
                    high, low = window_hashes(h, width)
                    columns = [high[at], low[at], np.full(len(at), doc_id.as_py(), dtype=np.int64), at + unit_bits(digest(words))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["high", "low", "doc_id", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, places in zip(*(batch.column(i) for i in range(3)), strict=True):
                words = words_of(text.as_py())
                key = digest(words)
                places = places.values.to_numpy(zero_copy_only=False)
                own = places[(places >> POSITION_BITS) << POSITION_BITS == unit_bits(key)] & ((1 << POSITION_BITS) - 1)
                if len(own):
                    mask = mask_of(own, len(words), width)
                    kept = [w for w, gone in zip(words, mask.tolist(), strict=True) if not gone]
                    rows.append((doc_id.as_py(), key, int(mask.sum()), digest(kept), [{"start": a, "end": b} for a, b in intervals(mask)]))
            yield arrow(rows, [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))], ["doc_id", "unit", "cut", "kept", "cut_spans"])

    seen = written(docs.mapInArrow(read, "doc_id long, unit binary, n_words long, anchors array<long>"), "units")
    units = written(seen.groupBy("unit").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "firsts")
    seen = looked_up(seen, units, ["unit"])
    owners = seen.where((F.col("n_words") >= width) & (F.col("doc_id") == F.col("first")))
    marks = owners.select("doc_id", F.explode("anchors").alias("anchor"))
    shared = written(marks.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"), "anchors")
    hit = looked_up(marks, shared, ["anchor"]).where("least IS NOT NULL").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    chosen = written(docs.join(hit, "doc_id").select("doc_id", "text", "anchors"), "candidates")
    windows = chosen.mapInArrow(hash_windows, "high long, low int, doc_id long, place long")
    counted = windows.groupBy("high", "low").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
    repeated = looked_up(windows, written(counted, "repeated"), ["high", "low"]).where("doc_id > least").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    cuts = chosen.drop("anchors").join(repeated, "doc_id").select("doc_id", "text", "places").mapInArrow(cut, "doc_id long, unit binary, cut long, kept binary, cut_spans array<struct<start:long,end:long>>").dropDuplicates(["doc_id", "unit"])
    whole = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= width)
    out = seen.select("doc_id", "unit", "n_words", "first").join(cuts, ["doc_id", "unit"], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("cut", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.lower(F.hex(F.coalesce("kept", "unit")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))).otherwise(F.coalesce("cut_spans", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("spans"),
    )
