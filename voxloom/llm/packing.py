"""Harmonic packing of tokenised documents into fixed-length sequences.

Every piece belongs to a reciprocal-capacity class: a piece of class j is as long as capacity // j allows, and a sequence of class j
holds exactly j of them. A document gives whole sequences first; what remains is cut greedily at the largest class length that it
reaches, so that a document has few pieces and every sequence of a class fills alike. Classes fill independently: each worker
numbers the pieces of a class within its partition, the counts per partition and class are summed, and a piece's number in its class
fixes sequence and place by arithmetic. No piece is moved to be packed.

The last, partly filled sequence of each class is the only one with room. Those pieces, fewer than TAIL whatever the size of the corpus,
are packed together by best fit.

Defined cases: a null or empty text is its end id alone; equal rows are packed each; a text of any length is cut; an empty table gives
no rows; a null doc_id is kept as null; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import documents, written
from voxloom.llm.tokens import default_vocabulary, encoder

CAPACITY = 2048
#: Id that ends every document.
END = 1


def class_lengths(capacity: int = CAPACITY) -> list[int]:
    """Ascending lengths of the classes: capacity // j for every j; between the small lengths there are no gaps."""
    return sorted({capacity // j for j in range(1, capacity + 1)})


def cuts(length: int, lengths: list[int]) -> list[int]:
    """Lengths of the pieces of a document of that many ids, in order."""
    out = [lengths[-1]] * (length // lengths[-1])
    rest = length % lengths[-1]
    while rest:
        out.append(lengths[bisect.bisect_right(lengths, rest) - 1])
        rest -= out[-1]
    return out


def cut_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, and ids unless keep_ids is off; part and nth number the pieces of each length within a partition."""
    path = vocabulary or default_vocabulary()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths, part = encoder(path), class_lengths(capacity), TaskContext.get().partitionId()
        seen = dict.fromkeys(lengths, 0)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), np.uint32(end)).astype("<u4")
                start = 0
                for n in cuts(len(ids), lengths):
                    piece = ids[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(piece.tobytes()), len(ids), part, seen[n], *([piece] if keep_ids else [])))
                    seen[n] += 1
                    start += n
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    return documents(docs).mapInArrow(cut, schema)


def best_fit(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """sequence and offset of each piece: longest first, each into the fullest sequence with room."""
    pieces = pieces.sort_values(["length", "part", "nth"], ascending=[False, True, True])
    room: list[tuple[int, int]] = []  # (free ids, sequence), ascending
    sequence, offset = [], []
    opened = 0
    for n in pieces["length"]:
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            free, k = capacity, opened
            opened += 1
        else:
            free, k = room.pop(at)
        sequence.append(k)
        offset.append(capacity - free)
        if free > n:
            bisect.insort(room, (free - n, k))
    return pieces.assign(sequence=sequence, offset=offset)[["part", "length", "nth", "sequence", "offset"]].astype("int64")


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = True) -> DataFrame:
    """Packs all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). A sequence is the pieces of one sequence_id by offset, padded to capacity."""
    pieces = written(cut_documents(docs, vocabulary, capacity, end, keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))  # a row per partition and class
    before = Window.partitionBy("length").orderBy("part")
    counts = counts.select("part", "length", (F.sum("n").over(before) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("length")).alias("of_class"))
    per = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    number = F.col("before") + F.col("nth")
    placed = pieces.join(counts, ["part", "length"]).withColumns({"per": per, "number": number}).withColumn("sequence", F.expr("number div per"))
    carried = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] * keep_ids
    whole = F.col("sequence") < F.expr("of_class div per")
    full = placed.where(whole).select(*carried, (F.col("sequence") * 2 * capacity + F.col("length")).alias("sequence_id"), ((F.col("number") % F.col("per")) * F.col("length")).alias("offset"), *ids)
    tail = placed.where(~whole).drop("sequence")
    fitted = tail.groupBy().applyInPandas(lambda x: best_fit(x[["part", "length", "nth"]], capacity), "part long, length long, nth long, sequence long, offset long")
    tail = tail.join(fitted, ["part", "length", "nth"]).select(*carried, (F.col("sequence") * 2 * capacity).alias("sequence_id"), "offset", *ids)
    return full.unionByName(tail)
