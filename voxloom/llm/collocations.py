"""Collocations: phrases of up to LONGEST words that stand together more often than chance, counted level by level (Apriori).

Level 1 counts words, level k phrases of k words. A phrase can be frequent only if both its overlapping parts of k - 1 words are, so the
tasks of level k emit a phrase only where both parts are in the broadcast set of the level before. What is broadcast is a bitmap of hashes
with at most BITMAP_BITS bits, whatever the corpus: a frequent phrase is always in it, and a rare one that falls on a taken bit is only
counted in vain, as counts go by the words themselves and LEAST is applied to them. Its slots are worked out by Spark; the driver gets at
most BITMAP_BITS / 64 of them.

Each task counts phrases in blocks of TOKENS tokens before the shuffle (a text longer than PIECE bytes is read in pieces that overlap by the
words of a phrase), so a word or phrase in a third of all texts is a few rows per task. Tables of the levels are joined to
score each cut of a candidate; hot keys of those joins, such as a word that begins a great many phrases, go to all tasks.

Scores are floor(PARTS * a * a / (l * r)) in whole decimals of 38 digits, exact for counts below 10^15; the lowest-scoring cut counts.

Defined cases: a null or empty text has no words, a null lang is `und`; a language may lack words, and then has no rows; phrases neither
cross the ends of a text nor one of ENDS; ties in score go by count, then by the phrase's bytes; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import documents, looked_up, written
from voxloom.llm.hashing import BASES, mixed

LEAST, LONGEST, TOP, PARTS = 10, 3, 2000, 1_000_000
#: Tokens that a task counts at once, bytes of a text that it reads at once, and the most bits of a bitmap.
TOKENS, PIECE, BITMAP_BITS = 1_500_000, 1_000_000, 1 << 28
#: Rows that a task hands on at once.
ROWS = 100_000
#: Characters that end a piece, and the byte (in no UTF-8 text) that stands for them.
ENDS, END = b".,;:!?\n\x0b\x0c\r", b"\xff"
TABLE = bytes.maketrans(ENDS + b"\t", END * len(ENDS) + b" ")
#: Parts that the candidates of a language are ranked in before they are ranked together.
SALT = 64
LEVEL = "lang string, phrase string, n long"


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased, and END where a piece ends."""
    return text.lower().translate(TABLE).replace(END, b" \xff ").split()


def word_hashes(lang: str, words: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(xxhash.xxh3_64_intdigest(lang.encode()))), dtype=np.uint64)


def longer(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Hashes of phrases, each with a word more."""
    return mixed(hashes * np.uint64(BASES[0]) + following)


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """Hashes of phrases of one length."""
    words = [word_hashes(lang, x) for x in zip(*(p.split(b" ") for p in phrases), strict=True)]
    return reduce(longer, words)


class Bitmap:
    """A set of hashes with no false absence."""

    def __init__(self, slots: np.ndarray, bits: np.ndarray, size: int) -> None:
        self.size, self.words = size, np.zeros(size // 64, dtype=np.uint64)
        self.words[slots] = bits.astype(np.int64).view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes % np.uint64(self.size)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def hashed(level: DataFrame) -> DataFrame:
    """h of each lang and phrase of a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[bytes]] = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].append(phrase.encode("utf-8", "surrogatepass"))
            for lang, phrases in by.items():
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hashes(lang, phrases).view(np.int64))], ["h"])

    return level.select("lang", "phrase").mapInArrow(run, "h long")


def bitmap(level: DataFrame, bits: int = BITMAP_BITS) -> Bitmap:
    """Bitmap of the phrases of a level: 16 bits a phrase, at most bits in all."""
    size = 64
    while size < bits and size < 16 * level.count():
        size *= 2
    at = F.col("h").bitwiseAND(F.lit(size - 1))
    slots = hashed(level).select(F.shiftright(at, 6).alias("slot"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    rows = slots.toArrow()  # at most size / 64 rows
    return Bitmap(rows.column(0).to_numpy(), rows.column(1).to_numpy(), size)


class Block:
    """Tokens of texts of one language, as numbers."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.parts: list[np.ndarray] = []

    def add(self, tokens: list[bytes]) -> int:
        """Takes tokens after an END of their own; how many they are."""
        numbers = map(self.vocabulary.__getitem__, chain((END,), tokens))
        self.parts.append(np.fromiter(numbers, dtype=np.int64, count=len(tokens) + 1))
        return len(tokens) + 1


def count_phrases(lang: str, block: Block, k: int, frequent: list[Bitmap]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of k words in a block whose parts are in the bitmaps of the levels before, and how often each stands there, by up to ROWS phrases."""
    vocabulary, ids = block.vocabulary, np.concatenate(block.parts)
    names, size = pa.array(vocabulary, pa.binary()), len(vocabulary)
    at = np.flatnonzero(ids)
    if k > 1:
        words = word_hashes(lang, vocabulary)
        h, fine = words[ids], (frequent[0].holds(words) & (np.arange(size) > 0))[ids]  # by place: of the phrase that starts there, a word at first
        for more in range(1, k):
            at = np.flatnonzero(fine[: len(ids) - more] & fine[1 : len(ids) - more + 1]) if len(ids) > more else at[:0]
            if more < k - 1:
                h[at], fine[:] = longer(h[at], words[ids[at + more]]), False
                fine[at] = frequent[more].holds(h[at])
        del h, fine
    code = reduce(lambda code, j: code * size + ids[at + j], range(1, k), ids[at])
    if size**k < 1 << 63:
        keys, n = np.unique(code, return_counts=True)
        spelled = [keys // size**j % size for j in range(k - 1, -1, -1)]
    else:
        _, first, n = np.unique(np.stack([ids[at + j] for j in range(k)], axis=1), axis=0, return_index=True, return_counts=True)
        spelled = [ids[at[first] + j] for j in range(k)]
    for a in range(0, len(n), ROWS):
        part = [names.take(pa.array(x[a : a + ROWS])) for x in spelled]
        yield (pc.binary_join_element_wise(*part, b" ") if k > 1 else part[0]), n[a : a + ROWS]


def pieces_of(text: bytes, k: int) -> Iterator[list[bytes]]:
    """tokens_of(text) by stretches of about PIECE bytes, each with the k - 1 tokens before it, so that every phrase of k words is whole in one."""
    a, tail = 0, []
    while a < len(text):
        b = min(len(text), a + PIECE)
        while b < len(text) and text[b] not in b" \t" + ENDS:
            b += 1
        own = tokens_of(text[a:b])
        yield [*tail, *own]
        tail = [*tail, *own][-(k - 1) :] if k > 1 else []
        a = b


def level_counts(docs: DataFrame, k: int, frequent: list[Bitmap], least: int) -> DataFrame:
    """lang, phrase, n of the phrases of k words that stand least times or more; docs: lang, text."""
    context = docs.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in frequent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [x.value for x in shared]

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, block in blocks.items():
                for phrases, n in count_phrases(lang, block, k, sets):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), dtype=np.int64))), phrases.cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])
            blocks.clear()

        blocks: dict[str, Block] = defaultdict(Block)
        size = 0
        for batch in batches:
            for lang, text in zip(*batch.columns, strict=True):
                for tokens in pieces_of(text.as_py().encode("utf-8", "surrogatepass"), k):
                    size += blocks[lang.as_py()].add(tokens)
                    if size >= TOKENS:
                        yield from counted()
                        size = 0
        yield from counted()

    return docs.mapInArrow(run, LEVEL).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def levels(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the frequent phrases of 1 to longest words, and lang, total: all word occurrences of each language."""
    own = documents(docs, F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")).select("lang", "text")
    words = written(level_counts(own, 1, [], 1), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    out, frequent = [words.where(F.col("n") >= least)], []
    for k in range(2, longest + 1):
        frequent.append(bitmap(out[-1]))
        out.append(written(level_counts(own, k, frequent, least), f"phrases-{k}"))
    return out, totals


def part(phrase: Column, first: int, last: int) -> Column:
    """Words first to last (from 0, exclusive) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " "), first + 1, last - first), " ")


def whole(column: str) -> Column:
    return F.col(column).cast("decimal(15,0)")


def scored(level: list[DataFrame], k: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of k words, by the lowest-scoring of their cuts (ties: the earliest)."""
    own = level[k - 1].select("lang", "phrase", F.col("n").alias("a"))
    best = []
    for cut in range(1, k):
        for name, size, words in (("l", cut, part(F.col("phrase"), 0, cut)), ("r", k - cut, part(F.col("phrase"), cut, k))):
            own = own.withColumn("_part", words)
            asked = own.groupBy("lang", "_part").agg(F.count("*").alias("_asked"))
            counts = level[size - 1].select("lang", F.col("phrase").alias("_part"), F.col("n").alias(f"{name}{cut}"))
            own = looked_up(written(own, f"cut-{k}-{cut}{name}"), written(asked.join(counts, ["lang", "_part"]), "asked"), ["lang", "_part"], "_asked").drop("_part")
        score = F.expr(f"(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * {PARTS}) div (cast(l{cut} as decimal(15,0)) * cast(r{cut} as decimal(15,0)))")
        best.append(F.struct(score.alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
    return own.withColumn("_best", F.least(*best) if len(best) > 1 else best[0]).select("lang", "phrase", "a", "_best.l", "_best.r", "_best.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's top phrases of 2 to longest words, but for those that mostly stand in a longer one."""
    level, totals = levels(docs, least, longest)
    kept = []
    for k in range(2, longest + 1):
        own = scored(level, k)
        for longer in range(k + 1, longest + 1):
            inner = [F.struct(part(F.col("phrase"), i, i + k).alias("phrase")) for i in range(longer - k + 1)]
            around = level[longer - 1].select("lang", F.explode(F.array(*inner)).alias("p"), "n").groupBy("lang", F.col("p.phrase").alias("phrase")).agg(F.max("n").alias("_around"))
            own = own.join(around, ["lang", "phrase"], "left").where(F.col("_around").isNull() | (100 * whole("_around") < 50 * whole("a"))).drop("_around")
        kept.append(own)
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.union(more)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = Window.partitionBy("lang", "_salt").orderBy(*order)
    few = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    numbers = [F.col(c).cast("long").alias(c) for c in ("a", "l", "r")]
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *numbers, F.col("total").cast("long").alias("n"), F.col("score").cast("long").alias("score"))
