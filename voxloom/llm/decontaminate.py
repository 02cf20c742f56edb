"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit verification.

A document leaks an item if some passage of it lies within DIFFERENCE edits (insertions, deletions, replacements of words) per word of the
item. Windows as long as the item are embedded by random walks (CGK): a walk copies the current word at each step and moves on by a coin
that the word and the step determine, so texts that differ by few edits walk together for most steps, and edit distance becomes Hamming
distance. A repetition hashes the walk at a few sampled steps; a window whose hash equals the item's in any repetition is a candidate. How
many repetitions reach RECALL at the largest allowed distance is measured, for each class of lengths, on edited copies of the items
themselves; where REPETITIONS of them don't reach it, every window of that class is verified. Candidates are verified by the edit
distance between the item and the best passage around the window.

Walks start where a window can match at all: an item cut into one more segment than it may have edits leaves one segment whole in
every passage that matches, so windows are those that align a whole segment with its place. This loses none.

Items are read in blocks of at most BLOCK_BYTES, each held against all documents, so what a task holds is bounded whatever the benchmark.

Defined cases: words are runs of letters and digits, in lower case; null and empty texts have none, and match nothing; items too short to
allow an edit match exactly, be it a single word; equal items are found each; repeated rows are reported each; rows without an id are
reported with a null id; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow, documents, text_of
from voxloom.llm.hashing import BASES, mixed, rolling, word_hashes

DIFFERENCE, RECALL = 0.2, 0.995
#: Steps of a walk per word (it leaves the window after about so many), steps that a repetition samples, and most repetitions.
WALK, SAMPLED, REPETITIONS = 2, 3, 96
#: Edited copies that a class of lengths is measured on, and how much longer than the shortest its items may be.
TRIALS, CLASS = 200, 1.25
BLOCK_BYTES = 32 << 20
#: Windows embedded at once.
WINDOWS = 4096
WORD = re.compile(r"[^\W_]+")


def hashed_words(text: str) -> np.ndarray:
    return word_hashes([w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())]) | np.uint64(1)  # zero is the padding


def length_class(n: int) -> int:
    return int(math.log(n) / math.log(CLASS))


def most_edits(n: int) -> int:
    return int(DIFFERENCE * n)


@functools.lru_cache(maxsize=64)
def coins(steps: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Salt of each step and repetition, and whether the repetition samples the step, for walks of that many steps."""
    rng = np.random.default_rng(seed)
    at = rng.random((REPETITIONS, SAMPLED))
    sampled = np.zeros((steps, REPETITIONS), dtype=bool)
    sampled[(at * steps).astype(int), np.arange(REPETITIONS)[:, None]] = True
    return np.random.default_rng(seed + 1).integers(0, 2**63, (steps, REPETITIONS)).astype(np.uint64), sampled


def walk_keys(words: np.ndarray, repetitions: int) -> np.ndarray:
    """Hash per repetition (column) of each window (row of words, all of one length)."""
    n = words.shape[1]
    salts, sampled = coins(WALK * n)
    padded = np.concatenate([words, np.zeros((len(words), 1), dtype=np.uint64)], axis=1)
    at = np.zeros((len(words), repetitions), dtype=np.int64)
    keys = np.zeros((len(words), repetitions), dtype=np.uint64)
    for step in range(int(np.flatnonzero(sampled[:, :repetitions].any(axis=1))[-1]) + 1):
        now = np.take_along_axis(padded, at, axis=1)
        own = sampled[step, :repetitions]
        if own.any():
            keys[:, own] = mixed(keys[:, own] * np.uint64(BASES[1]) + now[:, own])
        at = np.minimum(at + (mixed(now ^ salts[step, :repetitions]) >> np.uint64(63)).astype(np.int64), n)
    return keys


def passage_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance between the item and a passage of the region, and where the passage ends."""
    row = np.zeros(len(region) + 1, dtype=np.int64)
    ramp = np.arange(len(region) + 1)
    for i, word in enumerate(item, 1):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (region != word))
        best[0] = i
        row = np.minimum.accumulate(best - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


def passage(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Distance, start and end (exclusive) of the best passage."""
    distance, end = passage_distance(item, region)
    _, length = passage_distance(item[::-1], region[:end][::-1])
    return distance, end - length, end


class Index:
    """The items of one block: segments by hash, and each item's keys. repetitions: those of each class of lengths, None where all windows are verified."""

    def __init__(self, items: list[tuple[int, str]], repetitions: dict[int, int | None] | None = None):
        read = [(i, hashed_words(text)) for i, text in items]
        self.ids = [i for i, h in read if len(h)]
        self.items = [h for _, h in read if len(h)]
        segments: dict[int, list[tuple[int, int, int]]] = {}
        for k, h in enumerate(self.items):
            width = len(h) // (most_edits(len(h)) + 1)
            for s in range(most_edits(len(h)) + 1):
                segments.setdefault(width, []).append((int(mixed(rolling(h[s * width : (s + 1) * width], width, BASES[0]))[0]), k, s * width))
        self.segments = {}
        for width, own in segments.items():
            own.sort()
            value = np.array([x[0] for x in own], dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[value >> np.uint64(44)] = True
            self.segments[width] = (seen, value, np.array([x[1] for x in own]), np.array([x[2] for x in own]))
        self.repetitions = self.needed() if repetitions is None else repetitions
        self.keys = [walk_keys(h[None, :], self.repetitions[length_class(len(h))] or 1)[0] for h in self.items]

    def needed(self) -> dict[int, int | None]:
        """Repetitions per class of lengths that reach RECALL, over all aligned windows of TRIALS copies with as many edits as are allowed."""
        rng = np.random.default_rng(11)
        classes: dict[int, list[np.ndarray]] = {}
        for h in self.items:
            classes.setdefault(length_class(len(h)), []).append(h)
        out: dict[int, int | None] = {}
        for c, own in sorted(classes.items()):
            own = [h for h in own if most_edits(len(h))]
            trials = [(h, w) for t in range(TRIALS * bool(own)) if len(w := self.windows_of_a_copy(h := own[t * len(own) // TRIALS if len(own) > TRIALS else t % len(own)], rng))]
            hits = np.zeros((len(trials), REPETITIONS), dtype=bool)
            for n in {len(h) for h, _ in trials}:
                at = [i for i, (h, _) in enumerate(trials) if len(h) == n]
                owner = np.repeat(at, [len(trials[i][1]) for i in at])
                keys = walk_keys(np.stack([trials[i][0] for i in at]), REPETITIONS)
                same = walk_keys(np.concatenate([trials[i][1] for i in at]), REPETITIONS) == keys[np.searchsorted(at, owner)]
                np.logical_or.at(hits, owner, same)
            reached = np.logical_or.accumulate(hits, axis=1).mean(axis=0) if trials else np.ones(1)
            enough = np.flatnonzero(reached >= RECALL)
            out[c] = int(enough[0] + 1) if len(enough) else None
        return out

    def windows_of_a_copy(self, h: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The aligned windows of a copy of the item with the most edits allowed, between other words."""
        words = h.tolist()
        for _ in range(most_edits(len(h))):
            at, kind = int(rng.integers(len(words))), rng.integers(3)
            words[at : at + (kind != 0)] = [int(rng.integers(1, 2**63))] if kind < 2 else []
        noise = rng.integers(1, 2**63, 2 * len(h)).tolist()
        text = np.array(noise[: len(h)] + words + noise[len(h) :], dtype=np.uint64)
        starts = sorted({s for k, s in self.alignments(text) if np.array_equal(self.items[k], h) and 0 <= s <= len(text) - len(h)})
        return np.array([text[s : s + len(h)] for s in starts], dtype=np.uint64)

    def alignments(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, start of the window) of all windows that align a whole segment."""
        out: set[tuple[int, int]] = set()
        for width, (seen, value, item, offset) in self.segments.items():
            if len(h) < width:
                continue
            g = mixed(rolling(h, width, BASES[0]))
            at = np.flatnonzero(seen[g >> np.uint64(44)])
            low, high = np.searchsorted(value, g[at], "left"), np.searchsorted(value, g[at], "right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                out.update((int(item[k]), p - int(offset[k])) for k in range(a, b))
        return out

    def leaks(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start word, words, distance) of the leaks in each text; overlapping passages of an item give the nearest one."""
        hashed, windows = [], {}
        for t, text in enumerate(texts):
            h = hashed_words(text)
            hashed.append(h)
            for k, s in sorted(self.alignments(h)):
                windows.setdefault(len(self.items[k]), []).append((t, k, s))
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        whole: dict[tuple[int, int], int] = {}  # start of the last passage without edits: one that overlaps it is no nearer, and the next is aligned at most_edits() before its end or later
        for n, own in windows.items():
            for a in range(0, len(own), WINDOWS):
                block = own[a : a + WINDOWS]
                words = np.zeros((len(block), n), dtype=np.uint64)
                for row, (t, _, s) in zip(words, block, strict=True):
                    part = hashed[t][max(0, s) : max(0, s + n)]
                    row[max(0, -s) : max(0, -s) + len(part)] = part
                repetitions = self.repetitions[length_class(n)]
                same = (walk_keys(words, repetitions) == np.stack([self.keys[k] for _, k, _ in block])).any(axis=1) if repetitions else np.ones(len(block), dtype=bool)
                for (t, k, s), candidate in zip(block, same.tolist(), strict=True):
                    if candidate and s >= whole.get((t, k), -math.inf) + n - most_edits(n):
                        edits, first = most_edits(n), max(0, s - most_edits(n))
                        distance, start, end = passage(self.items[k], hashed[t][first : max(0, s + n + edits)])
                        if distance <= edits:
                            found.setdefault((t, k), []).append((first + start, end - start, distance))
                        if distance == 0:
                            whole[t, k] = first + start
        out = []
        for (t, k), own in sorted(found.items()):
            last = -math.inf
            best = None
            for s, n, d in sorted(set(own)):
                if s < last:
                    if d < best[4]:
                        best = (t, k, s, n, d)
                        out[-1] = best
                else:
                    best = (t, k, s, n, d)
                    out.append(best)
                last = max(last, s + n)
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text) in blocks of about BLOCK_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    held = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = int(held // BLOCK_BYTES) + 1
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((x.item_id, x.text) for x in rows), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity of every leaked passage."""
    docs = documents(docs)
    return functools.reduce(DataFrame.union, (found_in(docs, items) for items in item_blocks(benchmark)))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    for items in item_blocks(benchmark):
        docs = docs.where(~leaky(shared_index(docs, items))(text_of(docs)))
    return docs


def leaky(index: Callable[[], Index]) -> Callable:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        found = {t for t, *_ in index().leaks(texts.tolist())}
        return pd.Series([t in found for t in range(len(texts))], dtype="bool")

    return run


def shared_index(docs: DataFrame, items: list[tuple[int, str]]) -> Callable[[], Index]:
    """A function that gives a task the index of the items, built once in it; its repetitions are measured once, here."""
    sent = docs.sparkSession.sparkContext.broadcast((items, Index(items).repetitions))
    built: list[Index] = []

    def index() -> Index:
        if not built:
            built.append(Index(*sent.value))
        return built[0]

    return index


def found_in(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = shared_index(docs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = [(ids[t], index.ids[k], s, n, d, 1 - d / len(index.items[k])) for t, k, s, n, d in index.leaks(batch.column(1).to_pylist())]
            yield arrow(rows, [pa.int64()] * 5 + [pa.float64()], ["doc_id", "item_id", "start_word", "n_words", "distance", "similarity"])

    return docs.mapInArrow(run, "doc_id long, item_id long, start_word long, n_words long, distance long, similarity double")
