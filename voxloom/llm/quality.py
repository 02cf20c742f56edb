"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is good or bad. A line's score uses its own features and those of the lines before and after it; transition weights
tie neighbouring labels. Forward-backward gives each line's marginal; their mean, weighted by line length, is the document's evidence,
and a logistic curve fitted on the same training rows turns it into a score between 0 and 1.

Only document labels exist, so the lines' own labels are latent: a document's label is seen at each of its lines, wrongly with probability
GOOD_IN_BAD or BAD_IN_GOOD (a bad document may well hold good lines, a good one hardly any bad ones), and the field maximises the likelihood of what is seen given the features. Fitting begins (WARM steps) with the document's label at every line and no
ties between lines; after that a line may differ from its document where its features and neighbours say so, and ties are learned from that. The field
is fitted on the whole texts of a bounded sample of labelled documents: those with the smallest hash of their id, at most TRAIN_DOCS
documents, TRAIN_LINES lines and TRAIN_CHARS characters, none of more than LONGEST_TRAIN characters or LINES_TRAIN lines (all arguments of
train()); every document is scored. In texts of more than LONG lines, forward-backward goes by products of the moves of runs of lines, so that its steps don't grow with
the longest text. Texts are scored in blocks of BLOCK_CHARS characters and BLOCK_LINES lines; a text beyond either goes by pieces of so many
lines, whose moves are multiplied once to know what comes before and after each piece, and keeps about 60 bytes a line.

Defined cases: a null or empty text is one empty line and is scored like any other; equal texts have equal scores; rows with a null
doc_id are scored but never trained on; labels without quality are left out; with no usable label of one kind every score is the share
of good labels (0.5 without labels); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import documents, text_of

#: Most labelled documents that the field is fitted on, most lines and characters of all of them, most characters of one.
TRAIN_DOCS, TRAIN_LINES, TRAIN_CHARS = 4000, 500_000, 64_000_000
#: Most characters and lines of one of them.
LONGEST_TRAIN, LINES_TRAIN = 1_000_000, 10_000
#: Texts of more lines than this go by products of moves, of so many lines each.
LONG, RUN = 128, 32
#: Characters and lines that one scoring step holds at once; lines and bytes whose pairs are counted at once.
BLOCK_CHARS, BLOCK_LINES, PAIR_LINES, PAIR_BYTES = 4_000_000, 100_000, 10_000, 1_000_000
STEPS, WARM, RATE, RIDGE = 100, 30, 0.15, 1e-3
#: Shares of good lines that stand in bad documents, and of bad lines that stand in good ones, before anything else is known of a line.
GOOD_IN_BAD, BAD_IN_GOOD = 0.5, 0.02

#: Classes of bytes: lower case, upper case, digits, blanks, stops, bangs, symbols, brackets and bars, other, beyond ASCII.
KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b".,;:?'\"-", b"!", b"#$%&*@^~+=<>/\\_`", b"|[](){}"]
LETTERS, DIGITS, BLANKS, STOPS, SYMBOLS = [0, 1, 9], 2, 3, 4, [5, 6, 7]
FEATURES = 22
WORD = re.compile(rb"[^ \t\n\r\f\v]+")


def byte_kinds() -> np.ndarray:
    kinds = np.full(256, 8, dtype=np.uint8)
    kinds[128:] = 9
    for k, chars in enumerate(KINDS):
        kinds[list(chars)] = k
    return kinds


def pair_counts(data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """By some lines at a time: how often each pair of byte kinds stands in them (lines x 10 x 10), and how often a bang, symbol or bracket follows itself. data: bytes of the lines, each with its line break."""
    ends = np.cumsum(sizes + 1)
    for a in range(0, len(sizes), PAIR_LINES):
        own = ends[a : a + PAIR_LINES]
        first = int(own[0] - sizes[a] - 1)
        pairs, same = np.zeros(len(own) * 100, dtype=np.int64), np.zeros(len(own), dtype=np.int64)
        for x in range(first, int(own[-1]), PAIR_BYTES):
            y = min(int(own[-1]), x + PAIR_BYTES)
            here = data[x : y + 1] if y < len(data) else np.append(data[x:y], np.uint8(10))  # with the byte that follows
            kind = byte_kinds()[here]
            if y == int(own[-1]):
                kind[-1] = 8  # what follows a line's break is no part of it
            low, high = np.searchsorted(own, x, side="right"), np.searchsorted(own, y - 1, side="right")
            row = np.repeat(np.arange(high + 1 - low), np.diff([x, *own[low:high].tolist(), y]))
            pairs[low * 100 : (high + 1) * 100] += np.bincount(row * 100 + kind[:-1].astype(np.int64) * 10 + kind[1:], minlength=(high + 1 - low) * 100)
            twice = (here[:-1] == here[1:]) & (kind[:-1] >= 5) & (kind[:-1] <= 7)
            same[low : high + 1] += np.bincount(row[twice], minlength=high + 1 - low)
        yield slice(a, a + len(own)), pairs.reshape(-1, 10, 10), same


def word_repeats(line: bytes) -> tuple[float, float]:
    """Shares of a line's words that stood before in it, and that equal the word after."""
    if len(line) <= PAIR_BYTES:
        words = line.split()
        return (1 - len(set(words)) / len(words), sum(map(eq, words, words[1:])) / len(words)) if words else (0.0, 0.0)
    seen, n, twice, before = set(), 0, 0, b""
    for m in WORD.finditer(line):
        word = m[0]
        seen.add(word)
        n, twice, before = n + 1, twice + (word == before), word
    return (1 - len(seen) / n, twice / n) if n else (0.0, 0.0)


def features(lines: list[bytes], repeated: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of lines (lines x FEATURES) and their bytes. repeated: whether the line stood before in its text; alone: whether it is all of it."""
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    out = np.empty((len(lines), FEATURES))
    again, twice = np.zeros(len(lines)), np.zeros(len(lines))
    for i, line in enumerate(lines):
        if line:
            again[i], twice[i] = word_repeats(line)
    # pairs of byte kinds that follow each other are counted per line; each line is followed by its line break
    for at, pairs, same in pair_counts(np.frombuffer(b"\n".join(lines) + b"\n", dtype=np.uint8), sizes):
        n = np.maximum(sizes[at], 1).astype(np.float64)
        of = pairs.sum(axis=2)
        ends = pairs[:, :, BLANKS] + pairs[:, :, 8]  # a byte of this kind stands before a blank or at the end
        words = ends.sum(axis=1) - ends[:, BLANKS] - ends[:, 8] + 1e-9
        columns = [
            *(of[:, k] / n for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)),
            np.log1p(sizes[at]) / 8,
            np.minimum(n / words, 40) / 10,
            pairs[:, LETTERS][:, :, SYMBOLS].sum(axis=(1, 2)) / words,
            same / n,
            pairs[:, BLANKS, 7] / words,
            pairs[:, 1, 1] / n,
            ends[:, STOPS] / words,
            pairs[:, DIGITS][:, LETTERS].sum(axis=1) / n,
            repeated[at],
            again[at],
            twice[at],
            alone[at],
            sizes[at] == 0,
        ]
        for k, column in enumerate(columns):
            out[at, k] = column
    return out, sizes


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line (lines x FEATURES), bytes of every line, and the number of lines of each text."""
    lines = [text.encode("utf-8", "replace").split(b"\n") for text in texts]
    counts = np.array([len(x) for x in lines], dtype=np.int64)
    repeated = []
    for own in lines:
        seen: set[bytes] = set()
        for line in own:
            repeated.append(line in seen and line != b"")
            seen.add(line)
    return *features([line for x in lines for line in x], np.array(repeated), np.repeat(counts, counts) == 1), counts


def line_pieces(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """features() of one long text's lines, by pieces of BLOCK_LINES lines and BLOCK_CHARS bytes, or one longer line."""
    ends = np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.empty(len(ends), dtype=np.uint64)
    edges = [0]
    while edges[-1] < len(ends):
        a = edges[-1]
        b = max(a + 1, min(a + BLOCK_LINES, int(np.searchsorted(ends, starts[a] + BLOCK_CHARS, side="right"))))
        hashes[a:b] = np.fromiter(map(xxhash.xxh3_64_intdigest, data[starts[a] : ends[b - 1]].split(b"\n")), dtype=np.uint64, count=b - a)
        edges.append(b)
    repeated = np.ones(len(ends), dtype=bool)
    repeated[np.unique(hashes, return_index=True)[1]] = False
    repeated &= starts < ends
    for a, b in zip(edges, edges[1:], strict=False):
        yield features(data[starts[a] : ends[b - 1]].split(b"\n"), repeated[a:b], np.full(b - a, len(ends) == 1))


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after it (zero at the ends), and a constant."""
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


@dataclass(frozen=True)
class Field:
    """weights of a good line over its features, log potentials between labels (from, to), and the logistic curve over a document's evidence."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    between: np.ndarray
    slope: float
    shift: float


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products (... x 2 x 2) in logarithms."""
    return np.logaddexp(a[..., :, :1] + b[..., :1, :], a[..., :, 1:] + b[..., 1:, :])


def products(moves: np.ndarray) -> np.ndarray:
    """The product of each move (2 x 2, in logarithms) with all before it."""
    n = len(moves)
    if n < 2:
        return moves
    none = np.broadcast_to(np.log(np.eye(2) + 1e-300), (-n % RUN, 2, 2))
    runs = np.concatenate([moves, none]).reshape(-1, RUN, 2, 2)
    for t in range(1, RUN):
        runs[:, t] = product(runs[:, t - 1], runs[:, t])
    if len(runs) > 1:
        runs[1:] = product(products(runs[:, -1])[:-1, None], runs[1:])
    return runs.reshape(-1, 2, 2)[:n]


def along(states: np.ndarray, counts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward logarithms of texts in a row, each text's but for a constant: the move into a text's first line forgets the text before."""
    moves = np.repeat(states[1:, None, :], 2, axis=1)
    inner = np.ones(len(moves), dtype=bool)
    inner[np.cumsum(counts)[:-1] - 1] = False
    moves[inner] += between
    forward = np.logaddexp(*(states[0, a] + products(moves)[:, a] for a in (0, 1)))
    back = products(moves[::-1].transpose(0, 2, 1))[::-1]
    return np.concatenate([states[:1], forward]), np.concatenate([np.logaddexp(back[:, 0], back[:, 1]), np.zeros((1, 2))])


def marginals(good: np.ndarray, counts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good) and the expected number of each transition, by forward-backward over all texts at once; good: log potential of good against bad."""
    order = np.argsort(-counts, kind="stable")
    starts, counts = (np.cumsum(counts) - counts)[order], counts[order]
    long = int(np.searchsorted(-counts, -LONG, side="left"))
    steps = int(counts[long]) if len(counts) > long else 0
    states = np.stack([np.zeros_like(good), good], axis=1)
    forward, backward = np.empty_like(states), np.zeros_like(states)
    if long:
        own = np.repeat(starts[:long] - np.cumsum(counts[:long]) + counts[:long], counts[:long]) + np.arange(counts[:long].sum())
        forward[own], backward[own] = along(states[own], counts[:long], between)
    short = starts[long:]
    active = np.searchsorted(-counts[long:], -np.arange(steps), side="left")  # short texts with more lines than t
    for t in range(steps):
        at = short[: active[t]] + t
        forward[at] = states[at] if t == 0 else states[at] + np.logaddexp(forward[at - 1][:, :1] + between[0], forward[at - 1][:, 1:] + between[1])
    for t in range(steps - 2, -1, -1):
        at = short[: active[t + 1]] + t
        later = states[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(between[:, 0] + later[:, :1], between[:, 1] + later[:, 1:])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    expected = np.zeros((2, 2))
    inner = np.ones(len(good), dtype=bool)
    inner[starts + counts - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        later = states[at + 1] + backward[at + 1]
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.exp(forward[at, a] + between[a, b] + later[:, b] - total[at]).sum()
    return np.exp(both[:, 1] - total), expected


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def evidence(probability: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of the lines' marginals, weighted by length."""
    starts = np.cumsum(counts) - counts
    weight = sizes + 1.0
    return np.add.reduceat(weight * probability, starts) / np.add.reduceat(weight, starts)


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(slope * x + shift)))
        w = p * (1 - p) + 1e-6
        hessian = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-2]])
        step = np.linalg.solve(hessian, [np.sum((y - p) * x), np.sum(y - p)])
        slope, shift = slope + step[0], shift + step[1]
    return float(slope), float(shift)


def is_long(text: str) -> bool:
    return len(text) > BLOCK_CHARS or text.count("\n") >= BLOCK_LINES


def blocks(texts: Iterable[str]) -> Iterator[list[str]]:
    """The texts in blocks of up to BLOCK_CHARS characters and BLOCK_LINES lines, or one longer text."""
    block, chars, lines = [], 0, 0
    for text in texts:
        own = text.count("\n") + 1
        if block and (chars + len(text) > BLOCK_CHARS or lines + own > BLOCK_LINES):
            yield block
            block, chars, lines = [], 0, 0
        block.append(text)
        chars, lines = chars + len(text), lines + own
    if block:
        yield block


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """line_features() of many texts, read in blocks."""
    x, sizes, counts = zip(*map(line_features, blocks(texts)), strict=True)
    return np.concatenate(x), np.concatenate(sizes), np.concatenate(counts)


def potentials(x: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """with_neighbours(x) @ weights, without the wide table; first: the first line of each text."""
    own, before, after = x @ weights[:FEATURES], x @ weights[FEATURES : 2 * FEATURES], x @ weights[2 * FEATURES : -1]
    before[first[1:] - 1] = 0
    after[first] = 0
    own[1:] += before[:-1]
    own[:-1] += after[1:]
    return own + weights[-1]


def slopes(x: np.ndarray, first: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """with_neighbours(x).T @ residual, without the wide table."""
    later, earlier = residual.copy(), residual.copy()
    later[first] = 0
    earlier[first[1:] - 1] = 0
    return np.concatenate([residual @ x, later[1:] @ x[:-1], earlier[:-1] @ x[1:], [residual.sum()]])


def fit(texts: list[str], quality: np.ndarray) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of the documents' labels, the lines' labels being latent after WARM steps."""
    x, sizes, counts = features_of(texts)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x -= mean
    x /= scale
    first = np.cumsum(counts) - counts
    y = np.repeat(quality.astype(np.float64), counts)
    theta, mean_slope, square = np.zeros(3 * FEATURES + 5), 0.0, 0.0
    evident = np.where(y == 1, np.log((1 - GOOD_IN_BAD) / BAD_IN_GOOD), np.log(GOOD_IN_BAD / (1 - BAD_IN_GOOD)))
    for step in range(1, STEPS + 1):
        good, between = potentials(x, first, theta[:-4]), theta[-4:].reshape(2, 2)
        p, expected = marginals(good, counts, between)
        if step > WARM:
            y, seen = marginals(good + evident, counts, between)
        else:
            seen = expected  # transitions wait for lines that may differ
        slope = np.concatenate([slopes(x, first, y - p), (seen - expected).ravel()]) / len(y) - RIDGE * theta
        mean_slope, square = 0.9 * mean_slope + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta += RATE * (mean_slope / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    p, _ = marginals(potentials(x, first, theta[:-4]), counts, theta[-4:].reshape(2, 2))
    return Field(mean, scale, theta[:-4], theta[-4:].reshape(2, 2), *fit_logistic(logit(evidence(p, sizes, counts)), quality.astype(np.float64)))


def score(field: Field, texts: list[str]) -> np.ndarray:
    if len(texts) == 1 and is_long(texts[0]):
        found = np.array([long_evidence(field, texts[0])])
    else:
        x, sizes, counts = line_features(texts)
        p, _ = marginals(with_neighbours((x - field.mean) / field.scale, counts) @ field.weights, counts, field.between)
        found = evidence(p, sizes, counts)
    return 1 / (1 + np.exp(-(field.slope * logit(found) + field.shift)))


def long_evidence(field: Field, text: str) -> float:
    """evidence() of one long text, by pieces of its lines."""
    own, before, after, weights = [], [], [], []
    for x, sizes in line_pieces(text.encode("utf-8", "replace")):
        x = (x - field.mean) / field.scale
        for kept, w in zip((own, before, after), (field.weights[k * FEATURES : (k + 1) * FEATURES] for k in range(3)), strict=True):
            kept.append(x @ w)
        weights.append(sizes + 1.0)
    good, before, after, weight = (np.concatenate(x) for x in (own, before, after, weights))
    good[1:] += before[:-1]
    good[:-1] += after[1:]
    return float(weight @ long_marginals(good + field.weights[-1], field.between) / weight.sum())


def long_marginals(good: np.ndarray, between: np.ndarray) -> np.ndarray:
    """P(line is good) of one text, by pieces of BLOCK_LINES lines: the product of each piece's moves tells what enters the next and what leaves for the one before."""
    edges = [*range(1, len(good), BLOCK_LINES), len(good)]  # the first line has no move into it

    def moves(a: int, b: int) -> np.ndarray:
        return between + np.stack([np.zeros(b - a), good[a:b]], axis=1)[:, None, :]

    spans = [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]
    whole = [products(moves(a, b))[-1].copy() for a, b in spans]
    enter, leave = [np.array([0.0, good[0]])], [np.zeros(2)]
    for m in whole:
        enter.append(np.logaddexp(enter[-1][0] + m[0], enter[-1][1] + m[1]))
    for m in reversed(whole):
        leave.append(np.logaddexp(m[:, 0] + leave[-1][0], m[:, 1] + leave[-1][1]))
    leave.reverse()
    out = np.empty(len(good))
    first = enter[0] + leave[0]
    out[0] = np.exp(first[1] - np.logaddexp(*first))
    for (a, b), before, after in zip(spans, enter[:-1], leave[1:], strict=True):
        own = moves(a, b)
        ahead = products(own)
        forward = np.logaddexp(before[0] + ahead[:, 0], before[1] + ahead[:, 1])
        back = products(own[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)[1:]  # from each line to the piece's end, but for the last
        backward = np.concatenate([np.logaddexp(back[:, :, 0] + after[0], back[:, :, 1] + after[1]), after[None]])
        both = forward + backward
        out[a:b] = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS, most_lines: int | None = None, most_chars: int | None = None, longest: int | None = None, longest_lines: int | None = None) -> Field | float:
    """Fits the field on at most limit labelled documents that are not held out, of so many lines and characters at most (where not given: the constants above); a plain share of good labels where only one kind is there."""
    most_lines, most_chars, longest, longest_lines = (own or most for own, most in ((most_lines, TRAIN_LINES), (most_chars, TRAIN_CHARS), (longest, LONGEST_TRAIN), (longest_lines, LINES_TRAIN)))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lines = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    short = documents(docs).where((F.char_length("text") <= longest) & (lines <= longest_lines))
    sized = short.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("chars"), F.max(lines).alias("lines")).join(usable, "doc_id")
    sample = sized.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)  # at most limit rows of four numbers from here on
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    fits = (F.sum("chars").over(upto) <= most_chars) & (F.sum("lines").over(upto) <= most_lines)
    chosen = F.broadcast(sample.withColumn("fits", fits).where("fits").select("doc_id", "quality"))
    rows = short.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    quality = rows["quality"].to_numpy()
    if len(set(quality)) < 2:
        return float(quality.mean()) if len(quality) else 0.5
    return fit(rows["text"].tolist(), quality)


def with_scores(docs: DataFrame, field: Field | float, column: str = "score") -> DataFrame:
    """docs with a score column; a column of that name is replaced. Each step takes texts up to BLOCK_CHARS characters."""
    if isinstance(field, float):
        return docs.withColumn(column, F.lit(field))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [score(field, block) for block in blocks(texts)]
            yield pd.Series(np.concatenate(out) if out else [], dtype="float64")

    return docs.withColumn(column, scores(text_of(docs)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, limit: int = TRAIN_DOCS) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 at the threshold or above)."""
    return with_scores(docs, train(docs, labels, limit)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
