"""Secret scan: three fixed patterns, and a battery of randomness tests over every other long token.

A candidate is a maximal run of at least SHORTEST characters of the base64 and URL alphabets that mixes letters with digits or cases; also
each piece of a run that no pattern covers, and each piece between joiners, be they those of one alphabet (`_` and `-`, or `+` and `/`) or all,
so that a key joined to a path, a name or another secret is judged alone. Its encoding is inferred from its characters. Were it drawn uniformly from that alphabet, three statistics would have known laws: the counts
of groups of the alphabet (chi-squared), the runs above and below the alphabet's middle (Wald-Wolfowitz) and the lag-one serial
correlation. Fisher's method joins the three p-values. Random keys spread evenly over (0, 1); words, paths and names crowd near 0.

What is flagged is what passes a threshold, and the threshold controls false discoveries: per encoding and class of length, the
candidates of the whole corpus with a p-value over one half tell how many truly random ones there are, and what passes beyond their share is
false. A threshold lower than PRIOR is taken only where a lower bound on their number keeps the false within FDR; otherwise PRIOR holds, or
what is higher and needed for FDR by the plain estimate. So with less evidence a threshold is never looser: with none it is PRIOR, by which
nine random keys of ten are flagged. Short tokens carry less evidence, and so their classes get stricter thresholds. Only those counts
(encodings x lengths x BINS) reach the driver.

Defined cases: a null or empty text has no spans; equal texts have equal spans; offsets are code points, end exclusive; texts are scanned
whole; an empty table gives no rows and the thresholds of no evidence; columns of the names added are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import text_of

# The patterns of the three base kinds and the shortest match (or group) that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of [0-9a-f]+ with 32 or more
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 16
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
#: What joins names: all of it, and what is no character of the other alphabet.
JOINERS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"), re.compile(r"[^+/_-]+"))
#: Bins of the p-value, false discoveries allowed among the flagged, the least threshold, and the threshold without evidence.
BINS, FDR, LEAST, PRIOR = 50, 0.05, 0.02, 0.1
#: Classes of length begin here.
LENGTHS = (16, 20, 24, 32, 40, 64, 128)

# The alphabets in their own order, and groups of characters that ordinary words use unevenly.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
GROUPS = ("aeiou", "tnshrdlc", "AEIOU", "0123456789", "+/-_")


def grouped(alphabet: str) -> np.ndarray:
    """Group of each character of the alphabet; other letters form one group per case."""
    return np.array([next((k for k, group in enumerate(GROUPS) if x in group), 5 + x.isupper()) for x in alphabet])


GROUPED = {name: grouped(x) for name, x in ALPHABETS.items()}


def upper_tail(chi2: float, df: int) -> float:
    """P(chi-squared with df degrees exceeds chi2), by the cube-root approximation."""
    z = ((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 0.5 * math.erfc(z / math.sqrt(2))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def inferred(token: str) -> str | None:
    """The smallest alphabet that holds the token; None without a mix of letters with digits or of both cases."""
    chars = set(token)
    if not (any(x.isdigit() for x in chars) and any(x.isalpha() for x in chars)) and not (any(x.islower() for x in chars) and any(x.isupper() for x in chars)):
        return None
    return next((name for name, alphabet in ALPHABETS.items() if chars <= set(alphabet)), None)


def randomness(token: str, encoding: str) -> float:
    """Fisher's combined p-value of the three tests under the hypothesis of uniform characters."""
    alphabet, groups = ALPHABETS[encoding], GROUPED[encoding]
    codes = np.array([alphabet.index(x) for x in token])
    n, size = len(codes), len(alphabet)
    share = np.bincount(groups, minlength=7) / size
    seen = np.bincount(groups[codes], minlength=7)
    used = share > 0
    chi = upper_tail(float(np.sum((seen[used] - n * share[used]) ** 2 / (n * share[used]))), int(used.sum()) - 1)
    high = codes >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs, expected = 1 + int(np.sum(high[1:] != high[:-1])), 1 + 2 * a * b / n
        run = two_sided((runs - expected) / math.sqrt(max(1e-9, (expected - 1) * (expected - 2) / (n - 1))))
    else:
        run = 2.0 ** (1 - n)
    centred = codes - codes.mean()
    square = float(centred @ centred)
    serial = two_sided((float(centred[1:] @ centred[:-1]) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    fisher = -2 * sum(math.log(max(p, 1e-12)) for p in (chi, run, serial))
    half = fisher / 2
    return math.exp(-half) * (1 + half + half * half / 2)  # upper tail of chi-squared with 6 degrees, exactly


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three base kinds."""
    out = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [(*m.span(), 2) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, int, int, float, int]]:
    """(start, end, encoding, class of length, p, start of the run) of every token that the battery can judge; a token before its pieces."""
    out = []
    runs = [m.span() for m in TOKEN.finditer(text)]
    base = base_spans(text) if runs else []
    for a, b in runs:
        wide = [(a, b), *uncovered(a, b, base)]
        pieces = [(x + m.start(), x + m.end()) for x, y in wide for joiners in JOINERS for m in joiners.finditer(text[x:y])]
        for x, y in dict.fromkeys(wide + pieces):
            token = text[a:b] if (x, y) == (a, b) else text[x:y].strip("+/_-")  # what joins a piece to the next is no part of a key
            if len(token) >= SHORTEST and (encoding := inferred(token)):
                length = int(np.searchsorted(LENGTHS, len(token), side="right")) - 1
                out.append((x, y, list(ALPHABETS).index(encoding), length, randomness(token, encoding), a))
    return out


def uncovered(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of the span from a to b outside all base spans."""
    out = []
    for x, y, _ in sorted(base):
        if x < b and a < y:
            out.append((a, x))
            a = max(a, y)
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def least_allowed(n: np.ndarray, random: float, nothing: float) -> float:
    """The least threshold over which at most FDR of what passes is beyond the share of so many random tokens; 1 if none is. nothing: that share where nothing passes."""
    passing, edges = n[::-1].cumsum()[::-1], np.arange(BINS) / BINS
    false = np.where(passing > 0, np.maximum(0, passing - random * (1 - edges)) / np.maximum(passing, 1e-9), nothing)
    allowed = np.flatnonzero((false <= FDR) & (edges >= LEAST))
    return float(edges[allowed[0]]) if len(allowed) else 1.0


def thresholds_of(counts: np.ndarray) -> np.ndarray:
    """Least p-value that is flagged, from counts by bin of the p-value (ascending); last axis: bins."""
    out = np.empty(counts.shape[:-1])
    for at in np.ndindex(*out.shape):
        n = counts[at].astype(float)
        high = n[BINS // 2 :].sum()
        sure = least_allowed(n, 2 * max(0.0, high - math.sqrt(high)), 1.0)
        out[at] = sure if sure < PRIOR else max(PRIOR, least_allowed(n, 2 * high, 0.0))
    return out


def thresholds(docs: DataFrame) -> np.ndarray:
    """Threshold per encoding and class of length, from all documents; a token that is repeated, as in copies, counts once."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {(e, k, min(BINS - 1, int(p * BINS)), hashlib.blake2b(text[a:b].encode(), digest_size=12).digest()) for text in batch["text"] for a, b, e, k, p, _ in candidates(text)}
            yield pd.DataFrame(sorted(rows), columns=["encoding", "length", "bin", "token"]).astype({x: "int64" for x in ("encoding", "length", "bin")})

    counts = np.zeros((len(ALPHABETS), len(LENGTHS), BINS))
    rows = docs.select(text_of(docs).alias("text")).mapInPandas(count, "encoding long, length long, bin long, token binary").distinct().groupBy("encoding", "length", "bin").agg(F.count("*").alias("n"))
    for e, k, b, n in rows.collect():  # at most one row per bin
        counts[e, k, b] = n
    return thresholds_of(counts)


def spans_of(text: str, least: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans (start, end, kind) by start and kind; a random token inside a base span is that span, a piece inside random tokens is those."""
    base = base_spans(text)
    more: list[tuple[int, int, int]] = []
    for a, b, e, k, p, run in candidates(text):
        own = takewhile(lambda x: x[0] >= run, reversed(more))  # noqa: B023: tokens of this run
        if p >= least[e, k] and not any(x <= a and b <= y for x, y, _ in chain(base, own)):
            more.append((a, b, 3))
    return sorted(base + more, key=lambda x: (x[0], x[2], x[1]))


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """text with every maximal stretch of spans replaced by mask."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, least: np.ndarray | None = None, mask: str | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex (long), base_sha256 and spans (string); with a mask, also redacted (string), the text without its secrets."""
    least = thresholds(docs) if least is None else least
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * (mask is not None)

    @F.pandas_udf(schema)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = spans_of(text, least)
            base = [x for x in spans if x[2] < 3]
            kinds = Counter(k for _, _, k in base)
            row = (kinds[0], kinds[1], kinds[2], hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(spans))
            rows.append((*row, redacted(text, spans, mask)) if mask is not None else row)
        return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])

    kept = [c for c in docs.columns if c not in {x.split()[0] for x in schema.split(", ")}]
    return docs.select(*(docs[c] for c in kept), found(text_of(docs)).alias("_found")).select(*kept, "_found.*")


def redact(docs: DataFrame, mask: str, least: np.ndarray | None = None) -> DataFrame:
    """docs with the secrets of their texts replaced by mask; all other columns stay."""
    least = thresholds(docs) if least is None else least

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: redacted(text, spans_of(text, least), mask))

    return docs.withColumn("text", clean(text_of(docs)))
