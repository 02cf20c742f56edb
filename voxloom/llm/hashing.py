"""Words, word hashes and rolling hashes over them, as NumPy arrays."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Bases of the two rolling hashes: odd, so that they have an inverse modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@functools.lru_cache(maxsize=8)
def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below size."""
    out = []
    for x in (base, pow(base, -1, 2**64)):
        p = np.ones(1, dtype=np.uint64)
        while len(p) < size:
            p = np.concatenate([p, p * np.uint64(pow(x, len(p), 2**64))])
        out.append(p)
    return out[0], out[1]


def rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash of every width consecutive elements: the sum of h[i + j] * base^(width - 1 - j) modulo 2^64, by differences of one running sum."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, 1 << (len(h) + width).bit_length())
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * down[: len(h)], out=total[1:])
    return (total[width:] - total[:-width]) * up[width - 1 : len(h)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def words_of(text: str) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
