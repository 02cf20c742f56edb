"""The 128-bit murmur3 hash (32-bit form) of 64-bit numbers, as Column expressions on 32-bit halves held in longs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hash: multipliers of the key's words and of the final mix.
WORDS, MIX = (0x239B961B, 0xAB0E9789, 0x38B34AE5), (0x85EBCA6B, 0xC2B2AE35)
TOP, LOW = 1 << 32, (1 << 32) - 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def times(a: Column, by: int) -> Column:
    """a * by modulo 2^32, in steps that stay below 2^63."""
    return let(a, lambda a: (a * (by & 0xFFFF) + (a * (by >> 16)) % 0x10000 * 0x10000) % TOP)


def turned(a: Column, by: int) -> Column:
    return let(a, lambda a: (F.shiftleft(a, by) + F.shiftright(a, 32 - by)) % TOP)


def folded(a: Column, by: int) -> Column:
    return let(a, lambda a: a.bitwiseXOR(F.shiftright(a, by)))


def mixed(h: Column) -> Column:
    return folded(times(folded(times(folded(h, 16), MIX[0]), 13), MIX[1]), 16)


def murmur3_128(number: Column) -> Column:
    """The lower 64 bits of the hash of a number's eight bytes (the lowest first), as a long."""
    low, high = number.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(number, 32)
    h1 = times(turned(times(low, WORDS[0]), 15), WORDS[1]).bitwiseXOR(F.lit(8))
    h2 = times(turned(times(high, WORDS[1]), 16), WORDS[2]).bitwiseXOR(F.lit(8))
    # the third and fourth state words hold the length alone
    state = let(h1, lambda h1: let(h2, lambda h2: F.struct(((h1 + h2 + 16) % TOP).alias("a"), h2.alias("b"))))
    state = let(state, lambda s: F.struct(s["a"].alias("a"), mixed((s["b"] + s["a"]) % TOP).alias("b"), mixed((s["a"] + 8) % TOP).alias("c")))
    state = let(state, lambda s: F.struct(((mixed(s["a"]) + s["b"] + s["c"] + s["c"]) % TOP).alias("a"), s["b"].alias("b")))
    return let(state, lambda s: s["a"].bitwiseOR(F.shiftleft((s["b"] + s["a"]) % TOP, 32)))
