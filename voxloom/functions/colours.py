"""Colours (structs of r, g, b, a from 0 to 255) and colour maps as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b", "a")
Colour = tuple[int, int, int, int]


def channelwise(f: Callable[..., Column], *colours: Column) -> Column:
    return F.struct(*(f(*(c[k] for c in colours)).cast("int").alias(k) for k in CHANNELS))


def brighter(a: Column, b: Column) -> Column:
    """The greater value of each channel."""
    return channelwise(F.greatest, a, b)


def mixed(a: Column, b: Column, share: Column) -> Column:
    """a at share 0 and less, b at 1 and more, and between them each channel's weighted mean, cut to a whole number."""
    part = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    return channelwise(lambda x, y: (1 - part) * x + part * y, a, b)


def mapped(value: Column, keys: Sequence[tuple[float, Colour, Colour]]) -> Column:
    """Colour of a value by keys (intensity, colour on its left, colour on its right), ascending.

    Up to the first key its left colour holds, beyond the last its right one. Between two keys each channel moves from the lower one's
    right to the upper one's left colour, by a whole step towards zero. Without keys all is 0; a null value has no colour.
    """
    if not keys:
        return F.struct(*(F.lit(0).alias(k) for k in CHANNELS))

    def channel(i: int) -> Column:
        out = F.when(value <= keys[0][0], F.lit(keys[0][1][i]))
        for (low, _, start), (high, end, _) in zip(keys, keys[1:], strict=False):
            step = (value - low) / F.lit(float(high - low)) * (end[i] - start[i]) if high > low else F.lit(0.0)
            out = out.when(value <= high, F.lit(start[i]) + step.cast("int"))
        return out.when(value > keys[-1][0], F.lit(keys[-1][2][i]))

    return F.when(value.isNotNull(), F.struct(*(channel(i).cast("int").alias(k) for i, k in enumerate(CHANNELS))))
