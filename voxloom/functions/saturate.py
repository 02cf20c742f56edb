"""Voxel types and saturating arithmetic as Column expressions.

Spark has no unsigned integers, so a voxel type is a name that travels beside a wider column, and results are clamped to its range.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The range of each voxel type (floats: the range that stands for black to white).
RANGES: dict[str, tuple[int, int]] = {
    "uint8": (0, 2**8 - 1),
    "uint16": (0, 2**16 - 1),
    "uint32": (0, 2**32 - 1),
    "uint64": (0, 2**64 - 1),
    "int8": (-(2**7), 2**7 - 1),
    "int16": (-(2**15), 2**15 - 1),
    "int32": (-(2**31), 2**31 - 1),
    "int64": (-(2**63), 2**63 - 1),
}
FLOATS = ("float32", "float64")
DATA_RANGE = {**RANGES, "float32": (0.0, 1.0), "float64": (0.0, 1.0)}


def check(kind: str) -> str:
    if kind not in DATA_RANGE:
        raise ValueError(f"unknown voxel type {kind}")
    return kind


def wide(kind: str) -> str:
    """A Spark type in which sums and differences of two values of the type are exact."""
    return "double" if kind in FLOATS else "decimal(38,0)" if kind in ("uint64", "int64") else "bigint"


def stored(kind: str) -> str:
    """The smallest Spark type that holds the voxel type."""
    return {"int8": "tinyint", "uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}[check(kind)]


def clamp(value: Column, kind: str) -> Column:
    if kind in FLOATS:
        return value
    low, high = (F.lit(str(x)).cast(wide(kind)) for x in RANGES[kind])
    return F.when(value.isNotNull(), F.least(F.greatest(value, low), high))  # least and greatest pass over nulls


def saturate_cast(value: Column, kind: str) -> Column:
    """Rounds half away from zero, takes NaN as 0 and clamps; a float type takes the value as it is."""
    check(kind)
    if kind in FLOATS:
        return value.cast(stored(kind))
    low, high = (F.lit(str(x)).cast(wide(kind)) for x in RANGES[kind])
    whole = F.round(F.when(F.isnan(value), F.lit(0)).otherwise(value))  # of the value's own type, so that 64-bit numbers stay exact
    return F.when(whole >= high, high).when(whole <= low, low).otherwise(whole.cast(wide(kind))).cast(stored(kind))


def fractional(*values: Column) -> Column:
    """Whether one of the values is of a type with fractions: a constant once the types are known."""
    kinds = [F.typeof(v) for v in values]
    return functools.reduce(operator.or_, (k.isin("float", "double") | (k.startswith("decimal") & ~k.endswith(",0)")) for k in kinds))


def whole_or(exact: Column, x: Column, y: Column, op: Callable[[Column, Column], Column], kind: str) -> Column:
    """exact for whole operands; an operand with fractions makes it a computation in doubles, rounded and clamped at the end."""
    if kind in FLOATS:
        return exact
    return F.when(fractional(x, y), saturate_cast(op(x.cast("double"), y.cast("double")), kind)).otherwise(exact)


def add(x: Column, y: Column, kind: str) -> Column:
    return whole_or(clamp(x.cast(wide(kind)) + y.cast(wide(kind)), kind).cast(stored(kind)), x, y, operator.add, kind)


def sub(x: Column, y: Column, kind: str) -> Column:
    return whole_or(clamp(x.cast(wide(kind)) - y.cast(wide(kind)), kind).cast(stored(kind)), x, y, operator.sub, kind)


def mul(x: Column, y: Column, kind: str) -> Column:
    """The product of two 64-bit values can exceed 38 digits; it then lies beyond the range, on the side of its sign."""
    if kind in FLOATS:
        return (x * y).cast(stored(kind))
    width = "bigint" if kind in ("uint8", "int8", "uint16", "int16", "int32") else "decimal(38,0)"
    a, b = x.cast(width), y.cast(width)
    low, high = RANGES[kind]
    beyond = F.when((a < 0) == (b < 0), F.lit(str(high))).otherwise(F.lit(str(low))).cast(wide(kind))
    exact = a * b if width == "bigint" else F.try_multiply(a, b)
    product = exact.cast("decimal(38,0)") if wide(kind) != "bigint" else exact
    inside = F.when(product.isNotNull(), F.least(F.greatest(product, F.lit(str(low)).cast("decimal(38,0)")), F.lit(str(high)).cast("decimal(38,0)")).cast(wide(kind)))
    return whole_or(F.when(x.isNull() | y.isNull(), None).otherwise(F.coalesce(inside, beyond)).cast(stored(kind)), x, y, operator.mul, kind)


def div(x: Column, y: Column, kind: str) -> Column:
    """Integers truncate toward zero; over zero the bound of the numerator's sign, 0 over 0 is 0. Floats divide."""
    if kind in FLOATS:
        return F.try_divide(x.cast("double"), y.cast("double")).cast(stored(kind))
    low, high = (F.lit(str(v)).cast(wide(kind)) for v in RANGES[kind])
    a, b = x.cast(wide(kind)), y.cast(wide(kind))
    safe = F.when(b == 0, F.lit(1).cast(wide(kind))).otherwise(b)
    quotient = truncated(a, safe, wide(kind))
    over_zero = F.when(a == 0, F.lit(0).cast(wide(kind))).when(a > 0, high).otherwise(low)
    exact = F.when(b == 0, over_zero).otherwise(clamp(quotient, kind)).cast(stored(kind))
    bound = F.when(x == 0, F.lit(0.0)).when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return whole_or(exact, x, y, lambda p, q: F.when(q == 0, bound).otherwise(F.try_divide(p, q)), kind)


def truncated(a: Column, b: Column, kind: str) -> Column:
    """Quotient of integers of any width, toward zero, without the overflow of the smallest long over -1."""
    x, y = F.abs(a), F.abs(b)
    size = F.call_function("div", x, y) if kind == "bigint" else ((x - x % y) / y).cast("decimal(38,0)")
    return F.when((a < 0) != (b < 0), -size).otherwise(size)


def div_secure(x: Column, y: Column, kind: str) -> Column:
    """div() where the divisor is not 0, otherwise 0."""
    return F.when(y == 0, F.lit(0).cast(stored(kind))).otherwise(div(x, y, kind))


OPERATIONS = {"+": add, "-": sub, "*": mul, "/": div}


def rescale(value: Column, source: tuple[Column, Column], target: str) -> Column:
    """Maps the range source (low, high) onto the data range of the target type and casts; values outside are clamped, an empty range gives the low end."""
    low, high = source
    to_low, to_high = (float(v) for v in DATA_RANGE[target])
    share = F.when(high > low, (value.cast("double") - low) / (high - low)).otherwise(F.lit(0.0))
    return saturate_cast(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (to_high - to_low) + to_low, target)
