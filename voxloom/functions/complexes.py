"""Complex numbers (structs of re and im) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def add(a: Column, b: Column) -> Column:
    return number(a["re"] + b["re"], a["im"] + b["im"])


def multiply(a: Column, b: Column) -> Column:
    return number(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def conjugate(a: Column) -> Column:
    return number(a["re"], -a["im"])


def magnitude(a: Column) -> Column:
    return F.sqrt(a["re"] * a["re"] + a["im"] * a["im"])
