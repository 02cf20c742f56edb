"""String functions: natural order, whole numbers in names, comments, numbers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 20


def natural_key(text: Column) -> Column:
    """A key that sorts names as people do: digits by value, the rest by character."""
    runs = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    padded = F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(F.regexp_replace(x, "^0+(?=[0-9])", ""), DIGITS, "0")).otherwise(x))
    return F.array_join(padded, "")


def last_integer(text: Column) -> Column:
    """The last run of digits, or null."""
    found = F.regexp_extract(text, r"([0-9]+)[^0-9]*$", 1)
    return F.when(found != "", found.cast("bigint"))


def replace_last_integer(text: Column, number: Column) -> Column:
    """text with its last run of digits replaced; unchanged without one."""
    before, after = F.regexp_extract(text, r"(?s)^(.*?)[0-9]+[^0-9]*$", 1), F.regexp_extract(text, r"[0-9]([^0-9]*)$", 1)
    return F.when(text.rlike("[0-9]"), F.concat(before, number.cast("string"), after)).otherwise(text)


def without_comment(text: Column) -> Column:
    """What stands before the first # that is not part of a float token such as 1.#INF, without outer blanks."""
    return F.trim(F.regexp_replace(text, r"(?<![0-9]\.)#.*$", ""))


def number(text: Column, strict: bool = False) -> Column:
    """The number a text stands for; without strict, null where it stands for none."""
    trimmed = F.trim(text)
    return trimmed.cast("double") if strict else trimmed.try_cast("double")
