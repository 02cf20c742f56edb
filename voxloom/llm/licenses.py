"""Licence scan by the ordered signature rules of license_rules.py, in DataFrame operations alone.

A text is lower-cased (A-Z only) and read as words; rules are regular expressions over the words joined by single blanks. Three gates keep
the cost of hundreds of rules low: texts without any trigger word are done at once, a rule is tried only where its keyword stands, and only
rules that match are searched for all their places. Overlapping detections are resolved in order: a detection that lies within one of higher
priority, or within a longer one of equal priority, is suppressed (equal places: the higher priority, then the first label, stays).

Everything is decided within a row, without a shuffle.

Defined cases: a null or empty text has no words, no label and score 0; equal texts have equal results; texts are read whole; an empty table
gives no rows; columns of the names added are replaced, others kept by scan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import text_of
from voxloom.llm.license_rules import TRIGGERS, rules

#: Phrases of the base labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Upper-case characters outside A-Z whose lower case holds an ASCII letter.
ODD_CASES = ("İ", "K")

PRIORITIES = 5


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but none of them becomes or stops being a character of a word."""
    odd = F.contains(text, F.lit(ODD_CASES[0])) | F.contains(text, F.lit(ODD_CASES[1]))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def rule_array() -> Column:
    """The rules as one literal; neither quotes nor backslashes stand in them."""
    own = (f"struct('{label}' AS label, {priority} AS priority, {score}D AS score, '{keyword}' AS keyword, '{pattern}' AS pattern)" for label, priority, score, keyword, pattern in rules())
    return F.expr(f"array({', '.join(own)})")


def detections(words: str) -> Column:
    """All places of the rules in column _rules, before suppression: array of (first word, end word, priority, label, score)."""
    matching = f"filter(_rules, r -> contains({words}, r.keyword) AND {words} rlike r.pattern)"
    count = "length({0}) - length(replace({0}, ' ', ''))".format
    # the blanks before a match are the words before it; a match begins with a blank of its own
    places = f"""flatten(transform({matching}, r -> aggregate(
        arrays_zip(split({words}, r.pattern), regexp_extract_all({words}, r.pattern, 0)),
        struct(cast(0 AS int) AS at, cast(array() AS array<struct<first:int,last:int,priority:int,label:string,score:double>>) AS out),
        (acc, x) -> if(x.`1` IS NULL, acc, struct(
            acc.at + {count("x.`0`")} + {count("x.`1`")} AS at,
            concat(acc.out, array(struct(acc.at + {count("x.`0`")} AS first, acc.at + {count("x.`0`")} + {count("x.`1`")} AS last, r.priority AS priority, r.label AS label, r.score AS score))) AS out)),
        acc -> acc.out)))"""
    return F.expr(places)


def kept(found: str) -> Column:
    """The detections that no other contains, by first word: one pass over them in order with the furthest end so far of each priority."""
    order = f"array_sort({found}, (a, b) -> CASE WHEN a.first <> b.first THEN a.first - b.first WHEN a.last <> b.last THEN b.last - a.last WHEN a.priority <> b.priority THEN b.priority - a.priority WHEN a.label < b.label THEN -1 WHEN a.label > b.label THEN 1 ELSE 0 END)"
    ends = ", ".join(f"cast(0 AS int) AS e{p}" for p in range(PRIORITIES))
    above = "greatest(" + ", ".join(f"if(x.priority <= {p}, acc.e{p}, 0)" for p in range(PRIORITIES)) + ")"
    moved = ", ".join(f"if(x.priority = {p}, greatest(acc.e{p}, x.last), acc.e{p}) AS e{p}" for p in range(PRIORITIES))
    return F.expr(f"""aggregate({order},
        struct({ends}, cast(array() AS array<struct<first:int,last:int,priority:int,label:string,score:double>>) AS out),
        (acc, x) -> struct({moved}, if({above} >= x.last, acc.out, concat(acc.out, array(x))) AS out),
        acc -> acc.out)""")


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and licenses: the detections kept (first word, end word, priority, label, score)."""
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses"]
    carried = [c for c in docs.columns if c not in added]
    rows = docs.select(*carried, F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text_of(docs)), GAP, " ")), F.lit(" ")).alias("_w"))
    words = F.col("_w")
    rows = rows.withColumn("n_words", F.when(words == "  ", 0).otherwise(blanks(words) - 1).cast("long"))
    any_base = " (?:" + "|".join(BASE) + ")(?= )"
    has_base = F.lit(False)
    for phrase in BASE:
        has_base = has_base | F.contains(words, F.lit(f" {phrase} "))
    gaps = F.when(has_base, F.split(words, any_base))
    last_hit = F.element_at(F.regexp_extract_all(words, F.lit(any_base), F.lit(0)), -1)
    labels = F.array_compact(F.array(*(F.when(F.contains(words, F.lit(f" {phrase} ")), F.lit(label)) for phrase, label in BASE.items())))
    rows = rows.withColumn("_gaps", gaps).withColumn("_base", F.when(has_base, labels).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumns({
        "n_base": F.when(has_base, F.size("_gaps") - 1).otherwise(0).cast("long"),
        "first_word": F.when(has_base, blanks(F.element_at("_gaps", 1))).cast("long"),
        "last_word": F.when(has_base, F.col("n_words") - (blanks(F.element_at("_gaps", -1)) - 1) - blanks(last_hit)).cast("long"),
    })
    triggered = F.lit(False)
    for x in TRIGGERS:
        triggered = triggered | F.contains(words, F.lit(x))
    nothing = F.expr("cast(array() AS array<struct<first:int,last:int,priority:int,label:string,score:double>>)")
    rows = rows.withColumn("_rules", F.when(triggered, rule_array())).withColumn("_found", F.when(F.col("_rules").isNotNull(), detections("_w"))).withColumn("licenses", F.when(F.size("_found") > 0, kept("_found")).otherwise(nothing))
    base_score = F.when(has_base, 0.5).otherwise(0.0)
    every = F.array_sort(F.array_union("_base", F.array_distinct(F.transform("licenses", lambda x: x["label"]))))
    return rows.select(
        *carried, "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("_base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(base_score, F.coalesce(F.array_max(F.transform("licenses", lambda x: x["score"])), F.lit(0.0))).alias("score"), "licenses",
    )
