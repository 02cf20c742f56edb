import random
import re
from itertools import product
from re import _parser

from tests.llm.conftest import prose
from voxloom.llm import licenses, queries

SAMPLES = """Licensed under the Apache License, Version 2.0.|This work is licensed under the GNU General Public License, version 3.|Released under the MIT License.|SPDX-License-Identifier: MPL-2.0
https://creativecommons.org/licenses/by-sa/4.0/|All rights reserved.|CC BY 4.0|Copyright (c) 2019 Some One|GNU Lesser General Public License v2.1|BSD 3-Clause|the Unlicense|released into the public domain|Boost Software License 1.0
Permission is hereby granted, free of charge, to any person obtaining a copy|you can redistribute it and/or modify it under the terms of the GNU General Public License|attribution share-alike|Affero General Public License|X11 license|gplv3|beerware license|CC0 1.0|proprietary and confidential
Internet Systems Consortium license|cc by cc by|www.apache.org/licenses/LICENSE-2.0|zlib/libpng license|Mozilla Public License|licensed under|general public license|Released under the Expat License.|Do not copy without written permission.|without prior consent
Creative Commons Attribution-NonCommercial-ShareAlike 4.0|This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License|Attribution-NoDerivatives|the free software foundation""".replace("\n", "|").split("|")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def brute(text):
    """(n_words, n_base, first, last, base labels, labels, score) by trying every rule at every place and every pair of detections."""
    words = words_of(text)
    norm = f" {' '.join(words)} "
    base = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found = []
    for label, priority, score, _, pattern in licenses.rules():
        for m in re.finditer(pattern, norm):
            found.append((norm[: m.start()].count(" "), norm[: m.end()].count(" "), priority, label, score))
    kept = []
    for x in set(found):
        over = [y for y in set(found) if y[0] <= x[0] and y[1] >= x[1] and y[2] >= x[2] and y != x]
        if not any(y[:2] != x[:2] or y[2] > x[2] or (y[2] == x[2] and y[3] < x[3]) for y in over):
            kept.append(x)
    labels = {x[3] for x in kept} | {x for _, x in base}
    score = max([x[4] for x in kept] + [0.5 if base else 0.0])
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)


def expanded(parsed):
    """Texts that a parsed expression matches: all alternatives, up to two rounds of a repetition, one character of a class."""
    parts = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            parts.append([chr(value)])
        elif name == "IN":
            first, own = value[0]
            parts.append([chr(own if str(first) == "LITERAL" else own[0])])
        elif name == "BRANCH":
            parts.append([x for branch in value[1] for x in expanded(branch)])
        elif name == "SUBPATTERN":
            parts.append(expanded(value[-1]))
        elif name == "MAX_REPEAT":
            low, high, inner = value
            own = expanded(inner)
            parts.append(["".join(x) for n in range(low, min(int(high), max(low, 2)) + 1) for x in product(own, repeat=n)])
        elif name == "ASSERT":
            parts.append([""])
        else:
            raise AssertionError(name)
    return ["".join(x) for x in product(*parts)]


def test_every_alternative_of_a_rule_holds_its_keyword_and_a_trigger():
    rules = licenses.rules()
    assert len({pattern for *_, pattern in rules if "spdx" not in pattern}) >= 250
    for _, priority, score, keyword, pattern in rules:
        texts = expanded(_parser.parse(pattern))
        assert 0 <= priority < licenses.PRIORITIES and 0 < score <= 1
        for text in texts:
            assert keyword in text, (keyword, text)
            assert any(x in f"{text} " for x in licenses.TRIGGERS), text


def test_labels_of_alternatives_that_a_gate_could_lose(spark):
    want = {
        "Released under the Expat License.": "expat",
        "Do not copy without written permission.": "proprietary",
        "not without the express prior written consent": "proprietary",
        "Creative Commons Attribution-NonCommercial-ShareAlike": "cc-by-nc-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa-4.0",
    }
    rows = licenses.scan(spark.createDataFrame([(i, x) for i, x in enumerate(want)], "doc_id long, text string")).orderBy("doc_id").collect()
    for x, label in zip(rows, want.values(), strict=True):
        assert label in x.labels.split(",") and x.score >= 0.6


def row(x):
    return (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["", " ", "licensed", *SAMPLES]
    for _ in range(400):
        parts = [rng.choice(SAMPLES) if rng.random() < 0.5 else prose(rng, rng.randint(0, 6)) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", ", ", ""]).join(parts))
    texts += [f"{a}İK {b}" for a, b in zip(SAMPLES, SAMPLES[1:], strict=False)]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)).collect()
    assert len(rows) == len(texts) and len(licenses.rules()) > 300
    for x in rows:
        assert row(x) == brute(texts[x.doc_id]), texts[x.doc_id]
    assert len({y for x in rows for y in x.labels.split(",")}) > 25


def test_query_against_brute_force_and_base_sql(spark, sf_dir):
    texts = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_license_rules(spark, sf_dir).collect()
    assert sorted(x.doc_id for x in rows) == sorted(texts)
    for x in rows:
        assert row(x) == brute(texts[x.doc_id])


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op2_license_rules(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd, none):
    rows = licenses.scan(odd).collect()
    assert len(rows) == 9 and set(odd.columns) <= set(rows[0].asDict())
    by = {x.doc_id: x for x in rows}
    assert row(by[1]) == row(by[2]) == (0, 0, None, None, "", "", 0.0) and by[5].n_words == 60_000 and by[6].n_words == 1
    assert row(by[3]) == row(by[4]) and by[3].base_labels == "reserved" and by[3].first_word == by[3].last_word == 5
    assert licenses.scan(none).count() == 0
