"""Collocations against a plain count of everything, and against their SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from voxloom.llm import collocations as C
from voxloom.llm.queries import OP13_SQL

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least=10, longest=3, top=2000):
    f = defaultdict(Counter)
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * found[q] >= 50 * a for q in inside):
                continue
            score, _, l, r = min((1_000_000 * a * a // (n[p[:k]] * n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        total = sum(c for p, c in n.items() if len(p) == 1)
        out += [(lang, i, p.decode(), -a, l, r, total, -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def found(df, **more):
    return sorted(tuple(r) for r in C.collocations(df, **more).select(*COLUMNS).collect())


def random_rows(rng, n):
    words = ["The", "the", "of", "café", "Ä", "x\x00y", "new", "york", "city", "🙂", "no-one", "A"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", "?!", " "]
    return [(rng.choice(["en", "en", "de", None, ""]), rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(words[: rng.randint(2, 12)]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, text, lang, "s") for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string, phrase string")


def test_equals_plain_count_and_sql(spark, monkeypatch):
    rows = random_rows(random.Random(1), 400)
    df = frame(spark, rows)
    want = plain(rows)
    assert len(want) > 50 and found(df) == want
    with duckdb.connect() as db:
        documents = df.select("text", "lang").toPandas()  # noqa: F841
        assert sorted(db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({OP13_SQL})").fetchall()) == want
    monkeypatch.setattr(C, "PIECE", 50)  # texts in many overlapping pieces and blocks
    monkeypatch.setattr(C, "TOKENS", 30)
    monkeypatch.setattr(C, "BITMAP_BITS", 64)
    assert found(df) == want


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths_and_limits(spark, longest):
    rows = random_rows(random.Random(2), 60)
    assert found(frame(spark, rows), least=3, longest=longest, top=25) == plain(rows, 3, longest, 25)


def test_blocks_of_a_text_count_each_phrase_once(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab. \t") for _ in range(3000)).encode()
    every = C.Bitmap.__new__(C.Bitmap)
    every.holds = lambda h: h == h

    def counts(pieces, k):
        block = C.Block()
        for tokens in pieces:
            block.add(tokens)
        out = Counter()
        for phrases, n in C.count_phrases("", block, k, [every] * 3):
            for p, x in zip(phrases.to_pylist(), n.tolist(), strict=True):
                out[p] += x
        return out

    monkeypatch.setattr(C, "PIECE", 40)
    for k in (1, 2, 3, 4):
        assert counts(C.pieces_of(text, k), k) == counts([C.tokens_of(text)], k) != {}
    words = [str(i).encode() for i in range(50_000)] * 2  # four numbers of so many words pass 64 bits
    got = counts([words], 4)
    assert len(got) == 50_000 and got[b"0 1 2 3"] == 2 and got[b"49999 0 1 2"] == 1 and sum(got.values()) == 99_997


def test_bitmap_holds_every_phrase(spark):
    level = spark.createDataFrame([("en", f"w{i} x", 1) for i in range(3000)], C.LEVEL)
    own, other = (C.phrase_hashes(lang, [f"w{i} x".encode() for i in range(3000)]) for lang in ("en", "de"))
    for bits in (64, 1 << 20):
        held = C.bitmap(level, bits)
        assert held.size <= bits and held.holds(own).all()
    assert held.holds(other).mean() < 0.1


def test_odd_rows_and_empty_tables(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.select("lang", "text").collect()]
    assert found(odd) == plain(rows)
    assert found(none) == []
