"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import zlib

import pytest

from voxloom.llm import conversations as C

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def initials_ok(roles):
    roles = roles[1:] if roles.startswith("s") else roles
    return roles == "ua" * (len(roles) // 2)


def best_edits(turns):
    """Least (cost, audit, lines) over all edits of turns (role, text, fault), by growing every edit string in order."""
    level, best = [(0, "", 0, "", ())], None
    top = 4 * len(turns)  # deleting everything
    for _ in range(2 * len(turns) + 3):
        grown = []
        for cost, audit, i, roles, lines in level:
            if cost > top or best and cost > best[0]:
                continue
            if i == len(turns) and (not roles or initials_ok(roles) and roles != "s"):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
            if i < len(turns):
                role, text, fault = turns[i]
                grown.append((cost + 4, audit + "D", i + 1, roles, lines))
                if fault not in (C.BLANK, C.DUPLICATE):
                    more = 3 * (fault == C.TRUNCATED)
                    grown.append((cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                    grown += [(cost + more + 3, audit + "R", i + 1, roles + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            grown += [(cost + 3, audit + "I", i, roles + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        level = [x for x in grown if x[3] in ("", "s") or initials_ok(x[3] if len(x[3].lstrip("s")) % 2 == 0 else x[3] + "a")]
    return best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain(rows, solve):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in plain_damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, turns = set(), []
        for _, _, role, text in own:
            body = text.strip(" \t\n\v\f\r")
            turns.append((role, text, C.BLANK if not body else C.DUPLICATE if (role, text) in seen else C.TRUNCATED if body[-1] not in ".!?" else C.FINE))
            seen.add((role, text))
        numbers = [t for _, t, _, _ in own if t is not None]
        illegal = sum((a[2][:1], b[2][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in itertools.pairwise(own))
        cost, audit, lines = solve(turns)
        faults = [t[2] for t in turns]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def by_walk(turns):
    ((cost, audit),) = C.walk([(r[:1], f) for r, _, f in turns]).values()
    return cost, audit, list(C.edited([t[:2] for t in turns], audit))


def random_rows(rng, convs, most, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None)):
    texts = ["Yes.", "No", " ", "", None, "Why?", "é漢🙂!", "a\nb. ", "Yes.\t"]
    return [(c, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(texts)) for c in convs for t in range(rng.randint(0, most))]


def test_walk_equals_all_edits():
    rng = random.Random(1)
    for _ in range(300):
        turns = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(0, 4))]
        assert by_walk(turns) == (lambda b: (b[0], b[1], list(b[2])))(best_edits(turns)), turns


def test_segments_equal_one_walk():
    rng = random.Random(2)
    for _ in range(200):
        turns = [(rng.choice("suat"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 30))]
        size = rng.randint(1, 7)
        arcs = [[(p, q, *x) for p in (range(4) if a else (0,)) for q, x in C.walk(turns[a : a + size], p, whole=False).items()] for a in range(0, len(turns), size)]
        cost, path = C.joined(arcs)
        assert (cost, "".join(audit for _, audit in path)) == next(iter(C.walk(turns).values()))


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df):
    return sorted((tuple(r) for r in C.repair(df).select(*COLUMNS).collect()), key=str)


def test_repair_equals_plain_version(spark):
    rows = random_rows(random.Random(3), [None, *range(60)], 4)
    assert found(frame(spark, rows)) == plain(rows, best_edits)


def test_long_conversations_go_by_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 8)
    rng = random.Random(4)
    rows = random_rows(rng, [1, 2, 3], 150) + [(9, None, "user", "Same.")] * 40 + random_rows(rng, range(20, 40), 9)
    assert found(frame(spark, rows)) == plain(rows, by_walk)


def test_extra_columns_repeats_and_empty_tables(spark):
    rows = [(1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (2, 5, None, None)]
    df = frame(spark, rows).selectExpr("*", "1 AS place", "2 AS fault", "3 AS conv", "4 AS n")
    assert found(df) == plain(rows, best_edits)
    assert found(df.where("false")) == []


@pytest.mark.parametrize("roles", [("user", "assistant"), ("system", "user", "assistant", "sage")])
def test_repaired_roles_alternate(roles):
    rng = random.Random(5)
    for _ in range(100):
        turns = [(rng.choice(roles), f"{i}.", rng.choice([0, 0, 3])) for i in range(rng.randint(0, 12))]
        _, audit, lines = by_walk(turns)
        assert initials_ok("".join(x[0] for x in lines)) and sum(e != "I" for e in audit) == len(turns)
