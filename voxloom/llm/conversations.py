"""Repair of conversations: the cheapest edits that turn a conversation's turns into an optional system turn and pairs of user and assistant.

The edits of a conversation form a lattice of nodes (turn index, state of the grammar of roles), never built as a whole. Dijkstra's
algorithm walks it by the key (cost, audit), where the audit is the initials of the edits so far, and stops at the first end node popped
whose state accepts. The key never falls along an edge; and of two audits of one cost at one node neither begins with the other (the
longer would have an insertion more), so what follows keeps their order and the first visit of a node is its best.

Edits: Keep (K) costs 0, Rerole to user or assistant (R) 3, Delete (D) 4, Insert of an empty user or assistant turn (I) 3; a truncated turn
that stays adds 3. Blank and repeated turns must go. In each state one of user and assistant can come next, so an edit's initial says all.

A conversation of up to SEGMENT turns is one walk. A longer one is cut into segments of so many turns, each walked from every state to
every state by a task of its own; the segments' best walks are then joined in order, by the same key. Only that joining, and the digest of
the repaired text, which hashes text after text, go through a conversation in one place: they stream it, and hold four bytes a turn.

Defined cases: a null role or text is one space, and so is a null id or turn where the damage is drawn; rows with a null conv_id are one
conversation; turns are taken by number, nulls first, and those of equal numbers by role, then text; a role's initial is its first
character as it stands, and roles of other initials than s, u and a (an empty role too) can't be kept; a conversation without rows has no
faults, no edits and the digest of the empty text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import arrow, looked_up, written
from voxloom.operators.ordering import numbered

#: Turns that one walk takes.
SEGMENT = 512
#: Faults of a turn, and the characters that are no content.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACES = "\\x20\\x09-\\x0D"
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3
#: States: nothing yet, after the system turn, after a user's, after an assistant's; which initials lead where; what the edits may make.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = ("u", "u", "a", "u")
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

Best = dict[int, tuple[int, str]]


def walk(turns: Sequence[tuple[str, int]], state: int = 0, whole: bool = True) -> Best:
    """Cost and audit of the best edits of turns (initial of the role, fault) from a state to each end state; if whole, to the best accepting one alone."""
    heap, seen, ends = [(0, "", 0, state)], set(), {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        made = NEXT[q][MADE[q]]
        if i == len(turns):
            if not whole or q in ACCEPTING:
                ends[q] = (cost, audit)
            if len(ends) == (1 if whole else 4):
                break
        else:
            initial, fault = turns[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, q))
            if fault not in (BLANK, DUPLICATE):
                more = CUT_SHORT if fault == TRUNCATED else 0
                if initial in NEXT[q]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, NEXT[q][initial]))
                heapq.heappush(heap, (cost + more + REROLE, audit + "R", i + 1, made))
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, made))
    return ends


def joined(segments: Sequence[Sequence[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost through consecutive segments, each given by its walks (from, to, cost, audit), and each segment's first state and audit on the way.

    Of audits of states that are still open only what differs is kept for comparison.
    """
    best: Best = {0: (0, "")}
    came: list[dict[int, tuple[int, str]]] = []
    for arcs in segments:
        found: dict[int, tuple[int, str, int, str]] = {}
        for p, q, cost, audit in arcs:
            if p in best:
                one = (best[p][0] + cost, best[p][1] + audit, p, audit)
                found[q] = min(found.get(q, one), one)
        came.append({q: (p, audit) for q, (_, _, p, audit) in found.items()})
        same = len(commonprefix([audit for _, audit, _, _ in found.values()]))
        best = {q: (cost, audit[same:]) for q, (cost, audit, _, _) in found.items()}
    cost, _, q = min((*best[q], q) for q in ACCEPTING if q in best)
    path = []
    for own in reversed(came):
        q, audit = own[q]
        path.append((q, audit))
    return cost, path[::-1]


def edited(turns: Sequence[tuple[str, str]], audit: str, state: int = 0) -> Iterator[str]:
    """`role:text` of each turn that the audit leaves of turns (role, text)."""
    i = 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = turns[i] if edit != "I" else ("", "")
        state = NEXT[state][role[:1] if edit == "K" else MADE[state]]
        yield f"{role if edit == 'K' else ROLES['a' if state == 3 else 'u']}:{text}"
        i += edit != "I"


def spelled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, conv (its key, never null), turn, role, text of the rows after damage."""
    code = F.crc32(F.concat_ws(":", spelled(F.col("conv_id")), spelled(F.col("turn"))).cast("binary")) % 20
    text = spelled(F.col("text"))
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(code == 4, "user").otherwise(spelled(F.col("role")))
    copies = F.when(code == 0, F.expr("cast(array() as array<int>)")).when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", key_of(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def key_of(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text of rows with place (in the order of conversations and turns, from 1), segment, of (turns of the conversation), fault and illegal (whether the initials of the turn before and this one may not meet)."""
    marked = written(rows.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("_row")), "turns")  # numbered as written, so that equal rows are told apart for good
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    placed = written(numbered(marked, order, "place").withColumn("digest", F.sha2(F.concat_ws("\0", F.length("role"), "role", "text"), 256)), "placed")
    spans = written(placed.groupBy("conv").agg(F.count("*").alias("n"), F.count("*").alias("of"), F.min("place").alias("first")), "conversations")
    seen = written(placed.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min("place").alias("earliest")), "seen")
    own = looked_up(looked_up(placed.select("conv", "turn", "role", "text", "place", "digest"), seen, ["conv", "digest"]), spans, ["conv"])
    before = placed.select((F.col("place") + 1).alias("place"), F.col("conv").alias("_conv"), F.substring("role", 1, 1).alias("_initial"))
    own = own.join(before, "place", "left")
    legal = F.concat_ws("-", "_initial", F.substring("role", 1, 1)).isin("s-u", "u-a", "a-u")
    last = F.regexp_extract("text", f"([^{SPACES}])[{SPACES}]*\\z", 1)
    fault = F.when(last == "", BLANK).when(F.col("place") > F.col("earliest"), DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    return own.select(
        "conv", "turn", "role", "text", "place", "of",
        F.expr(f"(place - first) div {SEGMENT}").alias("segment"),
        fault.alias("fault"),
        (F.coalesce(F.col("_conv") == F.col("conv"), F.lit(False)) & ~F.coalesce(legal, F.lit(False))).alias("illegal"),
    )


def batches_to_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows of sorted batches by their first keys columns."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[:keys])


def repaired(rows: DataFrame) -> DataFrame:
    """conv, cost, audit, repaired_sha256 of every conversation of faults()."""
    plan = "conv string, segment long, of long, start int, end int, cost long, audit string, sha string"
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in plan.split(", ")]

    def plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, segment, of), group in batches_to_groups(batches, 3):
            own = [(role, text, fault) for *_, role, text, fault in group]
            turns = [(role[:1], fault) for role, _, fault in own]
            if of <= SEGMENT:
                ((end, (cost, audit)),) = walk(turns).items()
                sha = hashlib.sha256("\n".join(edited([x[:2] for x in own], audit)).encode("utf-8", "surrogatepass")).hexdigest()
                out.append((conv, segment, of, 0, end, cost, audit, sha))
            else:
                out += [(conv, segment, of, p, q, cost, audit, None) for p in (range(4) if segment else (0,)) for q, (cost, audit) in walk(turns, p, whole=False).items()]
            if len(out) >= 1000:
                yield arrow(out, kinds, names)
                out = []
        yield arrow(out, kinds, names)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), group in batches_to_groups(batches, 1):
            arcs = ([row[2:] for row in own] for _, own in groupby(group, key=lambda row: row[1]))
            cost, path = joined(arcs)
            for a in range(0, len(path), 1000):
                yield arrow([(conv, a + k, cost, state, audit) for k, (state, audit) in enumerate(path[a : a + 1000])], [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()], ["conv", "segment", "cost", "start", "audit"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, segment, cost, state, audit), group in batches_to_groups(batches, 5):
            lines = list(edited([(role, text) for *_, role, text in group], audit, state))
            yield arrow([(conv, segment, cost, audit, "\n".join(lines) if lines else None)], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()], ["conv", "segment", "cost", "audit", "lines"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, cost), group in batches_to_groups(batches, 2):
            sha, audits, begun = hashlib.sha256(), [], False
            for _, _, _, audit, lines in group:
                audits.append(audit)
                if lines is not None:
                    sha.update(("\n" * begun + lines).encode("utf-8", "surrogatepass"))
                    begun = True
            yield arrow([(conv, cost, "".join(audits), sha.hexdigest())], [pa.string(), pa.int64(), pa.string(), pa.string()], ["conv", "cost", "audit", "sha"])

    own = rows.select("conv", "segment", "of", "place", "role", "text", "fault").repartition("conv", "segment").sortWithinPartitions("conv", "segment", "place")
    found = written(own.select("conv", "segment", "of", "role", "text", "fault").mapInArrow(plans, plan), "plans")
    short = found.where(F.col("sha").isNotNull()).select("conv", "cost", "audit", F.col("sha").alias("repaired_sha256"))
    arcs = found.where(F.col("sha").isNull()).select("conv", "segment", "start", "end", "cost", "audit")
    chosen = arcs.repartition("conv").sortWithinPartitions("conv", "segment").mapInArrow(paths, "conv string, segment long, cost long, start int, audit string")
    cut = rows.where(F.col("of") > SEGMENT).join(written(chosen, "paths"), ["conv", "segment"])
    lines = cut.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "place").select("conv", "segment", "cost", "start", "audit", "role", "text")
    lines = lines.mapInArrow(texts, "conv string, segment long, cost long, audit string, lines string").repartition("conv").sortWithinPartitions("conv", "segment")
    long = lines.select("conv", "cost", "segment", "audit", "lines").mapInArrow(lambda b: digests(b), "conv string, cost long, audit string, sha string")
    return short.union(long)


def repair(conversations: DataFrame) -> DataFrame:
    """A row per conv_id of conversations: what is wrong with its turns after damage (gaps, blank, duplicate, truncated, illegal), and the cheapest repair (cost, audit, repaired_sha256)."""
    rows = written(faults(damaged(conversations)), "faults")
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    sums = rows.groupBy("conv").agg(gaps.alias("gaps"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(TRUNCATED).alias("truncated"), F.sum(F.col("illegal").cast("long")).alias("illegal"))
    everyone = conversations.select("conv_id", key_of(F.col("conv_id")).alias("conv")).distinct()
    out = everyone.join(sums.join(repaired(rows), "conv"), "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
