"""Repair of damaged conversations with the fewest edits, by divide and conquer over cost vectors.

A repaired conversation is an optional system turn and then pairs of a user and an assistant turn. That is an automaton of four
states: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn; 0 and 3 may end. The edits of a
row are Keep (0), Rerole to the role that the state wants (3) and Delete (4, the only one for blank and repeated
rows); an empty turn of the wanted role may be Inserted (3) anywhere; a truncated row that stays costs 3 more. The audit is
the initials of the edits in order, and of the cheapest ones the least in ASCII is taken.

**Crossings.** A path is cut after the edit of a row, so inserts belong to the row that follows. Audits up to such a cut have
one letter other than I for every row and end in one, so none is the beginning of another: of two ways into a state,
or two states, the one with the lesser audit stays the lesser whatever follows. Four costs and four ranks, the order of the
least audits of the states, therefore say all about the rows before a cut, and four costs all about those after it. The
cut in the middle is crossed in the state of the least rank among those of the least sum; both halves are then solved
alike. A row has nine kinds; ``STEP`` holds the cheapest inserts and edit from a state to a state for each.

**Any length.** Rows get numbers in the order of conversation and turn, by a range sort of the table. Rows of a conversation whose
numbers agree but for the last eight bits are a block. A block is summed up in a table of costs and ranks from each state to
each, which can be composed like a row's step; the same divide and conquer runs over a conversation's blocks, gives the states in
which each begins and ends, and then inside every block. Only one block's texts are held at a time, and a
conversation's audit and hash are put together from its blocks in order.

Nulls are read as one space, but order and gaps see a null turn as null; turns that agree are ordered by role and text. Rows without
a conv_id are one conversation. Roles count by their first letter. Other columns than the four are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.groups import runs_of_rows
from graphloom.llm.tables import cut, forget, in_arrow, partitions

STATES = 4
NEVER = 1 << 40
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
WANTED = ("user", "user", "assistant", "user")  # the role that an edit gives in each state
AFTER = (2, 2, 3, 2)  # the state that it leads to
BY_ROLE = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
KINDS = ("s", "u", "a", "")  # of rows that may stay; + 4 where truncated; 8 is to go
MUST_GO = 8
BLOCK_BITS = 8


class Step(NamedTuple):
    """What leads from each state to each: the cost, the audit's order among those from one state, and the audit."""

    cost: tuple[tuple[int, ...], ...]
    order: tuple[tuple[int, ...], ...]
    audit: tuple[tuple[str | None, ...], ...]


def _row_step(kind: int) -> Step:
    best: list[list[tuple[int, str] | None]] = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        state, paid, letters = start, 0, ""
        for _ in range(STATES):  # more inserts only go round
            ways = [("D", state, DELETE)]
            if kind != MUST_GO:
                extra = CUT_OFF if kind >= 4 else 0
                ways.append(("R", AFTER[state], REROLE + extra))
                if state in BY_ROLE.get(KINDS[kind % 4], {}):
                    ways.append(("K", BY_ROLE[KINDS[kind % 4]][state], KEEP + extra))
            for letter, end, price in ways:
                found = (paid + price, letters + letter)
                if best[start][end] is None or found < best[start][end]:
                    best[start][end] = found
            state, paid, letters = AFTER[state], paid + INSERT, letters + "I"
    audits = [sorted(x[1] for x in row if x is not None) for row in best]
    return Step(
        tuple(tuple(NEVER if x is None else x[0] for x in row) for row in best),
        tuple(tuple(STATES if x is None else line.index(x[1]) for x in row) for row, line in zip(best, audits)),
        tuple(tuple(None if x is None else x[1] for x in row) for row in best),
    )


STEP = [_row_step(kind) for kind in range(9)]
#: the cheapest inserts to an end, of each state
CLOSE = ("", "II", "I", "")
END_COST = [INSERT * len(c) for c in CLOSE]


def forward(steps: Sequence[Step], cost: list[int], rank: list[int]) -> tuple[list[int], list[int]]:
    """Costs and ranks of the four states after the steps; costs of ``NEVER`` and more cannot be reached."""
    for step in steps:
        found = []
        for end in range(STATES):
            found.append(min([(cost[q] + step.cost[q][end], rank[q], step.order[q][end]) for q in range(STATES)]))
        line = sorted({way[1:] for way in found if way[0] < NEVER})
        cost = [min(way[0], NEVER) for way in found]
        rank = [line.index(way[1:]) if way[0] < NEVER else STATES for way in found]
    return cost, rank


def backward(steps: Sequence[Step], cost: list[int]) -> list[int]:
    """Costs to the end from the four states before the steps, given those after them."""
    for step in reversed(steps):
        cost = [min(NEVER, *[way + after for way, after in zip(ways, cost)]) for ways in step.cost]
    return cost


def _only(state: int) -> list[int]:
    return [0 if q == state else NEVER for q in range(STATES)]


def _cross(before: tuple[list[int], list[int]], after: list[int]) -> int:
    sums = [(b + a, r) for b, r, a in zip(*before, after)]
    return sums.index(min(sums))


def crossings(steps: Sequence[Step], start: int, end: int) -> list[int]:
    """The states before, between and after the steps on the cheapest way, of the least audit, from ``start`` to ``end``."""
    out = [start] + [end] * len(steps)
    todo = [(0, len(steps), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo < 2:
            continue
        mid = (lo + hi) // 2
        out[mid] = _cross(forward(steps[lo:mid], _only(a), [0] * STATES), backward(steps[mid:hi], _only(b)))
        todo += [(lo, mid, a, out[mid]), (mid, hi, out[mid], b)]
    return out


def best_end(steps: Sequence[Step]) -> tuple[int, int]:
    """The state after all steps, from state 0, and the whole cost with the inserts that close the conversation."""
    before = forward(steps, _only(0), [0] * STATES)
    end = _cross(before, END_COST)
    return end, before[0][end] + END_COST[end]


@lru_cache(1 << 12)  # short conversations have few patterns
def composed(kinds: tuple[int, ...]) -> Step:
    """One step for the rows of these kinds, without its audits."""
    rows = [forward([STEP[k] for k in kinds], _only(q), [0] * STATES) for q in range(STATES)]
    return Step(tuple(tuple(cost) for cost, _ in rows), tuple(tuple(rank) for _, rank in rows), ())


@lru_cache(1 << 12)
def edits(kinds: tuple[int, ...], start: int, end: int) -> list[str]:
    """The letters of each row of these kinds, on the best way between two states."""
    steps = [STEP[k] for k in kinds]
    at = crossings(steps, start, end)
    return [s.audit[a][b] for s, a, b in zip(steps, at, at[1:])]


def repair(kinds: Sequence[int]) -> tuple[int, str]:
    """Cost and audit of one conversation whose rows have these kinds."""
    end, cost = best_end([STEP[k] for k in kinds])
    return cost, "".join(edits(tuple(kinds), 0, end)) + CLOSE[end]


# ---- tables

#: a conversation; rows without a conv_id are loose, and have 0
KEY = ["loose", "conv_id"]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by the hash of their key; nulls of role and text are one space."""
    conv, turn = (F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    text, role = (F.coalesce(c, F.lit(" ")) for c in ("text", "role"))
    rows = conversations.select(
        *_key(), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        (F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20).alias("damage"),
    ).where("damage != 0")
    changed = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1)))
    return rows.select(*KEY, "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), copies.alias("copy"))


def _key() -> list:
    conv = F.col("conv_id").cast("long")
    return [conv.isNull().alias("loose"), F.coalesce(conv, F.lit(0)).alias("conv_id")]


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, a number that rises with conversation, turn, role and text. Equal rows may part between tasks."""
    keys = [*KEY, "turn", "role", "text"]
    tied = rows.select(*keys, F.monotonically_increasing_id().alias("tie"))
    dealt = tied.repartitionByRange(partitions(rows.sparkSession), *keys, "tie").sortWithinPartitions(*keys, "tie")
    return cut(dealt.select(*keys, F.monotonically_increasing_id().alias("at")), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """Numbered rows with the first fault of each: 1 blank, 2 repeated, 3 truncated, or 0."""
    marked = rows.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # the one row of each role and text of a conversation that comes first, so that no key's rows meet in a task
    firsts = marked.where("not blank").groupBy(*KEY, "role", "text").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    closed = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(~closed, 3).otherwise(0)
    return marked.join(firsts, "at", "left").select(*KEY, "turn", "role", "text", "at", fault.alias("fault"))


def _kinds(part: pa.Table) -> tuple[tuple[int, ...], list[str]]:
    initials = [r[:1] for r in part["role"].to_pylist()]
    faults = part["fault"].to_pylist()
    kinds = [MUST_GO if f in (1, 2) else (KINDS.index(i) if i in KINDS else 3) + (4 if f == 3 else 0) for i, f in zip(initials, faults)]
    return tuple(kinds), initials


ADJACENT = ("su", "ua", "au")
BLOCK = "loose boolean, conv_id long, block long"
SUMMARY = f"{BLOCK}, cost array<long>, rank array<long>, first string, last string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long"
PLAN = f"{BLOCK}, start long, end long, is_last boolean, cost long, illegal long, gaps long"
PIECE = f"{BLOCK}, audit string, repaired binary"
WHOLE = "loose boolean, conv_id long, audit string, repaired_sha256 string"
ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
HELD = 1 << 20  # bytes of texts in a batch that leaves a task


def _batches(rows: Iterator[dict], described: str) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in described.split(", "))])
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row.get("repaired", b""))
        if len(out) >= 1000 or held > HELD:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _named(part: pa.Table) -> dict:
    return {k: part[k][0].as_py() for k in (*KEY, "block")}


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in runs_of_rows(batches, [*KEY, "block"]):
        kinds, initials = _kinds(part)
        whole, faults = composed(kinds), part["fault"].to_pylist()
        turns = sorted({t for t in part["turn"].to_pylist() if t is not None})
        yield _named(part) | {
            "cost": sum(whole.cost, ()), "rank": sum(whole.order, ()),
            "first": initials[0], "last": initials[-1], "illegal": sum(a + b not in ADJACENT for a, b in zip(initials, initials[1:])),
            "blank": faults.count(1), "duplicate": faults.count(2), "truncated": faults.count(3),
            "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(turns),
        }


def _square(flat: list[int]) -> tuple[tuple[int, ...], ...]:
    return tuple(tuple(flat[q : q + STATES]) for q in range(0, STATES * STATES, STATES))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The states in which each block of a conversation begins and ends; its last block has the conversation's figures."""
    for part in runs_of_rows(batches, KEY):
        rows = part.to_pylist()
        steps = [Step(_square(r["cost"]), _square(r["rank"]), ()) for r in rows]
        end, cost = best_end(steps)
        at = crossings(steps, 0, end)
        illegal = sum(r["illegal"] for r in rows) + sum(a["last"] + b["first"] not in ADJACENT for a, b in zip(rows, rows[1:]))
        known = [r for r in rows if r["turns"]]
        distinct = sum(r["turns"] for r in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        for r, a, b in zip(rows, at, at[1:]):
            yield {k: r[k] for k in (*KEY, "block")} | {"start": a, "end": b, "is_last": r is rows[-1], "cost": cost, "illegal": illegal, "gaps": gaps}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The audit and the repaired rows of each block, a line feed after every row."""
    for part in runs_of_rows(batches, [*KEY, "block"]):
        start, end, is_last = (part[c][0].as_py() for c in ("start", "end", "is_last"))
        audit, lines, state = [], [], start
        for letters, role, text in zip(edits(_kinds(part)[0], start, end), part["role"].to_pylist(), part["text"].to_pylist()):
            for letter in letters:
                if letter == "I":
                    lines.append(f"{WANTED[state]}:")
                elif letter != "D":
                    lines.append(f"{WANTED[state] if letter == 'R' else role}:{text}")
                state = state if letter == "D" else BY_ROLE[role[:1]][state] if letter == "K" else AFTER[state]
            audit.append(letters)
        if is_last:
            audit.append(CLOSE[end])
            for _ in CLOSE[end]:
                lines.append(f"{WANTED[state]}:")
                state = AFTER[state]
        yield _named(part) | {"audit": "".join(audit), "repaired": "".join(f"{x}\n" for x in lines).encode()}


def _wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Audit and hash of each conversation from its pieces in order; texts are hashed as they come."""
    key, audit, digest, fed = None, [], hashlib.sha256(), False

    def whole() -> dict:
        return dict(zip(KEY, key)) | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    for batch in batches:
        for row in batch.to_pylist():
            if key != (row["loose"], row["conv_id"]):
                if key:
                    yield whole()
                key, audit, digest, fed = (row["loose"], row["conv_id"]), [], hashlib.sha256(), False
            audit.append(row["audit"])
            if row["repaired"]:
                digest.update((b"\n" if fed else b"") + row["repaired"][:-1])
                fed = True
    if key:
        yield whole()


def _in_arrow(df: DataFrame, rows, described: str) -> DataFrame:
    return in_arrow(df, lambda batches: _batches(rows(batches), described), described)


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation.

    A conversation without rows after damage has zeros, an empty audit and the hash of nothing.
    """
    tasks = partitions(conversations.sparkSession)
    turns = numbered(damaged(conversations))
    rows = cut(with_faults(turns).withColumn("block", F.shiftright("at", BLOCK_BITS)), "faults")
    forget(turns)
    block, place = [*KEY, "block"], [*KEY, "block", "at"]
    letters = rows.select(*place, "turn", F.substring("role", 1, 1).alias("role"), "fault")
    summaries = cut(_in_arrow(letters.repartition(tasks, *block).sortWithinPartitions(*place), _summaries, SUMMARY), "summaries")
    plans = cut(_in_arrow(summaries.repartition(tasks, *KEY).sortWithinPartitions(*block), _plans, PLAN), "plans")

    planned = rows.drop("turn").join(plans.select(*block, "start", "end", "is_last"), block)
    pieces = _in_arrow(planned.repartition(tasks, *block).sortWithinPartitions(*place), _pieces, PIECE)
    wholes = cut(_in_arrow(pieces.repartition(tasks, *KEY).sortWithinPartitions(*block), _wholes, WHOLE), "repaired")
    forget(rows)

    sums = summaries.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    figures = plans.where("is_last").select(*KEY, "cost", "illegal", "gaps")
    every = conversations.select(*_key()).distinct()
    out = every.join(sums, KEY, "left").join(figures, KEY, "left").join(wholes, KEY, "left")
    return out.select(
        F.when(~F.col("loose"), F.col("conv_id")).alias("conv_id"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
