import hashlib
import random
import re
import zlib

import pytest

from graphloom.llm import conversation_repair
from graphloom.llm.conversation_repair import AFTER, BY_ROLE, WANTED, repair, repaired_conversations

GRAMMAR = re.compile(r"(s?(ua)+)?")


def kind(initial, fault):
    return 8 if fault in (1, 2) else "sua".find(initial) % 4 + (4 if fault == 3 else 0)


def brute_repair(rows):
    """Cheapest edits of (initial, fault) by trying all; the audit of the least cost, then in ASCII order."""
    best = (10**9, "")

    def go(i, made, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if GRAMMAR.fullmatch(made):
                best = min(best, (cost, audit))
        else:
            initial, fault = rows[i]
            go(i + 1, made, cost + 4, audit + "D", 0)
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                go(i + 1, made + (initial or "?"), cost + extra, audit + "K", 0)
                for role in "ua":
                    go(i + 1, made + role, cost + 3 + extra, audit + "R", 0)
        if inserts < 2:
            for role in "ua":
                go(i, made + role, cost + 3, audit + "I", inserts + 1)

    go(0, "", 0, "", 0)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_repair_is_the_cheapest_and_least(seed):
    rng = random.Random(seed)
    for _ in range(120):
        rows = [(rng.choice("suaax"), rng.choice((0, 0, 0, 3, 1, 2))) for _ in range(rng.randrange(0, 6))]
        assert repair([kind(*r) for r in rows]) == brute_repair(rows), rows


def plain(rows):
    """Cost, audit and repaired rows of (role, text, fault), by the letter of least order that stays on a cheapest way."""
    n = len(rows)

    def ways(i, q):
        out = [("I", i, AFTER[q], 3)]
        if i < n:
            role, _, fault = rows[i]
            out.append(("D", i + 1, q, 4))
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                out.append(("R", i + 1, AFTER[q], 3 + extra))
                if q in BY_ROLE.get(role[:1], {}):
                    out.append(("K", i + 1, BY_ROLE[role[:1]][q], extra))
        return out

    least = [[10**9] * 4 for _ in range(n + 1)]
    least[n] = [0, 6, 3, 0]
    for i in reversed(range(n)):
        for _ in range(3):
            for q in range(4):
                least[i][q] = min([least[i][q], *[p + least[j][e] for _, j, e, p in ways(i, q)]])
    i = q = 0
    audit, lines = "", []
    while not (i == n and least[n][q] == 0):
        letter, j, e, _ = min(w for w in ways(i, q) if w[3] + least[w[1]][w[2]] == least[i][q])
        if letter in "KR":
            lines.append(f"{rows[i][0] if letter == 'K' else WANTED[q]}:{rows[i][1]}")
        elif letter == "I":
            lines.append(f"{WANTED[q]}:")
        audit, i, q = audit + letter, j, e
    return least[0][0], audit, lines


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            damage = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if damage:
                text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
                rows += [(turn, "user" if damage == 4 else role, text)] * (2 if damage == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\v\f\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, audit, lines = plain([(role, text, f) for (_, role, text), f in zip(rows, faults)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, block string, AT int, loose string"


def frame(spark, table):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in table], SCHEMA).repartition(3)


def found(conversations):
    rows = repaired_conversations(conversations).collect()
    out = {r.conv_id: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "no end", "", " \n", None, "ends in space. ", "\x1c", "Ünïcode。", "a\nb.", "x" * 3000 + "."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    table = []
    for conv in [*range(n), None]:
        for turn in range(rng.randrange(1, 12)):
            table.append((conv, rng.choice((turn, turn, turn + 1, None, -turn)), rng.choice(roles[: rng.choice((3, 5, 8))]), rng.choice(texts)))
    return table + table[:5]


@pytest.mark.parametrize("bits", [8, 1])
def test_conversations_are_those_of_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversation_repair, "BLOCK_BITS", bits)  # blocks of two rows compose to the same
    table = made(bits, 60)
    assert found(frame(spark, table)) == brute(table)


def test_a_long_conversation_and_one_that_vanishes(spark):
    rng = random.Random(2)
    table = [(7, t, rng.choice(("user", "assistant", "system")), rng.choice(("One.", "Two", f"n{t}!", f"w{t}"))) for t in range(5000)]
    gone = next(c for c in range(100, 200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table += [(gone, 0, "user", "Alone.")]
    got = found(frame(spark, table))
    assert got == brute(table)
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}
