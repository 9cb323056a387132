"""Repair of conversations against a plain relaxation of all edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stackscan.llm import queries, turn_repair
from stackscan.llm.common import table
from tests.llm.tables import SF

TURNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def slow_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def slow_faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACES)
        found.append("b" if not end else "d" if (role, text) in seen else "k" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    return found


STATE = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def slow_audit(letters, faults):
    """(cost, audit) over labels (rows dealt with, last role), relaxed until nothing changes."""
    best = {(0, ""): (0, "")}
    changed = True
    while changed:
        changed = False
        for (i, q), (cost, audit) in list(best.items()):
            ways = [(5, "I", i, STATE.get((q, c))) for c in "ua"]
            if i < len(letters):
                ways.append((2, "D", i + 1, q))
                if faults[i] not in "bd":
                    more = 5 * (faults[i] == "t")
                    ways.append((more, "K", i + 1, STATE.get((q, letters[i]))))
                    ways += [(1 + more, "R", i + 1, STATE.get((q, c))) for c in "ua"]
            for more, edit, j, p in ways:
                if p is not None and ((j, p) not in best or (cost + more, audit + edit) < best[j, p]):
                    best[j, p] = cost + more, audit + edit
                    changed = True
    return min(best[len(letters), q] for q in ("", "a") if (len(letters), q) in best)


def slow_turns(rows, audit):
    letters, out, rest = len(audit) - audit.count("D"), [], iter(rows)
    roles = ["system"] * (letters % 2) + ["user", "assistant"] * (letters // 2)
    for edit in audit:
        row = ("", "") if edit == "I" else next(rest)[2:]
        if edit != "D":
            out.append((row[0] if edit == "K" else roles[len(out)], row[1]))
    return out


def slow_row(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    found = slow_faults(rows)
    letters = [r[2][:1] or "-" for r in rows]
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit = slow_audit(letters, found)
    text = "\n".join(f"{role}:{text}" for role, text in slow_turns(rows, audit))
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("b"), found.count("d"), found.count("t"),
            illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def slow(rows):
    groups = {conv: [] for conv, *_ in rows}
    for row in slow_damage(rows):
        groups[row[0]].append(row)
    return sorted((slow_row(c, r) for c, r in groups.items()), key=str)


def fetched(df):
    return sorted(map(tuple, df.collect()), key=str)


def codes(n, rng):
    return "".join(rng.choice("suax") + rng.choice("kkkkktbd") for _ in range(n))


def test_search_equals_relaxation():
    for n in range(4):
        for rows in itertools.product(["sk", "uk", "ak", "xk", "ut", "ub"], repeat=n):
            rows = "".join(rows)
            assert turn_repair.cheapest(rows) == slow_audit(rows[::2], rows[1::2]), rows
    rng = random.Random(5)
    for _ in range(600):
        rows = codes(rng.randint(4, 14), rng)
        assert turn_repair.cheapest(rows) == slow_audit(rows[::2], rows[1::2]), rows


def test_parts_joined_equal_the_whole():
    rng = random.Random(6)
    for _ in range(150):
        pieces = [codes(rng.randint(1, 5), rng) for _ in range(rng.randint(2, 6))]
        tables = [turn_repair.part_table(p, k == 0, k == len(pieces) - 1) for k, p in enumerate(pieces)]
        cut = rng.randint(1, len(pieces) - 1)
        found = turn_repair.joined([turn_repair.joined(tables[:cut]), turn_repair.joined(tables[cut:])])
        rows = "".join(pieces)
        assert min(w for (p, q), w in found["ways"].items()) == slow_audit(rows[::2], rows[1::2])
        assert found["illegal"] == turn_repair.illegal_pairs(rows[::2])


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_query_equals_the_rule(spark):
    found = queries.op12_turn_repair(spark, SF)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert fetched(found) == slow(rows_of(table(spark, SF, "conversations")))


EDGES = [(None, 0, "user", "No id."), (None, None, None, None), (None, 1, "assistant", "Yes."), (1, None, "user", "b."), (1, None, "user", "a."), (1, 5, "assistant", None),
         (1, 5, "assistant", "Same turn!"), (2, 0, "tool", "What?"), (2, 1, "", "x"), (2, 2, "System", "y."), (3, 0, "system", " \t "), (4, 0, "user", "same."), (4, 1, "user", "same."),
         (4, 9, "user", "same."), (4, 9, "user", "same."), (5, -3, "assistant", "w. \x0b"), (5, 2**40, "user", "\u00a0"), (6, 1, "user", "Long. " * 5000), (7, 0, "user", "\u2003."), (8, None, None, "z?")]


def test_edges(spark):
    turns = spark.createDataFrame(EDGES + [(100 + i, t, r, "t.") for i in range(60) for t, r in enumerate(["user", "assistant"])]
                                  + [(200 + i, 0, "user", "u.") for i in range(100)], TURNS)
    want = slow(rows_of(turns))
    assert any(row[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for row in want)
    odd = turns.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("place", "fault", "any", "kind", "copy", "first", "block"))])
    assert fetched(turn_repair.repaired_after_damage(odd)) == want
    assert turn_repair.repaired_after_damage(spark.createDataFrame([], TURNS)).collect() == []


@pytest.mark.parametrize("bits", [0, 2])
def test_long_conversations_lie_in_many_blocks(spark, monkeypatch, bits):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", bits)
    monkeypatch.setattr(turn_repair, "FAN", 3)
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randint(0, 40), rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "c!", " ", "dd.", "ee?"]) + str(rng.randint(0, 9)) * rng.randint(0, 1))
            for _ in range(120)]
    turns = spark.createDataFrame(rows, TURNS)
    assert fetched(turn_repair.repaired_after_damage(turns)) == slow(rows)


def test_turns_are_written(spark):
    turns = spark.createDataFrame(EDGES, TURNS)
    found, placed = turn_repair.repair(turns)
    groups = defaultdict(list)
    for conv, turn, role, text in EDGES:
        groups[conv].append((conv, turn, " " if role is None else role, " " if text is None else text))
    got = defaultdict(list)
    for r in sorted(turn_repair.repaired_turns(placed, found).collect(), key=lambda r: r["n"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    for conv, rows in groups.items():
        rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
        audit = slow_audit([r[2][:1] or "-" for r in rows], slow_faults(rows))[1]
        assert got[conv] == slow_turns(rows, audit)
