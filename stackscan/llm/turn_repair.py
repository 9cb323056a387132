"""Repair of conversations: the cheapest edits that give every one a legal order of turns.

A conversation's rows and the roles it has had so far span a lattice: node (i, q) means that i rows are
dealt with and the roles written so far end in state q. An edge keeps, re-roles or deletes the next row or
inserts a turn. Two searches by Dijkstra's rule, one from the start and one from the ends, meet; they go on
until no crossing of the best cost can be missing, and of all crossings the least audit, the forward and the
backward one concatenated, is taken.

Rows are put in order by a range sort, which spreads a long conversation over tasks, and cut into blocks of
consecutive rows. A conversation that lies in one block is repaired there. One that does not gives, for each
of its blocks, the best way from every state to every other one; these tables are merged in rounds of 16
neighbours, so no task holds more than its share of the rows. Only its answer, one line of edits, is whole;
texts stream past it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackscan.llm.common import kept, stored

# White space, marks that end a sentence, and what the edits cost.
BLANKS, MARKS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
#: States: nothing written, a system turn, last a user turn, last an assistant turn; and those that may end.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The state after the turn that must come next, if it is no system turn, and the letter of its role.
NEXT, WANTED = (USER, USER, ASSISTANT, USER), "uuau"
BEFORE = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
LEGAL = {"su", "ua", "au"}
#: Rows in a block: 2 to this power. Tables that meet in a round of merging.
BLOCK_BITS, FAN = 10, 16


def _edges(rows: str, i: int, q: int) -> list[tuple[int, str, int, int]]:
    """(cost, edit, rows dealt with, state) of every edge from (i, q). A row is two letters: role, fault."""
    found = [(INSERT, "I", i, NEXT[q])]
    if 2 * i < len(rows):
        role, fault = rows[2 * i], rows[2 * i + 1]
        found.append((DELETE, "D", i + 1, q))
        if fault not in "bd":
            more = CUT_OFF if fault == "t" else 0
            found.append((REROLE + more, "R", i + 1, NEXT[q]))
            if role == WANTED[q]:
                found.append((more, "K", i + 1, NEXT[q]))
            elif role == "s" and q == START:
                found.append((more, "K", i + 1, SYSTEM))
    return found


def _edges_to(rows: str, i: int, q: int) -> list[tuple[int, str, int, int]]:
    """(cost, edit, rows dealt with, state) of every edge into (i, q), by the node it comes from."""
    found = [(INSERT, "I", i, p) for p in BEFORE[q]]
    if i:
        role, fault = rows[2 * i - 2], rows[2 * i - 1]
        found.append((DELETE, "D", i - 1, q))
        if fault not in "bd":
            more = CUT_OFF if fault == "t" else 0
            found += [(REROLE + more, "R", i - 1, p) for p in BEFORE[q]]
            found += [(more, "K", i - 1, p) for p in BEFORE[q] if role == WANTED[p]]
            if q == SYSTEM and role == "s":
                found.append((more, "K", i - 1, START))
    return found


class _Side:
    """One of the two searches. Of equal costs, nodes are settled in the order of the rows, along which edges
    without a cost lead, so a settled node's audit is the least of its cost."""

    def __init__(self, sources: list[tuple[int, int]], step: int):
        self.step, self.settled = step, {}
        self.best = {node: (0, "") for node in sources}
        self.heap = [(0, step * i, q) for i, q in sources]

    def least(self) -> float:
        while self.heap and (self.step * self.heap[0][1], self.heap[0][2]) in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, edges) -> tuple[tuple[int, int], int, str]:
        cost, place, q = heappop(self.heap)
        node = self.step * place, q
        self.settled[node] = cost, audit = self.best[node]
        for more, edit, i, p in edges(*node):
            label = cost + more, audit + edit if self.step > 0 else edit + audit
            old = self.best.get((i, p))
            if old is None or label < old:
                self.best[i, p] = label
                if old is None or label[0] < old[0]:
                    heappush(self.heap, (label[0], self.step * i, p))
        return node, cost, audit


def cheapest(rows: str, start: int = START, ends: tuple[int, ...] = FINAL) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of ``rows`` that lead from state ``start`` to one of ``ends``; of equal
    costs the least audit. None where there are none."""
    n = len(rows) // 2
    ahead, back = _Side([(0, start)], 1), _Side([(n, q) for q in ends], -1)
    best = 0 if not n and start in ends else float("inf")
    while (f := ahead.least()) + (b := back.least()) <= best and f + b < float("inf"):
        side, other, edges = (ahead, back, _edges) if f <= b else (back, ahead, _edges_to)
        node, cost, _ = side.settle(lambda i, q: edges(rows, i, q))
        if node in other.best:
            best = min(best, cost + other.best[node][0])
    if best == float("inf"):
        return None
    # an end's own label is final from the beginning
    back.settled |= {(n, q): (0, "") for q in ends}
    crossings = [ahead.settled[v][1] + back.settled[v][1] for v in ahead.settled.keys() & back.settled.keys()
                 if ahead.settled[v][0] + back.settled[v][0] == best]
    for (i, q), (cost, audit) in ahead.settled.items():
        for more, edit, j, p in _edges(rows, i, q):
            rest = back.settled.get((j, p))
            if rest and cost + more + rest[0] == best:
                crossings.append(audit + edit + rest[1])
    return int(best), min(crossings)


def illegal_pairs(roles: str) -> int:
    return sum(roles[i:i + 2] not in LEGAL for i in range(len(roles) - 1))


def joined(tables: list[dict]) -> dict:
    """The table of neighbouring parts, from theirs: the best way through all of them, for each pair of states."""
    first, *rest = tables
    ways, illegal, last = first["ways"], first["illegal"], first["last"]
    for table in rest:
        found: dict[tuple[int, int], tuple[int, str]] = {}
        for (p, q), (cost, audit) in ways.items():
            for (r, t), (more, other) in table["ways"].items():
                if q == r:
                    way = cost + more, audit + other
                    found[p, t] = min(way, found.get((p, t), way))
        ways, illegal = found, illegal + table["illegal"] + (last + table["first"] not in LEGAL)
        last = table["last"]
    return {"ways": ways, "illegal": illegal, "first": first["first"], "last": last}


def part_table(rows: str, opens: bool, closes: bool) -> dict:
    """A part's table: all ways that can be of use; ``opens`` and ``closes`` tell whether it is the first or last part."""
    ways = {}
    if opens and closes:
        ways[START, ASSISTANT] = cheapest(rows)
    else:
        for p in (START,) if opens else range(4):
            for q in FINAL if closes else range(4):
                if (q == START and p != START) or (q == SYSTEM and p > SYSTEM):
                    continue
                if (way := cheapest(rows, p, (q,))) is not None:
                    ways[p, q] = way
    roles = rows[::2]
    return {"ways": ways, "illegal": illegal_pairs(roles), "first": roles[:1], "last": roles[-1:]}


TABLE = "illegal bigint, first string, last string, ways array<struct<p:int,q:int,cost:bigint,audit:string>>"


def _packed(table: dict) -> dict:
    ways = [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(table["ways"].items())]
    return {"illegal": table["illegal"], "first": table["first"], "last": table["last"], "ways": ways}


def _unpacked(row: dict) -> dict:
    return row | {"ways": {(w["p"], w["q"]): (w["cost"], w["audit"]) for w in row["ways"]}}


def damage(turns: DataFrame) -> DataFrame:
    """The rows of ``turns`` (conv_id, turn, role, text) after a damage that their ids choose; null roles and texts
    become one space, and a null id counts as one space in the choice.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence marks, 3
    repeats it, 4 makes it a user's.
    """
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(name.cast("binary")), F.lit(20))
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, MARKS, "")).otherwise(text)
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, 2).otherwise(1)
    return (rows.where("kind != 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
            .drop("copy"))


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null role and text: one space) and ``place``, an increasing number in the order
    of conversation, turn (nulls first), role and text. Written, so places are fixed."""
    order = ["conv_id", "turn", "role", "text"]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # rows equal in all four may lie in any order, so a number of their own spreads very many of them
    rows = rows.withColumn("any", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order, "any").sortWithinPartitions(*order)
    return stored(rows.select(*order, F.monotonically_increasing_id().alias("place")), "turns-in-order")


def faults(placed: DataFrame) -> DataFrame:
    """conv_id, turn, place, the first letter of the role (s, u, a; x: another) and the row's first fault:
    b (blank), d (role and text seen earlier in the conversation), t (cut off) or k (none)."""
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    mark = F.endswith(end, F.lit(MARKS[0])) | F.endswith(end, F.lit(MARKS[1])) | F.endswith(end, F.lit(MARKS[2]))
    letter = F.substring("role", 1, 1)
    rows = placed.select("conv_id", "turn", "place", "role", F.sha2("text", 256).alias("digest"),
                         F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("letter"),
                         F.when(end == "", "b").when(mark, "k").otherwise("t").alias("own"))
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == "b", "b").when(F.col("first").isNull(), "d").otherwise(F.col("own"))
    return rows.join(firsts, "place", "left").select("conv_id", "turn", "place", "letter", fault.alias("fault"))


def _beside(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` and the columns of ``right``, one row per conversation; null ids meet."""
    named = right.withColumnRenamed("conv_id", "_conv")
    return left.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), how).drop("_conv")


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit and illegal of every conversation of ``rows`` (conv_id, place, letter, fault)."""
    block = F.shiftright("place", BLOCK_BITS)
    codes = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.concat("letter", "fault").alias("code")))), lambda x: x["code"]), "")
    parts = rows.groupBy("conv_id", block.alias("block")).agg(codes.alias("codes"))
    spans = parts.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high"))
    parts = _beside(parts, spans).select("conv_id", "block", "codes", (F.col("block") == F.col("low")).alias("opens"),
                                         (F.col("block") == F.col("high")).alias("closes"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_packed(part_table(*x)) for x in zip(*(batch[c].to_pylist() for c in ("codes", "opens", "closes")))]
            table = pa.RecordBatch.from_pylist(out, WAYS)
            whole = [a and b for a, b in zip(batch["opens"].to_pylist(), batch["closes"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["block"], pa.array(whole, pa.bool_()), *table.columns],
                                             names=["conv_id", "block", "whole", *WAYS.names])

    found = kept(parts.mapInArrow(tables, f"conv_id bigint, block bigint, whole boolean, {TABLE}"))
    done = found.where("whole")
    # the parts of the others, numbered; one row stands for up to 1,024 rows, or a line of edits
    by_block = Window.partitionBy("conv_id").orderBy("block")
    rest = found.where("NOT whole").withColumn("at", F.row_number().over(by_block) - 1).drop("whole", "block")
    width = (rest.agg(F.max("at")).first()[0] or 0) + 1

    def merged(group: pa.Table) -> pa.Table:
        some = group.sort_by("at").to_pylist()
        row = _packed(joined([_unpacked(r) for r in some]))
        keys = {"conv_id": some[0]["conv_id"], "at": some[0]["at"] // FAN}
        return pa.Table.from_pylist([keys | row], pa.schema([("conv_id", pa.int64()), ("at", pa.int32()), *WAYS]))

    while width > 1:
        width = -(-width // FAN)
        rest = kept(rest.withColumn("next", F.floor(F.col("at") / FAN)).groupBy("conv_id", "next")
                    .applyInArrow(merged, f"conv_id bigint, at int, {TABLE}"))
    whole = done.select("conv_id", "illegal", "ways").unionByName(rest.select("conv_id", "illegal", "ways"))
    # ways to both ends from the start: the cheaper, then the lesser one
    way = F.sort_array(F.transform(F.filter("ways", lambda w: w["q"].isin(*FINAL) & (w["p"] == START)),
                                   lambda w: F.struct(w["cost"].alias("cost"), w["audit"].alias("audit"))))[0]
    return whole.select("conv_id", way["cost"].alias("cost"), way["audit"].alias("audit"), "illegal")


WAYS = pa.schema([("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                  ("ways", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))])


class _Replay:
    """Applies a line of edits to the rows of one conversation as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.n = audit, 0, 0
        self.system = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return "user" if (self.n - self.system) % 2 == 0 else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            yield "I", self._role(), ""
            self.at, self.n = self.at + 1, self.n + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield edit, role if edit == "K" else self._role(), text
            self.n += 1


def _replayed(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of every conversation in order, its line of edits before them, in one partition each."""
    lines = found.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    rows = placed.select("conv_id", "place", "role", "text")
    return lines.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str, str]] | None]]:
    """(conversation, written turns) for its line of edits, each of its rows, and its end, which is told by None before the next."""
    replay = conv = None
    for batch in batches:
        for conv_id, place, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "place", "role", "text"))):
            if place < 0:
                if replay:
                    yield conv, replay.inserted()
                    yield conv, None
                conv, replay = conv_id, _Replay(text)
            else:
                yield conv, replay.row(role, text)
    if replay:
        yield conv, replay.inserted()
        yield conv, None


def repaired_turns(placed: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of every conversation after its edits: conv_id, n (from 0), edit, role, text. ``found`` is what
    ``audits`` gave for the rows of ``placed``."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for conv_id, turns in _conversations(batches):
            for edit, role, text in turns or ():
                out.append({"conv_id": conv_id, "n": n, "edit": edit, "role": role, "text": text})
                n += 1
            n = 0 if turns is None else n
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    return _replayed(placed, found).mapInArrow(written, "conv_id bigint, n bigint, edit string, role string, text string")


def repaired_digests(placed: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of its turns after the edits as role:text, joined by newlines. Texts pass one
    by one; a conversation holds no more than its digest and its line of edits."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, between = [], hashlib.sha256(), b""
        for conv_id, turns in _conversations(batches):
            for _, role, text in turns or ():
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            if turns is None:
                out.append({"conv_id": conv_id, "repaired_sha256": digest.hexdigest()})
                digest, between = hashlib.sha256(), b""
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    return _replayed(placed, found).mapInArrow(digests, "conv_id bigint, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per conversation of ``turns``, its rows in order), for ``repaired_turns``.

    The first: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns with a null number come
    first and count for no gap; rows with equal turns lie by role and text; null roles and texts are one space;
    rows with a null conv_id are one conversation. Rows that repeat are duplicates of the first. Other columns
    are left out. An empty table gives empty results.
    """
    placed = in_order(turns)
    rows = kept(faults(placed))
    found = kept(audits(rows))
    # turns are made distinct before they meet their conversation
    ranges = (rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).groupBy("conv_id")
              .agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps")))
    sums = rows.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == k).alias(c) for k, c in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    table = _beside(_beside(found, ranges), sums).select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return table, placed


def repaired_after_damage(turns: DataFrame) -> DataFrame:
    """Every conv_id of ``turns``, damaged (see ``damage``) and repaired (see ``repair``), with the digest of its
    repaired turns. A conversation that the damage took whole has zeros, an empty audit and an empty text's digest."""
    table, placed = repair(damage(turns))
    found = _beside(table, repaired_digests(placed, table))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _beside(turns.select("conv_id").distinct(), found, "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
