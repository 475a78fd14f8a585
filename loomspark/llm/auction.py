"""Repair of conversations by the auction algorithm for shortest paths.

The edits of a conversation are paths through a lattice: a layer for each row, and in it the states of the pattern
`(s?(ua)+)?` (nothing yet, after s, after u, after a). Arcs keep, rerole or delete a row and lead to the next layer, or
insert one and stay in theirs; their costs are integers. The auction holds a path from the origin and a price for each node.
If the end of the path costs less than its cheapest arc and the price behind it, its price rises to that and the path
contracts; else the path extends along that arc. At the target, prices are shortest distances along every
cheapest path, and the arcs without slack are the cheapest ones; of these the trace takes the first by label at each node. (An
arc with slack never loses it while the path stands, so the trace is the ASCII-least cheapest path.)

Conversations have no bound. Rows are sorted by range over all of them, and blocks of BLOCK rows are the leaves of a tree; a
conversation of one block needs no more. In longer ones a block becomes 16 costs between its states, with the order of
the labels of these paths; BLOCK such summaries are a lattice again, whose auction gives the summary of the level
above. From the top down auctions then fix the states at which each block begins and ends. Labels of two paths through a block
differ before either ends, so that an order per block is enough. Equal rows of one turn are one row with a count. Only
the hash of a repaired conversation has to run over its rows in turn: it streams over them, sorted, in one task.

Edge cases: nulls count as one blank, rows of a null conv_id are one conversation, null turns come first; equal turns go
by role and text; an empty role has no initial and cannot be kept; a conversation without rows has zeros and an empty
audit; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.common import stored

#: Rows of a leaf, and children of a node above.
BLOCK = 32
#: Costs of edits, and roles.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = 4
#: The state after the role that a state asks for, and that role.
NEXT = [AFTER_U, AFTER_U, AFTER_A, AFTER_U]
ROLE = ["user", "user", "assistant", "user"]
#: States from which a state can be reached.
BEFORE = [{START}, {START, AFTER_S}, {START, AFTER_S, AFTER_U, AFTER_A}, {START, AFTER_S, AFTER_U, AFTER_A}]
#: Inserts after the last row, by state.
TAIL = [[], [AFTER_S, AFTER_U], [AFTER_U], []]
FAULTS = ["", "blank", "duplicate", "truncated"]
#: Characters of roles and texts by which equal turns are dealt to ranges.
PREFIX = 64
SPACE = r"\x20\x09-\x0D"

Arc = tuple[int, int]
ROW = "struct<turn: long, role: string, text: string, fault: int, n: long>"
KEY = "no_id boolean, conv long"


# --- the auction ------------------------------------------------------------------------------


def auction(arcs: list[list[Arc]], origin: int, target: int) -> list[float] | None:
    """Prices after the auction (the origin's is the shortest distance), or None if the target cannot be reached. arcs: (cost, node) of each node, in order of their labels; no cycle is free."""
    price = [0.0] * len(arcs)
    path = [origin]
    while path[-1] != target:
        at = path[-1]
        least, to = math.inf, -1
        for cost, node in arcs[at]:
            if cost + price[node] < least:
                least, to = cost + price[node], node
        if price[at] < least:
            price[at] = least
            if at != origin:
                path.pop()
            elif least == math.inf:
                return None
        else:
            path.append(to)
    return price


def traced(arcs: list[list[Arc]], price: list[float], origin: int, target: int) -> list[int]:
    """Which arc is taken at each node from origin to target: the first one without slack."""
    taken, at = [], origin
    while at != target:
        k = next(k for k, (cost, node) in enumerate(arcs[at]) if price[at] == cost + price[node])
        taken.append(k)
        at = arcs[at][k][1]
    return taken


def row_lattice(rows: list[tuple[str, int, int]], last: int | None) -> tuple[list[list[Arc]], list[list[str]], int]:
    """Arcs, their labels and the target, for rows of (initial, fault, count): the state `last` after the rows, or the end of the conversation if that is None."""
    n, target = len(rows), STATES * (len(rows) + 1) if last is None else STATES * len(rows) + last
    allowed = BEFORE[AFTER_A if last is None else last]
    arcs: list[list[Arc]] = [[] for _ in range(STATES * (n + 1) + 1)]
    labels: list[list[str]] = [[] for _ in arcs]
    for layer in range(n + (last is None)):
        for q in allowed:
            found: list[tuple[str, int, int]] = []
            if layer == n:
                if q in (START, AFTER_A):
                    found.append(("", 0, target))
            else:
                initial, fault, count = rows[layer]
                rest = "D" * (count - 1)
                below = STATES * (layer + 1)
                found.append(("D" + rest, DELETE * count, below + q))
                if fault not in (1, 2):
                    more = DELETE * (count - 1) + TRUNCATED * (fault == 3)
                    to = AFTER_S if q == START and initial == "s" else NEXT[q] if initial == ROLE[q][0] else None
                    if to in allowed:
                        found.append(("K" + rest, more, below + to))
                    if NEXT[q] in allowed:
                        found.append(("R" + rest, REROLE + more, below + NEXT[q]))
            if NEXT[q] in allowed:
                found.append(("I", INSERT, STATES * layer + NEXT[q]))
            for label, cost, to in sorted(found):
                arcs[STATES * layer + q].append((cost, to))
                labels[STATES * layer + q].append(label)
    return arcs, labels, target


def best_edits(rows: list[tuple[str, int, int]], first: int = START, last: int | None = None) -> tuple[int, list[str]] | None:
    """Cost and labels of the cheapest edits between two states, the ASCII-least of them."""
    arcs, labels, target = row_lattice(rows, last)
    price = auction(arcs, first, target)
    if price is None:
        return None
    out, at = [], first
    for k in traced(arcs, price, first, target):
        out.append(labels[at][k])
        at = arcs[at][k][1]
    return int(price[first]), out


def _ranked(found: dict[tuple[int, int], tuple[int, tuple]]) -> tuple[list[int | None], list[int | None]]:
    """Costs of paths between states, and their place in the order of labels among the paths from one state."""
    cost: list[int | None] = [None] * STATES**2
    rank: list[int | None] = [None] * STATES**2
    for first in range(STATES):
        ends = sorted((label, last) for (q, last), (_, label) in found.items() if q == first)
        for place, (_, last) in enumerate(ends):
            cost[STATES * first + last], rank[STATES * first + last] = found[first, last][0], place
    return cost, rank


def summary_of_rows(rows: list[tuple[str, int, int]]) -> tuple[list[int | None], list[int | None]]:
    found = {}
    for last in range(STATES):
        for first in BEFORE[last]:
            if edits := best_edits(rows, first, last):
                found[first, last] = edits[0], "".join(edits[1])
    return _ranked(found)


def child_lattice(children: list[tuple[list, list]]) -> list[list[Arc]]:
    """Arcs between the states at the ends of children (costs, ranks), in order of their labels."""
    arcs: list[list[Arc]] = [[] for _ in range(STATES * (len(children) + 1))]
    for i, (cost, rank) in enumerate(children):
        for q in range(STATES):
            there = sorted((rank[STATES * q + t], t) for t in range(STATES) if cost[STATES * q + t] is not None)
            arcs[STATES * i + q] = [(cost[STATES * q + t], STATES * (i + 1) + t) for _, t in there]
    return arcs


def child_states(children: list[tuple[list, list]], first: int, last: int) -> tuple[int, tuple[int, ...], list[int]] | None:
    """Cost of the cheapest path through the children, the places of its arcs, and the states between them, both ends included."""
    arcs, target = child_lattice(children), STATES * len(children) + last
    price = auction(arcs, first, target)
    if price is None:
        return None
    taken, states, at = traced(arcs, price, first, target), [first], first
    for k in taken:
        at = arcs[at][k][1]
        states.append(at % STATES)
    return int(price[first]), tuple(taken), states


def summary_of_children(children: list[tuple[list, list]]) -> tuple[list[int | None], list[int | None]]:
    found = {}
    for last in range(STATES):
        for first in BEFORE[last]:
            if path := child_states(children, first, last):
                found[first, last] = path[0], path[1]
    return _ranked(found)


def last_state(cost: list[int | None], rank: list[int | None]) -> int:
    """The state in which a whole conversation's rows end best."""
    ends = [(cost[t] + INSERT * len(TAIL[t]), rank[t], t) for t in range(STATES) if cost[t] is not None]
    return min(ends)[2]


# --- rows -------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """no_id, conv, turn, role, text and n (how many equal rows there are) after the damage."""
    blank = F.lit(" ")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.crc32(name) % 20).alias("h"),
    ).filter("h != 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("no_id", "conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("no_id", "conv", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault (a place in FAULTS) of the first of each n equal rows; the others are blank or duplicates."""
    named = rows.withColumn("d1", F.xxhash64("role", "text")).withColumn("d2", F.xxhash64("text", F.lit(1), "role"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = named.groupBy("no_id", "conv", "d1", "d2").agg(F.min(when).alias("first"))
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(blank, 1).when(when > F.col("first"), 2).when(~end.isin(".", "!", "?"), 3).otherwise(0)
    return named.join(seen, ["no_id", "conv", "d1", "d2"]).select("no_id", "conv", "turn", "role", "text", fault.alias("fault"), "n")


def _arrow_rows(batch: pa.RecordBatch) -> pa.StructArray:
    names = ["turn", "role", "text", "fault", "n"]
    return pa.StructArray.from_arrays([batch.column(c) for c in names], names)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows sorted over all conversations and cut: no_id, conv, part, block and up to BLOCK rows of a conversation."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, block = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            none, conv = np.asarray(batch.column("no_id")), np.asarray(batch.column("conv"))
            heads = [0, *(np.flatnonzero((none[1:] != none[:-1]) | (conv[1:] != conv[:-1])) + 1).tolist(), batch.num_rows]
            starts, numbers = [], []
            for a, b in zip(heads, heads[1:], strict=False):
                block = block if before == (none[a], conv[a]) else 0
                before = none[a], conv[a]
                for k in range(a, b, BLOCK):
                    starts.append(k)
                    numbers.append(block)
                    block += 1
            at = pa.array(starts)
            held = pa.ListArray.from_arrays(pa.array([*starts, batch.num_rows], pa.int32()), _arrow_rows(batch))
            yield pa.RecordBatch.from_arrays([batch.column("no_id").take(at), batch.column("conv").take(at), pa.array([part] * len(starts), pa.int64()), pa.array(numbers, pa.int64()), held], ["no_id", "conv", "part", "block", "rows"])

    turn = F.asc_nulls_first("turn")
    ranged = rows.repartitionByRange("no_id", "conv", turn, F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX))
    return ranged.sortWithinPartitions("no_id", "conv", turn, "role", "text").mapInArrow(run, f"{KEY}, part long, block long, rows array<{ROW}>")


# --- the tree over long conversations ---------------------------------------------------------


SUMMARY = "cost array<long>, rank array<long>"


def _slim(rows: list[dict]) -> list[tuple[str, int, int]]:
    return [(r["role"][:1], r["fault"], r["n"]) for r in rows]


def _leaves(segments: DataFrame) -> DataFrame:
    """The summary of each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary_of_rows(_slim(rows)) for rows in batch.column("rows").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("no_id", "conv", "part", "block")], pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["no_id", "conv", "part", "block", "cost", "rank"])

    slim = F.transform("rows", lambda r: F.struct(F.substring(r["role"], 1, 1).alias("role"), r["fault"].alias("fault"), r["n"].alias("n")))
    return segments.select("no_id", "conv", "part", "block", slim.alias("rows")).mapInArrow(run, f"{KEY}, part long, block long, {SUMMARY}")


def _children(table: pa.Table) -> list[tuple[list, list]]:
    return list(zip(table.column("cost").to_pylist(), table.column("rank").to_pylist(), strict=True))


def _above(table: pa.Table) -> pa.Table:
    table = table.sort_by("ord")
    cost, rank = summary_of_children(_children(table))
    head = table.slice(0, 1)
    return pa.table({"no_id": head.column("no_id"), "conv": head.column("conv"), "ord": head.column("up"), "cost": pa.array([cost], pa.list_(pa.int64())), "rank": pa.array([rank], pa.list_(pa.int64()))})


def _below(table: pa.Table) -> pa.Table:
    table = table.sort_by("ord")
    _, _, states = child_states(_children(table), table.column("first")[0].as_py(), table.column("last")[0].as_py())
    return pa.table({"no_id": table.column("no_id"), "conv": table.column("conv"), "ord": table.column("ord"), "first": pa.array(states[:-1], pa.int64()), "last": pa.array(states[1:], pa.int64())})


def ends_of_blocks(segments: DataFrame) -> DataFrame:
    """no_id, conv, part, block, first and last: the states around each block of conversations of several blocks."""
    whole = ["no_id", "conv"]
    parts = segments.groupBy(*whole, "part").agg(F.count(F.lit(1)).alias("k"))
    # a conversation has a row here for each partition that it reaches into
    placed = parts.withColumn("all", F.sum("k").over(W.partitionBy(*whole))).filter("all > 1")
    placed = stored(placed.select(*whole, "part", (F.sum("k").over(W.partitionBy(*whole).orderBy("part")) - F.col("k")).alias("before")), "parts")
    leaves = stored(_leaves(segments.join(placed.select(*whole).distinct(), whole, "left_semi")).join(placed, [*whole, "part"]).withColumn("ord", F.col("before") + F.col("block")).drop("before"), "leaves")
    up = F.floor(F.col("ord") / BLOCK)
    levels = [leaves.drop("part", "block")]
    while (levels[-1].agg(F.max("ord")).first()[0] or 0) > 0:
        levels.append(stored(levels[-1].withColumn("up", up).groupBy(*whole, "up").applyInArrow(_above, f"{KEY}, ord long, {SUMMARY}"), "level"))

    def top(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [last_state(cost[:STATES], rank[:STATES]) for cost, rank in zip(batch.column("cost").to_pylist(), batch.column("rank").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("no_id"), batch.column("conv"), batch.column("ord"), pa.array([START] * len(last), pa.int64()), pa.array(last, pa.int64())], ["no_id", "conv", "ord", "first", "last"])

    schema = f"{KEY}, ord long, first long, last long"
    ends = levels[-1].mapInArrow(top, schema)
    for level in levels[-2::-1]:
        above = ends.withColumnRenamed("ord", "up")
        ends = stored(level.withColumn("up", up).join(above, [*whole, "up"]).groupBy(*whole, "up").applyInArrow(_below, schema), "ends")
    return ends.join(leaves.select(*whole, "ord", "part", "block"), [*whole, "ord"]).drop("ord")


# --- results ----------------------------------------------------------------------------------


LEGAL = {"su", "ua", "au"}
COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
PIECE = f"{KEY}, part long, block long, last long, blank long, duplicate long, truncated long, illegal long, cost long, low long, high long, turns long, first_turn long, last_turn long, first_role string, last_role string, audit string, repaired string"


def repaired_rows(rows: list[dict], labels: list[str], state: int) -> list[str]:
    """`role:text` of what the edits leave of the rows, from a state on."""
    out, k = [], 0
    for label in labels:
        if label == "I":
            out.append(f"{ROLE[state]}:")
            state = NEXT[state]
        elif label:
            kind, row = label[0], rows[k]
            k += 1
            if kind == "R":
                out.append(f"{ROLE[state]}:{row['text']}")
            elif kind == "K":
                out.append(f"{row['role']}:{row['text']}")
            if kind != "D":
                state = AFTER_S if kind == "K" and state == START and row["role"][:1] == "s" else NEXT[state]
    return out


def piece(rows: list[dict], first: int | None, last: int | None) -> dict:
    """What a block adds to its conversation's result; without states the block is a whole conversation."""
    cost, labels = best_edits(_slim(rows), START if first is None else first, last)
    kept = repaired_rows(rows, labels, START if first is None else first)
    initials, turns = [r["role"][:1] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
    pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)) + sum(r["n"] - 1 for r in rows)
    return {
        "last": last, "blank": sum(r["n"] for r in rows if r["fault"] == 1), "duplicate": sum(r["n"] - 1 + (r["fault"] == 2) for r in rows if r["fault"] != 1), "truncated": sum(r["fault"] == 3 for r in rows),
        "illegal": pairs, "cost": cost, "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns)), "first_turn": rows[0]["turn"], "last_turn": rows[-1]["turn"],
        "first_role": initials[0], "last_role": initials[-1], "audit": "".join(labels), "repaired": "\n".join(kept) if kept else None,
    }


def pieces(segments: DataFrame) -> DataFrame:
    """The piece of each block(rows, first, last)."""
    names = [c.split()[0] for c in PIECE.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(batch.column("rows").to_pylist(), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True)
            found = [piece(*x) for x in ends]
            kinds = {n: pa.string() for n in ("first_role", "last_role", "audit", "repaired")}
            made = {n: pa.array([f[n] for f in found], kinds.get(n, pa.int64())) for n in names[4:]}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:4]], *made.values()], names)

    return segments.mapInArrow(run, PIECE)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Whole:
    """A conversation's result from its pieces in order."""

    def __init__(self):
        self.sum, self.audit, self.hash, self.any = dict.fromkeys(COUNTS, 0), [], hashlib.sha256(), False
        self.low = self.high = self.last = None
        self.turns, self.end = 0, None

    def _text(self, text: str) -> None:
        self.hash.update((("\n" if self.any else "") + text).encode())
        self.any = True

    def add(self, x: dict) -> None:
        for c in COUNTS:
            self.sum[c] += x[c]
        if self.end is not None:
            self.sum["illegal"] += self.end["last_role"] + x["first_role"] not in LEGAL
        self.turns += x["turns"] - (self.end is not None and x["first_turn"] is not None and self.end["last_turn"] == x["first_turn"])
        self.low = x["low"] if self.low is None else self.low
        self.high = self.high if x["high"] is None else x["high"]
        self.audit.append(x["audit"])
        if x["repaired"] is not None:
            self._text(x["repaired"])
        self.end = {"last_role": x["last_role"], "last_turn": x["last_turn"]}
        self.last = x["last"]

    def result(self) -> dict:
        for state in TAIL[self.last] if self.last is not None else []:
            self.sum["cost"] += INSERT
            self.audit.append("I")
            self._text(f"{ROLE[state]}:")
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {"gaps": gaps, **self.sum, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def wholes(found: DataFrame) -> DataFrame:
    """One row per conversation, streamed over its pieces in order."""
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(done: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.int64())]
            columns += [pa.array([d[2][n] for d in done], pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]
            return pa.RecordBatch.from_arrays(columns, ["no_id", "conv", *names])

        now, state = None, None
        for batch in batches:
            done = []
            for x in batch.to_pylist():
                if now != (x["no_id"], x["conv"]):
                    if state:
                        done.append((*now, state.result()))
                    now, state = (x["no_id"], x["conv"]), Whole()
                state.add(x)
            yield out(done)
        if state:
            yield out([(*now, state.result())])

    dealt = found.repartition("no_id", "conv").sortWithinPartitions("no_id", "conv", "part", "block")
    return dealt.mapInArrow(run, f"{KEY}, {RESULT}")


def repairs(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, faults, cost, edits and repaired text's hash of every conversation; rows are what `damaged` (or a like step) left."""
    segments = stored(blocks(with_faults(rows)), "blocks")
    ends = ends_of_blocks(segments)
    found = wholes(pieces(segments.join(ends, ["no_id", "conv", "part", "block"], "left")))
    names = [c.split()[0] for c in RESULT.split(", ")]
    every = conversations.select(F.col("conv_id").isNull().alias("no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv")).distinct()
    filled: list[Column] = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names[:-2]]
    filled += [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")]
    return every.join(found, ["no_id", "conv"], "left").select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), *filled)


def op12_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repairs(table, damaged(table))
