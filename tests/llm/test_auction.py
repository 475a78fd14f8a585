import hashlib
import random
import re
import zlib
from functools import cache

import pytest

from loomspark.llm import auction

WHITE = " \t\n\x0b\f\r"


def plain_repair(rows):
    """The result of one conversation from its rows (turn, role, text) after damage, by a plain recursion over rows and states."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(WHITE)[-1:]
        faults.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(k, state, inserts):
        found = []
        if k == len(rows) and state in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            cost, rest = best(k, follow[state], inserts + 1)
            found.append((cost + 5, "I" + rest))
        if k < len(rows):
            cost, rest = best(k + 1, state, 0)
            found.append((cost + 2, "D" + rest))
            if faults[k] not in ("blank", "duplicate"):
                more = 5 * (faults[k] == "truncated")
                initial = rows[k][1][:1]
                if initial and (initial == follow[state] or (state == "" and initial == "s")):
                    cost, rest = best(k + 1, initial, 0)
                    found.append((cost + more, "K" + rest))
                cost, rest = best(k + 1, follow[state], 0)
                found.append((cost + more + 1, "R" + rest))
        return min(found) if found else (10**9, "")

    cost, audit = best(0, "", 0)
    out, k, state = [], 0, ""
    for edit in audit:
        role, text = rows[k][1:] if edit != "I" else ("", "")
        full = {"u": "user", "a": "assistant"}[follow[state]]
        k += edit != "I"
        if edit == "K":
            out.append(f"{role}:{text}")
            state = role[0]
        elif edit != "D":
            out.append(f"{full}:{text}")
            state = follow[state]
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def plain(conversations):
    out = {}
    for conv, turn, role, text in conversations:
        rows = out.setdefault(conv, [])
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, h = " " if role is None else role, " " if text is None else text, zlib.crc32(name.encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        rows += [(turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return {c: plain_repair(rows) for c, rows in out.items()}


def made(rng, n, conv, turns=None):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Long\nanswer. ", "é."]
    rows = []
    for k in range(n):
        turn = rng.choice([None, rng.randrange(turns or n + 1)]) if rng.random() < 0.2 else k
        role = (["system"] + ["user", "assistant"] * n)[k] if rng.random() < 0.6 else rng.choice(roles)
        rows.append((conv, turn, role, f"Text {k}." if rng.random() < 0.6 else rng.choice(texts)))
    return rows


@pytest.mark.parametrize(("block", "parts"), [(32, 4), (3, 7)])
def test_like_plain_recursion(spark, monkeypatch, block, parts):
    monkeypatch.setattr(auction, "BLOCK", block)
    rng = random.Random(block)
    rows = [r for c in range(60) for r in made(rng, rng.randint(1, 12), c)]
    rows += made(rng, 150, 900) + made(rng, 90, None, 5) + [(901, 3, "user", "Same.")] * 70 + [(902, 1, "user", "x."), (902, None, "assistant", "y.")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")
        got = {r[0]: tuple(r)[1:] for r in auction.repairs(df, auction.damaged(df)).collect()}
        assert got == plain(rows)
        assert auction.repairs(df.limit(0), auction.damaged(df.limit(0))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prices_are_shortest_distances_and_the_trace_is_least():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice("suatx"), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 1, 3])) for _ in range(rng.randint(0, 7))]
        arcs, labels, target = auction.row_lattice(rows, None)
        price = auction.auction(arcs, 0, target)
        distance = [0.0 if n == target else float("inf") for n in range(len(arcs))]
        for _ in arcs:
            distance = [min([distance[n], *(c + distance[t] for c, t in arcs[n])]) for n in range(len(arcs))]
        assert price[0] == distance[0] and all(p <= d for p, d in zip(price, distance, strict=True))
        at = 0
        for k in auction.traced(arcs, price, 0, target):
            tight = [i for i, (c, t) in enumerate(arcs[at]) if distance[at] == c + distance[t]]
            assert k == tight[0]
            at = arcs[at][k][1]
        assert labels[0] == sorted(labels[0])


def test_unreachable_states_end():
    assert auction.best_edits([("u", 0, 1)], auction.START, auction.AFTER_S) is None
    assert auction.best_edits([("s", 0, 1)], auction.START, auction.AFTER_S) == (0, ["K"])
