"""stretches of occurrences taken in order give the answers of the rule, in few rounds."""

import random

import pytest

from loomspark.operators import build


def in_order(rows, names_of):
    """The rule, occurrence by occurrence."""
    born, oldest, now, chunk, out = {}, {}, {}, None, {}
    for occ, c, name, path in rows:
        if c != chunk:
            chunk, now = c, {}
        names = names_of[occ]
        said = [now.get(x, x if x in born else oldest[x][1] if x in oldest else None) for x in names]
        entity = out[occ] = next((x for x in said if x), name)
        met = (born.setdefault(entity, occ), entity)
        for x in names:
            oldest[x] = min(oldest.get(x, met), met)
        now |= dict.fromkeys([*names, entity], entity)
    return out


@pytest.mark.parametrize("guessed", [False, True])
def test_stretches_like_the_rule(spark, monkeypatch, guessed):
    monkeypatch.setattr(build, "STRETCH", 40)
    rng = random.Random(4)
    rows = []
    for occ in range(400):
        base, d, b = f"f{rng.randrange(6)}", f"d{rng.randrange(3)}", f"b{rng.randrange(5)}"
        name = rng.choice([base, f"m{rng.randrange(3)}::{base}", f".{b}.{base}", f"{d}.{b}.{base}"])
        rows.append((10 * occ, (occ // 7) * 37 % 101, name, f"{d}/{b}.py" if occ % 50 else None))
    df = spark.createDataFrame(rows, "occ long, chunk_seq long, name string, path string")
    names_of = {r.occ: [x for x in r.names if x] for r in df.select("occ", build.aliases(df.name, df.path).alias("names")).collect()}
    guess = spark.createDataFrame([(r[0], rng.choice(rows)[2]) for r in rows[::3]], "occ long, entity string") if guessed else None
    want = in_order(rows, names_of)
    assert {r.occ: r.entity for r in build.register(df, guess).collect()} == want and 6 < len(set(want.values())) < 100


def test_rounds_do_not_follow_the_occurrences(spark, monkeypatch):
    """A name of each occurrence hangs on the one before it; that took a round for each."""
    rounds = []
    keep = build.stored
    monkeypatch.setattr(build, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    rows = [(i, i // 8, f"n{i}::g{i // 2}" if i % 2 else f"g{i // 2}", f"p{i // 3}.py") for i in range(60)]
    build.register(spark.createDataFrame(rows, "occ long, chunk_seq long, name string, path string")).collect()
    assert rounds.count("entities") == 1 and rounds.count("state") <= 2


def test_only_names_that_share_an_alias_are_taken_in_order(spark, monkeypatch):
    """Every occurrence went through rounds, and every entity was given its aliases, though next to none was shared or asked for."""
    rng = random.Random(7)
    names, paths = [f"{p}{b}" for p in ("", "b.", "a.b.", "::", "m::", "m::b.", ".b.", "m::a.b.", "d.", "n::m::") for b in ("f", "g", "f.g", "h.")], ["a/b.py", "b.py", "a.py", "c::d/b.py", "", None]
    rows = [(i, i // 3, rng.choice(names + [f"only{i}", f"C{i}.f", f"::C{i}"]), rng.choice(paths)) for i in range(300)]
    df = spark.createDataFrame(rows, "occ long, chunk_seq long, name string, path string")
    users = {}
    for r in df.select("name", build.aliases(df.name, df.path).alias("names")).collect():
        for x in r.names:
            if x is not None:
                users.setdefault(x, set()).add(r.name)
    shared = {n for u in users.values() if len(u) > 1 for n in u}
    found = {r.name for r in build.contested(df).collect()}
    assert shared <= found and not any(n.startswith("only") for n in found) and 10 < len(shared) < len(found) + 1
    monkeypatch.setattr(build, "OFTEN", 2)
    calls = spark.createDataFrame([(f"c{i}", rng.choice(names + ["C1.f", "x.f", "b.C2.f", "nobody", "q::f", "b.x.f"])) for i in range(300)], "chunk_id string, called string")
    known = df.filter("occ % 4 = 0").selectExpr("name", "path", "occ as seq")
    want = build.resolve_calls(calls, build.alias_table(known)).select("chunk_id", "called", "resolved")
    got = build.resolved_calls(calls, known).select("chunk_id", "called", "resolved")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("resolved != called").count() > 10
    monkeypatch.setattr(build, "_in_order", None)
    plain = spark.createDataFrame([(i, i, f"C{i // 2}.f", f"p{i}.py") for i in range(20)], "occ long, chunk_seq long, name string, path string")
    assert {(r.occ, r.entity) for r in build.register(plain).collect()} == {(i, f"C{i // 2}.f") for i in range(20)}
