import random

import brute
import pytest

from loomspark.llm import simhash


def texts(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(rng.randint(1, 200))) for _ in range(n // 3)]
    out = [None, "", "  ", "Word", "TWO words", "É É É", *base]
    while len(out) < n:
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
        out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    return out


def test_components_like_brute_force(spark):
    docs = list(enumerate(texts(4)))
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, fp long")).collect()}
    prints = {d: brute.fingerprint(t) for d, t in docs}
    root = brute.roots(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert got == {d: (prints[d], root[d]) for d in prints}


@pytest.mark.parametrize("pairwise", [1, 3, 64])
def test_links_connect_all_near_fingerprints(spark, pairwise):
    rng = random.Random(pairwise)
    fps = {0, 1, 3, 7}
    centre = rng.getrandbits(64)
    for _ in range(40):
        x = centre
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps |= {x, rng.getrandbits(64)}
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for plan in (simhash.plan_groups(df), [(list(range(32)), 1), (list(range(32, 64)), 0)], [(list(range(21)), 0), (list(range(21, 42)), 0), (list(range(42, 64)), 0)]):
        found = {(r.a, r.b) for r in simhash.links(df, plan, pairwise=pairwise).collect()}
        assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in found)
        near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        assert brute.roots(signed, near) == brute.roots(signed, lambda a, b: (a, b) in found or (b, a) in found)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i * 3 % 7, 107) for i in range(7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(41)) and all(got.get(100 + i, 100) == 100 for i in range(8))


def test_thresholds_add_up():
    cost, chosen = simhash.best_thresholds([{-1: 0, 0: 5, 1: 9}, {-1: 0, 0: 1, 1: 3}], 1)
    assert (cost, chosen) == (8, [0, 1])
    assert simhash.best_thresholds([{0: 1}], 5)[0] == float("inf")


def test_keep_one_and_edge_cases(spark):
    rows = [(5, "a b c d", "k"), (2, "A B C D", "k"), (2, "A B C D", "k"), (None, "a b c d", "k"), (9, None, "k"), (8, " ", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str) == sorted([(2, "A B C D"), (None, "a b c d"), (8, " ")], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.keep_one(df.limit(0)).count()
    other = spark.createDataFrame([(2, "a b c d", "k"), (2, "quite another text that shares the id", "k")], df.schema)
    assert simhash.keep_one(other).count() == 2
