import random

import brute
import numpy as np
import pytest

from loomspark.llm import common, nearcopies, oddsketch


def shingles(text):
    w = brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 2]) for i in range(max(len(w) - 1, 1))} if w else set()


def changed(text, n, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), min(n, len(w))):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def similar(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize(("tile", "seed"), [(512, 1), (5, 2)])
def test_components_like_brute_force(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(oddsketch, "TILE", tile)
    rng = random.Random(seed)
    rows, base = [], [" ".join(f"w{rng.randrange(2000)}" for _ in range(n)) for n in (5, 9, 12, 40, 200, 1000)]
    for text in base:
        n = len(text.split())
        for k in range(25):
            rows.append(text if k < 3 else changed(rows[-1] if k % 2 else text, max(1, rng.randrange(n // 6 + 1)), rng))
    rows += ["a", "A", "a b", "É b", "é b", None, "", " \t", "one two three", "ONE two three"]
    docs = [(i, t) for i, t in enumerate(rows)]
    sets = {d: shingles(t) for d, t in docs}
    root = brute.roots(sets, lambda a, b: similar(sets[a], sets[b]))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, own string, n long")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in oddsketch.near_duplicates(df).collect()}
    assert got == {d: (len(sets[d]), root[d]) for d in sets}
    assert len(set(root.values())) > 20


def test_ids_that_repeat_or_are_missing(spark):
    text = "some words that stand in every one of these texts"
    rows = [(7, text), (7, "quite another text under that id"), (7, text), (None, text), (None, "only rows without an id"), (None, None), (3, text + " more"), (9, None)]
    got = sorted(map(tuple, oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 9, 3), (7, 5, 7), (7, 9, 3), (None, 9, 3), (None, 4, None), (None, 0, None), (3, 10, 3), (9, 0, 9)], key=str)
    assert oddsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    off, refuted = [], 0
    for similarity in (0.8, 0.9, 0.97):
        for _ in range(60):
            n = 600
            common_part = int(round(2 * n * similarity / (1 + similarity)))
            all_values = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = all_values[:n], all_values[n - common_part : 2 * n - common_part]
            true = common_part / (2 * n - common_part)
            _, odd = oddsketch.sketch(np.concatenate([a, b]), np.array([n, n]))
            ones = int(np.bitwise_count(odd[0].view(np.uint64) ^ odd[1].view(np.uint64)).sum())
            off.append(oddsketch.estimate(ones) - true)
            refuted += oddsketch.highest()[ones] < true
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05 and not refuted
    table = oddsketch.chances()
    assert np.allclose(table.sum(axis=1), 1) and abs(oddsketch.estimate(table[-40] @ np.arange(table.shape[1])) - (1 - 39 / 200)) < 0.02
    assert oddsketch.highest()[oddsketch.BITS // 2 - 10] < 0.8 and (np.diff(oddsketch.highest()) <= 0).all()


def thue_morse(a, b, n):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_word_hashes_tell_words_apart_whose_sums_are_equal():
    words = [thue_morse("a", "b", 1024), thue_morse("b", "a", 1024), "a", "b", "ab", "ba", "a" * 8, "a" * 9, "a" * 16, "a" * 64, "a" * 65, ""]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    for kind in (0, 1):
        got = common.word_hashes(data, ends - [len(w) for w in words], ends, kind)
        assert len(set(got.tolist())) == len(words)
    shifted = np.frombuffer(("xyz" + "".join(words)).encode(), np.uint8)
    assert (common.word_hashes(shifted, ends - [len(w) for w in words] + 3, ends + 3) == common.word_hashes(data, ends - [len(w) for w in words], ends)).all()
    assert len(nearcopies.shingle_hashes(data, np.array([0, len(data)]), 2)[0]) == 1
