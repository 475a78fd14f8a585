import random

import brute
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomspark.llm import nearcopies, simhash
from loomspark.llm.common import text_bytes


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b) if a or b else True


def changed(text, n, rng):
    w = text.split()
    for i in rng.sample(range(len(w)), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_of_the_stage(spark):
    rng = random.Random(1)
    rows, pairs = [], {}
    for words, changes in ((200, 1), (500, 5), (1000, 5), (200, 3), (300, 6)):
        for _ in range(20):
            text = " ".join(f"w{rng.randrange(5000)}" for _ in range(words))
            pairs[len(rows)] = len(rows) + 1
            rows += [(len(rows), text), (len(rows) + 1, changed(text, changes, rng))]
        assert similar(shingles(rows[-1][1]), shingles(rows[-2][1]))
    far = [(1000 + i, changed(rows[0][1], 12, rng)) for i in range(10)]  # 200 words, 12 of them changed: about 0.54
    assert not any(similar(shingles(t), shingles(rows[0][1])) for _, t in far)
    docs = spark.createDataFrame(rows + far, "doc_id long, text string")
    sets = {d: shingles(t) for d, t in rows + far}
    root = brute.roots(sets, lambda a, b: similar(sets[a], sets[b]))
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert got == {d for d in root if root[d] == d} and {d for d, _ in far} <= got


@pytest.mark.parametrize(("tile", "seed"), [(4, 1), (512, 3)])
def test_crowded_groups_like_brute_force(spark, monkeypatch, tile, seed):
    monkeypatch.setattr(nearcopies, "TILE", tile)
    rng = random.Random(seed)
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text if i < 3 else changed(text, rng.choice([1, 3, 5, 7, 9]), rng)) for i in range(30)]
    for i in range(30, 40):
        rows.append((i, changed(rows[-1][1], 4, rng)))
    sets = {d: shingles(t) for d, t in rows}
    root = brute.roots(sets, lambda a, b: similar(sets[a], sets[b]))
    got = {}
    for r in nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.root, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(d for d in root if root[d] == k) for k in set(root.values()))


def test_edge_cases(spark):
    rows = [(5, "a b c d"), (2, "A B C D"), (2, "A B C D"), (2, "other words that share this id"), (None, "a b c d"), (9, None), (8, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, nearcopies.keep_one(df).collect()), key=str) == sorted([(2, "A B C D"), (2, rows[3][1]), (None, "a b c d"), (8, " ")], key=str)
    assert nearcopies.keep_one(df.limit(0)).count() == 0


def test_overlaps_in_parts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(25)]
    at = np.cumsum([0, *map(len, sets)])
    got = nearcopies.overlaps(np.concatenate(sets), at, columns=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(25) if i != j)


def test_fingerprints_give_candidates(spark, monkeypatch):
    """with no two texts in one band, near copies within two bits of SimHash are found all the same, and confirmed on whole sets."""
    monkeypatch.setattr(nearcopies, "_bands", lambda hashes, n: np.random.default_rng().integers(-(2**62), 2**62, (len(n), nearcopies.BANDS)))
    rng = random.Random(2)
    rows, near = [], set()
    for k in range(12):
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(4000))
        copy = changed(text, 1, rng)
        fp = [int(simhash._fingerprints(*text_bytes(pa.array([t])), nearcopies.SHINGLE)[0]) for t in (text, copy)]
        rows += [(2 * k, text), (2 * k + 1, copy)]
        near |= {2 * k + 1} if 0 < (fp[0] ^ fp[1]).bit_count() <= simhash.MOST else set()
    line = "the same line again and again "  # its repeats decide the bits, but one text has many other words
    rows += [(100, line * 3000 + "the end"), (101, line * 3000 + " ".join(f"x{i}" for i in range(40)))]
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(near) >= 4 and not near & got and {100, 101} <= got and {2 * k for k in range(12)} <= got
