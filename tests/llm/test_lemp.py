import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import lemp


def brute(rows, anchors, relabel):
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score); rows: (vec_id, embedding, label)."""
    good = [(i, [math.floor(256 * x) for x in v], relabel(i, y), n) for n, (i, v, y) in enumerate(rows) if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    key = lambda s: (-s[0], s[1] is None, s[1] or 0, s[2])
    out = []
    for i, v, y, n in good:
        if i is None or not anchors(i):
            continue
        scored = [(dot(v, w), j, m, z) for j, w, z, m in good if m != n]
        for p, pid, _, _ in sorted((s for s in scored if s[3] == y), key=key)[:5]:
            fit = sorted((s for s in scored if s[3] != y and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:10]
            out += [(i, pid, r, s[1], p, s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out, key=str)


def query(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, lemp.hard_negatives(df, F.col("vec_id") % 5 == 0, label).collect()), key=str)


def relabel(i, y):
    return (y + 1) % 10 if i is not None and i % 7 == 0 else y


@pytest.mark.parametrize(("parts", "bucket"), [(3, 16), (1, 512)])
def test_like_brute_force(spark, monkeypatch, parts, bucket):
    monkeypatch.setattr(lemp, "LEAST_PARTS", parts)
    monkeypatch.setattr(lemp, "BUCKET", bucket)
    rng = random.Random(parts)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(300):
        c, size = rng.choice(centres), rng.choice([0.1, 1, 1, 5])
        rows.append((i, [size * (x + rng.gauss(0, 0.4)) for x in c], rng.randrange(4)))
    rows += [rows[10], rows[10], (10, rows[11][1], 2), (None, rows[12][1], 1), (None, rows[12][1], 2), (400, [0.0] * 8, 1), (401, [0.0] * 8, 2), (405, [], 1), (410, [1.0, 2.0], 3)]
    rows += [(420, None, 1), (425, [1.0, None], 1), (430, [float("nan")], 1), (435, [float("inf")], 1), (440, [1.0] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, part string, uid int")
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    want = brute(rows, lambda i: i % 5 == 0, relabel)
    assert query(df.coalesce(1)) == want and len(want) > 500
    assert query(df.limit(0)) == []


def test_pruning_leaves_few_candidates_and_none_that_count():
    rng = np.random.default_rng(2)
    v = np.floor(256 * rng.normal(size=(512, 6)) * np.exp(0.1 * rng.normal(size=(512, 1))))
    v = v[np.argsort(-np.abs(v @ v.T).diagonal())][100:300]
    n = len(v)
    rows = lemp.Rows(v, np.sqrt((v * v).sum(1)), np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool), np.arange(n))
    bucket, pruned = lemp.Bucket(rows), 0
    for q in np.floor(256 * rng.normal(size=(50, 6))):
        length = math.sqrt(q @ q)
        focus = np.argsort(-np.abs(q))[: lemp.FOCUS]
        all_scores = v @ q
        for least in np.quantile(all_scores, [0, 0.3, 0.9, 0.99, 1]):
            found = set(bucket.candidates(q / length, length, focus, float(least)).tolist())
            assert set(np.flatnonzero(all_scores >= least).tolist()) <= found
            pruned += n - len(found)
    assert pruned > 0.3 * 250 * n


def test_large_scores_are_exact(spark):
    big = 2.0**22
    rows = [(10, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big / 2, 1.0], 2), (3, [big / 2, 2.0], 2), (5, [1e30, 1.0], 3), (6, [1e30, 2.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = query(df)
    want = [r for r in brute(rows, lambda i: i % 5 == 0, relabel) if r[0] == 10]
    assert [r for r in got if r[0] == 10] == want and want
