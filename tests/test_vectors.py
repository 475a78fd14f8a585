import numpy as np
import pytest

from loomspark.operators import vectors
from loomspark.plans import registry

SF = "/root/testdata/sf0.1"


def exact(rows, queries, k):
    out = {}
    for i, q in queries:
        d = sorted((round(float(((np.array(v) - np.array(q)) ** 2).sum()), 9), j) for j, v in rows if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


def test_recall_of_the_registered_query(spark):
    got = registry.QUERIES["knn_index"](spark, SF).collect()
    want = registry.QUERIES["knn_index_exact"](spark, SF).collect()
    pairs = {(r["query"], r.vec_id) for r in want}
    assert len(want) == 200 and len({(r["query"], r.vec_id) for r in got} & pairs) >= 0.9 * len(pairs)


@pytest.mark.parametrize(("rows_at_once", "queries_at_once"), [(8192, 1024), (7, 3)])
def test_exact_search_like_brute_force(spark, tmp_path, monkeypatch, rows_at_once, queries_at_once):
    monkeypatch.setattr(vectors, "ROWS", rows_at_once)
    monkeypatch.setattr(vectors, "QUERIES", queries_at_once)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.choice([1, 1, 10])).round(3).tolist()) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    path = f"file://{tmp_path}/index"
    vectors.save_index(df.filter("vec_id < 100").union(spark.createDataFrame([(999, None), (998, [])], df.schema)), path, cells=9)
    vectors.add_to_index(df.filter("vec_id >= 100"), path)
    asked = df.filter("vec_id % 4 = 0")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = exact(rows, [(r.vec_id, r.embedding) for r in asked.collect()], 5)
    got = {}
    for r in vectors.nearest_exact(spark, path, asked, 5, probes=2, other_keys=True).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.key)
    assert got == want
    assert vectors.nearest_exact(spark, path, asked.limit(0), 5).count() == 0
    assert spark.read.parquet(f"{path}/cells").agg({"n": "sum"}).first()[0] == 190


def test_only_probed_cells_are_read(spark, tmp_path):
    rows = [(i, [float(i % 4) * 100, float(i) / 100]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    vectors.save_index(df, f"file://{tmp_path}/index", cells=4)
    near = df.filter("vec_id in (4, 8)")
    before = vectors.nearest(spark, f"file://{tmp_path}/index", near, 3, probes=1).collect()
    cell = vectors._probed(vectors._vectors(near, "vec_id", "embedding"), vectors.centres_of(spark, f"file://{tmp_path}/index"), 1).first().cell
    for folder in (tmp_path / "index/lists").glob("cell=*"):
        if folder.name != f"cell={cell}":
            for file in folder.glob("*.parquet"):
                file.write_bytes(b"no table")
    assert vectors.nearest(spark, f"file://{tmp_path}/index", near, 3, probes=1).collect() == before and len(before) == 6


def test_vectors_of_two_lengths_raise(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="one length"):
        vectors.save_index(df, f"file://{tmp_path}/bad", cells=1)
