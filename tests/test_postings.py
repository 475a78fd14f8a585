import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import postings, search


@pytest.fixture
def docs(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (1 + i) for i in range(60)], k=rng.choice([3, 10, 40, 200]))) for _ in range(400)]
    texts[5], texts[6] = "rare " * 4 + texts[5], texts[6] + " rare"
    return [(i, t) for i, t in enumerate(texts)] + [(1000, None), (1001, "")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def full(spark, rows, query, k):
    """The whole scores without an index."""
    scored = search.bm25(frame(spark, [(i, t or "") for i, t in rows]), "id", "text", query)
    return [(r.id, r.score) for r in scored.orderBy(F.desc("score"), "id").limit(k).collect()]


def top(index, query, k):
    return [(r.key, r.score) for r in index.top(query, k).orderBy("rank").collect()]


def test_top_like_full_scores_through_changes(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 8)
    rows = dict(docs)
    index = postings.Index.create(frame(spark, docs[:250]), f"file://{tmp_path}/index", "id", "text")
    rows = dict(docs[:250])

    def same():
        for query, k in (("rare w3", 5), ("w0 w41 nothing", 300)):
            assert top(index, query, k) == full(spark, list(rows.items()), query, k), (query, k)

    index.add(frame(spark, docs[250:]), "id", "text")
    rows |= dict(docs[250:])
    index.delete(frame(spark, docs).filter("id % 7 = 3"), "id")
    rows = {i: t for i, t in rows.items() if i % 7 != 3}
    same()
    index.add(frame(spark, [(5, "now it says something else w1"), (2000, "rare and new")]), "id", "text")
    rows |= {5: "now it says something else w1", 2000: "rare and new"}
    assert top(index, "rare w3", 5) == full(spark, list(rows.items()), "rare w3", 5)
    index.merge()
    assert len(index.manifest()[1]) == 1 and index.living().count() == len(rows)
    index.delete(frame(spark, [(2000, "")]), "id")
    del rows[2000]
    assert top(index, "rare w3", 5) == full(spark, list(rows.items()), "rare w3", 5)
    assert top(index, "absent", 3) == []


def test_blocks_are_skipped(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE", 4)
    index = postings.Index.create(frame(spark, docs), f"file://{tmp_path}/index", "id", "text")
    _, mean, idf = index.figures(["rare", "w0"])
    every, kept = index.headers(idf, mean), index.chosen(2, idf, mean)
    read = every.join(kept, ["segment", "range"], "left_semi").count()
    assert 0 < read < 0.25 * every.count()
    # bounds hold for each document of each block
    blocks = index._read("blocks").filter(F.col("token").isin(list(idf)))
    each = blocks.select("token", "segment", "range", index._part(idf, mean, "max_tf", "min_dl").alias("most"), F.explode("entries").alias("e")).select("token", "most", "e.*")
    assert each.filter(index._part(idf, mean, "tf", "dl") > F.col("most") + 1e-12).count() == 0
