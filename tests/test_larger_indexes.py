"""postings are shuffled once for each segment that is written."""

from loomspark.operators import postings


def test_postings_are_shuffled_once(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(postings, "stored", lambda df, name, keep=postings.stored: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or keep(df, name))
    docs = spark.createDataFrame([(1, "a b a"), (2, "b, c B"), (3, None), (4, "")], "id long, text string")
    index = postings.Index.create(docs, f"file://{tmp_path}/index", "id", "text")
    assert [n for n, p in plans if "Exchange" in p] == []
    index.add(spark.createDataFrame([(2, "d d d")], "id long, text string"), "id", "text")
    index.merge()
    read = index._read("blocks")
    assert {(r.token, e.key, e.tf, e.dl) for r in read.collect() for e in r.entries} == {("a", 1, 2, 3), ("b", 1, 1, 3), ("d", 2, 3, 3)}
    assert sorted(r.key for r in index.living().collect()) == [1, 2, 3, 4]
