import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators.versions import Versions
from loomspark.plans import sources
from loomspark.streaming.graphs import Graph


def test_versions_like_copies_of_the_table(spark, tmp_path):
    rng = random.Random(3)
    table = Versions(spark, f"file://{tmp_path}/t", "path string, ord int, content string", ["path", "ord"])
    assert table.as_of().count() == 0
    state, copies = {}, [{}]
    for batch in range(5):
        scope = rng.sample("abcdef", 3)
        new = {(p, o): rng.choice([None, "x", "y"]) for p in scope if rng.random() < 0.8 for o in range(rng.randrange(4))}
        state = {k: v for k, v in state.items() if k[0] not in scope} | new
        copies.append(dict(state))
        rows = spark.createDataFrame([(*k, v) for k, v in new.items()], table.schema)
        change = spark.createDataFrame([(p,) for p in scope], "path string")
        assert table.commit(rows, change, batch) == batch + 1 == table.commit(rows, change, batch)
    for v, copy in enumerate(copies):
        assert {(r.path, r.ord): r.content for r in table.as_of(v).collect()} == copy
    assert {(r.path, r.ord): r.content for r in table.as_of(99).collect()} == copies[-1]
    for r in table.history().collect():
        holds = [v for v, copy in enumerate(copies) if copy.get((r.path, r.ord), "none") == r.content]
        assert set(range(r.valid_from, r.valid_to or len(copies))) <= set(holds) and (r.valid_to is None or r.valid_to not in holds)
    for a, b in ((0, 5), (1, 3), (2, 2)):
        want = {(k, "added" if k not in copies[a] else "removed" if k not in copies[b] else "changed") for k in {**copies[a], **copies[b]} if copies[a].get(k, 0) != copies[b].get(k, 0)}
        assert {((r.path, r.ord), r.status) for r in table.changes(a, b).collect()} == want


@pytest.mark.parametrize("seed", [1])
def test_graph_of_batches_like_one_build(spark, tmp_path, seed):
    rng = random.Random(seed)
    code = lambda k, n: f"class C{k}:\n    pass\n\n\ndef f{k}():\n    return f{n}() + shared()\n\n\ndef shared():\n    return C{n}()\n"
    graph = Graph(spark, f"file://{tmp_path}/g", sources.chunked)
    now, states, seq = {}, [], 0
    for _ in range(3):
        rows = []
        for k in rng.sample(range(8), 4):
            for _ in range(rng.choice([1, 2])):
                seq += 1
                content = None if rng.random() < 0.2 else code(k, rng.randrange(8))
                rows.append((f"d{k % 2}/m{k}.py", content, seq))
                now[rows[-1][0]] = content
        rng.shuffle(rows)
        rows.append((rows[0][0], "late = 1", 0))  # an older version that comes late
        graph.apply(spark.createDataFrame(rows, "path string, content string, seq long"))
        states.append({p: c for p, c in now.items() if c is not None})
    for version, state in ((3, states[2]), (2, states[1])):
        whole = Graph(spark, f"file://{tmp_path}/w{version}", sources.chunked)
        whole.apply(spark.createDataFrame([(p, c, 1) for p, c in state.items()], "path string, content string, seq long"))
        for got, want in zip(graph.graph(version), whole.graph(), strict=True):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert graph.names.as_of(3).filter(F.col("name") == "shared").count() > 0


def test_streamed_names_that_are_not_shared_are_not_ordered(spark, tmp_path, monkeypatch):
    """all declarations were sorted, numbered and kept with their answers, and the first version was compared with nothing."""
    from loomspark.streaming import graphs

    written = []
    keep = graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda df, name: written.append(name) or keep(df, name))
    graph = Graph(spark, f"file://{tmp_path}/g", sources.chunked)
    code = "class {c}:\n    def {m}(self):\n        return run{k}()\n\n\ndef run{k}():\n    return {c}().{m}() + shared()\n"
    make = lambda c, m: spark.createDataFrame([(f"a/b{k}.py", code.format(c=f"{c}{k}", m=f"{m}{k}", k=k), 1) for k in range(5)], "path string, content string, seq long")
    graph.apply(make("C", "go"))
    edges = graph.graph()[1]
    assert ("chunk:a/b1.py_0", "entity:C1.go1", "declares") in {tuple(r) for r in edges.collect()} and "declared" not in written
    assert "registered" not in written and not (tmp_path / "g" / "answers").exists()
    # methods with the names of functions do share aliases, and are taken in order
    graph.apply(make("D", "run").withColumn("seq", F.lit(2).cast("long")))
    whole = Graph(spark, f"file://{tmp_path}/w", sources.chunked)
    whole.apply(make("D", "run"))
    again = graph.graph()
    for got, want in zip(again, whole.graph(), strict=True):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert written.count("declared") == 2 and ("chunk:a/b1.py_0", "entity:D1.run1", "declares") in {tuple(r) for r in again[1].collect()}
