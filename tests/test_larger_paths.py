"""Paths of many pairs: work that grows no faster than its input."""

from loomspark.operators import graph


def test_a_hub_does_not_meet_all_its_pairs(spark, tmp_path, monkeypatch):
    """300 pairs of one source that is near 300 nodes: what is stored stays in proportion."""
    rows = [("hub", f"m{i:03d}") for i in range(300)] + [(f"m{i:03d}", f"t{i:03d}") for i in range(300)]
    edges = spark.createDataFrame([(*r, "x") for r in rows], "src string, dst string, relation string")
    pairs = spark.createDataFrame([("hub", f"t{i:03d}") for i in range(300)], "src string, dst string")
    sizes, keep = [], graph.stored

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    found = graph.paths_between(edges, pairs, 4)
    got = {(r.src, r.dst): (r.length, r.path) for r in found.collect()}
    assert got == {("hub", f"t{i:03d}"): (2, f"hub>m{i:03d}>t{i:03d}") for i in range(300)}
    assert max(sizes) <= 600  # the edges
    # both ways of meeting: a target near many nodes, ties by the least path
    rows = [("s1", f"m{i}") for i in range(5)] + [(f"m{i}", "t") for i in (4, 2, 3)] + [(f"z{i}", "m2") for i in range(9)]
    edges = spark.createDataFrame([(*r, "x") for r in rows], "src string, dst string, relation string")
    found = graph.paths_between(edges, spark.createDataFrame([("s1", "t"), ("z1", "t"), ("t", "s1")], "src string, dst string"), 3)
    assert sorted((r.src, r.dst, r.length, r.path) for r in found.collect()) == [("s1", "t", 2, "s1>m2>t"), ("z1", "t", 2, "z1>m2>t")]


def test_a_path_is_met_once(spark, monkeypatch):
    """halves met at each node of a path, and each half was shuffled with the whole of its way."""
    import random

    draw = random.Random(9)
    links = sorted({(f"v{draw.randrange(24):02d}", f"v{draw.randrange(24):02d}") for _ in range(60)})
    nodes = [f"v{i:02d}" for i in range(24)]
    edges = spark.createDataFrame([(*e, "x") for e in links], "src string, dst string, relation string")
    pairs = spark.createDataFrame([(a, b) for a in nodes for b in nodes], "src string, dst string")
    for depth in (1, 2, 3, 4, 5):
        want, ways = {}, {(a,): a for a in nodes}
        for _ in range(depth + 1):
            for way in sorted(ways):
                if len(way) - 1 <= want.get((way[0], way[-1]), (99,))[0]:
                    want.setdefault((way[0], way[-1]), (len(way) - 1, ">".join(way)))
            ways = {(*way, b): b for way in ways for a, b in links if a == way[-1] and b not in way}
        got = graph.paths_between(edges, pairs, depth).collect()
        assert {(r.src, r.dst): (r.length, r.path) for r in got} == want and len(got) == len(want)
    # targets one step from a middle that is two steps from their source: only the middle is met
    rows = [("r", "n"), ("n", "s")] + [("s", f"o{i:03d}") for i in range(200)]
    sizes, keep = {}, graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: sizes.setdefault(name, (keep(df, name), df))[0] if name == "ahead" else keep(df, name))
    edges = spark.createDataFrame([(*e, "x") for e in rows], "src string, dst string, relation string")
    found = graph.paths_between(edges, spark.createDataFrame([("r", f"o{i:03d}") for i in range(200)], "src string, dst string"), 4)
    assert {(r.dst, r.length, r.path) for r in found.collect()} == {(f"o{i:03d}", 3, f"r>n>s>o{i:03d}") for i in range(200)}
    assert sizes["ahead"][0].count() <= 2
