"""Work that grows no faster than its input: no broadcast of what was derived, no pairs that are not asked for."""

from pyspark.sql import functions as F

from loomspark.operators import build, extract, graph, search
from loomspark.plans import adapters as A
from loomspark.plans import sources
from loomspark.sources import scratch, tree

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_are_not_broadcast(spark):
    """The words of a small table's files are many."""
    assert "Broadcast" not in plan(sources.mapped(A.Tables(spark, SF))[2])
    assert "Broadcast" not in plan(sources.shown(A.Tables(spark, SF), "cpp"))


def test_names_are_not_broadcast(spark):
    """F1, F2, F5, F6."""
    decl = spark.createDataFrame([(1, 1, "f", "a.py", "c1", "function")], "occ long, chunk_seq long, name string, path string, chunk_id string, type string")
    registered = build.register(decl)
    table = build.alias_table(registered.select(F.col("entity").alias("name"), "path", F.col("occ").alias("seq")))
    resolved = build.resolve_calls(spark.createDataFrame([("c2", "f")], "chunk_id string, called string"), table)
    assert "Broadcast" not in plan(resolved)
    files, chunks = spark.createDataFrame([("a.py",)], "path string"), spark.createDataFrame([("a.py", 0, "c1")], "path string, ord int, chunk_id string")
    assert all("Broadcast" not in plan(x) for x in build.build_graph(files, chunks, registered, resolved))


def test_files_are_dealt_over_tasks(spark, monkeypatch):
    """A table of one small file becomes very many files."""
    monkeypatch.setattr(sources, "FILES_PER_TASK", 20)
    t = A.Tables(spark, SF)
    assert sources.files(t, sources.PYTHON).rdd.getNumPartitions() >= t.part.count() // 20


def test_edges_are_dealt_by_their_number(spark, monkeypatch):
    """a task's share of a graph's edges does not grow with the graph; a node with very many edges is cut in parts."""
    monkeypatch.setattr(graph, "ROWS_PER_TASK", 50)
    edges = spark.createDataFrame([("hub", f"n{i:04d}", "contains") for i in range(300)] + [("n0001", "hub", "calls")] * 2, "src string, dst string, relation string")
    nodes = edges.select(F.col("dst").alias("node_id"), F.lit("k").alias("kind"), F.lit("x").alias("name")).distinct()
    few, near = graph.node_edges(edges, 3), graph.neighbors(nodes, edges, 3)
    assert "REPARTITION_BY_NUM" in plan(few) and "REPARTITION_BY_NUM" in plan(near) and "13)" in plan(few)
    assert sorted((r["rank"], r.other, r.n_total, r.has_more) for r in few.filter("node_id = 'hub' and direction = 'outgoing'").collect()) == [(k, f"n{k - 1:04d}", 300, True) for k in (1, 2, 3)]
    assert sorted((r["rank"], r.neighbor, r.direction) for r in near.filter("node_id = 'hub'").collect()) == [(1, "n0000", "outgoing"), (2, "n0001", "outgoing"), (3, "n0002", "outgoing")]


def test_graph_files_are_parsed_once(spark, tmp_path):
    """each join with the nodes of a JSON graph parsed its files again."""
    edges = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, relation string")
    tree.save_graph_json(spark.createDataFrame([("a", "file", "a"), ("b", "file", "b")], "node_id string, kind string, name string"), edges, str(tmp_path / "g"))
    n, e = tree.load_graph_json(spark, str(tmp_path / "g"))
    assert "FileScan json" not in plan(e.join(n, e.src == n.node_id)) and [(r.src, r.dst, r.relation) for r in e.collect()] == [("a", "b", "calls")]


def test_tokens_are_not_shuffled_before_they_are_counted(spark, tmp_path, monkeypatch):
    """a text's tokens are counted within it."""
    plans = []
    monkeypatch.setattr(search, "stored", lambda df, name, keep=scratch.stored: plans.append(plan(df)) or keep(df, name))
    search.save_index(spark.createDataFrame([(1, "a b A"), (2, None), (3, "")], "id long, text string"), "id", "text", f"file://{tmp_path}/i")
    assert len(plans) == 1 and "Exchange" not in plans[0]
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/i/postings").select("token", "id", "tf", "dl").collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3)]


def test_files_of_all_languages_are_read_in_one_pass(spark):
    """a table of files was filled and read once for Python, once for other languages, and once for scripts of pages."""
    rows = [("a.py", "def f(): g()"), ("b.js", "function h() {}"), ("c.html", "<p id=top onclick='hit(1)'></p>"), ("d.md", "f()"), ("e.py", None)]
    found = extract.entities(spark.createDataFrame(rows, "path string, content string"))
    assert plan(found).count("MapInArrow") + plan(found).count("MapInPandas") == 1
    assert {(r.path, r.role, r.name, r.pos) for r in found.collect()} == {("a.py", "declared", "f", 0), ("a.py", "called", "g", 1), ("b.js", "declared", "h", 0), ("c.html", "called", "hit", 0), ("c.html", "declared", "top", 0)}


def test_deep_python_is_read_whole():
    """a walk by recursion gave up a file with a long sum."""
    rows = extract.read_entities("class A:\n  x = " + " + ".join(["f()"] * 600) + "\ndef g(n: int): A.h()", "python")
    assert {r[1] for r in rows} == {"A", "f", "g", "n", "A.h"}


def test_forms_of_all_languages_are_read_together(spark):
    """the files of each language had passes of their own, and the markup that they don't hold was sought for each."""
    found = plan(sources.form_entities(A.Tables(spark, SF)))
    assert found.count("MapInArrow") + found.count("MapInPandas") == 1 and found.count("SortAggregate") + found.count("HashAggregate") <= 4


def test_ids_of_few_bytes_are_not_broadcast(spark, monkeypatch):
    """files in which ids take few bytes hold more rows than a driver has room for."""
    plans = []
    keep = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: plans.append(plan(df)) or keep(df, name))
    monkeypatch.setattr(scratch, "BROADCAST_CHARACTERS", 2000)
    edges = spark.createDataFrame([("a", f"n{i:03d}", "x") for i in range(200)] + [(f"n{i:03d}", f"t{i:03d}", "x") for i in range(200)], "src string, dst string, relation string")
    targets = spark.createDataFrame([(f"t{i:03d}",) for i in range(201)], "node_id string")
    found = graph.find_paths(edges, spark.createDataFrame([("a",)], "node_id string"), targets, 3)
    assert sorted((r.target, r.status, r.length, r.path) for r in found.collect()) == [(f"t{i:03d}", "found", 2, f"a>n{i:03d}>t{i:03d}") for i in range(200)] + [("t200", "none", None, "")]
    assert "Broadcast" in plans[1] and "SortMergeJoin" in plans[2]  # a step from one node, and one from 200
    assert "SortMergeJoin" in plans[-1] and "Broadcast" not in plan(found)


def test_nodes_of_few_bytes_are_not_broadcast(spark, tmp_path):
    """nodes of a stored graph, most columns of which are empty."""
    edges = spark.createDataFrame([("a", f"n{i:03d}", "x") for i in range(200)], "src string, dst string, relation string")
    nodes = edges.select(F.col("dst").alias("node_id"), F.lit("k").alias("kind"), F.lit("x").alias("name"))
    tree.save_graph_json(nodes, edges, str(tmp_path / "g"))
    assert "BroadcastHashJoin" not in plan(tree.load_graph_json(spark, str(tmp_path / "g"))[1])
    tree.save_graph(nodes, edges, str(tmp_path / "h"))
    nodes, edges = tree.load_graph(spark, str(tmp_path / "h"))
    assert "Broadcast" not in plan(graph.related(nodes, edges))


def test_chunks_of_a_file_are_not_shuffled(spark):
    """words, code and found entities were shuffled, several times what the files take."""
    found = plan(sources.shown(A.Tables(spark, SF), "cpp"))
    assert "Exchange" not in found[: found.index("MapInArrow")]
    code = "class A:\n    def go(self):\n        return self.stop(x::y)\n\n\n# go()\nb = A().go() + go('go')\n\n\ndef go(): pass\n"
    page = "<p id=top class='a b' onclick='go(1)'>go</p>\n\n\n<script>function go() {}</script> top"
    rows = [("a.py", code), ("b.py", "def ("), ("c.html", page), ("d.cpp", "class P {};\n\n\nP::go(int n) { go(n); }"), ("e.py", None), ("f.md", "go()"), ("g.py", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    for cut in (sources.chunked, sources.cut_at("\n", "cpp")):
        want = extract.entities_in_chunks(extract.entities(files), cut(files))
        listed = lambda df: sorted(map(str, df.collect()))
        assert listed(extract.located(files, cut)) == listed(want) == listed(extract.located(files, lambda f, cut=cut: cut(f))) and want.count() > 5
        once = want.groupBy(*[c for c in want.columns if c != "pos"]).agg({"pos": "min"}).drop("min(pos)")
        assert listed(extract.located(files, cut, True).select(*once.columns)) == listed(once)
