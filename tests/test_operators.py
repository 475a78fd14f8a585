"""Operators on small hand-made inputs, and against plain Python."""

import ast
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from loomspark.functions import names
from loomspark.operators import build, catalog, chunks, extract, graph, mining, search, vectors
from loomspark.sources import tree
from loomspark.streaming import ingest

MODULE = '''
import os
from app.db import Session


class Base:
    pass


class Store(Base):
    def __init__(self, size: int):
        self.size = size
        self.db = Session()

    def load(self, key):
        return self.read(key)


app = FastAPI()


@app.get("/items/{item}")
def item(item: str):
    s = Store(3)
    s.load(item)
    return helper(item)
'''

JAVA = """package com.shop;
import java.util.List;
@RequestMapping("/api")
public class A extends B {
  private int n = 1; // class Ghost {
  A() { String s = "{"; run(); }
  @RequestMapping(value = "/x/{id}", method = {RequestMethod.GET, RequestMethod.PUT})
  public List<String> find() { return new Thing(1); }
  int go(final int a) { return a; }
}
"""


def edges(spark, pairs, relation="contains"):
    return spark.createDataFrame([(a, b, relation) for a, b in pairs], "src string, dst string, relation string")


def nodes(spark, ids):
    return spark.createDataFrame([(i, "k", i) for i in ids], "node_id string, kind string, name string")


def test_reach_and_paths_like_plain_search(spark):
    rng = random.Random(5)
    ids = [f"n{i:02d}" for i in range(30)]
    pairs = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(45)})
    depth, front = {"n00": 0}, ["n00"]
    while front:
        step = sorted({b for a, b in pairs if a in front and b not in depth})
        depth.update(dict.fromkeys(step, max(depth.values()) + 1))
        front = step
    start = spark.createDataFrame([("n00",)], "node_id string")
    got = {r.node_id: r.depth for r in graph.reach(edges(spark, pairs), start, 4).collect()}
    assert got == {k: v for k, v in depth.items() if v <= 4}
    targets = spark.createDataFrame([(i,) for i in [*ids, "absent"]], "node_id string")
    for r in graph.find_paths(edges(spark, pairs), start, targets, 4).collect():
        if depth.get(r.target, 9) > 4:
            assert (r.status, r.path) == ("none", "")
        else:
            path = r.path.split(">")
            assert len(path) == r.length + 1 == depth[r.target] + 1
            assert path[0] == "n00" and path[-1] == r.target and all(p in pairs for p in zip(path, path[1:], strict=False))


def test_tree_stops_at_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c")])
    got = graph.tree(nodes(spark, "abc"), e, spark.createDataFrame([("a",)], "node_id string"), 5)
    assert sorted(r.path for r in got.collect()) == ["a", "a>b", "a>b>c"]


def test_subgraph_keeps_all_relations_unless_filtered(spark):
    e = edges(spark, [("a", "b"), ("b", "c")]).unionByName(edges(spark, [("c", "a")], "declares"))
    start = spark.createDataFrame([("a",)], "node_id string")
    n, among = graph.subgraph(nodes(spark, "abcd"), e, start, 2, ["contains"])
    assert n.count() == 3 and among.count() == 3
    assert graph.subgraph(nodes(spark, "abcd"), e, start, 2, ["contains"], True)[1].count() == 2


def test_neighbors_prefer_outgoing(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("a", "a")])
    got = graph.neighbors(nodes(spark, "ab"), e).collect()
    assert sorted((r.node_id, r.neighbor, r.direction) for r in got) == [("a", "b", "outgoing"), ("b", "a", "outgoing")]


def test_names(spark):
    row = spark.createDataFrame([("src/utils/helper.py", "A::b.c", "run")], "path string, name string, n string")
    r = row.select(names.module_path(F.col("path")).alias("m"), names.simple_name(F.col("name")).alias("s"), names.language(F.col("path")).alias("l"), names.language(F.lit("x.zig")).alias("z"), names.aliases(F.col("n"), F.col("path")).alias("a"), names.aliases(F.col("n"), F.lit("tmpx1/lib/a.py")).alias("t")).first()
    assert (r.m, r.s, r.l, r.z) == ("src.utils.helper", "b.c", "python", "zig")
    assert set(r.a) == {"run", ".helper.run", ".utils.helper.run", "src.utils.helper.run", ".src.utils.helper.run"}
    assert r.t == ["run", ".a.run", ".lib.a.run", "lib.a.run", "tmpx1.lib.a.run"]
    assert row.select(names.include_path(F.lit("<boost/algorithm/string.hpp>")).alias("i")).first().i == "boost.algorithm.string"


def test_resolution_prefers_exact_then_shortest(spark):
    known = spark.createDataFrame([("lib.client.APIClient", "lib/client.py", 0), ("x.y.z.Long.go", "a.py", 1), ("B.go", "b.py", 2)], "name string, path string, seq long")
    calls = spark.createDataFrame([("lib.client.APIClient",), ("APIClient",), ("go",), ("nothing",)], "called string")
    got = {r.called: (r.resolved, r.match_kind) for r in build.resolve_calls(calls, build.alias_table(known)).collect()}
    assert got["lib.client.APIClient"] == ("lib.client.APIClient", "exact")
    assert got["APIClient"] == ("lib.client.APIClient", "simple")
    assert got["go"] == ("B.go", "simple")
    assert got["nothing"] == ("nothing", "none")


def test_registration_joins_names_across_files(spark):
    rows = [(0, 0, "math::Calculator", "a.cpp", "a_0", "class", None), (1, 1, "Calculator", "b.cpp", "b_0", "class", None), (2, 2, "Other", "c.cpp", "c_0", "class", None)]
    got = build.register(spark.createDataFrame(rows, "occ long, chunk_seq long, name string, path string, chunk_id string, type string, dtype string"))
    assert [r.entity for r in got.orderBy("occ").collect()] == ["math::Calculator", "math::Calculator", "Other"]


def test_python_entities_and_endpoints(spark):
    files = spark.createDataFrame([("a.py", MODULE), ("bad.py", "def ("), ("none.py", None)], "path string, content string")
    got = extract.python_entities(files).collect()
    declared = {(r.name, r.type) for r in got if r.role == "declared"}
    assert {("Store", "class"), ("Store.load", "method"), ("Store.size", "variable"), ("item", "api_endpoint"), ("app", "variable")} <= declared
    called = {r.name for r in got if r.role == "called"}
    assert {"os", "app.db", "app.db.Session", "Base", "Store.read", "helper"} <= called
    assert {(r.endpoint, r.method) for r in got if r.type == "api_endpoint"} == {("/items/{item}", "GET")}


@pytest.mark.parametrize(
    ("path", "code", "want"),
    [
        ("A.java", JAVA, {("com.shop.A", "class"), ("com.shop.A::go", "method"), ("com.shop.A::go.a", "variable"), ("com.shop.A::A", "constructor"), ("com.shop.A::n", "variable"), ("com.shop.A::find", "api_endpoint"), ("java.util.List", "import"), ("B", "base"), ("run", "call"), ("Thing", "call")}),
        ("a.ts", "import x from 'lib';\nclass K extends M { go(p) { let q = 1; } }\nfunction f() { axios.post(`/u/${id}`); } // class No {}\nconst g = (z) => { let y = 2; };", {("K", "class"), ("K.go", "method"), ("K.go.p", "variable"), ("K.q", "variable"), ("f", "function"), ("g", "function"), ("g.y", "variable"), ("lib", "import"), ("M", "base"), ("axios.post", "call"), ("API:POST:/u/{param}", "api")}),
        ("a.c", "#include <stdio.h>\nstruct P { int x; };\nstruct P start;\nint main(int n) {\n puts(\"x(\"); }", {("stdio.h", "import"), ("P", "struct"), ("start", "variable"), ("P", "type"), ("main", "function"), ("main.n", "variable"), ("puts", "call")}),
        ("a.cpp", '#include "m.h"\nnamespace n { class C : public D { C(int a); ~C() {} int v() const { return w(); } }; }\nvoid C::run() { go(); }', {("m.h", "import"), ("n::C", "class"), ("D", "base"), ("n::C::C", "method"), ("n::C::C.a", "variable"), ("n::C::~C", "method"), ("n::C::v", "method"), ("w", "call"), ("C::run", "method"), ("go", "call")}),
        ("a.rs", "use std::fs;\nmod m { pub fn h() {} }\nstruct S { pub id: u32 }\nenum E { A, B(X) }\ntrait T {}\nimpl T for S { fn f(&self, k: u8) { g(); p!(1); } }\n#[post(\"/x\")]\nfn e() {}", {("use std::fs;", "import"), ("m", "module"), ("m::h", "method"), ("S", "struct"), ("S.id", "field"), ("E", "enum"), ("E::A", "enum_variant"), ("E::B", "enum_variant"), ("T", "trait"), ("T", "base"), ("S::f", "method"), ("S::f.k", "variable"), ("g", "call"), ("p!", "call"), ("e", "api_endpoint")}),
        ("a.html", "<p id=\"top\" class='big red' onclick=\"hit(1)\"></p><script src=x.js></script><script>function s() { t(); }</script>", {("top", "element"), ("big", "class"), ("red", "class"), ("x.js", "script"), ("hit", "call"), ("s", "function"), ("t", "call")}),
    ],
)
def test_patterns_of_other_languages(spark, path, code, want):
    got = {(r.name, r.type) for r in extract.entities(spark.createDataFrame([(path, code)], "path string, content string")).collect()}
    assert got == want


def test_java_and_rust_endpoints(spark):
    got = extract.entities(spark.createDataFrame([("A.java", JAVA), ("b.rs", '#[route("/r", method="PUT")]\nfn r() {}\n#[get("/u/{id}")]\nasync fn u() {}')], "path string, content string"))
    assert {(r.name, r.endpoint, r.method) for r in got.filter("type = 'api_endpoint'").collect()} == {("com.shop.A::find", "/api/x/{id}", "GET"), ("com.shop.A::find", "/api/x/{id}", "PUT"), ("r", "/r", "PUT"), ("u", "/u/{id}", "GET")}


def test_namespaces_in_chunks(spark):
    c = spark.createDataFrame([("a.cpp", 0, "a_0", "cpp", "class Calc {"), ("a.cpp", 1, "a_1", "cpp", "using namespace math;\nCalc c;"), ("a.cpp", 2, "a_2", "cpp", "Calc d;"), ("a.cpp", 3, "a_3", "cpp", "// Calc(1)\nadd(2)")], "path string, ord int, chunk_id string, language string, content string")
    f = spark.createDataFrame([("a.cpp", "declared", 0, "math::Calc", "class"), ("a.cpp", "called", 1, "add", "call"), ("a.cpp", "declared", 2, "P", "struct")], "path string, role string, pos int, name string, type string")
    assert {(r.name, r.chunk_id) for r in extract.entities_in_chunks(f, c).collect()} == {("math::Calc", "a_0"), ("math::Calc", "a_1"), ("add", "a_3")}


def test_entities_meet_chunks_but_not_comments(spark):
    c = spark.createDataFrame([("a.py", 0, "a_0", "python", "def go():\n    pass  # stop"), ("a.py", 1, "a_1", "python", "go()")], "path string, ord int, chunk_id string, language string, content string")
    f = spark.createDataFrame([("a.py", "declared", 0, "go", "function"), ("a.py", "called", 1, "go", None), ("a.py", "called", 2, "stop", None)], "path string, role string, pos int, name string, type string")
    got = {(r.role, r.name, r.chunk_id) for r in extract.entities_in_chunks(f, c).collect()}
    assert ("declared", "go", "a_0") in got and ("called", "go", "a_1") in got and not any(x[1] == "stop" for x in got)


def test_tree_to_graph_end_to_end(spark, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "src" / "a.py").write_text(MODULE)
    (repo / "top.py").write_text("from src.a import Store\nStore(1)\n")
    (repo / "bin").write_bytes(b"\xff\xfe\x00")
    (repo / ".git").mkdir()
    (repo / ".git" / "x.py").write_text("x = 1")
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.write(repo / "top.py", "top.py")
    assert [r.path for r in tree.read_tree(spark, tree.prepared(str(tmp_path / "r.zip"))).collect()] == ["top.py"]
    files = tree.read_tree(spark, str(repo), skip_dirs=[".git"])
    assert sorted(r.path for r in files.collect()) == ["src/a.py", "top.py"]
    pieces = chunks.split_source(files, 200).withColumn("chunk_id", F.concat_ws("_", "path", "ord")).withColumn("language", F.lit("python"))
    for r in files.collect():
        assert "".join(x.content for x in pieces.filter(F.col("path") == r.path).orderBy("ord").collect()) == r.content
    found = extract.entities_in_chunks(extract.entities(files), pieces)
    decl = found.filter("role = 'declared'").withColumn("occ", F.expr("row_number() over (order by path, ord, pos)").cast("long")).withColumn("chunk_seq", F.expr("dense_rank() over (order by path, ord)").cast("long")).withColumn("dtype", F.lit(None).cast("string"))
    registered = build.register(decl)
    table = build.alias_table(registered.select(F.col("entity").alias("name"), "path", F.col("occ").alias("seq")))
    resolved = build.resolve_calls(found.filter("role = 'called'").select("chunk_id", F.col("name").alias("called")), table)
    n, e = build.build_graph(files, pieces, registered, resolved)
    tree.save_graph(n, e, str(tmp_path / "g"))
    n2, e2 = tree.load_graph(spark, str(tmp_path / "g"))
    assert (n2.count(), e2.count()) == (n.count(), e.count()) == (n.select("node_id").distinct().count(), tree.complete_edges(n, e).count())
    called = {(r.src, r.dst) for r in e2.filter("relation = 'called_by'").collect()}
    assert any(s == "entity:Store" and d.startswith("chunk:top.py") for s, d in called)


def test_flat_round_trip(spark):
    t = spark.createDataFrame([("a", ["x"], None), ("b", [], 3)], "node_id string, aliases array<string>, order_in_file int")
    f = tree.flat(t)
    assert f.filter("node_id = 'a'").first().order_in_file == -1 and dict(f.dtypes)["aliases"] == "string"
    assert [r.aliases for r in tree.unflat(f, {"aliases": "array<string>"}).orderBy("node_id").collect()] == [["x"], []]


def test_graph_json(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes": [{"id": "f", "class": "FileNode", "data": {"name": "f", "node_type": "file"}}], "edges": [{"source": "root", "target": "f", "relation": "contains"}, {"source": "f", "target": "gone", "relation": "contains"}]}')
    n, e = tree.load_graph_json(spark, str(tmp_path / "g.json"))
    assert sorted(r.node_id for r in n.collect()) == ["f", "root"] and [(r.src, r.dst) for r in e.collect()] == [("root", "f")]


def test_listing_patterns(spark):
    files = spark.createDataFrame([("src/a/b.py",), ("src/c.txt",), ("d.py",)], "path string")
    assert sorted(r.path for r in catalog.list_files(files, glob="*.py").collect()) == ["d.py", "src/a/b.py"]
    assert [r.path for r in catalog.list_files(files, "src", recursive=False).collect()] == ["src/c.txt"]
    assert [r.path for r in catalog.list_files(files, glob="[!a-c].py").collect()] == ["d.py"]
    assert [r.path for r in catalog.file_names_by_regex(files, "^c").collect()] == ["src/c.txt"]
    with pytest.raises(Exception, match="unterminated|missing"):
        catalog.file_names_by_regex(files, "(")
    assert [r.path for r in catalog.paged(files, [F.col("path")], 2, 2).collect()] == ["src/c.txt"]
    scored = catalog.search_by_type_and_name(spark.createDataFrame([("k", "test_function"), ("k", "MyTestFunction"), ("k", "tst")], "kind string, name string"), "testfun", "K")
    assert sorted((r.name, r.score) for r in scored.collect()) == [("MyTestFunction", 1), ("test_function", 2)]
    classes = spark.createDataFrame([("A", ["lib.Base"]), ("B", ["Other"])], "name string, bases array<string>")
    assert [r.name for r in catalog.inheriting(classes, "base").collect()] == ["A"]


def test_search(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "vec_id long, embedding array<float>")
    near = vectors.nearest_to_each(v, v.filter("vec_id in (0, 5)"), 2)
    assert sorted((r["query"], r["rank"], r.key) for r in near.collect()) == [(0, 1, 1), (0, 2, 2), (5, 1, 4), (5, 2, 3)]
    whole = vectors.nearest_to_each(v, v, 2).collect()
    monkeypatch.setattr(vectors, "QUERIES", 2)
    monkeypatch.setattr(vectors, "ROWS", 4)
    assert sorted(map(tuple, vectors.nearest_to_each(v, v, 2).collect())) == sorted(map(tuple, whole)) and len(whole) == 12
    d = spark.createDataFrame([(1, "red fish red"), (2, "blue fish"), (3, "")], "id long, text string")
    assert [r.id for r in search.bm25(d, "id", "text", "red fish").orderBy(F.desc("score")).collect()] == [1, 2]
    post, size = search.inverted_index(d, "id", "text")
    assert {(r.token, r.id, r.tf) for r in post.collect()} == {("red", 1, 2), ("fish", 1, 1), ("blue", 2, 1), ("fish", 2, 1)} and size.count() == 3
    length = d.select(search.hashed_embedding(F.col("text"), 8).alias("v")).first().v
    assert abs(sum(x * x for x in length) - 1) < 1e-5


def test_mining(spark):
    trip = spark.createDataFrame([("a", "b", "c1"), ("b", "c", "c2"), ("c", "d", "c3")], "a string, b string, chunk_id string")
    assert [(r.a, r.b) for r in mining.diverse_triplets(trip).collect()] == [("a", "b"), ("c", "d")]
    many = spark.createDataFrame([("a", x, "c1") for x in "bcdefgh"] + [("x", "y", "c2"), ("y", "z", "c3"), ("u", "v", "c4")], "a string, b string, chunk_id string")
    assert [(r.a, r.b) for r in mining.diverse_triplets(many).collect()] == [("a", "b"), ("x", "y"), ("u", "v")]
    calls = spark.createDataFrame([(1, "GET", "http://h/api/users/7?x=1"), (2, "POST", "/api/users/{id}/")], "call_id long, verb string, url string")
    ends = spark.createDataFrame([(1, "/api/users/{user}", ["GET"])], "endpoint_id long, path string, methods array<string>")
    assert [r.call_id for r in mining.endpoint_matches(calls, ends).collect()] == [1]


def test_diff_and_gaps(spark):
    p = spark.createDataFrame([("a", "x\ny", "b", "x\nz"), ("c", "", "d", "q")], "id_a string, text_a string, id_b string, text_b string")
    got = {r.id_a: r for r in chunks.diff_pairs(p).collect()}
    assert "-y" in got["a"].diff and "+z" in got["a"].diff and got["c"].error
    c = spark.createDataFrame([("f", 0, "A"), ("f", 2, "C")], "path string, ord int, content string")
    assert chunks.join_files(c).first().text.endswith("A\n[...]\nC")


def test_stream_of_files(spark, tmp_path):
    source = str(tmp_path / "in")
    for text in ("x" * 2500, "new"):
        spark.createDataFrame([("f", text, 2), ("f", "older", 1)], "path string, content string, seq long").coalesce(1).write.mode("append").parquet(source)
        ingest.stream_chunks(spark, source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.content for r in ingest.latest_chunks(spark, str(tmp_path / "out")).collect()] == ["new"]


def test_python_route_methods():
    parsed = extract._Python()
    parsed.visit(ast.parse('@app.route("/a", methods=["POST", "put"])\ndef a(): pass\n@app.route("/b")\ndef b(): pass\n@bp.delete("/c")\ndef c(): pass\n'))
    assert [(r[4], r[5]) for r in parsed.rows if r[2] == "api_endpoint"] == [("/a", "POST"), ("/a", "PUT"), ("/b", "GET"), ("/c", "DELETE")]


def test_stored_index_and_modes(spark, tmp_path):
    d = spark.createDataFrame([(1, "red fish red", [0.0, 1.0]), (2, "blue fish", [1.0, 0.0]), (3, "", [5.0, 5.0]), (4, None, [9.0, 9.0])], "node_id long, text string, embedding array<float>")
    search.save_index(d, "node_id", "text", str(tmp_path / "i"))
    for q in ("red fish", "blue", "none"):
        got = search.indexed_bm25(spark, str(tmp_path / "i"), "node_id", q).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, search.bm25(d, "node_id", "text", q).collect())), q
    options = {"text": ["text"], "name": "text"}
    assert [(r.node_id, r["rank"]) for r in search.search(d, "fish red", mode="keyword", limit=1, page=2, **options).collect()] == [(2, 2)]
    assert [r.node_id for r in search.search(d, "", [0.0, 1.0], "vector", 2, 1, **options).orderBy("rank").collect()] == [1, 2]
    assert [[r.node_id for r in search.search(d, "blue", [0.0, 1.0], "hybrid", 1, p, **options).collect()] for p in (1, 2)] == [[2], [1]]
    for bad in ({"mode": "other"}, {"mode": "vector"}, {"mode": "keyword", "page": 0}):
        with pytest.raises(ValueError, match="mode|vector|start"):
            search.search(d, "x", **bad)


def test_candidates_results_and_repos(spark, tmp_path):
    c = spark.createDataFrame([(x, x.upper()) for x in "pqr"], "chunk_id string, content string")
    t = spark.createDataFrame([("a", "b", "p", "q", "r"), ("a", "c", "p", "gone", "r")], "a string, b string, decl_a string, decl_b string, chunk_id string")
    assert [(r.text_a, r.text_b, r.call_text) for r in mining.candidate_triplets(t, c).collect()] == [("P", "Q", "R")]
    mining.save_results(c, str(tmp_path / "r"))
    mining.save_results(c.limit(1), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 1
    for repo in ("x", "y"):
        (tmp_path / repo).mkdir()
        (tmp_path / repo / "a.py").write_text("a = 1")
    trees = tree.in_one_graph(tree.read_trees(spark, {r: str(tmp_path / r) for r in "xy"}))
    assert sorted(r.path for r in trees.collect()) == ["x/a.py", "y/a.py"]


def test_registration_like_a_replay_of_tables(spark):
    """Against the rule told plainly: a table of all names, made anew at each chunk."""
    rng = random.Random(11)
    rows = [(i, i // 3, rng.choice(["a", "b", "m::a", "m::b", "x.a", "n::m::a", "f.a", ".f.a"]), rng.choice(["f.py", "d/f.py", "g.py"]), f"c{i // 3}", "k") for i in range(60)]
    d = spark.createDataFrame(rows, "occ long, chunk_seq long, name string, path string, chunk_id string, type string")
    known = {r.occ: r.aliases for r in d.withColumn("aliases", names.aliases(F.col("name"), F.col("path"))).collect()}
    entities, table, chunk, want = {}, {}, None, {}
    for occ, seq, name, *_ in rows:
        if seq != chunk:
            chunk, table = seq, {}
            for e, held in entities.items():
                for a in held:
                    table.setdefault(a, e)
            table.update((e, e) for e in entities)
        found = next((table[a] for a in [name, *known[occ]] if a in table), name)
        entities.setdefault(found, []).extend(known[occ])
        table.update((a, found) for a in known[occ])
        table[found] = found
        want[occ] = found
    assert {r.occ: r.entity for r in build.register(d).collect()} == want and len(set(want.values())) > 2


def test_split_source_shares_and_joins_again(spark):
    text = "".join(f"class A{i}:\n    def run(self):\n        return {i}\n\n" for i in range(40)) + "x" * 900
    rows = [("a.py", "python", text), ("b.txt", "other", "é" * 250), ("short", "python", "x = 1"), ("blank", "python", ""), ("none", "python", None)]
    files = spark.createDataFrame(rows, "path string, language string, content string")
    for overlap in (0, 30):
        pieces = chunks.split_source(files, 100, overlap)
        assert {r.path: r.content for r in chunks.rejoined(pieces).collect()} == {p: c for p, _, c in rows if c}
        found = {}
        for r in pieces.orderBy("path", "ord").collect():
            assert len(r.content) <= 100 and (r.ord > 0 or r.shared == 0)
            if r.ord:
                assert r.shared <= overlap and found[r.path].endswith(r.content[: r.shared]) and bool(r.shared) == bool(overlap)
            found[r.path] = r.content
    assert pieces.filter("path = 'a.py' and ord > 0 and substring(content, shared + 1, 7) = '\nclass '").count() > 10
    with pytest.raises(ValueError):
        chunks.split_source(files, 10, 10)


def test_paths_end_where_they_start_and_repeat_targets(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d")])
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node_id string")
    got = sorted((r.target, r.status, r.length, r.path) for r in graph.find_paths(e, frame("a"), frame("a", "d", "d", "b", "z"), 3).collect())
    assert got == sorted([("a", "found", 0, "a"), ("b", "found", 1, "a>b"), ("d", "found", 3, "a>b>c>d"), ("d", "found", 3, "a>b>c>d"), ("z", "none", None, "")])
    assert {r.status for r in graph.find_paths(e, frame("a"), frame("d"), 2).collect()} == {"none"}


def test_json_graph_files_are_many_and_whole(spark, tmp_path):
    rows = [(f"n{i}", "entity" if i % 2 else None, f"name {i}", ["al", str(i)], None) for i in range(50)] + [("root", "root", "root", None, None)]
    n = spark.createDataFrame(rows, "node_id string, kind string, name string, aliases array<string>, extra string")
    e = edges(spark, [("n0", f"n{i}") for i in range(1, 50)] + [("n1", "absent")])
    tree.save_graph_json(n, e, str(tmp_path / "g"), per_file=10)
    assert len(list((tmp_path / "g").glob("*.json"))) > 5
    n2, e2 = tree.load_graph_json(spark, str(tmp_path / "g"))
    assert {(r.node_id, r.kind, r.name, tuple(r.aliases or ())) for r in n2.collect()} == {(i, k or "node", m, tuple(a or ())) for i, k, m, a, _ in rows}
    assert n2.count() == 51
    assert sorted((r.src, r.dst) for r in e2.collect()) == sorted(("n0", f"n{i}") for i in range(1, 50))
    classes = spark.read.schema(tree.GRAPH_JSON).json(str(tmp_path / "g")).selectExpr("inline(nodes)").groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in classes} == {"EntityNode": 25, "Node": 26}
    tree.save_graph_json(n.limit(0), e.limit(0), str(tmp_path / "none"))
    assert tree.load_graph_json(spark, str(tmp_path / "none"))[1].count() == 0
