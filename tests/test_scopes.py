import re
import time

import pytest
from pyspark.sql import functions as F

from loomspark.operators import extract, scopes


def read(code, lang):
    rows = scopes._Reader(code, lang).read()
    return {(r[1], r[2]) for r in rows if r[0] == "declared"}, {r[1] for r in rows if r[0] == "called"}, rows


def test_words_of_other_languages_are_names():
    declared, _, _ = read("struct P; impl P { pub fn new(x: u8) -> P { P } fn get(&self) {} }", "rust")
    assert {("P::new", "method"), ("P::get", "method")} <= declared
    declared, called, rows = read('class A { @DeleteMapping("/x") public void delete(int id) { repo.delete(id); s.match(a); } }', "java")
    assert ("A::delete", "api_endpoint") in declared and {"delete", "match"} <= {c.rpartition(".")[2] for c in called}
    assert ("declared", "A::delete", "api_endpoint", None, "/x", "DELETE") in rows
    declared, called, _ = read('class K { delete(id) { api.delete(id); p.catch(e); "x".match(y); if (a) { go(); } } run = (z) => { f(); } }\nfunction g<T>(q) { return q; }', "js")
    assert {("K.delete", "method"), ("K.run", "method"), ("K.run.z", "variable"), ("g", "function"), ("g.q", "variable")} <= declared
    assert {"api.delete", "p.catch", "match", "go", "f"} <= called and "if" not in called
    assert "match" in read("void f(int a) { match(a); new(a); }", "c")[1]


def test_comments_macros_and_enums():
    assert read("/* a /* b */ fn ghost() {} */ fn real() {}", "rust")[0] == {("real", "function")}
    assert read("fn a() { let s = \"/*\"; } fn b() {}", "rust")[0] == {("a", "function"), ("b", "function")}
    declared, called, _ = read("enum class E { X, Y };\nint f(int a) { return a; }", "cpp")
    assert not any(n == "E" and k == "variable" for n, k in declared) and "enum" not in called and ("f", "function") in declared
    assert read("#define MAX(a, b) \\\n  do { int x(a); } while (0)\nint f(int a) { return a; }", "c")[0] == {("f", "function"), ("f.a", "variable")}


@pytest.mark.parametrize(("piece", "lang"), [("impl ", "rust"), ("class A ", "java"), ("class A ", "js"), ("class A ", "cpp"), ("use a", "rust"), ("typedef a ", "c"), ("enum E ", "java"), ("fn f<", "rust"), ("f(a ", "c"), ("/* ", "rust")])
def test_time_in_proportion(piece, lang):
    began = time.time()
    scopes._Reader(piece * (100_000 // len(piece)), lang).read()
    assert time.time() - began < 8


def test_words_are_searched_by_their_letters():
    """a pattern that starts with a word's boundary is tried at every character."""
    text = "if (a) { b = 12; run(x, y); }\n" * 20_000

    def took(pattern):
        began = time.perf_counter()
        assert pattern.search(text) is None
        return time.perf_counter() - began

    slow = min(took(re.compile(r"\bclass\s+")) for _ in range(3))
    for lang, words in (("java", 3), ("js", 1), ("rust", 8)):
        quick = [p for f, p in scopes.COMPILED[lang] if f.pattern.startswith("(?:") and not p.search(text)][:words]
        assert len(quick) == words and all(min(took(p) for _ in range(3)) < slow / 2 for p in quick)


@pytest.mark.parametrize("code", ["f(a, (b), c(d)) {}", "f(a, (b(c))) {}", "f(a", "f(a(", "f((a)", "f()", "f(a)(b) {}"])
def test_parentheses_two_deep(code):
    """the quicker pattern of parameters finds what the plain one found."""
    plain = re.compile(r"f\((?P<params>(?:[^()]|\([^()]*\))*)\)")
    assert [m.span("params") for m in re.finditer("f" + scopes.PARAMS, code)] == [m.span("params") for m in plain.finditer(code)]


def test_strings_hide_comments(spark):
    rows = [('x = "#a"; go()  # note', "python"), ("u = 'it\\'s # no'\n'''doc # x''' y", "python"), ('u = "http://a"; run(); // gone', "c"), ("a /* b\n */ c '//' d", "c"), ('s = "\\\\"; // gone', "c")]
    df = spark.createDataFrame(rows, "content string, lang string")
    got = [r.a if r.lang == "python" else r.b for r in df.select("lang", extract.without_comments(F.col("content"), "python").alias("a"), extract.without_comments(F.col("content"), "c").alias("b")).collect()]
    assert got == ['x = "#a"; go()  ', "u = 'it\\'s # no'\n y", 'u = "http://a"; run(); ', "a  c '//' d", 's = "\\\\"; ']
