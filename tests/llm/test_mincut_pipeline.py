import itertools
import random

import brute
import pyarrow as pa

import corpus_pipeline
from loomspark.llm import mincut, tokens

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>x</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies, do you agree to all of them being stored here?</div>
<article><h1>A &amp; B</h1><p>First paragraph,   with <b>bold</b> and
 <i>italic</i> words&nbsp;that go on.<p>Second one, 1 &lt; 2, with a <a href="#">link</a> inside.</p><aside class="ad">Buy it now</aside>
<div class="comments"><p>Nice article, I liked it very much indeed.</p></div><form><label>Mail</label><input></form></article>
<div class="sidebar"><p>Related: something else to read.</p></div><footer>&copy; 2020</footer></body></html>"""
TEXT = "A & B\nFirst paragraph, with bold and italic words that go on.\nSecond one, 1 < 2, with a link inside."


def test_main_text(spark):
    bare = "<div class='menu'><a href=x>a</a> <a href=y>b</a></div><div><p>A long paragraph of text that tells a story about many things, and it ends with a full stop.</p><p>Another long paragraph of text follows here, and it goes on for more than twenty words so that it is clearly content, is it not?</p></div>"
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>open <!-- never closed"), (5, "u", bare), (None, "u", "plain text only, with no markup at all in it."), (6, "u", "<" * 50 + "&am &amp"), (7, "u", "<article>" + "<p>Some words of a paragraph.</p>" * 3000 + "</article>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    weights = mincut.train(df)
    got = {r.page_id: r.text for r in mincut.extract(df, weights).collect()}
    assert got[1] == TEXT and got[2] == got[3] == "" and got[4] == "open"
    assert got[7].count("\n") == 2999 and len(got) == len(rows)
    assert "A long paragraph" in mincut.main_text(bare, mincut.PLAIN) and "Another" in mincut.main_text(bare, mincut.PLAIN) and not mincut.main_text(bare, mincut.PLAIN).startswith("a")
    assert mincut.extract(df.limit(0), mincut.train(df.limit(0))).count() == 0


def test_cut_is_minimal():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a in range(n) for b in range(a) if rng.random() < 0.4]
        cost = lambda y: sum(g for g, k in zip(gain, y, strict=True) if g > 0 and not k) - sum(g for g, k in zip(gain, y, strict=True) if g < 0 and k) + sum(c for a, b, c in edges if y[a] != y[b])  # noqa: B023, E731
        assert abs(cost(mincut.minimum_cut(gain, edges)) - min(cost(y) for y in itertools.product((True, False), repeat=n))) < 1e-6


def test_smoothing_overrules_a_weak_block():
    edges = [(0, 1, 1.0), (1, 2, 1.0)]
    assert mincut.minimum_cut([3.0, -0.5, 3.0], edges) == [True] * 3
    assert mincut.minimum_cut([3.0, -5.0, 3.0], edges) == [True, False, True]


def documents(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["the", "er", "in", "on", "ti", "and"]) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = "thein oner anderti onthe inin tithe erand onon thethe andin tier inand"
    rows = [(i, text(80), "en") for i in range(20)]
    rows += [(30, rows[3][1], "en"), (31, rows[4][1] + " x", "en"), (32, "12345 !!!", "en"), (33, None, None), (34, text(20) + " " + item + " " + text(20), "en"), (35, text(20) + ' token = "0123456789abcdef0123456789abcdef" ' + text(9), "en")]
    docs = spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(1, item)], "item_id long, text string")


def test_pipeline_stages(spark, tmp_path):
    docs, bench = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"{k}-{name}")
        stage(spark, table, str(tmp_path)).write.parquet(path)
        table = spark.read.parquet(path)
        kept.append({r.doc_id for r in table.collect()})
        if k < 4:
            assert table.columns == docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept[0] == set(texts) - {32, 33}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} for d in kept[0] for w in [texts[d].lower().split()]}
    root = brute.roots(sets, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert kept[1] == {d for d in root if root[d] == d} and not {30, 31} & kept[1]
    assert kept[2] == kept[1] - {34} and kept[3] == kept[2] == kept[4]
    last = spark.read.parquet(str(tmp_path / "3-redact_secrets"))
    assert all(r.n_chars == len(r.text) for r in last.collect()) and "[SECRET]" in last.filter("doc_id = 35").first().text
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.schema.simpleString() == table.schema.simpleString()
    assert {r.doc_id for r in whole.collect()} == kept[4]
    ids = {}
    for r in sorted(whole.collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    encoder = tokens.Encoder(tokens.tokenizer_path())
    for r in last.collect():
        assert ids[r.doc_id] == encoder(pa.array([r.text]))[0].tolist()


