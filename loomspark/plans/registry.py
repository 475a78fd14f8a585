"""Registered queries for the graph operators over the relational tables, and their SQL.

Every query reads whole tables. A limit stands only where it is the feature: a page of a list, the
first few of a group, the k best.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import names
from loomspark.operators import build, catalog, chunks, embed, extract, graph, mining, postings, search, trigrams, vectors
from loomspark.plans import adapters as A
from loomspark.operators.versions import Versions
from loomspark.plans import sources
from loomspark.sources import files, scratch, tree
from loomspark.streaming.graphs import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the tables under its name, with the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(A.Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _graph(t: A.Tables) -> tuple[DataFrame, DataFrame]:
    return A.key_nodes(t), A.key_edges(t)


WITH_GRAPH = f"WITH RECURSIVE {A.KEY_NODES_SQL}, {A.KEY_EDGES_SQL}"
BOTH = """both_ways AS (SELECT src AS node_id, dst AS other, 'outgoing' AS direction, relation FROM key_edges
  UNION ALL SELECT dst, src, 'incoming', relation FROM key_edges)"""


# --- graph ------------------------------------------------------------------------------------


@query(f"""{WITH_GRAPH}, parts AS (SELECT 'node' AS category, kind AS label FROM key_nodes UNION ALL SELECT 'relation', relation FROM key_edges),
n AS (SELECT category, label, count(*) AS n FROM parts GROUP BY ALL)
SELECT category, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY category), 4) AS pct FROM n""")
def graph_stats(t):
    return graph.graph_stats(*_graph(t))


@query(f"""{WITH_GRAPH}, {BOTH}, deg AS (SELECT node_id, count(*) FILTER (direction = 'outgoing') AS n_out, count(*) FILTER (direction = 'incoming') AS n_in FROM both_ways GROUP BY 1),
kid AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS r FROM key_edges),
top AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS kids FROM kid WHERE r <= 10 GROUP BY 1)
SELECT k.node_id, kind, name, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(kids, '') AS first_children
FROM key_nodes k LEFT JOIN deg USING (node_id) LEFT JOIN top ON k.node_id = top.src""")
def node_info(t):
    return graph.node_info(*_graph(t))


@query(f"""{WITH_GRAPH}, {BOTH}, r AS (SELECT *, row_number() OVER (PARTITION BY node_id, direction ORDER BY other, relation) AS rank, count(*) OVER (PARTITION BY node_id, direction) AS n_total FROM both_ways)
SELECT node_id, direction, CAST(rank AS INT) AS rank, other, relation, n_total, n_total > 20 AS has_more FROM r WHERE rank <= 20""")
def node_edges(t):
    return graph.node_edges(A.key_edges(t))


@query(f"""{WITH_GRAPH}, {BOTH}, e AS (SELECT node_id, other, max(direction || '/' || relation) AS e FROM both_ways WHERE node_id <> other GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY other) AS rank FROM e)
SELECT r.node_id, CAST(rank AS INT) AS rank, other AS neighbor, split_part(e, '/', 1) AS direction, split_part(e, '/', 2) AS relation, kind, name FROM r JOIN key_nodes k ON k.node_id = other WHERE rank <= 20""")
def neighbors(t):
    return graph.neighbors(*_graph(t))


@query(f"""{WITH_GRAPH}, reach AS (SELECT 'r:0' AS node_id, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM reach JOIN key_edges ON src = node_id AND relation = 'contains' WHERE depth < 2)
SELECT k.node_id, kind, name, depth FROM reach JOIN key_nodes k USING (node_id)""")
def subgraph_nodes(t):
    nodes, edges = _graph(t)
    return graph.subgraph(nodes, edges, t.spark.createDataFrame([("r:0",)], "node_id string"), 2, ["contains"])[0].select("node_id", "kind", "name", "depth")


@query(f"""{WITH_GRAPH}, reach AS (SELECT 'r:0' AS node_id, 0 AS depth UNION ALL SELECT dst, depth + 1 FROM reach JOIN key_edges ON src = node_id AND relation = 'contains' WHERE depth < 2)
SELECT src, dst, relation FROM key_edges WHERE src IN (SELECT node_id FROM reach) AND dst IN (SELECT node_id FROM reach)""")
def subgraph_edges(t):
    nodes, edges = _graph(t)
    return graph.subgraph(nodes, edges, t.spark.createDataFrame([("r:0",)], "node_id string"), 2, ["contains"])[1].select("src", "dst", "relation")


@query(f"""{WITH_GRAPH}, walk AS (SELECT 'r:1' AS node_id, 0 AS depth, 'r:1' AS path UNION ALL SELECT dst, depth + 1, path || '>' || dst FROM walk JOIN key_edges ON src = node_id AND relation = 'contains' WHERE depth < 5)
SELECT k.node_id AS target, CASE WHEN w.node_id IS NULL THEN 'none' ELSE 'found' END AS status, coalesce(depth, -1) AS length, coalesce(path, '') AS path FROM key_nodes k LEFT JOIN walk w USING (node_id) WHERE kind = 'orders'""")
def find_paths(t):
    nodes, edges = _graph(t)
    return graph.find_paths(edges, t.spark.createDataFrame([("r:1",)], "node_id string"), nodes.filter("kind = 'orders'").select("node_id"), 5, ["contains"]).fillna(-1, ["length"])


@query(f"""{WITH_GRAPH}, walk AS (SELECT node_id AS root, node_id, 0 AS depth, node_id AS path FROM key_nodes WHERE kind = 'region'
  UNION ALL SELECT root, dst, depth + 1, path || '>' || dst FROM walk JOIN key_edges ON src = node_id AND relation = 'contains' WHERE depth < 3)
SELECT root, k.node_id, kind, name, depth, path FROM walk JOIN key_nodes k USING (node_id)""")
def print_tree(t):
    nodes, edges = _graph(t)
    return graph.tree(nodes, edges, nodes.filter("kind = 'region'").select("node_id"), 3)


@query(f"""{WITH_GRAPH} SELECT e.src, e.dst, k.name FROM key_edges e JOIN key_nodes k ON k.node_id = e.dst WHERE relation = 'called_by'""")
def related_chunks(t):
    nodes, edges = _graph(t)
    return graph.related(nodes, edges, "called_by").select("src", "dst", "name")


@query(f"""{WITH_GRAPH}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst, relation) AS rank FROM key_edges) SELECT r.src, r.dst, r.relation, k.name FROM r JOIN key_nodes k ON k.node_id = r.dst WHERE rank BETWEEN 6 AND 10""")
def related_chunks_page(t):
    return graph.related(*_graph(t), "all", 5, 2)


@query(f"""{WITH_GRAPH}, {BOTH}, near AS (SELECT 'n:0' AS node_id UNION SELECT other FROM both_ways WHERE node_id = 'n:0'),
x AS (SELECT 'node' AS category, kind AS label, node_id AS id FROM key_nodes WHERE node_id IN (SELECT node_id FROM near) UNION ALL SELECT 'relation', relation, src || '>' || dst FROM key_edges WHERE src IN (SELECT node_id FROM near) AND dst IN (SELECT node_id FROM near)),
r AS (SELECT *, row_number() OVER (PARTITION BY category, label ORDER BY id) AS rank, count(*) OVER (PARTITION BY category, label) AS n FROM x)
SELECT category, label, n, string_agg(id, ',' ORDER BY id) AS samples FROM r WHERE rank <= 5 GROUP BY ALL""")
def subgraph_summary(t):
    """From a node with neighbours on both sides."""
    nodes, edges = _graph(t)
    return graph.summary(*graph.subgraph(nodes, edges, t.spark.createDataFrame([("n:0",)], "node_id string"), 1))


@query(f"""{WITH_GRAPH} SELECT src, dst, relation FROM key_edges WHERE src IN (SELECT node_id FROM key_nodes WHERE kind <> 'region') AND dst IN (SELECT node_id FROM key_nodes WHERE kind <> 'region')""")
def complete_edges(t):
    from loomspark.sources.tree import complete_edges as complete

    nodes, edges = _graph(t)
    return complete(nodes.filter("kind != 'region'"), edges).select("src", "dst", "relation")


# --- listings ---------------------------------------------------------------------------------

NEEDLE, FUZZY = "red", "rdg"


@query("""WITH r AS (SELECT p_partkey, p_name, lower(p_type) AS node_type, row_number() OVER (PARTITION BY lower(p_type) ORDER BY lower(p_name), p_partkey) AS rank FROM part)
SELECT p_partkey, p_name, node_type, CAST(rank AS INT) AS rank, CAST(ceil(rank / 20.0) AS BIGINT) AS page FROM r""")
def list_nodes_by_type(t):
    return catalog.nodes_by_type(t.part, "p_type", "p_name", "p_partkey").select("p_partkey", "p_name", "node_type", "rank", "page")


@query("""WITH s AS (SELECT p_partkey, p_name, p_type, CASE WHEN lower(p_name) = 'rdg' THEN 0 WHEN contains(lower(p_name), 'rdg') THEN 1 WHEN regexp_matches(lower(p_name), 'r.*d.*g') THEN 2 END AS score FROM part)
SELECT p_partkey, p_name, p_type, score FROM s WHERE score IS NOT NULL""")
def search_by_type_and_name(t):
    return catalog.search_by_type_and_name(t.part, FUZZY, None, True, "p_type", "p_name").select("p_partkey", "p_name", "p_type", "score")


@query(f"""WITH {A.EVENT_SQL}, d AS (SELECT entity, count(*) AS n, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM decl GROUP BY 1), c AS (SELECT entity, count(*) AS n FROM call GROUP BY 1)
SELECT coalesce(d.entity, c.entity) AS entity, coalesce(types, '') AS types, coalesce(d.n, 0) AS n_decl, coalesce(c.n, 0) AS n_call, d.n IS NOT NULL AS declared_in_repo, c.n IS NOT NULL AS called_in_repo FROM d FULL JOIN c ON d.entity = c.entity""")
def list_all_entities(t):
    return catalog.entity_list(*A.event_entities(t))


@query(f"WITH {A.DAILY_SQL} SELECT DISTINCT entity FROM decl WHERE entity NOT IN (SELECT entity FROM call)")
def list_all_entities_unused(t):
    return catalog.declared_entities(*A.daily_entities(t), called=False)


@query(f"WITH {A.EVENT_SQL} SELECT DISTINCT entity FROM decl WHERE entity IN (SELECT entity FROM call)")
def list_all_entities_declared(t):
    return catalog.declared_entities(*A.event_entities(t), called=True)


@query(f"WITH {A.DAILY_SQL} SELECT DISTINCT entity FROM call WHERE entity NOT IN (SELECT entity FROM decl)")
def list_all_entities_external(t):
    return catalog.external_entities(*A.daily_entities(t))


@query(f"""WITH {A.EVENT_SQL}, r AS (SELECT entity, chunk_id, pos, row_number() OVER (PARTITION BY entity ORDER BY pos, chunk_id) AS rank, count(*) OVER (PARTITION BY entity) AS n_total FROM decl),
ch AS (SELECT chunk_id, count(*) AS n_events FROM ev GROUP BY 1)
SELECT entity, CAST(rank AS INT) AS rank, chunk_id, n_total, n_events FROM r JOIN ch USING (chunk_id) WHERE rank <= 5""")
def go_to_definition(t):
    return catalog.definitions(A.event_entities(t)[0], A.event_chunks(t)).select("entity", "rank", "chunk_id", "n_total", "n_events")


@query(f"""WITH {A.EVENT_SQL}, r AS (SELECT entity, chunk_id, pos, row_number() OVER (PARTITION BY entity ORDER BY pos, chunk_id) AS rank FROM call),
ch AS (SELECT chunk_id, count(*) AS n_events FROM ev GROUP BY 1)
SELECT entity, CAST(rank AS INT) AS rank, chunk_id, n_events FROM r JOIN ch USING (chunk_id) WHERE rank <= 20""")
def find_usages(t):
    return catalog.usages(A.event_entities(t)[1], A.event_chunks(t)).select("entity", "rank", "chunk_id", "n_events")


@query("""SELECT doc_id AS path, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS n_lines,
length(text) AS n_characters, CAST(ceil(length(text) / 2000.0) AS BIGINT) AS n_chunks FROM documents""")
def file_stats(t):
    files = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return catalog.file_stats(files, chunks.fixed_chunks(files))


@query("""SELECT path, length(content) AS n_characters, true AS fits, sha256(content) AS sha256 FROM (SELECT 'd' || doc_id AS path, text AS content FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages) WHERE content <> ''""")
def split_source(t):
    """Documents and pages cut at separators with an overlap, and put together again from the pieces."""
    texts = t.documents.select(F.concat(F.lit("d"), "doc_id").alias("path"), F.lit("markdown").alias("language"), F.col("text").alias("content"))
    pages = t.pages.select(F.concat(F.lit("p"), "page_id").alias("path"), F.lit("html").alias("language"), F.col("html").alias("content"))
    back = chunks.rejoined(chunks.split_source(texts.unionByName(pages), 500, 50))
    return back.select("path", F.length("content").alias("n_characters"), (F.col("longest") <= 500).alias("fits"), F.sha2("content", 256).alias("sha256"))


@query("""SELECT d.doc_id AS path, CAST(i AS INT) AS ord, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS content FROM documents d, unnest(range(CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS u(i)""")
def chunk_documents(t):
    return chunks.fixed_chunks(t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content")))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://.*/en/.*$')")
def list_files_glob(t):
    return catalog.list_files(t.pages.select("page_id", "url"), glob="http*://*/en/*", path="url")


@query("SELECT page_id, url, list_last(string_split(url, '/')) AS name FROM pages WHERE regexp_matches(list_last(string_split(url, '/')), '^[0-9]+\\.html$')")
def file_names_regex(t):
    return catalog.file_names_by_regex(t.pages.select("page_id", "url"), r"^[0-9]+\.html$", "url")


@query("""SELECT page_id, kind, name, count(*) AS n FROM (SELECT page_id, 'class' AS kind, unnest(regexp_extract_all(html, ' class="([^"]+)"', 1)) AS name FROM pages
UNION ALL SELECT page_id, 'link', unnest(regexp_extract_all(html, ' href="([^"]+)"', 1)) FROM pages) GROUP BY ALL""")
def html_entities(t):
    found = [t.pages.select("page_id", F.lit(k).alias("kind"), F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(1))).alias("name")) for k, p in (("class", ' class="([^"]+)"'), ("link", ' href="([^"]+)"'))]
    return found[0].unionByName(found[1]).groupBy("page_id", "kind", "name").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, ' href="([^"]+)"', 1)) AS called FROM pages), named AS (SELECT page_id AS path, min(called) AS match FROM l WHERE contains(lower(called), 'the') GROUP BY 1),
c AS (SELECT page_id AS path, ord, regexp_extract(substr(html, CAST(ord * 2000 + 1 AS BIGINT), 2000), '(?i)\b(?:import|from|require|use|include)\b[^\n]*the') AS match FROM pages, (VALUES (0), (1), (2)) AS o(ord)),
t AS (SELECT path, arg_min(match, ord) AS match FROM c WHERE match <> '' AND path NOT IN (SELECT path FROM named) GROUP BY 1)
SELECT path, 'called_entity' AS match_type, match FROM named UNION ALL SELECT path, 'import_statement', match FROM t""")
def files_importing(t):
    calls = t.pages.select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit(' href="([^"]+)"'), F.lit(1))).alias("called"))
    pieces = chunks.fixed_chunks(t.pages.select(F.col("page_id").alias("path"), F.col("html").alias("content")))
    return catalog.files_importing(calls, pieces, "the")


@query("""WITH p AS (SELECT 'part' AS category, p_partkey AS k FROM part WHERE contains(lower(p_name), 'ring') ORDER BY k LIMIT 15), d AS (SELECT 'document' AS category, doc_id AS k FROM documents WHERE contains(lower(text), 'ring') ORDER BY k LIMIT 7),
g AS (SELECT 'page' AS category, page_id AS k FROM pages WHERE contains(lower(url), 'ring') ORDER BY k LIMIT 15), a AS (SELECT * FROM p UNION ALL SELECT * FROM d UNION ALL SELECT * FROM g)
SELECT category, CAST(k AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY category ORDER BY k) AS INT) AS rank FROM a""")
def concept_overview(t):
    sources = {"part": (t.part, "p_partkey", ["p_name"]), "document": (t.documents, "doc_id", ["text"]), "page": (t.pages, "page_id", ["url"])}
    return catalog.concept_overview("ring", sources, {"part": 15, "document": 7, "page": 15})


@query(f"""WITH {A.EVENT_SQL}, f AS (SELECT DISTINCT file FROM ev), d AS (SELECT file, count(*) AS n FROM decl GROUP BY 1),
r AS (SELECT file, CAST(entity AS VARCHAR) AS name, row_number() OVER (PARTITION BY file ORDER BY pos) AS r FROM decl), top AS (SELECT file, string_agg(name, ',' ORDER BY r) AS names FROM r WHERE r <= 15 GROUP BY 1),
c AS (SELECT file, chunk_id, row_number() OVER (PARTITION BY file ORDER BY chunk_id) - 1 AS ord FROM (SELECT DISTINCT file, chunk_id FROM ev)), g AS (SELECT file, count(*) AS n, string_agg(chunk_id, ',' ORDER BY ord) FILTER (ord < 10) AS ids FROM c GROUP BY 1)
SELECT f.file, coalesce(d.n, 0) AS n_declared, coalesce(names, '') AS declared, coalesce(g.n, 0) AS n_chunks, coalesce(ids, '') AS chunk_ids FROM f LEFT JOIN d USING (file) LEFT JOIN top USING (file) LEFT JOIN g USING (file)""")
def file_structure(t):
    decl, call = A.event_entities(t)
    every = decl.unionByName(call)
    pieces = graph.ranked(every.select("file", "chunk_id").distinct(), ["file"], [F.col("chunk_id")]).withColumn("ord", F.col("rank") - 1)
    return catalog.file_structure(every.select("file").distinct(), decl.withColumn("name", F.col("entity").cast("string")), pieces, "file")


# --- chunks -----------------------------------------------------------------------------------


@query("""WITH w AS (SELECT conv_id AS path, turn AS ord, text, lag(turn) OVER w AS p, lag(text) OVER w AS pt, lead(turn) OVER w AS n, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT path, ord, coalesce(p, -1) AS prev_ord, coalesce(n, -1) AS next_ord, CASE WHEN p IS NULL THEN '' ELSE pt || CASE WHEN p + 1 <> ord THEN chr(10) || '[...]' ELSE '' END || chr(10) END || text || CASE WHEN n IS NULL THEN '' ELSE CASE WHEN ord + 1 <> n THEN chr(10) || '[...]' ELSE '' END || chr(10) || nt END AS context FROM w""")
def chunk_context(t):
    return chunks.chunk_context(A.turns(t)).fillna(-1, ["prev_ord", "next_ord"])


@query("""WITH w AS (SELECT conv_id AS path, turn AS ord, text, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations)
SELECT path, repeat('=', 48) || chr(10) || path || chr(10) || repeat('=', 48) || chr(10) || string_agg(CASE WHEN p IS NULL THEN '' WHEN p + 1 <> ord THEN chr(10) || '[...]' || chr(10) ELSE chr(10) END || text, '' ORDER BY ord) AS text FROM w GROUP BY path""")
def join_chunks(t):
    return chunks.join_files(A.turns(t))


@query("""WITH o AS (SELECT conv_id AS path, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT a.path, a.ord AS first_ord, b.ord AS last_ord, b.r - a.r + 1 AS n FROM o a JOIN o b ON a.path = b.path AND b.r > a.r AND b.r < a.r + 4""")
def neighbouring_chunks(t):
    return chunks.ngrams(A.turns(t))


@query()
def diff_chunks(t):
    """Each turn against the next one of its conversation."""
    rows = A.turns(t)
    after = rows.select("path", (F.col("ord") - 1).alias("ord"), F.col("content").alias("text_b"))
    name = F.concat_ws("_", "path", "ord")
    return chunks.diff_pairs(rows.join(after, ["path", "ord"]).select(name.alias("id_a"), F.col("content").alias("text_a"), F.concat_ws("_", "path", F.col("ord") + 1).alias("id_b"), "text_b"))


# --- search -----------------------------------------------------------------------------------


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def keyword_scan(t):
    return search.keyword_scan(t.documents, "license token", ["text"]).select("doc_id", "lang")


BM25_SQL = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'token')) AS b FROM d),
f AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM c, f WHERE a > 0 OR b > 0"""
COMMON_SQL = BM25_SQL.replace("'license'", "'the'").replace("'token'", "'und'")


@query(BM25_SQL)
def bm25(t):
    return search.bm25(t.documents, "doc_id", "text", "license token")


@query(BM25_SQL)
def bm25_index(t):
    """The same from a stored index."""
    path = scratch.new_path(t.spark, "index")
    search.save_index(t.documents, "doc_id", "text", path)
    return search.indexed_bm25(t.spark, path, "doc_id", "license token")


@query(f"""WITH s AS ({COMMON_SQL}), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) SELECT doc_id, CAST(rank AS INT) AS rank, score FROM r WHERE rank BETWEEN 11 AND 20""")
def search_page(t):
    """The second page of a keyword search."""
    return search.search(t.documents, "the und", mode="keyword", limit=10, page=2, text=["text"], key="doc_id")


def _first_vector(t) -> list[float]:
    return [float(x) for x in t.embeddings.orderBy("vec_id").select("embedding").first()[0]]


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings, q)
SELECT vec_id, label, round(d, 4) AS distance FROM d ORDER BY d.d, vec_id LIMIT 10""")
def knn(t):
    return search.nearest(t.embeddings, _first_vector(t), 10).select("vec_id", "label", F.round("distance", 4).alias("distance"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, CAST(label AS VARCHAR) AS text, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings, q),
n AS (SELECT * FROM d ORDER BY d, vec_id LIMIT 60), k AS (SELECT *, CASE WHEN contains(text, '3') THEN 13.0 ELSE 0.0 END AS kw FROM n),
s AS (SELECT vec_id, round(0.7 * (1 - d / CASE WHEN max(d) OVER () > 0 THEN max(d) OVER () ELSE 1 END) + 0.3 * kw / CASE WHEN max(kw) OVER () > 0 THEN max(kw) OVER () ELSE 1 END, 4) AS score FROM k)
SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def hybrid_search(t):
    rows = t.embeddings.withColumn("text", F.col("label").cast("string"))
    found = search.hybrid(rows, "3", _first_vector(t), 20, ["text"], "text", "vec_id")
    return found.select("vec_id", F.round("score", 4).alias("score")).orderBy(F.desc("score"), "vec_id")


# --- mining -----------------------------------------------------------------------------------


@query(f"""WITH {A.EVENT_SQL}, m AS (SELECT d.entity, d.chunk_id AS decl_chunk, c.chunk_id AS call_chunk, d.file AS decl_file, c.file AS call_file, row_number() OVER (PARTITION BY d.entity ORDER BY d.pos, c.pos) AS r FROM decl d JOIN call c ON d.entity = c.entity AND d.file <> c.file AND d.chunk_id <> c.chunk_id)
SELECT entity, decl_chunk, call_chunk, decl_file, call_file FROM m WHERE r = 1""")
def decl_call_pairs(t):
    return mining.decl_call_pairs(*A.event_entities(t))


@query(f"""WITH {A.EVENT_SQL}, m AS (SELECT d.entity, d.chunk_id AS decl_chunk, c.chunk_id AS call_chunk, row_number() OVER (PARTITION BY d.entity ORDER BY d.pos, c.pos) AS r FROM decl d JOIN call c ON d.entity = c.entity AND d.file <> c.file AND d.chunk_id <> c.chunk_id),
ch AS (SELECT chunk_id, count(*) AS n FROM ev GROUP BY 1)
SELECT entity, decl_chunk, call_chunk, a.n AS decl_text, b.n AS call_text, 'entity_declaration_call_specific' AS category FROM m JOIN ch a ON a.chunk_id = decl_chunk JOIN ch b ON b.chunk_id = call_chunk WHERE r = 1""")
def candidate_pairs(t):
    return mining.candidate_pairs(mining.decl_call_pairs(*A.event_entities(t)), A.event_chunks(t), "n_events")


TRIPLETS = f"""WITH {A.EVENT_SQL}, f AS (SELECT entity, arg_min(chunk_id, pos) AS decl_chunk FROM decl GROUP BY 1), u AS (SELECT DISTINCT c.entity, c.chunk_id, decl_chunk FROM call c JOIN f ON f.entity = c.entity)
SELECT a.entity AS a, b.entity AS b, min(a.chunk_id) AS chunk_id, min(a.decl_chunk) AS decl_a, min(b.decl_chunk) AS decl_b FROM u a JOIN u b ON a.chunk_id = b.chunk_id AND a.entity <> b.entity GROUP BY 1, 2"""


@query(TRIPLETS)
def interacting_triplets(t):
    return mining.interacting(*A.event_entities(t))


@query(f"""WITH {A.EVENT_SQL}, m AS (SELECT d.entity, d.chunk_id AS decl_chunk, c.chunk_id AS call_chunk, row_number() OVER (PARTITION BY d.entity ORDER BY d.pos, c.pos) AS r FROM decl d JOIN call c ON d.entity = c.entity AND d.file <> c.file AND d.chunk_id <> c.chunk_id),
p AS (SELECT entity, decl_chunk, call_chunk FROM m WHERE r = 1), one AS (SELECT *, row_number() OVER (PARTITION BY decl_chunk ORDER BY entity) AS r FROM p)
SELECT entity, decl_chunk, call_chunk FROM one WHERE r = 1 ORDER BY decl_chunk, entity LIMIT 20""")
def diverse_pairs(t):
    return mining.diverse_pairs(mining.decl_call_pairs(*A.event_entities(t))).select("entity", "decl_chunk", "call_chunk")


@query("""WITH k AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/[0-9]+', '/{param}', 'g'), '/+$', '') AS key FROM pages)
SELECT key, count(*) AS n, min(page_id) AS first_page FROM k GROUP BY 1""")
def endpoint_keys(t):
    return t.pages.select("page_id", mining.endpoint_key(F.col("url")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT source, lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_success, count(*) FILTER (quality <> 1) AS n_failed, CAST(sum(n_chars) AS BIGINT) AS total_n_chars, CAST(sum(toxic) AS BIGINT) AS total_toxic FROM labels JOIN documents USING (doc_id) GROUP BY ALL""")
def eval_summary(t):
    rows = t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id").withColumn("ok", F.col("quality") == 1)
    return mining.run_summary(rows, ["source", "lang"], "ok", ["n_chars", "toxic"])


# --- names and roll-ups -----------------------------------------------------------------------


@query("""SELECT coalesce(source, '*') AS source, coalesce(lang, '*') AS lang, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (source, lang)""")
def dir_rollup(t):
    rows = t.documents.rollup("source", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").cast("long").alias("n_chars"))
    return rows.select(F.coalesce("source", F.lit("*")).alias("source"), F.coalesce("lang", F.lit("*")).alias("lang"), "n_docs", "n_chars")


@query("""WITH p AS (SELECT DISTINCT source, lang, list_transform(range(1, len(string_split(split_part(split_part(url, '://', 2), '?', 1), '/'))), lambda i: array_to_string(list_slice(string_split(split_part(split_part(url, '://', 2), '?', 1), '/'), 1, i), '/')) AS dirs FROM (SELECT url, '' AS source, '' AS lang FROM pages))
SELECT DISTINCT unnest(list_concat([''], dirs)) AS directory FROM p""")
def directories(t):
    path = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("?"), F.lit(1))
    return build.rolled_up(t.pages.select(path.alias("path")), [])


@query("SELECT url, list_last(string_split(split_part(url, '?', 1), '.')) AS name FROM pages WHERE NOT contains(url, '::')")
def simple_names(t):
    return t.pages.select("url", names.simple_name(F.split_part("url", F.lit("?"), F.lit(1))).alias("name"))


@query("""WITH o AS (SELECT p_partkey, replace(p_name, ' ', '.') AS called FROM part), c AS (SELECT called AS canonical, min(p_partkey) AS seq FROM o WHERE p_partkey % 2 = 0 GROUP BY 1),
s AS (SELECT list_last(string_split(canonical, '.')) AS simple, arg_min(canonical, (length(canonical), seq)) AS near FROM c GROUP BY 1)
SELECT o.p_partkey, o.called, coalesce(c.canonical, s.near, o.called) AS resolved, CASE WHEN c.canonical IS NOT NULL THEN 'exact' WHEN s.near IS NOT NULL THEN 'simple' ELSE 'none' END AS match_kind
FROM o LEFT JOIN c ON o.called = c.canonical LEFT JOIN s ON s.simple = list_last(string_split(o.called, '.'))""")
def alias_resolve(t):
    """Part names as calls; names of parts with even keys are the known entities."""
    calls = t.part.select("p_partkey", F.translate("p_name", " ", ".").alias("called"))
    known = calls.filter("p_partkey % 2 = 0").select(F.col("called").alias("name"), F.lit("").alias("path"), F.col("p_partkey").alias("seq"))
    table = build.alias_table(known)
    return build.resolve_calls(calls, table).select("p_partkey", "called", "resolved", "match_kind")


#: The rule of registration taken in order, for names of which those with different last parts share no alias; {name} is an occurrence's name.
REGISTER_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS occ, p_partkey // 8 AS chunk, replace(p_name, ' ', '_') AS base, lower(p_brand) AS b, lower(p_type) AS d FROM part),
a AS (SELECT row_number() OVER (PARTITION BY base ORDER BY occ) AS r, *, [name, list_last(string_split(name, '::')), '.' || b || '.' || name, '.' || d || '.' || b || '.' || name, d || '.' || b || '.' || name] AS names FROM (SELECT *, {name} AS name FROM p)),
st AS (
  SELECT DISTINCT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS occ, base, '' AS name, '' AS found, CAST(-1 AS BIGINT) AS chunk, CAST(MAP {{}} AS MAP(VARCHAR, BIGINT)) AS born, CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(b BIGINT, e VARCHAR))) AS oldest, CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) AS now FROM a
  UNION ALL
  SELECT r, occ, base, name, found, chunk, map_concat(born, MAP {{found: since}}),
    map_concat(oldest, map_from_entries(list_transform(list_filter(list_distinct(names), lambda x: coalesce(oldest[x].b > since, true)), lambda x: (x, {{'b': since, 'e': found}})))),
    map_concat(now, map_from_entries(list_transform(list_distinct(list_append(names, found)), lambda x: (x, found))))
  FROM (SELECT *, coalesce(born[found], occ) AS since FROM (
    SELECT *, coalesce(list_filter(list_transform(names, lambda x: coalesce(now[x], CASE WHEN born[x] IS NOT NULL THEN x END, oldest[x].e)), lambda x: x IS NOT NULL)[1], name) AS found
    FROM (SELECT a.r, a.occ, a.base, a.name, a.chunk, a.names, born, oldest, CASE WHEN a.chunk = st.chunk THEN now ELSE CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR)) END AS now FROM st JOIN a ON a.base = st.base AND a.r = st.r + 1))))
SELECT occ, name, found AS entity FROM st WHERE r > 0"""


def _parts_as_declarations(t, name) -> DataFrame:
    rows = t.part.select(F.col("p_partkey").alias("occ"), F.floor(F.col("p_partkey") / 8).alias("chunk_seq"), F.translate("p_name", " ", "_").alias("base"), F.lower("p_brand").alias("b"), F.lower("p_type").alias("d"))
    return rows.select("occ", "chunk_seq", name.alias("name"), F.concat("d", F.lit("/"), "b", F.lit(".py")).alias("path"))


@query(REGISTER_SQL.format(name="base"))
def register_entities(t):
    """Parts as declarations that may share a name: each joins the first entity that it is an alias of."""
    return build.register(_parts_as_declarations(t, F.col("base"))).select("occ", "name", "entity")


@query(REGISTER_SQL.format(name="CASE occ % 5 WHEN 1 THEN 'm' || occ % 3 || '::' || base WHEN 2 THEN '.' || b || '.' || base WHEN 3 THEN d || '.' || b || '.' || base ELSE base END"))
def register_shared_names(t):
    """The same with names that are each other's aliases: plain, in a namespace, and with their path."""
    kind = F.col("occ") % 5
    space = F.concat(F.lit("m"), (F.col("occ") % 3).cast("string"), F.lit("::"), "base")
    name = F.when(kind == 1, space).when(kind == 2, F.concat(F.lit("."), "b", F.lit("."), "base")).when(kind == 3, F.concat_ws(".", "d", "b", "base")).otherwise(F.col("base"))
    return build.register(_parts_as_declarations(t, name)).select("occ", "name", "entity")


# --- the build path ---------------------------------------------------------------------------


def _extraction(lang: str):
    template = sources.TEMPLATES[lang]

    def run(t):
        return sources.entities(t, template)

    run.__name__ = f"extract_{lang}"
    query(sources.entities_sql(template))(run)


for _lang in sources.TEMPLATES:
    _extraction(_lang)


@query(" UNION ALL ".join(sources.forms_sql(lang) for lang in sources.FORMS))
def extract_forms(t):
    """Entities of files of several forms in each language, by their keys."""
    return sources.form_entities(t)


@query(f"WITH {sources.PLACES_SQL} SELECT DISTINCT path, role, name, type, ord FROM places")
def entities_in_chunks(t):
    return sources.mapped(t, True)[2].select("path", "role", "name", F.coalesce("type", F.lit("")).alias("type"), "ord")


@query(f"""{sources.GRAPH_SQL} SELECT 'root' AS node_id, 'root' AS kind, 'root' AS name, '' AS path UNION ALL SELECT 'directory:shop', 'directory', 'shop', 'shop'
UNION ALL SELECT DISTINCT 'directory:' || folder, 'directory', list_last(string_split(folder, '/')), folder FROM f UNION ALL SELECT 'file:' || path, 'file', list_last(string_split(path, '/')), path FROM f
UNION ALL SELECT 'chunk:' || chunk_id, 'chunk', chunk_id, path FROM ch UNION ALL SELECT 'entity:' || entity, 'entity', entity, '' FROM (SELECT entity FROM d UNION SELECT entity FROM c)""")
def build_nodes(t):
    return sources.graph(t)[0]


@query(f"""{sources.GRAPH_SQL} SELECT 'root' AS src, 'directory:shop' AS dst, 'contains' AS relation UNION ALL SELECT DISTINCT 'directory:shop', 'directory:' || folder, 'contains' FROM f
UNION ALL SELECT 'directory:' || folder, 'file:' || path, 'contains' FROM f UNION ALL SELECT 'file:' || path, 'chunk:' || chunk_id, 'contains' FROM ch
UNION ALL SELECT 'chunk:' || chunk_id, 'entity:' || entity, 'declares' FROM d
UNION ALL SELECT 'entity:' || entity, 'chunk:' || chunk_id, 'called_by' FROM (SELECT entity, chunk_id FROM c EXCEPT SELECT entity, chunk_id FROM d)""")
def build_edges(t):
    return sources.graph(t)[1]


@query("""SELECT c_custkey AS caller, p_partkey AS part, '/parts/p' || p_partkey || '/{param}' AS key FROM customer JOIN part ON p_partkey = c_custkey""")
def endpoint_calls(t):
    """Requests of the scripts against the routes of the Python files, on addresses without their numbers."""
    calls = extract.entities(sources.files(t, sources.JAVASCRIPT)).filter("name like 'API:GET:/parts/%'")
    asked = calls.select(F.regexp_extract("path", r"_(\d+)\.ts$", 1).cast("long").alias("caller"), F.lit("GET").alias("verb"), F.regexp_extract("name", "^API:GET:(.*)$", 1).alias("url"))
    routes = extract.entities(sources.files(t, sources.PYTHON)).filter("type = 'api_endpoint'").groupBy("path", "endpoint").agg(F.collect_set("method").alias("methods"))
    routes = routes.select(F.regexp_extract("path", r"_(\d+)\.py$", 1).cast("long").alias("part"), F.col("endpoint").alias("path"), "methods")
    return mining.endpoint_matches(asked, routes).select("caller", "part", "key")


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*? class="([^"]*)"', 1)) AS names FROM pages), e AS (
SELECT page_id, 'element' AS type, unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*? id="([^"]*)"', 1)) AS name FROM pages UNION ALL SELECT page_id, 'element', unnest(regexp_extract_all(html, '<[a-zA-Z][^<>]*? name="([^"]*)"', 1)) FROM pages
UNION ALL SELECT page_id, 'class', unnest(string_split(trim(names), ' ')) FROM c UNION ALL SELECT page_id, 'script', unnest(regexp_extract_all(html, '<script[^<>]*? src="([^"]*)"', 1)) FROM pages)
SELECT DISTINCT page_id, type, name FROM e WHERE name <> ''""")
def extract_html(t):
    rows = extract.html_entities(t.pages.select(F.col("page_id").alias("path"), F.col("html").alias("content")))
    return rows.select(F.col("path").alias("page_id"), "type", "name")


@query(f"""WITH p AS (SELECT {sources.PYTHON.key} AS k, 'part_' || {sources.PYTHON.key} AS file, 'size' || {sources.PYTHON.group} AS folder FROM part)
SELECT unnest([a || 'show_' || k FOR a IN ['', '.' || file || '.', '.' || folder || '.' || file || '.', '.shop.' || folder || '.' || file || '.', 'shop.' || folder || '.' || file || '.']]) AS alias, 'show_' || k AS canonical FROM p""")
def alias_paths(t):
    """Every name by which the route functions of the Python files can be called."""
    rows = sources.files(t, sources.PYTHON).select("path", F.regexp_extract("path", r"_(\d+)\.py$", 1).cast("long").alias("seq"))
    return build.alias_table(rows.withColumn("name", F.concat(F.lit("show_"), F.col("seq").cast("string")))).select("alias", "canonical")


@query(f"""WITH e AS ({sources.entities_sql(sources.JAVA)}), up AS (SELECT unnest(['', 'src', regexp_extract(path, '^(.*)/[^/]*$', 1)]) AS directory, name, type FROM e WHERE role = 'declared') SELECT DISTINCT directory, name, type FROM up""")
def directory_entities(t):
    found = sources.entities(t, sources.JAVA).filter("role = 'declared'")
    return build.rolled_up(found, ["name", "type"])


@query(f"""WITH e AS ({sources.entities_sql(sources.PYTHON)}), n AS (SELECT path, count(DISTINCT name) FILTER (role = 'declared') AS n_declared, count(DISTINCT name) FILTER (role = 'called') AS n_called FROM e GROUP BY 1), f AS ({sources.files_sql(sources.PYTHON)})
SELECT path, length(content) - length(replace(content, chr(10), '')) AS n_lines, length(content) AS n_characters, CAST(ceil(length(content) / 200.0) AS BIGINT) AS n_chunks, n_declared, n_called FROM f JOIN n USING (path)""")
def source_file_stats(t):
    """The Python files with how many names they declare and call."""
    rows = sources.files(t, sources.PYTHON)
    found = extract.entities(rows)
    return catalog.file_stats(rows, chunks.fixed_chunks(rows, size=200), "path", found.filter("role = 'declared'"), found.filter("role = 'called'"))


@query("SELECT 'src/n' || s_nationkey || '/Supplier' || s_suppkey || '.java' AS path, 'com.n' || s_nationkey || '.Supplier' || s_suppkey AS name FROM supplier")
def classes_inheriting(t):
    """The Java classes that extend Party, by what was read from their files."""
    found = extract.entities(sources.files(t, sources.JAVA))
    bases = found.filter("role = 'called' and type = 'base'").groupBy("path").agg(F.collect_set("name").alias("bases"))
    return catalog.inheriting(found.filter("role = 'declared' and type = 'class'").join(bases, "path"), "party").select("path", "name")


@query("""SELECT 'src/c' || o_custkey || '/order_' || o_orderkey || '.c' AS path, unnest(['stdio', 'order']) AS module FROM orders""")
def included_modules(t):
    found = extract.entities(sources.files(t, sources.CLANG)).filter("role = 'called' and type = 'import'")
    return found.select("path", names.include_path(F.col("name")).alias("module"))


@query(" UNION ALL ".join(f"SELECT '{lang}' AS repo, '{lang}/' || path AS path, '{names.LANGUAGES[x.path.rsplit('.', 1)[1]]}' AS language, {str(x.path.rsplit('.', 1)[1] in names.EXTRACTED).lower()} AS extracted FROM ({sources.files_sql(x)})" for lang, x in sources.TEMPLATES.items()))
def trees_in_one_graph(t):
    """The source trees of all tables as one, with the languages of their files."""
    trees = [sources.files(t, x).withColumn("repo", F.lit(lang)) for lang, x in sources.TEMPLATES.items()]
    rows = trees[0]
    for more in trees[1:]:
        rows = rows.unionByName(more)
    rows = tree.in_one_graph(rows)
    return rows.select("repo", "path", names.language(F.col("path")).alias("language"), names.extension(F.col("path")).isin(names.EXTRACTED).alias("extracted"))


# --- stored graphs, pages of lists, more searches ----------------------------------------------


@query(f"""{WITH_GRAPH} SELECT src, dst, relation, k.name FROM key_edges JOIN key_nodes k ON k.node_id = src""")
def stored_graph(t):
    """The key graph written and read again."""
    path = scratch.new_path(t.spark, "graph")
    tree.save_graph(*_graph(t), path)
    nodes, edges = tree.load_graph(t.spark, path)
    return edges.join(nodes.select(F.col("node_id").alias("src"), "name").hint("merge"), "src").select("src", "dst", "relation", "name")


@query(f"""{WITH_GRAPH} SELECT src, dst, relation, a.kind AS src_kind, b.kind AS dst_kind, b.name AS dst_name FROM key_edges e JOIN key_nodes a ON a.node_id = src JOIN key_nodes b ON b.node_id = dst""")
def json_graph(t):
    """The key graph written as JSON graph files and read again."""
    path = scratch.new_path(t.spark, "graph")
    tree.save_graph_json(*_graph(t), path)
    nodes, edges = tree.load_graph_json(t.spark, path)
    ends = [nodes.select(F.col("node_id").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("name").alias(f"{end}_name")).hint("merge") for end in ("src", "dst")]
    return edges.join(ends[1], "dst").join(ends[0], "src").select("src", "dst", "relation", "src_kind", "dst_kind", "dst_name")


@query("""SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_characters FROM conversations GROUP BY 1""")
def flat_export(t):
    """Conversations with their turns nested, as a flat table of JSON strings and back."""
    nested = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("turns"))
    path = scratch.new_path(t.spark, "flat")
    tree.flat(nested).write.parquet(path)
    back = tree.unflat(t.spark.read.parquet(path), {"turns": "array<struct<turn: int, text: string>>"})
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), size.alias("n_characters"))


@query(f"{WITH_GRAPH}, {BOTH} SELECT node_id, other, direction, relation FROM both_ways")
def entity_relationships(t):
    return graph.both_ways(A.key_edges(t))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_type) = (SELECT min(lower(p_type)) FROM part) ORDER BY lower(p_name), p_partkey LIMIT 5 OFFSET 5")
def nodes_of_type_page(t):
    """The second page of one type; no other rows are sorted."""
    kind = t.part.agg(F.min(F.lower("p_type")).alias("kind"))
    rows = t.part.join(F.broadcast(kind), F.lower("p_type") == F.col("kind"))
    return catalog.paged(rows.select("p_partkey", "p_name"), [F.lower("p_name"), F.col("p_partkey")], 5, 2)


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https?://.*/en/.*$') ORDER BY url, page_id LIMIT 10 OFFSET 10")
def list_files_page(t):
    return catalog.paged(catalog.list_files(t.pages.select("page_id", "url"), glob="http*://*/en/*", path="url"), [F.col("url"), F.col("page_id")], 10, 2)


@query("""WITH d AS (SELECT q.vec_id AS query, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM d) SELECT query, CAST(rank AS INT) AS rank, vec_id, round(d, 5) AS distance FROM r WHERE rank <= 5""")
def knn_each(t):
    """The five nearest rows to every row whose id is divisible by 100."""
    found = vectors.nearest_to_each(t.embeddings, t.embeddings.filter("vec_id % 100 = 0"), 5)
    return found.select("query", "rank", F.col("key").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query("""WITH d AS (SELECT q.vec_id AS query, e.vec_id, list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, vec_id) AS rank FROM d) SELECT query, CAST(rank AS INT) AS rank, vec_id, round(d, 4) AS distance FROM r WHERE rank <= 10""")
def knn_index_exact(t):
    """The ten nearest rows to every row whose id is divisible by 100, from a stored index whose lists come in two parts."""
    path = scratch.new_path(t.spark, "vectors")
    vectors.save_index(t.embeddings.filter("vec_id % 2 = 0"), path)
    vectors.add_to_index(t.embeddings.filter("vec_id % 2 != 0"), path)
    found = vectors.nearest_exact(t.spark, path, t.embeddings.filter("vec_id % 100 = 0"), 10, other_keys=True)
    return found.select("query", "rank", F.col("key").alias("vec_id"), F.round("distance", 4).alias("distance"))


@query()
def knn_index(t):
    """The same from the most promising cells alone; tests hold its recall against the exact rows."""
    path = scratch.new_path(t.spark, "vectors")
    vectors.save_index(t.embeddings, path)
    found = vectors.nearest(t.spark, path, t.embeddings.filter("vec_id % 100 = 0"), 10, other_keys=True)
    return found.select("query", "rank", F.col("key").alias("vec_id"), F.round("distance", 4).alias("distance"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings) SELECT vec_id, round(embedding[1] / size, 4) AS first, round(embedding[64] / size, 4) AS last FROM n""")
def unit_vectors(t):
    unit = t.embeddings.select("vec_id", search.normalised(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", *[F.round(F.col("unit")[i].cast("double"), 4).alias(name) for i, name in ((0, "first"), (63, "last"))])


@query("SELECT doc_id, CASE WHEN lang IS NULL OR doc_id % 3 = 0 THEN text ELSE lang END AS embedded FROM documents")
def texts_to_embed(t):
    """A blank or missing description gives way to the content."""
    described = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.col("lang"))
    return t.documents.select("doc_id", search.text_to_embed(described, F.col("text")).alias("embedded"))


@query(f"""{TRIPLETS.replace("SELECT a.entity AS a", ", ch AS (SELECT chunk_id, count(*) AS n FROM ev GROUP BY 1), t AS (SELECT a.entity AS a", 1)})
SELECT a, b, decl_a, decl_b, t.chunk_id, x.n AS text_a, y.n AS text_b, z.n AS call_text, 'interacting_entities' AS category FROM t JOIN ch x ON x.chunk_id = decl_a JOIN ch y ON y.chunk_id = decl_b JOIN ch z ON z.chunk_id = t.chunk_id""")
def candidate_triplets(t):
    return mining.candidate_triplets(mining.interacting(*A.event_entities(t)), A.event_chunks(t), "n_events")


# --- indexes of texts ---------------------------------------------------------------------------


def _gram_index(t, rows: DataFrame, key: str, text: str) -> str:
    path = scratch.new_path(t.spark, "grams")
    trigrams.save_index(rows, path, key, text)
    return path


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'token')")
def indexed_substrings(t):
    """The rows of keyword_scan from an index of character grams."""
    return trigrams.containing(t.spark, _gram_index(t, t.documents, "doc_id", "text"), ["license", "token"]).select(F.col("key").alias("doc_id"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|de)/[0-9]*7\.html$') OR regexp_matches(url, '//blog\.[a-z]+th')")
def indexed_pattern(t):
    """A regular expression over addresses: the literals that a match cannot do without choose the candidates."""
    found = trigrams.matching(t.spark, _gram_index(t, t.pages, "page_id", "url"), r"/(en|de)/[0-9]*7\.html$|//blog\.[a-z]+th")
    return found.select(F.col("key").alias("page_id"), F.col("text").alias("url"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'r.*d.*g')")
def indexed_subsequence(t):
    found = trigrams.with_subsequence(t.spark, _gram_index(t, t.part, "p_partkey", "p_name"), FUZZY)
    return found.select(F.col("key").alias("p_partkey"), F.col("text").alias("p_name"))


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, score FROM ({COMMON_SQL.replace('FROM documents', 'FROM documents WHERE doc_id % 5 <> 0')}) QUALIFY rank <= 20")
def bm25_top(t):
    """The twenty best of a stored index whose documents came in two segments, of which a fifth was deleted."""
    index = postings.Index.create(t.documents.filter("doc_id % 2 = 0"), scratch.new_path(t.spark, "postings"), "doc_id", "text")
    index.add(t.documents.filter("doc_id % 2 = 1"), "doc_id", "text")
    index.delete(t.documents.filter("doc_id % 5 = 0"), "doc_id")
    return index.top("the und", 20).select(F.col("key").alias("doc_id"), "rank", "score")


@query(f"SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank, score FROM ({BM25_SQL}) QUALIFY rank <= 20")
def bm25_top_merged(t):
    """The same over all documents, after a merge."""
    index = postings.Index.create(t.documents.filter("doc_id % 2 = 0"), scratch.new_path(t.spark, "postings"), "doc_id", "text")
    index.add(t.documents.filter("doc_id % 2 = 1"), "doc_id", "text")
    index.merge()
    return index.top("license token", 20).select(F.col("key").alias("doc_id"), "rank", "score")


# --- many pairs, greedy choices -----------------------------------------------------------------


@query(f"""{WITH_GRAPH}, ends AS (SELECT 'r:' || o_orderkey % 5 AS src, 'o:' || o_orderkey AS dst FROM orders UNION SELECT 'n:' || o_orderkey % 25, 'o:' || o_orderkey FROM orders UNION SELECT 'c:' || c_custkey, 'c:' || c_custkey FROM customer),
walk AS (SELECT src AS root, src AS node_id, 0 AS depth, [src] AS path FROM (SELECT DISTINCT src FROM ends) UNION ALL SELECT root, dst, depth + 1, list_append(path, dst) FROM walk JOIN key_edges ON src = node_id WHERE depth < 4),
best AS (SELECT src, dst, depth, path FROM ends JOIN walk ON root = src AND node_id = dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY depth, path) = 1)
SELECT src, dst, depth AS length, array_to_string(path, '>') AS path FROM best""")
def paths_between(t):
    """Shortest paths of all relations: from a region and a nation to each order, through customers or suppliers."""
    key = F.col("o_orderkey")
    pairs = [t.orders.select(F.concat(F.lit(p), (key % n).cast("string")).alias("src"), F.concat(F.lit("o:"), key.cast("string")).alias("dst")) for p, n in (("r:", 5), ("n:", 25))]
    alone = t.customer.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("src"))
    return graph.paths_between(A.key_edges(t), pairs[0].union(pairs[1]).union(alone.withColumn("dst", F.col("src"))), 4)


@query(TRIPLETS.replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT a.entity AS a", ", t AS (SELECT a.entity AS a", 1) + """),
pick AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS taken, NULL::STRUCT(c VARCHAR, a BIGINT, b BIGINT) AS m UNION ALL
SELECT n + 1, list_concat(taken, [x.a, x.b]), x FROM (SELECT n, taken, min(struct_pack(c := chunk_id, a := t.a, b := t.b)) AS x FROM pick, t WHERE n < 20 AND NOT list_has_any(taken, [t.a, t.b]) GROUP BY n, taken))
SELECT m.a AS a, m.b AS b, m.c AS chunk_id FROM pick WHERE n > 0""")
def diverse_triplets(t):
    return mining.diverse_interacting(*A.event_entities(t))


# --- versions and streams -----------------------------------------------------------------------


def _changed_chunks(t) -> Versions:
    """Chunks of the documents in two versions: in the second one a fifth of the documents is gone, and a third of the others has other letters."""
    rows = t.documents.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    table = Versions(t.spark, scratch.new_path(t.spark, "versions"), "path long, ord int, content string", ["path", "ord"])
    table.commit(chunks.fixed_chunks(rows), None)
    other = chunks.fixed_chunks(rows.filter("path % 3 = 0 and path % 5 != 0").withColumn("content", F.replace("content", F.lit("e"), F.lit("a"))))
    table.commit(other, rows.filter("path % 3 = 0 or path % 5 = 0").select("path"))
    return table


TWO_VERSIONS = """a AS (SELECT doc_id AS path, CAST(i AS INT) AS ord, substr(text, CAST(i * 2000 + 1 AS BIGINT), 2000) AS content FROM documents d, unnest(range(CAST(ceil(length(text) / 2000.0) AS BIGINT))) AS u(i)),
b AS (SELECT path, ord, CASE WHEN path % 3 = 0 THEN replace(content, 'e', 'a') ELSE content END AS content FROM a WHERE path % 5 <> 0)"""


@query(f"""WITH {TWO_VERSIONS} SELECT a.path, a.ord, a.content, 1 AS valid_from, CASE WHEN b.content IS DISTINCT FROM a.content THEN 2 ELSE -1 END AS valid_to FROM a LEFT JOIN b USING (path, ord)
UNION ALL SELECT b.path, b.ord, b.content, 2, -1 FROM b JOIN a USING (path, ord) WHERE b.content <> a.content""")
def chunk_history(t):
    rows = _changed_chunks(t).history()
    return rows.select("path", "ord", "content", F.col("valid_from").cast("int").alias("valid_from"), F.coalesce(F.col("valid_to").cast("int"), F.lit(-1)).alias("valid_to"))


@query(f"WITH {TWO_VERSIONS} SELECT path, ord, content FROM a")
def chunks_as_of(t):
    """The first version, read after the second one was made."""
    return _changed_chunks(t).as_of(1)


@query(f"WITH {TWO_VERSIONS} SELECT a.path, a.ord, CASE WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS status, a.content AS old, coalesce(b.content, '') AS new FROM a LEFT JOIN b USING (path, ord) WHERE b.content IS DISTINCT FROM a.content")
def chunk_changes(t):
    return _changed_chunks(t).changes(1, 2).select("path", "ord", "status", F.col("old.content").alias("old"), F.coalesce("new.content", F.lit("")).alias("new"))


def _streamed(t) -> Graph:
    """The Python tree as a stream of four batches: old versions of some files, their last ones, files that go again, and versions that come too late."""
    folder, place = scratch.new_path(t.spark, "stream"), scratch.new_path(t.spark, "graph")
    rows = sources.files(t, sources.PYTHON).withColumn("k", F.regexp_extract("path", r"_(\d+)\.py$", 1).cast("long"))
    old = F.when(F.col("k") % 3 == 0, F.concat("content", F.lit("\n\n\nold_value = show(1)\n"))).otherwise(F.col("content"))
    gone = rows.filter("k % 5 = 0").withColumn("path", F.concat(F.lit("gone/"), "path"))
    batches = [
        rows.select("path", old.alias("content"), F.lit(1).cast("long").alias("seq")),
        rows.filter("k % 3 = 0").select("path", "content", F.lit(2).cast("long").alias("seq")).unionByName(gone.select("path", "content", F.lit(2).cast("long").alias("seq"))),
        gone.select("path", F.lit(None).cast("string").alias("content"), F.lit(3).cast("long").alias("seq")),
        gone.unionByName(rows).select("path", F.lit("late = 1").alias("content"), F.lit(0).cast("long").alias("seq")),
    ]
    graph_ = Graph(t.spark, place, sources.chunked)
    for batch in batches:  # a run of the stream takes in what has come since the last one
        batch.write.mode("append").parquet(folder)
        graph_.follow(folder, f"{place}/checkpoint").awaitTermination()
    return graph_


@query(ORACLE_SQL["build_edges"])
def streamed_edges(t):
    """The edges of the Python tree after all batches are those of one build."""
    return _streamed(t).graph()[1]


@query(ORACLE_SQL["build_nodes"])
def streamed_nodes(t):
    return _streamed(t).graph()[0]


# --- trees of files, vectors of a model -----------------------------------------------------------


@query(f"SELECT path, list_last(string_split(path, '/')) AS name, 'python' AS language, content FROM ({sources.files_sql(sources.PYTHON)})")
def written_tree(t):
    """The Python files as a tree of files, beside a folder that is skipped and files of other kinds, read by the data source."""
    root = scratch.new_path(t.spark, "tree")
    python = sources.files(t, sources.PYTHON)
    skipped = python.withColumn("path", F.concat(F.lit("node_modules/"), "path"))
    files.write_source_tree(python.unionByName(skipped).unionByName(sources.files(t, sources.JAVA)), root)
    return files.read_source_tree(t.spark, root, skip_dirs="node_modules,.git", extensions="py")


def _letters():
    """A stand-in for a model: how often five letters occur."""
    import numpy as np

    return lambda texts: np.array([[text.count(c) for c in "aeiou"] for text in texts], np.float32)


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(text, 'a', 'o') ELSE text END AS text FROM documents), n AS (SELECT doc_id, text, CAST(length(text) - length(replace(text, 'a', '')) AS BIGINT) AS a, CAST(length(text) - length(replace(text, 'o', '')) AS BIGINT) AS o FROM d WHERE trim(text, ' ') <> '')
SELECT doc_id, a, o, text NOT IN (SELECT text FROM documents WHERE text IS NOT NULL) AS fresh FROM n""")
def texts_embedded_again(t):
    """Vectors of all documents after a third of them changed: only texts that were not there before reach the model."""
    path = scratch.new_path(t.spark, "embedded")
    embed.embed(t.documents, _letters, path, "doc_id")
    changed = F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("a"), F.lit("o"))).otherwise(F.col("text"))
    found = embed.embed(t.documents.select("doc_id", changed.alias("text")), _letters, path, "doc_id").filter("vector is not null")
    return found.select("doc_id", F.col("vector")[0].cast("long").alias("a"), F.col("vector")[3].cast("long").alias("o"), "fresh")


# --- more lookups and pages ---------------------------------------------------------------------


@query(sources.shown_sql("java"))
def java_entities_in_chunks(t):
    return sources.shown(t, "java")


@query(sources.shown_sql("cpp"))
def cpp_entities_in_chunks(t):
    return sources.shown(t, "cpp")


@query(f"""{WITH_GRAPH}, walk AS (SELECT node_id AS root, node_id, 0 AS depth, node_id AS path FROM key_nodes WHERE kind = 'region'
  UNION ALL SELECT root, dst, depth + 1, path || '>' || dst FROM walk JOIN key_edges ON src = node_id WHERE depth < 3)
SELECT root, k.node_id, kind, name, depth, path FROM walk JOIN key_nodes k USING (node_id)""")
def print_tree_all_relations(t):
    nodes, edges = _graph(t)
    return graph.tree(nodes, edges, nodes.filter("kind = 'region'").select("node_id"), 3, None)


@query("""WITH s AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 're' THEN 0 WHEN contains(lower(p_name), 're') THEN 1 WHEN regexp_matches(lower(p_name), 'r.*e') THEN 2 END AS score FROM part WHERE lower(p_type) = (SELECT max(lower(p_type)) FROM part))
SELECT p_partkey, p_name, score FROM s WHERE score IS NOT NULL ORDER BY score, lower(p_name), p_partkey LIMIT 5 OFFSET 5""")
def search_by_type_and_name_page(t):
    """The second page of the parts of one type by how well their names match."""
    kind = t.part.agg(F.max(F.lower("p_type"))).first()[0]
    rows = catalog.search_by_type_and_name(t.part, "re", kind, True, "p_type", "p_name")
    return catalog.paged(rows, [F.col("score"), F.lower("p_name"), F.col("p_partkey")], 5, 2).select("p_partkey", "p_name", "score")


@query("SELECT conv_id AS path, turn AS ord, text AS content FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def chunks_of_files(t):
    """The turns of all conversations with a system turn."""
    return catalog.chunks_of(A.turns(t), t.conversations.filter("role = 'system'").select(F.col("conv_id").alias("path")))


@query("SELECT conv_id AS path, turn AS ord, text AS content FROM conversations ORDER BY conv_id, turn LIMIT 20 OFFSET 20")
def all_chunks_page(t):
    rows = A.turns(t)
    return catalog.chunks_of(rows, rows, limit=20, page=2)


@query("""WITH o AS (SELECT p_partkey, replace(p_name, ' ', '.') AS name FROM part), k AS (SELECT name, min(p_partkey) AS seq FROM o WHERE p_partkey % 2 = 0 GROUP BY 1),
a AS (SELECT name AS alias, name AS canonical, false AS other, seq FROM k UNION ALL SELECT '.' || name, name, true, seq FROM k)
SELECT p_partkey, '.' || o.name AS alias, coalesce((SELECT arg_min(canonical, (other, seq)) FROM a WHERE a.alias = '.' || o.name), '') AS canonical FROM o""")
def entities_by_alias(t):
    """Which entity a dotted name stands for; names of parts with even keys are entities, their aliases those without a path."""
    rows = t.part.select("p_partkey", F.translate("p_name", " ", ".").alias("name"))
    known = rows.filter("p_partkey % 2 = 0").groupBy("name").agg(F.min("p_partkey").alias("seq"))
    table = known.select(F.col("name").alias("canonical"), "seq", F.explode(F.array("name", F.concat(F.lit("."), "name"))).alias("alias"))
    table = table.groupBy("alias").agg(F.min_by("canonical", F.struct((F.col("alias") != F.col("canonical")), "seq")).alias("canonical"))
    return build.by_alias(rows.select("p_partkey", F.concat(F.lit("."), "name").alias("alias")), table).select("p_partkey", "alias", F.coalesce("canonical", F.lit("")).alias("canonical"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings, q)
SELECT vec_id, CAST(row_number() OVER (ORDER BY round(d, 6), vec_id) AS INT) AS rank FROM d QUALIFY rank BETWEEN 11 AND 20""")
def search_page_vector(t):
    found = search.search(t.embeddings, "", _first_vector(t), "vector", 10, 2, key="vec_id")
    return found.select("vec_id", "rank")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, CAST(label AS VARCHAR) AS text, list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS d FROM embeddings, q),
n AS (SELECT * FROM d ORDER BY d, vec_id LIMIT 60), k AS (SELECT *, CASE WHEN contains(text, '3') THEN 13.0 ELSE 0.0 END AS kw FROM n),
s AS (SELECT vec_id, round(0.7 * (1 - d / CASE WHEN max(d) OVER () > 0 THEN max(d) OVER () ELSE 1 END) + 0.3 * kw / CASE WHEN max(kw) OVER () > 0 THEN max(kw) OVER () ELSE 1 END, 6) AS score FROM k)
SELECT vec_id, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank BETWEEN 11 AND 20""")
def search_page_hybrid(t):
    rows = t.embeddings.withColumn("text", F.col("label").cast("string"))
    return search.search(rows, "3", _first_vector(t), "hybrid", 10, 2, ["text"], "text", "vec_id").select("vec_id", "rank")


@query("SELECT doc_id, quality, toxic FROM labels")
def saved_results(t):
    """Results written twice (the second time replaces the first) and read again."""
    path = scratch.new_path(t.spark, "results")
    mining.save_results(t.labels.limit(1), path)
    mining.save_results(t.labels, path)
    return t.spark.read.schema(t.labels.schema).json(path)
