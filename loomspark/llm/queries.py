"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from loomspark.llm import auction, langmix, lemp, linecrf, mincut, oddsketch, secrets, simhash, substrings, templates, tokens

QUERIES = {
    "op1_line_crf": linecrf.op1_line_crf,
    "op2_cost_balanced_packing": tokens.op2_cost_balanced_packing,
    "op3_language_mixture": langmix.op3_language_mixture,
    "op4_prefix_free_parse": substrings.op4_prefix_free_parse,
    "op5_markov_secrets": secrets.op5_markov_secrets,
    "op6_relative_lempel_ziv": substrings.op6_relative_lempel_ziv,
    "op7_simhash_pigeonhole": simhash.op7_simhash_pigeonhole,
    "op10_template_leaks": templates.op10_template_leaks,
    "op8_minimum_cut": mincut.op8_minimum_cut,
    "op9_token_files": tokens.op9_token_files,
    "op11_odd_sketches": oddsketch.op11_odd_sketches,
    "op12_auction_repair": auction.op12_auction_repair,
    "op13_coordinate_pruning": lemp.op13_coordinate_pruning,
    "base_line_counts": linecrf.base_line_counts,
    "base_secret_spans": secrets.base_secret_spans,
}

OP4_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS win FROM (SELECT doc_id, h, unnest(range(greatest(len(h) // 2 - 49, 0))) AS s FROM d)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS least FROM win) WHERE least < doc_id),
edge AS (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM dup),
isle AS (SELECT doc_id, s, sum(CASE WHEN p IS NULL OR s > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM edge),
gone AS (SELECT doc_id, g, min(s) AS a, max(s) + 50 AS b FROM isle GROUP BY 1, 2),
gap AS (SELECT doc_id, g, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY g) AS y FROM gone UNION ALL SELECT doc_id, 0, 0, min(a) FROM gone GROUP BY 1),
kept AS (SELECT gap.doc_id, string_agg(CASE WHEN y IS NULL THEN substr(h, 2 * x + 1) ELSE substr(h, 2 * x + 1, 2 * (y - x)) END, '' ORDER BY g) AS k FROM gap JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM gone GROUP BY 1)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS s FROM d)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM dup),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

OP13_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

OP11_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 1, least(len(w), 1)) + 1), lambda i: array_to_string(list_slice(w, i, i + 1), ' '))) AS s FROM w),
one AS (SELECT s, min(doc_id) AS a, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM d WHERE len(s) > 0) GROUP BY s),
x AS (SELECT a, n, unnest(s) AS s FROM one),
few AS (SELECT a, n, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY f, s) AS r FROM x JOIN (SELECT s, count(*) AS f FROM x GROUP BY 1) USING (s)) WHERE r <= n - (80 * n + 99) // 100 + 1),
pair AS (SELECT DISTINCT l.a, r.a AS b FROM few AS l JOIN few AS r ON l.s = r.s AND l.a < r.a AND 100 * least(l.n, r.n) >= 80 * greatest(l.n, r.n)),
link AS (SELECT a, b FROM (SELECT p.a, p.b, count(*) AS c FROM pair AS p JOIN x ON x.a = p.a JOIN x AS y ON y.a = p.b AND y.s = x.s GROUP BY 1, 2) AS p JOIN one AS l USING (a) JOIN one AS r ON r.a = p.b WHERE 100 * c >= 80 * (l.n + r.n - c)),
reach(a, b) AS (SELECT a, a FROM one UNION SELECT e.b, reach.b FROM reach JOIN (SELECT a, b FROM link UNION ALL SELECT b, a FROM link) AS e ON e.a = reach.a AND reach.b < e.b),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, len(d.s) AS n_shingles, coalesce(b, doc_id) AS component_id, doc_id = coalesce(b, doc_id) AS kept FROM d LEFT JOIN one ON one.s = list_sort(d.s) LEFT JOIN root USING (a)"""

OP12_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)),
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM named, crc),
r AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c FROM h),
o AS (SELECT *, left(role, 1) AS i, row_number() OVER w AS k, lag(left(role, 1)) OVER w AS prior
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM o),
per AS (SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1),
step(q, nx, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins AS (SELECT q, q AS t, 0 AS c, '' AS l, CAST([] AS VARCHAR[]) AS out FROM step UNION ALL SELECT q, nx, 5, 'I', [role || ':'] FROM step UNION ALL SELECT a.q, b.nx, 10, 'II', [a.role || ':', b.role || ':'] FROM step AS a JOIN step AS b ON a.nx = b.q),
dp(conv_id, k, q, c, l, out) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, 0, '', CAST([] AS VARCHAR[]) FROM per
  UNION ALL
  SELECT conv_id, k, q, c, l, out FROM (
    SELECT d.conv_id, d.k + 1 AS k, e.q, d.c + ins.c + e.c AS c, d.l || ins.l || e.l AS l, d.out || ins.out || e.out AS out
    FROM dp AS d JOIN ins ON ins.q = d.q JOIN step ON step.q = ins.t JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.k = d.k + 1,
    LATERAL (SELECT ins.t AS q, 2 AS c, 'D' AS l, CAST([] AS VARCHAR[]) AS out
      UNION ALL SELECT CASE WHEN f.i = 's' THEN 1 ELSE step.nx END, CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] WHERE f.fault NOT IN ('blank', 'duplicate') AND (f.i = left(step.role, 1) OR ins.t = 0 AND f.i = 's')
      UNION ALL SELECT step.nx, CASE WHEN f.fault = 'truncated' THEN 6 ELSE 1 END, 'R', [step.role || ':' || f.text] WHERE f.fault NOT IN ('blank', 'duplicate')) AS e
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, q ORDER BY c, l) = 1),
ended AS (SELECT d.conv_id, d.c + ins.c AS c, d.l || ins.l AS l, d.out || ins.out AS out FROM dp AS d JOIN per ON per.conv_id IS NOT DISTINCT FROM d.conv_id AND per.n = d.k JOIN ins ON ins.q = d.q WHERE ins.t IN (0, 3) QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.c + ins.c, d.l || ins.l) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(c, 0) AS BIGINT) AS cost, coalesce(l, '') AS audit, sha256(coalesce(array_to_string(out, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS e LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM e.conv_id"""

LINES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, s, list_slice(w, s, s + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS s FROM d)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(s, s + 3)) AS i FROM again) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""

SECRETS_SQL = r"""
WITH kinds(kind, rank, pattern, least) AS (VALUES ('assign', 0, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6), ('access', 1, '(AKIA[A-Z0-9]+)', 20), ('hex', 2, '([0-9a-f]+)', 24)),
d AS (SELECT doc_id, kind, rank, least, regexp_extract_all(text, pattern) AS m, regexp_extract_all(text, pattern, 1) AS v, string_split_regex(text, replace(replace(pattern, '(AKIA', '(?:AKIA'), '([', '(?:[')) AS p
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents), kinds),
h AS (SELECT doc_id, kind, rank, least, unnest(m) AS m, unnest(v) AS v, unnest(list_slice(p, 1, len(m))) AS p, generate_subscripts(m, 1) AS i FROM d WHERE len(m) > 0),
s AS (SELECT *, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM h),
n AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(stop - length(m) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop - length(m), rank) AS spans FROM s WHERE length(v) >= least GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(spans, '') AS base_spans FROM documents AS d LEFT JOIN n USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op4_prefix_free_parse": OP4_SQL, "op11_odd_sketches": OP11_SQL, "op6_relative_lempel_ziv": OP6_SQL, "op12_auction_repair": OP12_SQL, "op13_coordinate_pruning": OP13_SQL, "base_line_counts": LINES_SQL, "base_secret_spans": SECRETS_SQL}
