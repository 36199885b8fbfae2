"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from loomspark.functions.text import STOPWORDS

_CORPUS = """c AS (SELECT doc_id AS id, source AS source_id, source || '/' || lang || '/doc_' || doc_id || '.md' AS path,
  ['knowledge', 'expertise', 'norms'][doc_id % 3 + 1] AS bucket, text, lang,
  CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens, substr(sha256(text), 1, 32) AS hash FROM documents)"""

_POSTS = r"""posts AS (SELECT id, col, term, count(*) AS tf FROM (
    SELECT id, 'text' AS col, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM c
    UNION ALL SELECT id, 'path', unnest(regexp_extract_all(lower(path), '[\p{L}\p{N}_]+')) FROM c) GROUP BY ALL)"""

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"

_QUERY_TERMS = r"""w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS words FROM benchmark),
  u AS (SELECT item_id, unnest(words) AS term, unnest(range(len(words))) AS i FROM w),
  f AS (SELECT item_id, i, term FROM u QUALIFY row_number() OVER (PARTITION BY item_id, lower(term) ORDER BY i) = 1)"""

_SEARCH_TERMS = f"""{_QUERY_TERMS}, k AS (SELECT *, NOT list_contains({_STOP}, lower(term)) AND length(term) > 2 AS good FROM f),
  s AS (SELECT item_id, i, term FROM (SELECT *, bool_or(good) OVER (PARTITION BY item_id) AS any_good FROM k) WHERE good OR NOT any_good),
  st AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS pos, term, count(*) OVER (PARTITION BY item_id) AS n_terms FROM s)"""

_HITS = f"""{_CORPUS}, {_POSTS}, {_SEARCH_TERMS},
  q AS (SELECT item_id AS query_id, pos, lower(term) AS term, n_terms FROM st),
  tf AS (SELECT term, id, sum(tf * CASE col WHEN 'path' THEN 0.5 ELSE 1.0 END) AS f FROM posts GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
  len AS (SELECT id, sum(tf) AS length FROM posts GROUP BY ALL),
  tot AS (SELECT count(*) AS n_docs, avg(length) AS mean_length FROM len),
  part AS (SELECT query_id, id, n_terms, CASE WHEN n_docs <= 2 * df THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
      * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean_length)) AS p FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (id), tot),
  hits AS (SELECT query_id, id, sum(CAST(p AS DOUBLE)) AS score, count(*) = max(n_terms) AS strict FROM part GROUP BY ALL)"""


def _top(source: str, k: int) -> str:
    return f"(SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM {source} QUALIFY rank <= {k})"


def _shown(source: str) -> str:
    return f"SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM {source}"


_LOOSE = f"WITH {_HITS} "

_NEAR = """SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0"""

_TOUCH = "t AS (SELECT DISTINCT l_orderkey AS commit, l_partkey AS file FROM lineitem)"
_PAIRS = f"""{_TOUCH}, own AS (SELECT t.* FROM t JOIN (SELECT commit FROM t GROUP BY 1 HAVING count(*) <= 30) USING (commit)),
  pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS n FROM own x JOIN own y ON x.commit = y.commit AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2)"""
_EDGES = "e AS (SELECT 'part:' || l_partkey AS src, 'supplier:' || l_suppkey AS dst, lower(l_returnflag) AS kind, count(*) AS n FROM lineitem GROUP BY ALL)"
_DEGREES = f"{_EDGES}, g AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1)"
_MENTION = r"tok AS (SELECT id, name, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS name FROM c) GROUP BY ALL)"

ORACLE_SQL: dict[str, str] = {
    "token_estimate": f"WITH {_CORPUS} SELECT source_id, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, max(tokens) AS most FROM c GROUP BY 1",
    "chunk_identity": f"WITH {_CORPUS} SELECT id, substr(sha256(source_id || chr(0) || path || chr(0) || text || chr(0)), 1, 16) AS chunk_id, hash FROM c",
    "query_terms": f"WITH {_QUERY_TERMS} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS pos, term FROM f",
    "search_terms": f"WITH {_SEARCH_TERMS} SELECT item_id, CAST(pos AS INTEGER) AS pos, term FROM st",
    "glob_filter": rf"WITH {_CORPUS} SELECT id, path FROM c WHERE regexp_matches(path, '^src1[^/]*/(?:.*/)?doc_[^/][0-4][^/]*\.md$') OR regexp_matches(path, '^src2/en(?:/.*)?$')",
    "path_prefix_filter": f"WITH {_CORPUS} SELECT id, path, bucket FROM c WHERE starts_with(lower(path), 'src1/') AND bucket IN ('knowledge', 'norms')",
    "claim_first_source": rf"WITH {_CORPUS} SELECT id, CASE WHEN regexp_matches(path, '^src0/.*$') THEN 'first' WHEN regexp_matches(path, '^(?:.*/)?es/[^/]*\.md$') THEN 'spanish' WHEN regexp_matches(path, '^src1[0-9]$') THEN 'teens' WHEN regexp_matches(path, '^(?:.*/)?[^/]*\.md$') THEN 'rest' END AS claimed_by FROM c",
    "codeowners_last_match": rf"WITH {_CORPUS} SELECT id, CASE WHEN regexp_matches(path, '^src1[^/]/fr/[^/]*\.md$') THEN 'french' WHEN regexp_matches(path, '^(?:.*/)?en/.*$') THEN 'english' WHEN regexp_matches(path, '^src1/.*$') THEN 'team-one' ELSE 'core' END AS owner FROM c",
    "test_paths": f"WITH {_CORPUS} SELECT source_id, CAST(count(*) FILTER (id % 5 = 0 OR id % 7 = 0) AS BIGINT) AS tests, count(*) AS kotlin FROM c GROUP BY 1",
    "postings": f"WITH {_CORPUS}, {_POSTS} SELECT * FROM posts",
    "corpus_stats": f"WITH {_CORPUS}, {_POSTS}, len AS (SELECT id, sum(tf) AS n FROM posts GROUP BY 1) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS length, round(avg(n), 6) AS mean_length FROM len",
    "bm25_loose": _LOOSE + _shown(_top("hits", 10)),
    "bm25_strict": _LOOSE + _shown(_top("(FROM hits WHERE strict)", 10)),
    "bm25_filtered": _LOOSE + _shown(_top("(SELECT hits.* FROM hits JOIN c USING (id) WHERE bucket = 'knowledge' AND lang = 'en')", 10)),
    "bm25_adjusted": _LOOSE + _shown(_top("(SELECT query_id, id, score * CASE bucket WHEN 'norms' THEN 0.5 ELSE 1.0 END * (1 + 0.15 * ln(1 + id % 10)) AS score FROM hits JOIN c USING (id))", 10)),
    "bm25_mode_rrf": _LOOSE + f""", lists AS (SELECT query_id, id, 2.0 / (60 + rank) AS s FROM {_top('(FROM hits WHERE strict)', 30)} UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM {_top('hits', 30)}),
      fused AS (SELECT query_id, id, sum(CAST(s AS DOUBLE)) AS score FROM lists GROUP BY ALL), n AS (SELECT DISTINCT query_id, n_terms FROM q),
      any_strict AS (SELECT query_id, bool_or(strict) AS any_strict FROM hits GROUP BY 1),
      pool AS (SELECT query_id, id, score, 'all' AS mode FROM (FROM hits WHERE strict) JOIN n USING (query_id) WHERE n_terms = 1
        UNION ALL SELECT query_id, id, score, 'any' FROM hits JOIN n USING (query_id) JOIN any_strict USING (query_id) WHERE n_terms > 1 AND NOT any_strict
        UNION ALL SELECT query_id, id, score, 'all' FROM fused JOIN n USING (query_id) JOIN any_strict USING (query_id) WHERE n_terms > 1 AND any_strict)
      SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, mode FROM pool QUALIFY rank <= 10""",
    "rerank_head": _LOOSE + rf""", asked AS (SELECT query_id, list(DISTINCT term) AS asked FROM q GROUP BY 1), top AS {_top('hits', 20)},
      v AS (SELECT query_id, id, rank, CASE WHEN rank <= 10 THEN CAST(len(list_intersect(asked, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'))) AS DOUBLE) / len(asked) END AS v FROM top JOIN c USING (id) JOIN asked USING (query_id))
      SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 10 THEN 0 ELSE 1 END, v DESC NULLS LAST, rank) AS INTEGER) AS rank FROM v""",
    "rrf_hybrid": _LOOSE + f""", words AS {_top('hits', 50)}, dist AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score
        FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)), near AS {_top('dist', 50)},
      lists AS (SELECT query_id, id, 1.0 / (60 + rank) AS s FROM words UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM near), fused AS (SELECT query_id, id, sum(CAST(s AS DOUBLE)) AS score FROM lists GROUP BY ALL) """ + _shown(_top("fused", 10)),
    "vector_topk": f"WITH n AS ({_NEAR}) " + _shown(_top("n", 10)),
    "vector_topk_filtered": f"WITH n AS ({_NEAR} AND v.label % 3 = 0) " + _shown(_top("n", 10)),
    "incremental_diff": f"""WITH {_CORPUS}, o AS (SELECT DISTINCT sha256(source_id || chr(0) || path || chr(0) || text) AS k FROM c),
      n AS (SELECT DISTINCT sha256(source_id || chr(0) || path || chr(0) || text || CASE WHEN id % 13 = 0 THEN ' edited' ELSE '' END) AS k FROM c WHERE id % 11 <> 0)
      SELECT CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'unchanged' END AS status, count(*) AS n FROM o FULL JOIN n ON o.k = n.k GROUP BY 1""",
    "missing_embeddings": f"WITH {_CORPUS} SELECT source_id, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM embeddings v WHERE v.vec_id = c.id) GROUP BY 1",
    "prune_sources": f"WITH {_CORPUS} SELECT source_id, count(*) AS n FROM c WHERE source_id IN (SELECT 'src' || user_id % 13 FROM events) GROUP BY 1",
    "co_change": f"WITH {_PAIRS} SELECT * FROM pairs",
    "co_change_top10": f"WITH {_PAIRS}, sides AS (SELECT a AS file, b AS other, n FROM pairs UNION ALL SELECT b, a, n FROM pairs), kept AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY file ORDER BY n DESC, other DESC) <= 10) SELECT DISTINCT least(file, other) AS a, greatest(file, other) AS b, n FROM kept",
    "authored": f"WITH {_TOUCH} SELECT o_custkey AS author, file, count(*) AS commits FROM t JOIN orders ON commit = o_orderkey GROUP BY 1, 2",
    "last_toucher": f"WITH {_TOUCH} SELECT file, count(*) AS commits, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS author FROM t JOIN orders ON commit = o_orderkey GROUP BY 1",
    "ownership_propagation": "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'unassigned' ELSE r_name END AS owner, n_name AS service FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "reference_counts": f"WITH {_CORPUS}, {_MENTION}, {_SEARCH_TERMS} SELECT name, count(*) AS documents, CAST(sum(n) AS BIGINT) AS mentions FROM tok WHERE name IN (SELECT lower(term) FROM st) GROUP BY 1",
    "mentions": f"WITH {_CORPUS}, {_MENTION}, {_SEARCH_TERMS} SELECT id, name, n FROM tok WHERE name IN (SELECT lower(term) FROM st WHERE length(term) >= 4)",
    "resolve_unique": """WITH cand AS (SELECT c_custkey AS target, c_custkey % 701 AS key, c_nationkey AS scope FROM customer),
      a AS (SELECT key, count(*) AS n, min(target) AS only_one FROM cand GROUP BY 1), o AS (SELECT key, scope, count(*) AS m, min(target) AS near FROM cand GROUP BY 1, 2)
      SELECT o_orderkey AS ref, o_custkey % 701 AS key, CASE WHEN n = 1 THEN only_one WHEN m = 1 THEN near END AS target
      FROM orders LEFT JOIN a ON a.key = o_custkey % 701 LEFT JOIN o ON o.key = o_custkey % 701 AND o.scope = o_orderkey % 25""",
    "edge_merge": "SELECT l_partkey AS src, l_suppkey AS dst, 'references' AS kind, count(*) AS n, arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) AS via FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2",
    "entity_merge": "SELECT o_custkey AS id, arg_min(CASE WHEN o_totalprice > 200000 THEN o_orderstatus END, CASE WHEN o_totalprice > 200000 THEN o_orderkey END) AS status, arg_min(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY 1",
    "in_degree": f"WITH {_DEGREES} SELECT * FROM g",
    "file_importance": f"WITH {_EDGES} SELECT dst AS id, count(*) AS n, round(1 + 0.15 * ln(1 + count(*)), 6) AS boost FROM e GROUP BY 1",
    "entity_page": f"WITH {_DEGREES} SELECT * FROM g ORDER BY in_degree DESC, out_degree DESC, id LIMIT 50 OFFSET 10",
    "neighbors_1hop": f"WITH {_EDGES}, s AS (SELECT 'supplier:' || s_suppkey AS start FROM supplier) SELECT DISTINCT start, dst AS id, kind, 'out' AS direction FROM s JOIN e ON start = src UNION SELECT DISTINCT start, src, kind, 'in' FROM s JOIN e ON start = dst",
    "neighborhood_2hop": f"""WITH {_EDGES}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
      s AS (SELECT 'part:' || p_partkey AS start FROM part), h1 AS (SELECT DISTINCT start, dst AS id FROM s JOIN u ON src = start),
      h2 AS (SELECT DISTINCT start, dst AS id FROM h1 JOIN u ON src = id),
      d AS (SELECT start, start AS id, 0 AS depth FROM s UNION ALL SELECT start, id, 1 FROM h1 UNION ALL SELECT start, id, 2 FROM h2)
      SELECT start, id, min(depth) AS depth FROM d GROUP BY ALL""",
    "find_entities": rf"""WITH {_CORPUS}, ent AS (SELECT id, regexp_replace(path, '\.md$', '') AS name FROM c),
      asked AS (SELECT DISTINCT lower(CASE WHEN id % 2 = 0 THEN 'DOC_' || id ELSE regexp_replace(path, '\.md$', '') END) AS asked FROM c),
      x AS (SELECT asked, id FROM asked JOIN ent ON asked = lower(name)), r AS (SELECT asked FROM asked WHERE asked NOT IN (SELECT asked FROM x))
      SELECT asked, id, 'exact' AS how FROM x UNION ALL SELECT asked, id, 'suffix' FROM r JOIN ent ON asked = regexp_extract(lower(name), '[./]([^./]+)$', 1)""",
    "graph_counts": f"WITH {_EDGES} SELECT kind, count(*) AS edges, CAST(sum(n) AS BIGINT) AS weight FROM e GROUP BY 1",
    "source_overview": f"WITH {_CORPUS} SELECT source_id, count(*) AS chunks, count(DISTINCT hash) AS texts, count(DISTINCT path) AS paths, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY 1",
    "token_percentiles": f"WITH {_CORPUS}, s AS (SELECT lang, list(tokens ORDER BY tokens) AS v FROM c GROUP BY 1) SELECT lang, CAST(len(v) AS BIGINT) AS n, v[len(v) // 2 + 1] AS p50, v[least(len(v) - 1, CAST(floor(len(v) * 0.9) AS BIGINT)) + 1] AS p90, v[len(v)] AS max, CAST(list_sum(v) AS BIGINT) AS total FROM s",
    "files_page": f"WITH {_CORPUS} SELECT path, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens, min(hash) AS hash FROM c GROUP BY 1 ORDER BY tokens DESC, path LIMIT 40 OFFSET 5",
    "largest_chunks": f"WITH {_CORPUS} SELECT id, tokens FROM c ORDER BY tokens DESC, id LIMIT 5",
    "query_log_stats": "SELECT count(*) AS queries, count(*) FILTER (event_type = 'error') AS fallbacks, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS fallback_rate, count(*) FILTER (value > 100) AS over_budget, round(avg(value), 6) AS mean_value, count(DISTINCT user_id) AS users FROM events",
    "stats_findings": f"WITH {_CORPUS} SELECT DISTINCT 'never_retrieved' AS finding, source_id FROM c WHERE source_id NOT IN (SELECT 'src' || user_id % 23 FROM events WHERE event_type = 'view') UNION ALL SELECT DISTINCT 'oversized_chunks', source_id FROM c WHERE tokens > 1200",
    "log_tail": "SELECT event_id, event_type AS mode FROM events ORDER BY event_id DESC LIMIT 20",
    "eval_recall": _LOOSE + f", b AS (SELECT item_id AS query_id, text AS passage FROM benchmark), top AS {_top('hits', 10)}, h AS (SELECT query_id, max(CAST(contains(text, passage) AS INTEGER)) AS hit, min(CASE WHEN contains(text, passage) THEN rank END) AS first FROM top JOIN c USING (id) JOIN b USING (query_id) GROUP BY 1) SELECT count(*) AS questions, CAST(sum(hit) AS BIGINT) AS found, round(avg(hit), 6) AS recall, round(avg(1 / first), 6) AS mean_reciprocal FROM h",
    "grep_baseline": f"WITH {_CORPUS}, {_POSTS}, {_SEARCH_TERMS}, q AS (SELECT DISTINCT item_id AS query_id, lower(term) AS term FROM st), cover AS (SELECT query_id, id, count(*) AS terms FROM q JOIN posts USING (term) WHERE col = 'text' GROUP BY 1, 2), best AS (SELECT * FROM cover QUALIFY terms = max(terms) OVER (PARTITION BY query_id)) SELECT query_id, id, terms, CAST(row_number() OVER (PARTITION BY query_id ORDER BY id) AS INTEGER) AS rank FROM best QUALIFY rank <= 20",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "page_structure": """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
      len(regexp_extract_all(html, '<a href=')) AS n_links, len(regexp_extract_all(html, '<p>')) AS n_paragraphs FROM pages""",
    "page_links": """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY ALL""",
}
