"""DuckDB SQL for the queries over an entity graph and its pages."""

from __future__ import annotations

from loomspark.operators.facts import QUESTION_WORD, TEST_FOLDER, TEST_NAME
from loomspark.plans.context_queries import LABELS
from loomspark.plans.oracles import _CORPUS, _HITS, _LOOSE, _MENTION, _SEARCH_TERMS, _top

_PATTERNS = """pat AS (SELECT n_nationkey AS pos, n_name AS service, CASE WHEN r_name <> 'ASIA' THEN r_name END AS team, '^src' || n_nationkey || '/.*$' AS regex
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

_OWN_EDGES = f"""{_CORPUS}, {_PATTERNS}, edges AS (
  SELECT DISTINCT 'service:' || lower(service) AS src, 'file:' || path AS dst, 'contains' AS kind, NULL AS via FROM c JOIN pat ON regexp_matches(path, regex)
  UNION ALL SELECT DISTINCT 'team:' || lower(team), 'service:' || lower(service), 'owns', NULL FROM pat WHERE team IS NOT NULL
  UNION ALL SELECT DISTINCT 'person:' || lower(s_name), 'team:' || lower(r_name), 'member_of', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT DISTINCT 'service:' || lower(a.n_name), 'service:' || lower(b.n_name), 'depends_on', coalesce(lower(c_mktsegment), 'unknown')
    FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey)"""

_OWNERS = """o AS (SELECT path, arg_max(service, pos) AS service, arg_max(team, pos) FILTER (team IS NOT NULL) AS team FROM (SELECT DISTINCT path FROM c) JOIN pat ON regexp_matches(path, regex) GROUP BY 1),
  own AS (SELECT p.path, service, coalesce(team, CASE WHEN regexp_matches(p.path, '^src1[^/]/fr/[^/]*\\.md$') THEN 'french' WHEN regexp_matches(p.path, '^(?:.*/)?en/.*$') THEN 'english' END) AS owner
    FROM (SELECT DISTINCT path FROM c) p LEFT JOIN o ON o.path = p.path)"""

_ENTITIES = """ent AS (SELECT 'service:' || lower(n_name) AS id, 'service' AS type, n_name AS name, NULL AS kind, NULL AS path FROM nation
  UNION ALL SELECT 'team:' || lower(r_name), 'team', r_name, NULL, NULL FROM region UNION ALL SELECT 'person:' || lower(s_name), 'person', s_name, NULL, NULL FROM supplier
  UNION ALL SELECT DISTINCT 'file:' || path, 'file', path, 'doc', path FROM c)"""


def _is_test(name: str, path: str) -> str:
    return f"(regexp_matches(coalesce({path}, ''), '{TEST_FOLDER}') OR regexp_matches(string_split({name}, '.')[1], '{TEST_NAME}'))"


_SLOTS = " ".join(f"WHEN ends.kind = '{k}' AND direction = '{d}' THEN {i}" for i, (k, d) in enumerate(LABELS))
_TEXTS = "[" + ", ".join(f"'{t}'" for t in LABELS.values()) + "]"

_SYMBOLS = """sym AS (SELECT 'symbol:' || name AS id, 'symbol' AS type, name, CASE WHEN length(name) % 5 = 0 THEN 'property' ELSE 'class' END AS kind, min(path) AS path, count(*) AS in_degree
  FROM (SELECT regexp_extract(text, '[A-Za-z_]+') AS name, path FROM c) WHERE name <> '' GROUP BY name)"""

_NAMED = f"""wd AS (SELECT item_id AS query_id, regexp_extract_all(text, '{QUESTION_WORD}') AS w FROM benchmark),
  cand AS (SELECT DISTINCT query_id, word, deliberate OR regexp_matches(word, '[._]') OR (word[2:] <> lower(word[2:]) AND word[2:] <> upper(word[2:])) AS deliberate FROM (
    SELECT query_id, unnest(list_filter(w, lambda x: length(x) >= 3)) AS word, false AS deliberate FROM wd
    UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])), true FROM wd
    UNION ALL SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), true FROM wd)),
  sc AS (SELECT *, in_degree - CASE WHEN contains(name, '.') THEN 2 ELSE 0 END - CASE kind WHEN 'property' THEN 3 ELSE 0 END - CASE WHEN {_is_test("name", "path")} THEN 5 ELSE 0 END AS score FROM sym),
  named AS (SELECT query_id, id, CAST(max(score) AS DOUBLE) AS score, any_value(name) AS name FROM cand JOIN sc ON lower(word) = lower(name)
    WHERE deliberate OR (regexp_matches(word[1], '\\p{{Lu}}') AND name = word) OR NOT (score < 2 OR contains(name, '.')) GROUP BY 1, 2),
  qe AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, id) AS INTEGER) AS rank FROM named QUALIFY rank <= 20)"""

_BEHIND = f"""best AS (SELECT query_id, rank, path, CASE WHEN id % 2 = 0 THEN regexp_extract(text, '[A-Za-z_]+') ELSE '' END AS heading FROM {_top("hits", 5)} JOIN c USING (id)),
  found AS (SELECT query_id, rank, coalesce(sym.id, CASE WHEN f.path IS NOT NULL THEN 'file:' || best.path END) AS id, coalesce({_is_test("sym.name", "sym.path")}, {_is_test("best.path", "best.path")}) AS test
    FROM best LEFT JOIN sym ON sym.name = heading AND sym.path = best.path LEFT JOIN (SELECT path FROM c WHERE id % 3 = 0) f ON f.path = best.path),
  once AS (SELECT query_id, id, min(rank) AS hit_rank, any_value(test) AS test FROM found WHERE id IS NOT NULL GROUP BY 1, 2),
  bh AS (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY test, hit_rank, id) AS INTEGER) AS rank FROM once)"""

_BOTH = """firsts AS (SELECT query_id, id, list, rank FROM (SELECT query_id, id, 0 AS list, rank FROM qe UNION ALL SELECT query_id, id, 1, rank FROM bh) QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY list, rank) = 1),
  eq AS (SELECT query_id, id, CAST(place AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list, rank, id) AS place FROM firsts) WHERE place <= 5)"""

_EXPECTED = """ex AS (SELECT item_id AS query_id, unnest([0, 1, 1]) AS grp, unnest(['doc_' || item_id || '.md', 'doc_' || (item_id + 1) || '.md', 'doc_' || (item_id + 2) || '.md']) AS expected FROM benchmark)"""
_RECALLS = f"""{_EXPECTED}, top AS (SELECT t.query_id, t.rank, path FROM {_top("hits", 50)} t JOIN c USING (id)),
  met AS (SELECT ex.query_id, grp, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS p, 1 AS c FROM ex JOIN top ON ex.query_id = top.query_id AND (path = expected OR ends_with(path, '/' || expected)) GROUP BY 1, 2),
  rec AS (SELECT query_id, count(*) AS total, CAST(sum(coalesce(p, 0)) AS BIGINT) AS in_pack, CAST(sum(coalesce(c, 0)) AS BIGINT) AS in_candidates, CAST(sum(CASE WHEN c = 1 AND p = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cut
    FROM (SELECT DISTINCT query_id, grp FROM ex) LEFT JOIN met USING (query_id, grp) GROUP BY 1)"""

_LINES = "ln AS (SELECT *, len(regexp_extract_all(text, '\\n')) + CASE WHEN ends_with(text, chr(10)) OR text = '' THEN 0 ELSE 1 END AS end_line FROM c)"
_STATES = "st8 AS (SELECT 'src' || user_id % 40 AS source_id, event_id AS seq, event_type AS state FROM events)"

ORACLE_SQL: dict[str, str] = {
    "ownership_edges": f"WITH {_OWN_EDGES} FROM edges",
    "file_owners": f"WITH {_CORPUS}, {_PATTERNS}, {_OWNERS} FROM own",
    "file_kinds": f"WITH {_CORPUS} SELECT 'kind' AS what, 'doc' AS value, count(DISTINCT path) AS n FROM c UNION ALL SELECT 'type', 'file', count(DISTINCT path) FROM c",
    "entity_facts": f"""WITH {_OWN_EDGES}, {_ENTITIES}, ends AS (SELECT DISTINCT of, id, kind, direction FROM (SELECT src AS of, dst AS id, kind, 'out' AS direction FROM edges UNION ALL SELECT dst, src, kind, 'in' FROM edges)),
      near AS (SELECT of, CASE {_SLOTS} END AS slot, name, {_is_test("name", "path")} AS test FROM ends JOIN ent USING (id)),
      firsts AS (SELECT of, slot, list(name ORDER BY test, name) AS names FROM near WHERE slot IS NOT NULL GROUP BY 1, 2),
      parts AS (SELECT of, string_agg({_TEXTS}[slot + 1] || ': ' || array_to_string(names[1:6], ', ') || CASE WHEN len(names) > 6 THEN ' (+' || (len(names) - 6) || ' more)' ELSE '' END, '; ' ORDER BY slot) AS tail FROM firsts GROUP BY 1)
      SELECT id, name || ' — ' || coalesce(kind, type) || coalesce('; ' || tail, '') AS fact FROM ent LEFT JOIN parts ON of = id WHERE type IN ('service', 'team')""",
    "question_entities": f"WITH {_CORPUS}, {_SYMBOLS}, {_NAMED} FROM qe",
    "hit_entities": f"WITH {_HITS}, {_SYMBOLS}, {_BEHIND} FROM bh",
    "entities_for_questions": f"WITH {_HITS}, {_SYMBOLS}, {_NAMED}, {_BEHIND}, {_BOTH} FROM eq",
    "question_facts": f"""WITH {_HITS}, {_SYMBOLS}, {_NAMED}, {_BEHIND}, {_BOTH}, fact AS (SELECT query_id, rank, regexp_replace(id, '^[a-z]+:', '') || ' — ' || string_split(id, ':')[1] AS fact FROM eq),
      sized AS (SELECT *, CAST(greatest(1, (length(fact) + 3) // 4) AS BIGINT) AS tokens FROM fact)
      SELECT query_id, rank, fact, tokens FROM sized QUALIFY sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) <= 32""",
    "search_modes": _LOOSE
    + f""", n AS (SELECT DISTINCT query_id, n_terms FROM q), any_strict AS (SELECT query_id, bool_or(strict) AS any_strict FROM hits GROUP BY 1),
      lists AS (SELECT query_id, id, 2.0 / (60 + rank) AS s FROM {_top("(FROM hits WHERE strict)", 30)} UNION ALL SELECT query_id, id, 1.0 / (60 + rank) FROM {_top("hits", 30)}),
      fused AS (SELECT query_id, id, sum(CAST(s AS DOUBLE)) AS score FROM lists GROUP BY ALL),
      loose AS (SELECT query_id, id, score FROM {_top("hits", 30)}),
      pool AS (SELECT query_id, id, score, 'all' AS mode FROM (FROM hits WHERE strict) JOIN n USING (query_id) WHERE n_terms = 1
        UNION ALL SELECT query_id, id, score, 'any' FROM loose JOIN n USING (query_id) JOIN any_strict USING (query_id) WHERE n_terms > 1 AND NOT any_strict
        UNION ALL SELECT query_id, id, score, 'all' FROM fused JOIN n USING (query_id) JOIN any_strict USING (query_id) WHERE n_terms > 1 AND any_strict),
      words AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM pool QUALIFY rank <= 50),
      dist AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
      near AS {_top("dist", 50)}, own_w AS (SELECT * FROM words WHERE query_id % 3 <> 1), own_v AS (SELECT * FROM near WHERE query_id % 3 <> 0),
      state AS (SELECT item_id AS query_id, (SELECT any_value(mode) FROM own_w WHERE own_w.query_id = item_id) AS mode, (SELECT count(*) FROM own_v WHERE own_v.query_id = item_id) AS nv FROM benchmark),
      named AS (SELECT query_id, CASE WHEN nv = 0 THEN 'bm25' WHEN mode IS NULL THEN 'vector' ELSE 'hybrid' END AS retriever, CASE WHEN nv = 0 THEN mode WHEN mode IS NULL THEN 'vec' ELSE mode || '+vec' END AS mode FROM state),
      mixed AS (SELECT query_id, id, CASE retriever WHEN 'hybrid' THEN 1.0 / (60 + rank) ELSE score END AS s, named.mode, retriever FROM (SELECT query_id, id, score, rank FROM own_w UNION ALL SELECT query_id, id, score, rank FROM own_v) JOIN named USING (query_id)),
      out AS (SELECT query_id, id, sum(CAST(s AS DOUBLE)) AS score, any_value(mode) AS mode, any_value(retriever) AS retriever FROM mixed GROUP BY 1, 2)
      SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank, mode, retriever FROM out QUALIFY rank <= 10""",
    "question_recalls": f"WITH {_HITS}, {_RECALLS} FROM rec",
    "evaluation_report": f"WITH {_HITS}, {_RECALLS} SELECT count(*) AS questions, round_even(avg(in_pack / total), 3) AS path_recall, round_even(avg(in_candidates / total), 3) AS candidate_recall, CAST(sum(cut) AS BIGINT) AS cut, CAST(sum(total - in_candidates) AS BIGINT) AS not_found FROM rec",
    "files_view": f"""WITH {_CORPUS}, {_PATTERNS}, {_OWNERS}, g AS (SELECT path, min(source_id) AS source_id, count(*) AS chunks, CAST(sum(tokens) AS BIGINT) AS tokens FROM c WHERE contains(lower(path), 'src1') GROUP BY 1)
      SELECT g.path, source_id, chunks, tokens, 'doc' AS kind, owner, false AS test FROM g JOIN own ON own.path = g.path""",
    "chunk_rows": f"WITH {_CORPUS}, {_LINES} SELECT path, id, 1 AS start_line, CAST(end_line AS INTEGER) AS end_line, CASE WHEN id % 2 = 0 THEN lang ELSE '' END AS heading, tokens, id IN (SELECT vec_id FROM embeddings) AS embedded FROM ln",
    "file_texts": f"WITH {_CORPUS}, t AS (SELECT source_id || '/' || lang AS path, string_agg(lower(text), chr(10) ORDER BY id) AS text, CAST(sum(tokens) AS BIGINT) AS tokens FROM c GROUP BY 1) SELECT path, substr(sha256(text), 1, 32) AS hash, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS whole, tokens FROM t",
    "entity_list": f"WITH {_OWN_EDGES}, {_ENTITIES} SELECT id, type, name, (SELECT count(*) FROM edges WHERE dst = ent.id) AS in_degree, (SELECT count(*) FROM edges WHERE src = ent.id) AS out_degree FROM ent WHERE type = 'service' AND contains(lower(name), '_1')",
    "entity_chunks": f"WITH {_CORPUS}, {_LINES} SELECT 'e' || a.id AS entity, b.id FROM ln a JOIN ln b ON a.path = b.path WHERE a.id % 4 = 0 OR (b.end_line >= a.id % 40 AND 1 <= a.id % 40 + 5)",
    "mentioned_in": f"WITH {_CORPUS}, {_MENTION}, {_SEARCH_TERMS}, m AS (SELECT DISTINCT name AS entity, id FROM tok WHERE name IN (SELECT lower(term) FROM st WHERE length(term) >= 4)) SELECT entity, id, path, CAST(row_number() OVER (PARTITION BY entity ORDER BY path, id) AS INTEGER) AS place FROM m JOIN c USING (id) QUALIFY place <= 50",
    "corpus_counts": f"WITH {_CORPUS} SELECT 'language' AS what, lang AS value, count(*) AS n FROM c WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'bucket', bucket, count(*) FROM c GROUP BY 2",
    "chunks_by_source_type": f"WITH {_CORPUS} SELECT 'markdown' AS source_type, source_id, count(*) AS n FROM c WHERE length(source_id) % 2 = 1 GROUP BY 2",
    "latest_sources": f"WITH {_CORPUS}, {_STATES} SELECT source_id, max(seq) AS seq, arg_max(state, seq) AS state FROM st8 WHERE source_id IN (SELECT source_id FROM c) GROUP BY 1",
    "operations_by_user": "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS operations FROM events GROUP BY 1",
    "corpus_findings": f"""WITH {_CORPUS}, s AS (SELECT DISTINCT source_id FROM c UNION ALL SELECT 'new' || i FROM range(3) t(i)), n AS (SELECT source_id, count(*) AS n FROM c GROUP BY 1),
      tot AS (SELECT count(*) AS q, count(*) FILTER (event_type = 'view') AS f, count(*) FILTER (event_type = 'error') AS z, count(*) FILTER (value > 40) AS o FROM events)
      SELECT 'empty_sources' AS finding, source_id AS subject, 0 AS n FROM s WHERE source_id NOT IN (SELECT source_id FROM n)
      UNION ALL SELECT 'never_retrieved', source_id, n FROM n WHERE source_id NOT IN (SELECT 'src' || user_id % 13 FROM events)
      UNION ALL SELECT 'fallback_rate', 'log', f FROM tot WHERE f > 0.3 * q UNION ALL SELECT 'zero_hits', 'log', z FROM tot WHERE z > 0 UNION ALL SELECT 'budget_ceiling', 'log', o FROM tot WHERE o > 0.5 * q
      UNION ALL SELECT 'embedding_gap', source_id, count(*) FROM c WHERE id NOT IN (SELECT vec_id FROM embeddings) GROUP BY 2
      UNION ALL SELECT 'oversized_chunks', source_id, count(*) FROM c WHERE tokens > 1500 GROUP BY 2""",
    "search_references": f"WITH {_HITS}, {_LINES} SELECT query_id, CAST(rank AS INTEGER) AS rank, path || '#L1-' || end_line AS place, tokens FROM {_top('hits', 20)} JOIN ln USING (id)",
    "name_parts": f"""WITH {_CORPUS} SELECT id, source_id || '/' || lang AS folder, source_id || upper(lang[1]) || lang[2:] || upper(bucket[1]) || bucket[2:] AS camel, source_id AS outer_name, 'Doc' || id AS inner_name,
      'file:' || path AS file_id, 'service:svc' || lower(source_id) AS service_id, 'symbol:' || source_id || '.' || lang || '.Doc' || id || '@' || path AS symbol_id FROM c""",
}
