"""DuckDB SQL for the operators of this subpackage that SQL can express."""

from __future__ import annotations

from loomspark.llm.url_reputation import ADDRESS, ADDRESSES, LIMIT, POINTS, REACH, TAIL, TWO_LABEL_SUFFIXES

_ADDRESS = f"regexp_matches(array_to_string(l, '.'), '{ADDRESS}')"
_TWO = "(" + ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES) + ")"


def _strength(level: str) -> str:
    return f"""(SELECT 1 / least(0.9, greatest(0.001, CASE WHEN free > 0 THEN (s - (k - 1)) / free ELSE 0 END)) - 1 FROM
      (SELECT sum(n * pow(bad / n - mean, 2) / greatest(mean * (1 - mean), 1e-6)) AS s, count(*) AS k, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS free FROM {level} WHERE n > 0))"""


def _shrunk(level: str) -> str:
    """A level's groups with their posterior rate, the strength of its prior, and the spread of groups without labels."""
    return f"""SELECT *, (bad + m * mean) / (n + m) AS rate, CASE WHEN n > 0 THEN 0.0 ELSE 1 - (1 - above) * (m / (m + 1)) END AS loose FROM {level}, (SELECT coalesce({_strength(level)}, 999) AS m)"""


_SMALLEST = """
  WITH RECURSIVE {links}, reach(id, c) AS (SELECT id, id FROM v UNION SELECT l.b, r.c FROM reach r JOIN l ON l.a = r.id WHERE l.b > r.c),
  comp AS (SELECT id, min(c) AS c FROM reach GROUP BY 1)"""



def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', CAST({c} AS VARCHAR)) END"


def _leaf(text: str) -> str:
    return "sha256(concat(" + ", ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"


def _levels(name: str, key: str, base: str) -> str:
    """Levels of ternary trees: ``base`` gives (level 0, key, i, h, n)."""
    return f"""{name}(level, {key}, i, h, n) AS ({base} UNION ALL
        SELECT level + 1, {key}, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY level, {key}, i // 3, n)"""


def _siblings(above: str, of: str, tree: str, match: str, first: int) -> str:
    """A row for each level of a leaf's way, with the digests beside it."""
    own, run = "m.i // CAST(pow(3, t.level) AS BIGINT)", "m.i // CAST(pow(3, t.level + 1) AS BIGINT)"
    side = lambda sign: f"coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (WHERE t.i {sign} {own}), '')"
    return f"SELECT {above}, {first} + t.level AS level, {side('<')} AS before, {side('>')} AS after FROM {of} m JOIN {tree} t ON {match} AND t.n > 1 AND t.i // 3 = {run} GROUP BY {above}, t.level"


ORACLE_SQL: dict[str, str] = {
    "op3_url_reputation": rf"""
      WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
      h AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
            coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
      marked AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
      o AS (SELECT host, bad FROM h JOIN marked ON doc_id = TRY_CAST(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1), '') AS BIGINT) WHERE bad IS NOT NULL),
      g AS (SELECT host, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
            FROM (SELECT host, bad FROM o UNION ALL SELECT host, NULL FROM h) GROUP BY 1),
      t AS (SELECT host, l, n, bad, array_to_string(l[-2:], '.') AS two FROM g),
      hosts AS (SELECT host, n, bad, CASE WHEN {_ADDRESS} THEN '{ADDRESSES}' WHEN two IN {_TWO} THEN two ELSE l[-1] END AS suffix, CASE WHEN {_ADDRESS} THEN array_to_string(l, '.') WHEN two IN {_TWO} THEN array_to_string(l[-3:], '.') ELSE two END AS domain FROM t),
      s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END FROM hosts) AS mean, 0.0 AS above FROM hosts GROUP BY 1),
      s1 AS ({_shrunk("s0")}),
      d0 AS (SELECT hosts.suffix, hosts.domain, sum(hosts.n) AS n, sum(hosts.bad) AS bad, any_value(s1.rate) AS mean, any_value(s1.loose) AS above FROM hosts JOIN s1 ON hosts.suffix = s1.suffix GROUP BY 1, 2),
      d1 AS ({_shrunk("d0")}),
      h0 AS (SELECT host, hosts.n, hosts.bad, d1.rate AS mean, d1.loose AS above FROM hosts JOIN d1 ON hosts.suffix = d1.suffix AND hosts.domain = d1.domain),
      h1 AS ({_shrunk("h0")}),
      w AS (SELECT host, rate, 1 / (CASE WHEN n > 0 THEN 1 / (n + m + 1) ELSE loose END) - 1 AS weight FROM h1),
      ab AS (SELECT host, rate, greatest(rate * weight, 1e-6) AS a, greatest((1 - rate) * weight, 1e-6) AS b FROM w),
      grid AS (SELECT *, ln(a / b) AS mode, sqrt(1 / a + 1 / b + 1 / (a * a) + 1 / (b * b)) * {2 * REACH / (POINTS - 1)} AS step, unnest(range({POINTS})) AS i FROM ab),
      pts AS (SELECT *, mode + (i - {(POINTS - 1) // 2}) * step AS u FROM grid),
      bars AS (SELECT *, exp(-a * (greatest(-u, 0) + ln(1 + exp(-abs(u)))) - b * (greatest(u, 0) + ln(1 + exp(-abs(u))))
        + a * (greatest(-mode, 0) + ln(1 + exp(-abs(mode)))) + b * (greatest(mode, 0) + ln(1 + exp(-abs(mode))))) AS d FROM pts),
      sums AS (SELECT *, sum(d) OVER (PARTITION BY host ORDER BY i) AS upto, {TAIL} * sum(d) OVER (PARTITION BY host) AS goal FROM bars),
      k AS (SELECT host, any_value(rate) AS rate, 1 / (1 + exp(-arg_min(u + (0.5 - (upto - goal) / d) * step, i))) AS lower FROM sums WHERE upto >= goal GROUP BY 1),
      r AS (SELECT page_id, h.host, path, rate, lower,
        CASE WHEN (h.host = 'example.org' OR h.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (h.host = 'example.org' OR h.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (h.host = 'com' OR h.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (h.host = 'com' OR h.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (h.host = 'org' OR h.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h LEFT JOIN k USING (host))
      SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/fr/', 'org/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN lower >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
        round(rate, 6) AS bad_rate, round(lower, 6) AS lower_bound FROM r""",
    "op4_epsilon_grid_join": _SMALLEST.format(
        links="""v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
      l AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.95)"""
    )
    + " SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = comp.id) AS n_links, c AS component_id, id = c AS kept FROM comp",
    "op6_shingle_join": _SMALLEST.format(
        links=r"""w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
      v AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
      t AS (SELECT id, len(s) AS n, unnest(s) AS g FROM v),
      l AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.g = y.g AND x.id <> y.id GROUP BY ALL HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*)))"""
    )
    + " SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM comp JOIN v USING (id)",
    "op11_merkle_manifest": f"""
      WITH RECURSIVE tab AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))),
      odd AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])) & 1 AS odd FROM documents, tab),
      leaves AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS key, {_leaf("text")} AS leaf, CASE WHEN odd = 1 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS changed FROM odd),
      own AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM leaves),
      {_levels("t", "key", "SELECT CAST(0 AS BIGINT), key, i, leaf, n FROM own")},
      subs AS MATERIALIZED (SELECT key, h, row_number() OVER (ORDER BY key) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
      {_levels("u", "one", "SELECT CAST(0 AS BIGINT), 1, i, h, n FROM subs")},
      steps AS MATERIALIZED ({_siblings("m.rid", "own", "t", "t.key = m.key", 0)} UNION ALL
        {_siblings("m.rid", "(SELECT own.rid, subs.i FROM own JOIN subs USING (key))", "u", "true", 1000)}),
      k AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps),
      f(rid, k, h) AS (SELECT rid, CAST(0 AS BIGINT), changed FROM own UNION ALL SELECT f.rid, f.k + 1, sha256(concat(before, f.h, after)) FROM f JOIN k ON k.rid = f.rid AND k.k = f.k + 1),
      folded AS (SELECT rid, arg_max(h, k) AS h FROM f GROUP BY 1),
      proofs AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM k GROUP BY 1)
      SELECT doc_id, leaf, subs.h AS subroot, u.h AS root, coalesce(proof, sha256('')) AS proof_sha256, folded.h AS folded_root, folded.h = u.h AS verified
      FROM own JOIN subs USING (key) JOIN folded USING (rid) JOIN u ON u.n = 1 LEFT JOIN proofs USING (rid)""",
    "op13_hard_negatives": """
      WITH v AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
      p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
      n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
      SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_substring_dedup": r"""
      WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      g AS MATERIALIZED (SELECT rid, doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
      f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY 1),
      gone AS (SELECT rid, list_distinct(flatten(list(range(i, i + 50)))) AS gone_at FROM g JOIN f USING (h) WHERE first < doc_id GROUP BY 1)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone_at), 0) AS BIGINT) AS n_removed,
        sha256(array_to_string(CASE WHEN gone_at IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone_at, i)) END, ' ')) AS kept_sha256
      FROM d LEFT JOIN gone USING (rid)""",
}
