"""DuckDB SQL for the corpus queries that SQL can express.

All limits and lists are written out here again, so that an error in an
operator's values does not repeat itself.
"""

#: url terms that block alone, and soft ones with their weights.
_STRICT = (
    "casino poker gambling betting free-bets porn xxx escort nude viagra cialis cheap-pills spam-farm ads-track warez "
    "torrent keygen phishing malware"
).split()
_SOFT = {
    "1.0": "adult bet bets cheap crack dating jackpot loan loans lottery pills sex spam".split(),
    "0.5": "bonus buy click deal discount free hot promo track win winner".split(),
}


def _has(term: str) -> str:
    return f"regexp_matches(u, '(^|[^\\p{{L}}]){term}($|[^\\p{{L}}])')::INT"


_N_STRICT = " + ".join(_has(t) for t in _STRICT)
_N_SOFT = " + ".join(_has(t) for terms in _SOFT.values() for t in terms)
_WEIGHT = " + ".join(f"{w} * {_has(t)}" for w, terms in _SOFT.items() for t in terms)
_TERMS = ", ".join(f"CASE WHEN {_has(t)} = 1 THEN '{t}' END" for t in sorted([*_STRICT, *_SOFT["1.0"], *_SOFT["0.5"]]))

_URLS = f"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS u,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT page_id, host, path, ({_N_STRICT})::BIGINT AS strict_hits, ({_N_SOFT})::BIGINT AS soft_hits, ({_WEIGHT})::DOUBLE AS soft_weight,
    array_to_string(list_filter([{_TERMS}], lambda x: x IS NOT NULL), ',') AS terms
  FROM parts),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM hits)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN strict_hits > 0 OR (soft_hits >= 2 AND soft_weight >= 1.5) THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, soft_hits, soft_weight, terms
FROM ruled
"""

_HAMMING = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] >= 0) <> (c.embedding[i] >= 0))::BIGINT))::BIGINT AS distance
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id AND q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

_QUALITY = """
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM docs),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs)),
twice AS (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM windows JOIN twice USING (doc_id, g), (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS ws,
    regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS whole
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
judged AS (
  SELECT doc_id, line, list_sum(list_transform(ws, lambda w: length(w))) AS chars,
    10 * (length(whole) - length(regexp_replace(whole, 'licensed under the|is licensed under|all rights reserved|privacy policy|terms of service|terms of use|cookie policy|we use cookies|enable javascript|subscribe to our newsletter|click here to|sign in to|log in to|powered by|skip to content|back to top|copyright \\(c\\)', '', 'gi'))) >= length(whole)
      AND regexp_matches(whole, 'licensed under the|is licensed under|all rights reserved|privacy policy|terms of service|terms of use|cookie policy|we use cookies|enable javascript|subscribe to our newsletter|click here to|sign in to|log in to|powered by|skip to content|back to top|copyright \\(c\\)', 'i')
    OR len(string_split(line, ' | ')) + len(string_split(line, ' » ')) + len(string_split(line, ' > ')) + len(string_split(line, ' • ')) - 4 >= 3
    OR regexp_matches(line, ' \\|[\\x20\\x09-\\x0D]*$')
    OR len(ws) >= 4 AND (
      len(list_filter(ws, lambda w: strlen(w) > 1 AND regexp_matches(w, '[#*$%&|<>!]$'))) > 0.3 * len(ws)
      OR len(list_filter(ws, lambda w: length(w) > 2 AND upper(w) <> lower(w) AND w = upper(w))) > 0.6 * len(list_filter(ws, lambda w: length(w) > 2 AND upper(w) <> lower(w)))
      OR len(ws) >= 12 AND len(list_distinct(ws)) < 0.34 * len(ws)
        AND len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) / (len(ws) - 1) > 0.5) AS bad
  FROM lines),
by_doc AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM judged GROUP BY doc_id),
every AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(lost, 0) AS lost
  FROM base LEFT JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * word_chars AS kept
FROM every
"""

_JOIN = """
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS shingles
  FROM docs),
held AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM held a JOIN held b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reached AS (
  SELECT a AS doc_id, a AS other FROM links UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.c, s.doc_id)) AS component_id
FROM sets s LEFT JOIN (SELECT doc_id, min(other) AS c FROM reached GROUP BY doc_id) c USING (doc_id)
"""

_LINES = """
WITH cut AS (
  SELECT doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
shared AS (
  SELECT key, min(doc_id) AS first FROM cut WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT c.doc_id, c.line, c.i, s.key IS NOT NULL AND c.doc_id <> s.first AS lost FROM cut c LEFT JOIN shared s ON c.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(lost)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_FINITE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""

_NEGATIVES = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""


def _clusters(rounds: int = 10, k: int = 8) -> str:
    """Rounds of assignment and means, written out one after the other."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT id, e, c, d FROM (
    SELECT v.id, v.e, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.m[i]) * (v.e[i] - c.m[i])))::BIGINT AS d
    FROM v CROSS JOIN c{r} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT o.c, coalesce(w.m, o.m) AS m FROM c{r} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (
      SELECT c, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (
        SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) w ON w.c = o.c)"""
    steps = [nearest.format(r=0)]
    for r in range(rounds):
        steps += [moved.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id AS id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h) - 1)::INT AS c, e AS m FROM (
    SELECT e, sha256('3:' || id) AS h FROM v ORDER BY h LIMIT {k})),
{", ".join(steps)}
SELECT a.id AS vec_id, a.c AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m.m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON m.c = a.c
"""


ORACLE: dict[str, str] = {
    "op2_url_filter": _URLS,
    "op4_hamming_search": _HAMMING,
    "op9_line_quality": _QUALITY,
    "op10_ngram_join": _JOIN,
    "op11_line_dedup": _LINES,
    "op12_hard_negatives": _NEGATIVES,
    "op13_heap_clusters": _clusters(),
}
