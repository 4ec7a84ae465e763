"""DuckDB SQL for those registered queries that SQL can express."""

from . import line_quality

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS sh
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

# For each rule in turn: does it fit; the longest that fits decides.
OP2 = f"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
s AS (
  SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, h, p, verdict) AS (VALUES
  ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
  ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block'))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN (
  SELECT s.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM s JOIN r ON (s.host = h OR s.host LIKE '%.' || h) AND starts_with(s.path, p) GROUP BY s.page_id) m USING (page_id)
"""

OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(any_value(n_links), 0)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY vec_id
"""

OP8 = """
WITH t AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM conversations),
c AS (
  SELECT conv_id, place, role, text,
    string_agg(sha256(concat(role IS NULL, '/', text IS NULL, '/', length(coalesce(role, '')), '/', coalesce(role, ''), coalesce(text, ''))), '')
      OVER (PARTITION BY conv_id ORDER BY place) AS so_far,
    place = max(place) OVER (PARTITION BY conv_id) AS last
  FROM t),
e AS (SELECT so_far, min(conv_id) AS conv_id, max(place)::BIGINT AS n_turns, count(*)::BIGINT AS n_collapsed FROM c WHERE last GROUP BY so_far),
m AS (SELECT * FROM e WHERE so_far NOT IN (SELECT so_far FROM c WHERE NOT last))
SELECT m.conv_id, m.n_turns, m.n_collapsed,
  string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS chat
FROM m JOIN c USING (conv_id) GROUP BY m.conv_id, m.n_turns, m.n_collapsed
"""

# crc32 of an id's digits, bit by bit; then equal words of a text in pairs, and stretches of them by distance.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295)"""

OP11 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32.format("doc_id")} AS h FROM documents),
e AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS k FROM d),
t AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + k)) END]) ELSE w END AS w
  FROM e),
x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM t),
m AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND l.i < r.i WHERE 3 * (r.i - l.i) <= l.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM g GROUP BY doc_id, q, island),
r AS (SELECT * FROM s WHERE length >= greatest(24, 3 * period) QUALIFY row_number() OVER (PARTITION BY doc_id, start, length ORDER BY period) = 1),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
a AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM r GROUP BY doc_id),
k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
  (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_PHRASES = "|".join(line_quality.PHRASES)
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS part FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
v AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS word FROM (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY doc_id, part) > 1)),
n AS (SELECT doc_id, count(*) AS n_repeat_words FROM v GROUP BY doc_id),
p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
q AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
    len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(line, '[|»›•·]')) AS bars,
    regexp_matches(line, '[.!?…:;。！？]["'')\\]»”’]*[\\x20\\x09-\\x0D]*$') AS ended, row_number() OVER (PARTITION BY doc_id, line) > 1 AS again
  FROM p),
l AS (
  SELECT doc_id, sum(chars) AS word_chars, count(*) FILTER (words > 0 AND again) AS n_dup_lines,
    sum(chars) FILTER (words > 0 AND (words < 5 AND NOT ended OR symbols >= 3 AND 10 * symbols > 3 * words OR bars >= 2 AND 4 * bars >= words
      OR words <= 25 AND regexp_matches({LOWER.format("line")}, '{_PHRASES}'))) AS lost
  FROM q GROUP BY doc_id),
c AS (
  SELECT doc_id, len(w) AS n_words, word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost
  FROM d JOIN l USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * coalesce(lost, 0) <= 50 * word_chars AS kept
FROM c
"""

OP13 = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w FROM documents),
d AS (
  SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM h),
c AS (
  SELECT doc_id, text, n, w, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(w[1:lo], ''), '') AS p, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS m,
    coalesce(array_to_string(w[hi + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLES = {
    "op1_minhash_near_dedup": OP1, "op2_url_filters": OP2, "op5_warc": OP5, "op6_embedding_near_dedup": OP6, "op8_chat_formatting": OP8,
    "op11_periodic_runs": OP11, "op12_quality_rules": OP12, "op13_fill_in_middle": OP13,
}
