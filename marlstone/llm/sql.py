"""Equivalent DuckDB SQL of the corpus queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op3_url_filters"] = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
rules(verdict, rule, h, x) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                                      ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
hit AS (
  SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC) AS rn
  FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, x))
SELECT p.page_id, p.host, p.path, hit.rule,
       coalesce(hit.verdict, CASE WHEN p.host = 'cheap-pills.example.com' OR p.host LIKE '%.cheap-pills.example.com'
                                    OR p.host = 'spam-farm.example.org' OR p.host LIKE '%.spam-farm.example.org' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN hit ON hit.page_id = p.page_id AND hit.host = p.host AND hit.path = p.path AND hit.rn = 1
"""

_SCORE = "-ln((('0x' || substr(md5(doc_id::VARCHAR || ':' || {j}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"

SQL["op4_sharding"] = f"""
WITH crc_table AS (
  WITH RECURSIVE t(i, c, k) AS (SELECT i, i::UBIGINT, 0 FROM range(256) r(i) UNION ALL
    SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)
  SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 8 AS size FROM documents),
s AS (SELECT doc_id, text, size,
        arg_min(j, {_SCORE.format(j="j")}) FILTER (WHERE j < 24) AS shard, arg_min(j, {_SCORE.format(j="j")}) AS grown
      FROM d, range(25) r(j) GROUP BY doc_id, text, size),
c AS (SELECT s.*, xor(list_reduce(list_prepend(4294967295::UBIGINT,
          list_transform(range(octet_length(encode(text))), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::UBIGINT)),
          lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
      FROM s, crc_table)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(doc_id::VARCHAR || ':' || size::VARCHAR || ':' || crc::VARCHAR), 1, 8))::BIGINT % greatest(16, (SELECT (count(*) + 65535) // 65536 FROM documents)), doc_id) - 1 AS slot, grown::INT AS grown_shard FROM c
"""

SQL["op7_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, regexp_replace(replace(replace(role, '<|', '< |'), '|>', '| >'), '[\r\n]+', ' ', 'g') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, text) - 1 AS q, count(*) OVER (PARTITION BY conv_id) AS total FROM t),
d AS (
  SELECT conv_id, role, text, q, q // 1024 AS part, false AS carried FROM k
  UNION ALL SELECT conv_id, role, text, q, q // 1024 + 1, true FROM k WHERE q % 1024 >= 992 AND total > (q // 1024 + 1) * 1024),
f AS (
  SELECT p.conv_id, k.role, k.text, k.q, p.part, true AS carried
  FROM (SELECT DISTINCT conv_id, part FROM d WHERE part > 0) p JOIN k ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND k.role = 'system' AND k.q < p.part * 1024 - 32
  QUALIFY row_number() OVER (PARTITION BY p.conv_id, p.part ORDER BY k.q DESC) = 1),
a AS (SELECT * FROM d UNION ALL SELECT * FROM f),
s AS (SELECT DISTINCT conv_id, part, role AS participant FROM d WHERE NOT carried AND role IS DISTINCT FROM 'system'),
r AS (
  SELECT a.conv_id, a.part, participant, q, carried, text, NOT carried AND role IS NOT DISTINCT FROM participant AS own,
         CASE WHEN role IS NOT DISTINCT FROM participant THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' WHEN role IS NULL THEN '<|user|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
         text || '<|end|>' AS body
  FROM a JOIN s ON a.conv_id IS NOT DISTINCT FROM s.conv_id AND a.part = s.part),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, part, participant ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM r)
SELECT conv_id, part, participant, count(*) FILTER (WHERE NOT carried) AS n_turns, count(*) FILTER (WHERE own) AS n_assistant, count(*) FILTER (WHERE carried) AS n_carried,
       string_agg(head || body || chr(10), '' ORDER BY q) AS text,
       coalesce(string_agg((start::BIGINT)::VARCHAR || ':' || ((start + length(body))::BIGINT)::VARCHAR, ';' ORDER BY q) FILTER (WHERE own), '') AS mask_spans
FROM o GROUP BY conv_id, part, participant
"""

SQL["op8_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i + 1:i + least(13, len(w))], ' ') AS g
        FROM bw, LATERAL (SELECT unnest(range(greatest(len(w) - 12, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM dw, sizes, LATERAL (SELECT unnest(range(greatest(len(w) - n + 1, 0))) AS i)),
hit AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(n)) AS k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x COLLATE "C") AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL["op9_exact_dedup"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY x)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(x) AS text_sha256 FROM t JOIN g USING (x)
"""

SQL["op10_line_dedup"] = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS pos, ls[i + 1] AS line, ('0x' || substr(md5(ls[i + 1]), 1, 12))::BIGINT AS h,
             len(list_filter(regexp_split_to_array(ls[i + 1], '[ \t\r]+'), lambda w: w <> '')) AS w
      FROM d, LATERAL (SELECT unnest(range(len(ls))) AS i)),
f AS (SELECT l.*, w > 0 AND count(*) OVER (PARTITION BY h) > 1 AS again FROM l),
r AS (SELECT *, (h + coalesce(lag(h) OVER q, 0) * 31) % 1000003 % 4 = 0 AND coalesce(lag(again) OVER q = again, false) AS roll, lag(again) OVER q AS past, lead(again) OVER q AS future, lead(again, 2) OVER q AS later FROM f WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
c AS (SELECT *, roll AND NOT coalesce(lag(roll) OVER (PARTITION BY doc_id ORDER BY pos), false) AND coalesce(future = again, false) AND coalesce(later = again, false) AS cut FROM r),
b AS (SELECT *, coalesce(lag(cut) OVER q, true) OR past <> again AS starts FROM c WINDOW q AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk FROM b),
k AS (SELECT doc_id, chunk, min(pos) AS first, count(*) AS n, sum(w) AS w, bool_and(again) AS again, string_agg(line, chr(10) ORDER BY pos) AS body FROM n GROUP BY doc_id, chunk),
units AS (SELECT doc_id, chunk, true AS whole, first, n, body FROM k WHERE again AND (n >= 2 AND w >= 12 OR w >= 40)
          UNION ALL SELECT doc_id, chunk, false, n.pos, 1, line FROM n JOIN (SELECT doc_id, chunk FROM k WHERE n > 1) USING (doc_id, chunk) WHERE again AND w >= 40),
able AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM units),
lost AS (SELECT doc_id, chunk, n FROM able WHERE whole AND place > 1),
long AS (SELECT doc_id, first, n FROM able ANTI JOIN lost USING (doc_id, chunk) WHERE NOT whole AND place > 1),
kept AS (SELECT n.doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM n ANTI JOIN lost ON n.doc_id = lost.doc_id AND n.chunk = lost.chunk ANTI JOIN long ON n.doc_id = long.doc_id AND n.pos = long.first GROUP BY n.doc_id),
gone AS (SELECT doc_id, sum(n) AS nl, count(*) AS nc FROM (SELECT doc_id, n FROM lost UNION ALL SELECT doc_id, n FROM long) GROUP BY doc_id)
SELECT documents.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, coalesce(nl, 0)::BIGINT AS n_removed_lines,
       coalesce(nc, 0)::BIGINT AS n_removed_chunks, CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS text_sha256,
       CASE WHEN text IS NULL THEN NULL ELSE length(coalesce(t, '')) END::BIGINT AS n_chars
FROM documents LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""

SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS g FROM w, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, r FROM reach JOIN both_ways ON a = v WHERE b > r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.r AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) r ON r.v = d.doc_id
"""
