"""DuckDB statements for the queries that SQL can express, written independently
of the operators: plain comparison of all windows, pairs and scores."""

from __future__ import annotations

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP9 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM iw WHERE len(w) > 0)),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM dw CROSS JOIN (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, item_id, s, p.n AS n FROM places p JOIN windows v ON p.n = v.n AND p.phrase = v.phrase),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP10 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT DISTINCT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0 AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP3 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), %(az)s), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS s FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM g a JOIN g b ON a.g = b.g JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION
  SELECT l.b, r.c FROM _TABLE_ r JOIN links l ON l.a = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.v = d.doc_id
GROUP BY d.doc_id, n.n
""".replace("%(az)s", _AZ).replace("WITH w AS", "WITH RECURSIVE w AS", 1).replace("_TABLE_", "reach")

OP8 = rf"""
WITH l AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS no, x[i] AS line
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
t AS (
  SELECT *, list_sort(list_distinct(regexp_extract_all(translate(line, {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS w
  FROM l),
f AS (SELECT w, min((doc_id, no)) AS first FROM t WHERE len(w) >= 1 GROUP BY w),
u AS (SELECT first, w, len(w) AS n, unnest(w) AS tok FROM f WHERE len(w) >= 4),
m AS (
  SELECT y.first
  FROM u y JOIN u x ON x.tok = y.tok AND x.first < y.first AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY y.first, x.first, y.n, x.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
gone AS (
  SELECT DISTINCT t.doc_id, t.no
  FROM t JOIN f ON t.w = f.w
  WHERE (t.doc_id, t.no) <> f.first OR f.first IN (SELECT first FROM m))
SELECT doc_id, count(*) AS n_lines, count(*) - count(*) FILTER (g.no IS NULL) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY t.no) FILTER (g.no IS NULL), '') AS text
FROM t LEFT JOIN gone g USING (doc_id, no) GROUP BY doc_id
"""

OP11 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || CAST(doc_id AS VARCHAR)) AS d FROM documents),
h AS (
  SELECT doc_id, text, w, len(w) AS n,
         CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(w) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
c AS (
  SELECT doc_id, text, n, form, array_to_string(w[1:least(a, b)], '') AS pre,
         array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS mid, array_to_string(w[greatest(a, b) + 1:], '') AS suf
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""

# CRC-32 by its table of 256 entries, over the bytes of each different word.
OP12 = rf"""
WITH RECURSIVE steps AS (
  SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM steps WHERE k = 8),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dc AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(w) AS w FROM dw) GROUP BY ALL),
ic AS (SELECT w, count(*) AS c FROM (SELECT unnest(w) AS w FROM iw) GROUP BY ALL),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dc UNION SELECT w FROM ic)),
bucket AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
                                                                    lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                            lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS b
  FROM words, tab),
s AS (SELECT b, CAST(sum(c) AS BIGINT) AS s FROM dc JOIN bucket USING (w) GROUP BY b),
t AS (SELECT b, CAST(sum(c) AS BIGINT) AS t FROM ic JOIN bucket USING (w) GROUP BY b),
gain AS (
  SELECT g.b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)
                                   / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000)))) AS BIGINT) AS g
  FROM (SELECT unnest(range(0, 10000)) AS b) g LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
weights AS (SELECT doc_id, CAST(sum(c * g) AS BIGINT) AS weight FROM dc JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8)
                                                               AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM dw LEFT JOIN weights USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND r <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank
FROM placed
"""

ORACLES = {"op3_ngram_jaccard": OP3, "op8_line_dedup": OP8, "op9_decontaminate": OP9, "op10_topk": OP10,
           "op11_fill_middle": OP11, "op12_resample": OP12}
