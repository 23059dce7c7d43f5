"""The same results in DuckDB's SQL, where SQL can express them."""

OP1 = r"""
WITH u AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total FROM u GROUP BY source),
w AS (SELECT source, total, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS DOUBLE) AS weight, 2.0 * CAST(total AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, (1.5 * (SELECT CAST(sum(total) AS DOUBLE) FROM w)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nr FROM w),
f AS (SELECT arg_min(level, nr) FILTER (WHERE level * weight <= cap) AS share FROM l),
t AS (SELECT source, total, CASE WHEN share IS NULL THEN cap ELSE least(cap, share * weight) END AS target FROM l, f),
h AS (SELECT source, length(bin(size)) AS b, CAST(sum(size) AS BIGINT) AS words FROM u WHERE size > 0 GROUP BY ALL),
r AS (
  SELECT h.source, b, words, total, target,
         (target - 2.0 * CAST(coalesce(sum(words) OVER (PARTITION BY h.source ORDER BY b DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(b * words) OVER (PARTITION BY h.source ORDER BY b DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS rate
  FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source),
c AS (SELECT source, arg_max(rate, b) FILTER (WHERE rate * b <= 2.0) AS c FROM r GROUP BY source),
m AS (
  SELECT r.source, b, words, total, target,
         CASE WHEN c IS NULL OR target >= 2.0 * total THEN 2.0 ELSE least(2.0, c * b) END AS copies
  FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source),
p AS (SELECT *, CAST(floor(copies) AS BIGINT) AS certain, copies - floor(copies) AS p FROM m),
g AS (
  SELECT source, target - CAST(sum(certain * words) AS DOUBLE) AS sampled,
         CAST(sum(CASE WHEN p > 0 THEN words ELSE 0 END) AS DOUBLE) AS open_words, min(target) AS target FROM p GROUP BY source, target),
d AS (
  SELECT u.doc_id, u.source, u.size, p.certain, p.p, g.sampled, CASE WHEN open_words > 0 THEN g.sampled / open_words END AS mean,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(u.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS v
  FROM u LEFT JOIN p ON u.source IS NOT DISTINCT FROM p.source AND length(bin(u.size)) = p.b AND u.size > 0
         LEFT JOIN g ON u.source IS NOT DISTINCT FROM g.source),
q AS (
  SELECT *, CASE WHEN p > 0 AND mean > 0 AND mean < 1 AND size > 0 THEN (v / (1 - v)) * ((1 - p) / p) * (mean / (1 - mean)) END AS q FROM d),
k AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT k.doc_id, k.size, coalesce(t.total, 0) AS source_size, coalesce(t.target, 0.0) AS target,
       CAST(CASE WHEN k.size > 0 THEN k.size * (certain + CASE WHEN q IS NOT NULL AND CAST(upto AS DOUBLE) - k.size / 2.0 <= sampled THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM k LEFT JOIN t ON k.source IS NOT DISTINCT FROM t.source
"""

OP2 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
g AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(words)) AS n, array_to_string(words[i : i + least(10, len(words)) - 1], ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
k AS (SELECT DISTINCT n FROM g),
p AS (
  SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, k WHERE len(words) >= n)),
h AS (SELECT doc_id, p.n, i, item FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (
  SELECT DISTINCT doc_id, md5(array_to_string(words[i : i + 4], ' ')) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id != b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.least, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""

OP6 = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, host, path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
m AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""

ORACLES = {"op1_mixing": OP1, "op2_decontamination": OP2, "op3_ngram_jaccard": OP3, "op6_url_filter": OP6}
