"""SQL for DuckDB that gives the rows of the queries which SQL can express."""

#: op5: rules as rows, the longest that fits; then globs as regular expressions.
_OP5 = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN
    regexp_full_match(host || path, '[^/]*(casino|free-bets|cheap-pills|ads-track|poker|viagra)[^/]*/.*', 's')
    OR regexp_full_match(host || path, '.*/(login|cart|ads)/.*', 's')
    OR regexp_full_match(host || path, '.*\.(exe|zip)', 's')
  THEN 'block' ELSE 'allow' END) AS verdict
FROM fits WHERE k = 1
"""

#: op6: words and lines by position, windows of five words counted per document.
_OP6 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, k, list_slice(ws, k, k + 4) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS k FROM w WHERE len(ws) >= 5)),
c AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT k + j) AS n_repeat FROM c, (SELECT unnest(range(0, 5)) AS j) WHERE n > 1 GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

#: op8: levels of the sources by a running sum, then places on each source's word axis.
_OP8 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source::BLOB) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM s),
o AS (
  SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS ratio,
    row_number() OVER (ORDER BY (2 * source_size)::DOUBLE / weight, source IS NULL, source::BLOB) AS j
  FROM w),
v AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM o)::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT arg_min(level, j) FROM v WHERE level <= ratio) * weight, cap::DOUBLE)) AS target FROM v),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + least(greatest(budget - (budget // source_size) * source_size - start, 0), size) END)::BIGINT AS taken
FROM x
"""

#: op10: all products of queries and other vectors, whole numbers throughout.
_OP10 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

#: op13: SHA-1 by the engine's hexadecimal form, five bits a digit; equal payloads by their bytes.
_OP13 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
f AS (SELECT body, min(page_id) AS first_id, count(*) AS n FROM p GROUP BY body),
d AS (
  SELECT p.page_id, octet_length(encode(p.body)) AS payload_bytes, sha1(p.body) AS hex, first_id
  FROM p JOIN f USING (body)),
b AS (SELECT *, string_agg_bits FROM (
  SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || hex[i])::INT), 4, '0')), 'string_agg', '') AS string_agg_bits FROM d))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    list_reduce(list_transform(range(1, 6), lambda j: substr(string_agg_bits, 5 * k + j, 1)::INT), lambda x, y: 2 * x + y)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""

CHECKS = {"op10_norm_sorted_top_k": _OP10, "op13_warc_transactions": _OP13, "op5_url_filters": _OP5, "op6_quality_ledger": _OP6, "op8_source_mix": _OP8}
