"""DuckDB SQL that gives the rows of the queries it can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Five hexadecimal digits of a SHA-1 are four letters of base32.
OP2 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x),
v AS (SELECT page_id, n, x, list_transform(range(0, 8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS v FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v[k // 4 + 1] >> (15 - 5 * (k % 4))) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM v JOIN f USING (x)
"""

OP8 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents
), wins AS (
  SELECT rid, i, list_aggregate(w[i:i+7], 'string_agg', ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM docs WHERE len(w) >= 8)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid
), base AS (
  SELECT d.rid, doc_id, t, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (SELECT count(x) - count(DISTINCT x) FROM (SELECT unnest(string_split(t, chr(10))) AS x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]'))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(t) - len(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, len(t) - len(replace(t, '!', '')) AS n_bang,
    len(string_split(t, chr(10))) AS n_lines
  FROM docs d LEFT JOIN rep USING (rid)
), judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)
    OR word_chars > 25 * n_words OR word_chars < 2 * n_words OR 2 * n_upper > word_chars OR 10 * n_bang > 3 * n_words) AS kept
FROM judged
"""


OP3 = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
)
SELECT page_id, host, path,
  (SELECT h || rules.p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) ORDER BY length(h || rules.p) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) ORDER BY length(h || rules.p) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""

def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op3_url_filters": OP3, "op8_quality_rules": OP8}
