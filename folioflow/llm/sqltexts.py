"""DuckDB SQL of the queries that SQL can express, in the order of queries.py."""

URLS = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/?[^?#]*)', 1) AS path
  FROM u
), r(r_host, r_path, r_verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
    ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), w AS (
  SELECT v.page_id, v.host, v.path, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY v.page_id, v.host, v.path ORDER BY length(r_host || r_path) DESC NULLS LAST) AS k
  FROM (SELECT DISTINCT * FROM v) v LEFT JOIN r ON (v.host = r_host OR ends_with(v.host, '.' || r_host)) AND starts_with(v.path, r_path)
)
SELECT v.page_id, v.host, v.path, w.rule, coalesce(w.r_verdict, 'allow') AS verdict
FROM v JOIN w ON v.page_id IS NOT DISTINCT FROM w.page_id AND v.host = w.host AND v.path = w.path AND w.k = 1
"""

CHATS = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'),
      '<turn>', '<\turn>'), '</role>', '<\/role>'), '</part>', '<\/part>'), '</turn>', '<\/turn>') AS body,
    lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN opens THEN 13 + length(role) ELSE 7 END + CASE WHEN closes THEN 8 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

