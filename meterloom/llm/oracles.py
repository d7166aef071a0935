"""SQL for those queries of this package that SQL can express."""

OP5 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
p AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d),
l AS (SELECT doc_id, pos, lines[pos] AS line,
             CASE WHEN pos + 2 <= len(lines) THEN lines[pos] || chr(10) || lines[pos + 1] || chr(10) || lines[pos + 2] END AS passage
      FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY passage ORDER BY doc_id, pos) AS nth FROM l WHERE passage IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) AS o(k) WHERE nth > 1),
s AS (SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS text,
             count(*) AS n_lines, count(g.pos) AS n_removed
      FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.text, '') END AS text,
       coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

OP9 = r"""
WITH RECURSIVE
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
found AS (SELECT url AS a, unnest([
    regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?i)<link\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*?\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)', 1),
    regexp_extract(html, '(?i)<meta\b[^>]*?\bcontent\s*=\s*["''][^"''>]*?\burl\s*=\s*([^"''\s>]+)[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b', 1)]) AS b
  FROM pages),
links AS (SELECT a, CASE WHEN starts_with(b, '//') THEN 'http:' || b WHEN starts_with(b, '/') THEN regexp_extract(a, '^([^:]*://[^/?#]*)', 1) || b ELSE b END AS b FROM found WHERE b <> ''),
urls AS (SELECT url FROM pages UNION SELECT b FROM links WHERE contains(b, '://')),
parts AS (SELECT url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^/?#]*[^?#]*(\?[^#]*)', 1), '') AS query FROM urls),
ruled AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || path || query END AS node, r.rule, r.verdict
  FROM parts p LEFT JOIN LATERAL (
    SELECT rule_host || rule_path AS rule, rule_verdict AS verdict FROM rules
    WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
    ORDER BY length(rule_host || rule_path) DESC, rule_verdict LIMIT 1) r ON true),
edges AS (SELECT x.node AS u, y.node AS v FROM links l JOIN ruled x ON x.url = l.a JOIN ruled y ON y.url = l.b WHERE x.node IS NOT NULL AND y.node IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reached AS (SELECT DISTINCT node FROM ruled WHERE verdict = 'block' AND node IS NOT NULL UNION SELECT v FROM reached JOIN both_ways ON u = node),
marked AS (SELECT DISTINCT node FROM reached WHERE node IN (SELECT u FROM both_ways))
SELECT p.page_id, coalesce(r.host, '') AS host, coalesce(r.path, '') AS path, r.rule,
       CASE WHEN r.verdict IS NULL AND m.node IS NOT NULL THEN 'block' ELSE coalesce(r.verdict, 'allow') END AS verdict,
       r.verdict IS NULL AND m.node IS NOT NULL AS by_alias
FROM pages p LEFT JOIN ruled r ON r.url = p.url LEFT JOIN marked m ON m.node = r.node
"""

OP11 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, list_sum([(length(x) - length(replace(x, s, ''))) // length(s) FOR s IN ['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<<ROLE:', '<</ROLE>>']])
               + length(x) - length(replace(x, chr(92), '')) AS extra
      FROM (SELECT *, text AS x FROM t)),
r AS (SELECT *, list_sum([(length(role) - length(replace(role, s, ''))) // length(s) FOR s IN ['<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<<ROLE:', '<</ROLE>>']])
               + length(role) - length(replace(role, chr(92), '')) + length(role) - length(replace(role, '>', '')) AS role_extra FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(text) + extra + CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 6 WHEN 'system' THEN 19
                                           ELSE 22 + length(role) + role_extra END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

ORACLES: dict[str, str] = {"op5_line_dedup": OP5, "op9_url_filter": OP9, "op11_chat_format": OP11}
