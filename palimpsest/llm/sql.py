"""DuckDB SQL that says what a query returns, in full, over its whole tables.

op4 goes all its rounds by recursion over one table of weights, in which the teleport is a host without name. op1's says which items are in a text verbatim, which in the test tables are all leaks; leaks with edits are beyond SQL and
tested against edit distances. op2's and op8's tokenisers, op3's states, op6's checksums, op7's sample and op9's trees are
beyond SQL: those queries are tested against brute force in tests/llm.
"""

from .url_filter import BLOCK_AT, DAMPING, ROUNDS

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1), '')"


def _rule(host: str, path: str, values: tuple[str, str, str, str]) -> str:
    rules = (("example.net", "/en/"), ("example.com", "/de/"), ("org", "/fr/"), ("net", "/"))  # the longest first
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{v}'" for (h, p), v in zip(rules, values, strict=True)) + " END"


_NAMES, _VERDICTS = ("example.net/en/", "example.com/de/", "org/fr/", "net/"), ("allow", "block", "allow", "block")

OP4 = rf"""
WITH RECURSIVE parsed AS (SELECT page_id, html, {_host("url")} AS host, {_path("url")} AS path FROM pages),
judged AS (SELECT *, {_rule("host", "path", _NAMES)} AS rule, {_rule("host", "path", _VERDICTS)} AS ruled FROM parsed),
hosts AS (SELECT host, count(*) FILTER (ruled = 'allow')::DOUBLE AS trusted, count(*) FILTER (ruled = 'block')::DOUBLE AS blocked FROM judged WHERE host <> '' GROUP BY host),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?([^"''\s>]+)', 1)) AS u FROM parsed WHERE host <> '' AND contains(html, '//')),
named AS (SELECT src, CASE WHEN starts_with(u, '//') THEN 'x:' || u ELSE u END AS u FROM found WHERE contains(u, '//')),
linked AS (SELECT src, {_host("u")} AS dst, {_path("u")} AS path FROM named),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n, (count(*) FILTER ({_rule("dst", "path", _VERDICTS)} = 'block'))::DOUBLE AS bad FROM linked WHERE dst <> '' AND src <> dst GROUP BY src, dst),
outs AS (SELECT *, sum(n) OVER (PARTITION BY src) AS gone, sum(n) OVER (PARTITION BY dst) AS come FROM edges),
seeds AS (
  SELECT host, 'trust' AS kind, trusted / greatest(sum(trusted) OVER (), 1e-300) AS seed FROM hosts
  UNION ALL SELECT host, 'distrust', blocked / greatest(sum(blocked) OVER (), 1e-300) FROM hosts
  UNION ALL SELECT src, 'exposure', {DAMPING} * sum(bad / gone) FROM outs GROUP BY src),
weights AS (
  SELECT src, dst, 'trust' AS kind, {DAMPING} * n / gone AS w FROM outs
  UNION ALL SELECT dst, src, 'distrust', {DAMPING} * n / come FROM outs
  UNION ALL SELECT dst, src, 'exposure', {DAMPING} * (n - bad) / gone FROM outs
  UNION ALL SELECT '', host, kind, (1 - {DAMPING}) * seed FROM seeds
  UNION ALL SELECT DISTINCT '', '', kind, 1.0 FROM seeds),
scores AS (
  SELECT 0 AS r, host, kind, seed AS score FROM seeds
  UNION ALL SELECT DISTINCT 0, '', kind, 1.0 FROM seeds
  UNION ALL SELECT r + 1, dst, weights.kind, sum(score * w) FROM scores JOIN weights ON src = host AND weights.kind = scores.kind WHERE r < {ROUNDS} GROUP BY r + 1, dst, weights.kind),
settled AS (SELECT host, kind, score / CASE WHEN kind = 'exposure' OR sum(score) OVER (PARTITION BY kind) = 0 THEN 1 ELSE sum(score) OVER (PARTITION BY kind) END AS score FROM scores WHERE r = {ROUNDS} AND host <> ''),
bad AS (
  SELECT host FROM settled GROUP BY host
  HAVING coalesce(sum(score) FILTER (kind = 'exposure'), 0) >= {BLOCK_AT} AND coalesce(sum(score) FILTER (kind = 'distrust'), 0) > coalesce(sum(score) FILTER (kind = 'trust'), 0))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

_NORMAL = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"

OP1 = rf"""
WITH docs AS (SELECT doc_id, {_NORMAL} AS t FROM documents), items AS (SELECT item_id, {_NORMAL} AS i FROM benchmark)
SELECT doc_id, item_id, CAST(strpos(t, i) - 1 AS BIGINT) AS start, CAST(0 AS BIGINT) AS edits, true AS contaminated, false AS kept FROM docs JOIN items ON i <> '' AND contains(t, i)
"""

OP5 = r"""
WITH words AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS k FROM words, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS p)),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, p + i AS at FROM windows JOIN firsts USING (k), LATERAL (SELECT unnest(generate_series(0, 12)) AS i) WHERE least < doc_id),
kept AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.at) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM words) a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.at = g.at
  WHERE g.at IS NULL GROUP BY a.doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes m ON m.doc_id = a JOIN sizes n ON n.doc_id = b WHERE 100 * c >= 75 * (m.n + n.n - c)),
reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
FROM documents d JOIN reached ON reached.a = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id
"""

ORACLE_SQL = {"op1_decontamination": OP1, "op4_url_filter": OP4, "op5_substring": OP5, "op10_near_dedup": OP10}
