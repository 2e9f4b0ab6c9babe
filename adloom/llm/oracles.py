"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from adloom.llm import fim, linededup, mixing, substrings, urls


def _mix() -> str:
    weights = f"[{', '.join(f'{float(w)}' for w in mixing.WEIGHTS)}]"
    n = len(mixing.WEIGHTS)
    return f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         {weights}[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {n}) + 1] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT 0 AS step, CAST(0 AS DOUBLE) AS level
  UNION ALL
  SELECT step + 1,
         (SELECT ({mixing.SHARE} * sum(source_size)
                  - coalesce(sum({float(mixing.MOST)} * source_size) FILTER ({float(mixing.MOST)} * source_size <= level * weight), 0))
                 / nullif(sum(weight) FILTER ({float(mixing.MOST)} * source_size > level * weight), 0)
          FROM sources)
  FROM levels WHERE step <= (SELECT count(*) FROM sources) AND level IS NOT NULL),
top AS (SELECT max(level) AS level FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN {float(mixing.MOST)} * source_size <= level * weight THEN {float(mixing.MOST)} * source_size
              ELSE level * weight END AS target
  FROM sources, top),
ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected,
         CAST(row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS DOUBLE) AS rank,
         CAST(CAST('0x' || substr(md5(coalesce(s.source, '') || '/7'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor((rank + 1) * expected + start) - floor(rank * expected + start) AS BIGINT) * size AS taken
FROM ranked"""


def _urls() -> str:
    hit = "regexp_matches(lowered, '(^|[^a-z0-9]){}($|[^a-z0-9])')"
    strict = hit.format(f"({'|'.join(urls.STRICT)})")
    soft = " + ".join(f"CAST({hit.format(t)} AS INT)" for t in urls.SOFT)
    rules = ", ".join(f"('{r}', '{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for r, v in urls.RULES)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS h,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (
  SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN {strict} OR ({soft}) >= {urls.SOFT_HITS} THEN 'block' ELSE 'allow' END AS own
  FROM parts),
rules(rule, verdict, rule_host, rule_path) AS (VALUES {rules}),
fit AS (
  SELECT DISTINCT host, path,
         (SELECT max_by(struct_pack(rule := rule, verdict := verdict), (length(rule), rule)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best
  FROM (SELECT DISTINCT host, path FROM hosts))
SELECT page_id, hosts.host, hosts.path, best.rule AS rule, coalesce(best.verdict, own) AS verdict
FROM hosts JOIN fit ON hosts.host = fit.host AND hosts.path = fit.path"""


def _lines() -> str:
    return f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
line AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM split),
counted AS (
  SELECT doc_id, lines, i, len(regexp_extract_all(lines[i], '[^\\x20\\x09-\\x0D]+')) AS w FROM line),
summed AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
fit AS (
  SELECT a.doc_id, a.i AS first, b.i AS last
  FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND a.i <= b.i AND b.upto - a.upto + a.w >= {linededup.MIN_WORDS}),
window_ AS (
  SELECT doc_id, first, min(last) AS last FROM fit GROUP BY doc_id, first
  UNION SELECT doc_id, max(first), last FROM fit GROUP BY doc_id, last),
named AS (
  SELECT w.doc_id, first, last, array_to_string(lines[first:last], chr(10)) AS run
  FROM window_ w JOIN split s ON w.doc_id = s.doc_id),
kept AS (SELECT run, min((doc_id, first)) AS place FROM named GROUP BY run),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i
  FROM named n JOIN kept k ON n.run = k.run AND (n.doc_id, n.first) <> k.place),
rest AS (
  SELECT c.doc_id, string_agg(lines[c.i], chr(10) ORDER BY c.i) FILTER (g.i IS NULL) AS text,
         CAST(count(g.i) AS INT) AS removed_lines
  FROM counted c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.text, '') END AS text,
       coalesce(r.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN rest r ON d.doc_id = r.doc_id"""


def _fim() -> str:
    draw = "CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {at}, 8) AS BIGINT)"
    draws = ", ".join(f"{draw.format(seed=fim.SEED, at=8 * i + 1)} AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(t, '{m}')" for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE))
    return f"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, {draws},
         regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units
  FROM documents),
formed AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN t = '' OR {marked} OR h3 % 100 >= {fim.RATE} THEN 'plain'
              WHEN h4 % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:n], '') AS suffix
  FROM formed)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
              WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
              ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


def _substrings() -> str:
    w = substrings.WINDOW
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(doc_id, {substrings.LAST}) AS d, row_number() OVER () AS n,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
place AS (SELECT n, d, words, unnest(range(1, len(words) - {w - 2})) AS i FROM split WHERE len(words) >= {w}),
named AS (SELECT n, d, i, array_to_string(words[i:i + {w - 1}], ' ') AS run FROM place),
firsts AS (SELECT run, min(d) AS first FROM named GROUP BY run HAVING min(d) < max(d)),
gone AS (
  SELECT DISTINCT n, unnest(range(i, i + {w})) AS i FROM named JOIN firsts ON named.run = firsts.run WHERE d > first),
lost AS (SELECT n, list(i) AS spots FROM gone GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(spots), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(
         CASE WHEN spots IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(spots, i)) END, ' ')) AS kept_sha256
FROM split LEFT JOIN lost ON split.n = lost.n"""


ORACLES: dict[str, str] = {
    "op2_mix": _mix(), "op4_urls": _urls(), "op8_lines": _lines(), "op11_fim": _fim(),
    "op12_substrings": _substrings(),
}
