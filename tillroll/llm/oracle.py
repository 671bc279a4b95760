"""DuckDB SQL of the operators that SQL expresses."""

from __future__ import annotations

from .license_scan import TEMPLATES, bounds, template_bigrams, template_words
from .url_reputation import LEAST_STRENGTH, MOST_STRENGTH, OVERALL_BAD, OVERALL_GOOD, TWO_LABEL_SUFFIXES

_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_sql(rules: list[tuple[str, str, str]], z: float = 1.6448536269514722, threshold: float = 0.5) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    two = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def strength(level: str) -> str:
        n = "(good + bad)"
        r = (f"least(greatest(CASE WHEN sum(mu * (1 - mu) * ({n} - 1)) > 0 THEN (sum((bad - {n} * mu) ** 2 / {n}) - sum(mu * (1 - mu)))"
             f" / sum(mu * (1 - mu) * ({n} - 1)) ELSE 0 END, {1 / (1 + MOST_STRENGTH)!r}), {1 / (1 + LEAST_STRENGTH)!r})")
        return f"(SELECT coalesce((1 - {r}) / {r}, {MOST_STRENGTH}) FROM {level} WHERE {n} > 0)"

    def shrunk(level: str) -> str:
        return (f"SELECT *, (mu * m + bad) / (m + good + bad) AS rate, m + good + bad AS weight "
                f"FROM (SELECT *, {strength(level)} AS m FROM {level})")

    return f"""
WITH split_urls AS (
  SELECT page_id,
         translate(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*', 0, 's') ELSE '' END, {_FOLD}) AS host,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path
  FROM (SELECT page_id, coalesce(url, '') AS url FROM pages)),
rules(verdict, rule_host, rule_path) AS (VALUES {listed}),
pairs AS (SELECT DISTINCT host, path FROM split_urls),
fitting AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(verdict, length(rule_host || rule_path)) AS ruled
  FROM pairs JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL),
judged AS (SELECT s.*, rule, ruled FROM split_urls s LEFT JOIN fitting f ON s.host = f.host AND s.path = f.path),
named AS (
  SELECT host, good, bad, regexp_replace(host, ':[0-9]*$', '') AS name
  FROM (SELECT host, count(*) FILTER (ruled = 'allow') AS good, count(*) FILTER (ruled = 'block') AS bad FROM judged GROUP BY host)),
suffixed AS (
  SELECT *, CASE WHEN regexp_extract(name, '([^.]+[.][^.]+)$', 1) IN ({two}) THEN regexp_extract(name, '([^.]+[.][^.]+)$', 1)
                 ELSE regexp_extract(name, '([^.]*)$', 1) END AS suffix FROM named),
host_counts AS (
  SELECT *, CASE WHEN length(name) > length(suffix)
                 THEN regexp_extract(substr(name, 1, length(name) - length(suffix) - 1), '([^.]*)$', 1) || '.' || suffix
                 ELSE name END AS domain FROM suffixed),
domain_counts AS (SELECT domain, suffix, sum(good) AS good, sum(bad) AS bad FROM host_counts GROUP BY ALL),
suffix_counts AS (
  SELECT suffix, sum(good) AS good, sum(bad) AS bad,
         (SELECT (coalesce(sum(bad), 0) + {OVERALL_BAD}) / (coalesce(sum(good + bad), 0) + {OVERALL_GOOD + OVERALL_BAD}) FROM domain_counts) AS mu
  FROM domain_counts GROUP BY suffix),
suffix_rates AS ({shrunk("suffix_counts")}),
domain_level AS (SELECT d.*, s.rate AS mu FROM domain_counts d JOIN suffix_rates s USING (suffix)),
domain_rates AS ({shrunk("domain_level")}),
host_level AS (SELECT h.host, h.good, h.bad, d.rate AS mu FROM host_counts h JOIN domain_rates d USING (domain, suffix)),
host_rates AS ({shrunk("host_level")})
SELECT page_id, j.host, path, rule,
       coalesce(ruled, CASE WHEN rate - {z!r} * sqrt(rate * (1 - rate) / (weight + 1)) > {threshold} THEN 'block' ELSE 'allow' END) AS verdict,
       round(rate, 6) AS bad_rate, CAST(good + bad AS BIGINT) AS labelled
FROM judged j JOIN host_rates r ON j.host = r.host
"""


def license_sql(threshold: float = 0.8) -> str:
    listed = []
    for name, texts in sorted(TEMPLATES.items()):
        for t in texts:
            b = template_bigrams(t)
            low, high = bounds(len(b), threshold)
            listed.append(f"({len(listed)}, '{name}', [{', '.join(repr(x) for x in b)}], {len(template_words(t)) - 1}, {low}, {high})")
    return f"""
WITH templates(no, name, grams, span, low, high) AS (VALUES {', '.join(listed)}),
texts AS (SELECT row_number() OVER () AS row_no, coalesce(text, '') AS t FROM documents),
units AS (
  SELECT DISTINCT row_no, trim(regexp_replace(translate(u, {_FOLD}), '[^a-z0-9]+', ' ', 'g')) AS unit
  FROM (SELECT row_no, unnest(string_split(t, chr(10)) || string_split_regex(t, '\\n[ \\t\\r]*\\n') || [t]) AS u FROM texts)),
sets AS (
  SELECT row_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams
  FROM (SELECT row_no, string_split(unit, ' ') AS w FROM units)),
unit_hits AS (
  SELECT row_no, no, 2.0 * len(list_intersect(s.grams, t.grams))::DOUBLE / (len(s.grams) + len(t.grams)) AS dice
  FROM sets s JOIN templates t ON len(s.grams) BETWEEN t.low AND t.high),
pairs AS (
  SELECT row_no, i, w[i] || ' ' || w[i + 1] AS gram
  FROM (SELECT row_no, w, unnest(range(1, len(w))) AS i
        FROM (SELECT row_no, string_split(trim(regexp_replace(translate(t, {_FOLD}), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM texts))),
places AS (
  SELECT row_no, i, gram, no, span, low, size FROM pairs
  JOIN (SELECT no, span, low, len(grams) AS size, unnest(grams) AS gram FROM templates) USING (gram)),
starts AS (
  SELECT a.row_no, a.no, a.i, a.span, a.size, count(DISTINCT b.gram) AS common
  FROM places a JOIN places b ON a.row_no = b.row_no AND a.no = b.no AND b.i >= a.i AND b.i < a.i + a.span
  GROUP BY ALL HAVING count(DISTINCT b.gram) >= any_value(a.low)),
window_hits AS (
  SELECT s.row_no, s.no, 2.0 * s.common::DOUBLE / (count(DISTINCT p.gram) + s.size) AS dice
  FROM starts s JOIN pairs p ON p.row_no = s.row_no AND p.i >= s.i AND p.i < s.i + s.span
  GROUP BY s.row_no, s.no, s.i, s.common, s.size),
hits AS (
  SELECT row_no, no, any_value(name) AS name, max(dice) AS dice
  FROM (SELECT * FROM unit_hits UNION ALL SELECT * FROM window_hits) JOIN templates USING (no) WHERE dice >= {threshold} GROUP BY row_no, no),
best AS (
  SELECT row_no, count(*) AS n, max(dice) AS dice, min(name) FILTER (dice = top) AS name
  FROM (SELECT *, max(dice) OVER (PARTITION BY row_no) AS top FROM hits) GROUP BY row_no)
SELECT doc_id, b.name AS license, round(b.dice, 6) AS dice, CAST(coalesce(n, 0) AS BIGINT) AS n_matches
FROM (SELECT row_number() OVER () AS row_no, doc_id FROM documents) d LEFT JOIN best b USING (row_no)
"""


def crc32_sql(binary: str) -> str:
    """CRC-32 of a blob; the query must offer ``crc_step``, the 256 steps of ``CRC_STEPS``."""
    return (f"xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex({binary}), '..'), "
            "lambda h: (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1), "
            "lambda c, b: xor(c // 256, crc_step[xor(c, b) % 256 + 1])))")


CRC_STEPS = ("SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), "
             "lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS crc_step")


def shard_sql(shards: int) -> str:
    return f"""
WITH steps AS ({CRC_STEPS}),
sized AS (SELECT doc_id, coalesce(text, '') AS t, md5(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) + 16 AS size FROM documents),
ends AS (
  SELECT *, sum(size) OVER (ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS until, sum(size) OVER () AS total FROM sized),
dealt AS (SELECT *, CAST(least({shards - 1}, (2 * until - size) * {shards} // (2 * total)) AS INT) AS shard FROM ends)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST({crc32_sql("encode(t)")} AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY digest, doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS DOUBLE) AS grown_shard
FROM dealt, steps
"""


#: By node of the lattice: the node after an insertion or reroling; (initial, node) of the rows that it keeps.
_NEXT = ("v2", "v2", "v3", "v2")
_KEEP = (("s", "v1"), ("u", "v2")), (("u", "v2"),), (("a", "v3"),), (("u", "v2"),)


def _value(cost: int | str, edit: str, line: str | None, node: str) -> str:
    text = f"list_concat([{line}], {node}.t)" if line else f"{node}.t"
    return f"{{'c': {cost} + {node}.c, 'a': '{edit}' || {node}.a, 't': {text}}}"


def _least(options: list[str]) -> str:
    return f"list_min([{', '.join(options)}])"


def _layer(s: int) -> str:
    name = "'assistant:'" if s == 2 else "'user:'"
    out = [_value(3, "D", None, f"v{s}")]
    for initial, node in _KEEP[s]:
        out.append(f"CASE WHEN initial = '{initial}' AND NOT gone THEN {_value('extra', 'K', 'line', node)} END")
    out.append(f"CASE WHEN NOT gone THEN {_value('2 + extra', 'R', name + ' || text', _NEXT[s])} END")
    return _least(out)


def repair_sql() -> str:
    """The least (cost, edits, repaired lines) from each node, row by row from the last one."""
    return f"""
WITH RECURSIVE steps AS ({CRC_STEPS}),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, steps),
harmed AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
ordered AS (
  SELECT *, role || ':' || text AS line, substr(role, 1, 1) AS initial, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS shown,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
copied AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy FROM ordered),
marked AS (
  SELECT *, shown = '' OR copy > 1 AS gone, CASE WHEN shown <> '' AND copy = 1 AND right(shown, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS extra,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM copied),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (shown = '') AS blank,
         count(*) FILTER (shown <> '' AND copy > 1) AS duplicate, sum(extra) AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM marked GROUP BY conv_id),
paths AS (
  SELECT conv_id, n + 1 AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS v0, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS v1,
         {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS v2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS v3 FROM counts
  UNION ALL
  SELECT conv_id, i, {_least(["r0", _value(2, "I", "'user:'", "w2")])}, {_least(["r1", _value(2, "I", "'user:'", "w2")])}, w2, w3
  FROM (SELECT *, {_least(["r2", _value(2, "I", "'assistant:'", "r3")])} AS w2, {_least(["r3", _value(2, "I", "'user:'", "r2")])} AS w3
        FROM (SELECT p.conv_id, m.i, {', '.join(f"{_layer(s)} AS r{s}" for s in range(4))}
              FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i - 1))),
best AS (SELECT conv_id, v0 FROM paths WHERE i = 1)
SELECT d.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v0.c, 0) AS BIGINT) AS cost,
       coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
     LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM d.conv_id
"""
