"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .mixing import BITS

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP7 = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), urls AS (
  SELECT page_id, translate(raw, '{_UP}', '{_LOW}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), rules(rule, rhost, rpath, verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), fits AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE
  WHEN regexp_matches(path, '(?s)^/(?:.*/)?(?:login|signup|signin|checkout|cart)(?:[/.]|\z)') OR regexp_matches(host || path, '(?s)^(?:[^/]*\.)?doubleclick\.[^/.]+/') OR contains(path, '/wp-json/') THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id
"""

# Written from the rules, not from license_scan's constants. Digests of the canonical texts.
def _license_form(text: str) -> str:
    """Lower case; no copyright lines; no title; words apart by one blank; American and unhyphenated spellings."""
    no_notices = rf"regexp_replace(lower({text}), '(^|\n)[^a-z0-9©(\n]*(copyright[^\n]*(\(c\)|©|\d\d\d\d|year|yyyy)|\(c\)|©|all rights reserved)[^\n]*', chr(10), 'g')"
    no_title = rf"regexp_replace({no_notices}, '^\s*[^\n]{{{{0,60}}}}licen[cs]e[ \t]*(\([^)\n]{{{{0,40}}}}\))?[ \t:.]*\n', chr(10))".replace("{{", "{").replace("}}", "}")
    words = f"regexp_replace({no_title}, '[^a-z0-9' || chr(128) || '-' || chr(1114111) || ']+', ' ', 'g')"
    out = f"regexp_replace({words}, '([a-z][a-z][a-z])is(e|ed|er|es|ing|ation|ations)( |$)', '\\1iz\\2\\3', 'g')"
    for british, american in (("licence", "license"), ("https", "http"), ("non infringement", "noninfringement"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"), ("centre", "center"), ("favour", "favor"), ("labour", "labor"), ("honour", "honor"), ("behaviour", "behavior"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment")):
        out = f"replace({out}, '{british}', '{american}')"
    return f"md5(trim({out}))"


OP5 = f"""
WITH known(digest, license) AS (VALUES
  ('fa9583358e39e30cc008a801c940fa8c', '0BSD'),
  ('0ae0c834c28a339f559006a8285f2829', 'Apache-2.0'),
  ('64adb2d52a4ae99c0fbd1b059e58ef07', 'Apache-2.0'),
  ('8e6d22adc46d8edd245ea92b0565e956', 'Apache-2.0'),
  ('905b17b5c4c8def8e557d22530bedc5f', 'Apache-2.0'),
  ('f8a4230cb25525c0b4623452e82011a9', 'Artistic-1.0-Perl'),
  ('da79fdac217e656d53b52a2eb32d4738', 'BSD-2-Clause'),
  ('aee184725d072c7f46b9f820701482fa', 'BSD-3-Clause'),
  ('5226ce4da41af40d26e607d2e52028ce', 'BSD-3-Clause-UC'),
  ('91152d92148568b9815c3a22a806e04c', 'CC-BY-4.0'),
  ('cd0ca292473696e20f41510f86d31236', 'CC-BY-4.0'),
  ('1f7c49507667f7da1163e34855517938', 'CC-BY-NC-4.0'),
  ('8b91400ac0de12853070b71d8d0219be', 'CC-BY-SA-4.0'),
  ('23f238e36c9e580c0095be52dbfd7280', 'CC0-1.0'),
  ('2b9a027fef3beb67d3c2455904abc0d5', 'CC0-1.0'),
  ('d0b92f15fc0517d2bfe579ee3d2090a4', 'CC0-1.0'),
  ('9048a906a1560ac16c961615dfdaebff', 'GFDL-1.2-only'),
  ('c34cfb62a88465229ed5afda9888427f', 'GFDL-1.3-only'),
  ('b0f4b5a0d368109e9ae68bbb10776916', 'GPL-1.0-only'),
  ('6e8128977833fdf8adb91e1abe877459', 'GPL-2.0-only'),
  ('afb0dbeedb9a15908b91fde85b0da582', 'GPL-3.0-only'),
  ('bd3c3a058ac8f81f1870d5984c4a4564', 'GPL-3.0-only'),
  ('ea4317607afdd7d4a28711c582c002ee', 'GPL-3.0-only'),
  ('b6ab23f33a368e7f225abed7065c8009', 'ISC'),
  ('de5be4c4ea2d6bd0485a5cacde0942da', 'LGPL-2.0-only'),
  ('f0f09bb2d33266e881007d5169169e59', 'LGPL-2.1-only'),
  ('c66601bd909347a3138001ffe5ff1882', 'LGPL-3.0-only'),
  ('7ee4a98a2ff6de9f0817007c28ef2b80', 'MIT'),
  ('a1c63c67a4ef3446fc4e4b58443f7be8', 'MIT'),
  ('b44eae48fd2d3b0faa04278c3dd65d07', 'MIT'),
  ('e088b543bf2d8834b44999563dcb2e1c', 'MIT'),
  ('cf84e979817f7917811448de162faf44', 'MPL-1.1'),
  ('44d564e1e8d50f7adb97a711954b7020', 'MPL-2.0'),
  ('7ce88855ba566117c3ad44751efac703', 'Unlicense'),
  ('6df2a895c31891fec159c01a49b2d3cf', 'Zlib')
), lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
notes AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known ON {_license_form('line')} = digest WHERE regexp_matches(line, '(?i)licen|released|spdx') GROUP BY doc_id),
texts AS (SELECT doc_id, {_license_form('text')} AS digest FROM documents)
SELECT t.doc_id, t.digest, k.license, n.notices FROM texts t LEFT JOIN known k ON t.digest = k.digest LEFT JOIN notes n ON t.doc_id = n.doc_id
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS nibbles FROM d),
c AS (SELECT *, list_transform(range(0, 160), lambda i: (nibbles[i // 4 + 1] >> (3 - i % 4)) & 1) AS bits FROM b),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS winner,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', bits[5*i+1]*16 + bits[5*i+2]*8 + bits[5*i+3]*4 + bits[5*i+4]*2 + bits[5*i+5] + 1, 1)), '') AS payload_digest FROM c)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = winner THEN NULL ELSE winner END AS refers_to FROM g
"""


def mix_sql(table: str) -> str:
    """CTEs that end in mixed(doc_id, size, source_size, target, taken, copies) for a documents-like table."""
    return f"""
sized AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, {BITS // 4}) AS BIGINT) AS digest FROM {table}),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (ARRAY[5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight FROM sources),
outs AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS runs_out FROM weighed),
lefts AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS reached, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS budget FROM outs WINDOW w AS (ORDER BY runs_out, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT arg_min(reached, runs_out) AS level, max(budget) AS budget FROM lefts WHERE reached <= runs_out),
targets AS (SELECT source, source_size, weight, least(most, weight * level) AS target, levels.budget FROM lefts, levels),
queue AS (SELECT s.doc_id, s.size, s.digest, t.source_size, t.weight, t.target, t.budget, CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tokens FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT doc_id, size, digest, copy, source_size, target, budget, (tokens + copy * source_size) / weight AS finish FROM queue, (VALUES (0), (1)) AS c(copy)),
ranged AS (SELECT *, sum(size) OVER (ORDER BY finish, digest, doc_id, copy ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
mixed AS (SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN upto <= budget THEN size ELSE 0 END) AS BIGINT) AS taken, CAST(sum(CASE WHEN upto <= budget THEN 1 ELSE 0 END) AS INTEGER) AS copies FROM ranged GROUP BY ALL)"""


OP2 = f"WITH {mix_sql('documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"

OP8 = r"""
WITH split AS (SELECT doc_id, text, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> '')) AS body, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))), lambda x: x <> ''), 1) - 1 AS seq FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
counted AS (SELECT *, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words FROM split),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY seq) AS upto, sum(words) OVER (PARTITION BY doc_id, text ORDER BY seq) - words AS before, sum(words) OVER (PARTITION BY doc_id, text) AS total FROM counted),
lengths AS (SELECT *, count(*) OVER (PARTITION BY doc_id, text ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS ahead, count(*) OVER (PARTITION BY doc_id, text ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW) AS back FROM sums),
windows AS (SELECT doc_id, text, seq, ahead AS length FROM lengths WHERE total - before >= 50 UNION SELECT doc_id, text, seq - back + 1, back FROM lengths WHERE upto >= 50),
whole AS (SELECT doc_id, text, list(body ORDER BY seq) AS bodies FROM counted GROUP BY doc_id, text),
named AS (SELECT w.doc_id, w.text, w.seq, w.length, min((w.doc_id, w.seq)) OVER (PARTITION BY md5(array_to_string(bodies[w.seq + 1 : w.seq + w.length], chr(10)))) AS first FROM windows w JOIN whole h ON w.doc_id = h.doc_id AND w.text = h.text),
marks AS (SELECT doc_id, text, unnest(range(seq, seq + length)) AS seq, (first[1], first[2] - seq) AS source FROM named WHERE first <> (doc_id, seq)),
best AS (SELECT doc_id, text, seq, min(source) AS source FROM marks GROUP BY doc_id, text, seq),
runs AS (SELECT b.*, c.words, b.seq - row_number() OVER (PARTITION BY b.doc_id, b.text, b.source ORDER BY b.seq) AS run FROM best b JOIN counted c ON b.doc_id = c.doc_id AND b.text = c.text AND b.seq = c.seq)
SELECT doc_id, CAST(min(seq) AS BIGINT) AS start_line, count(*) AS n_lines, CAST(sum(words) AS BIGINT) AS n_words, source[1] AS source_doc_id, CAST(min(seq) + source[2] AS BIGINT) AS source_start_line FROM runs GROUP BY doc_id, text, source, run
"""

OP11 = r"""
WITH words AS (SELECT doc_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
weighed AS (SELECT item_id, term, qtf * CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM asked JOIN dfs USING (term), totals),
lengths AS (SELECT doc_id, 25 + (75 * n * big_n) // big_l AS m FROM sizes, totals),
scores AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM weighed JOIN tfs USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

OP12 = r"""
WITH tokens AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
drawn AS (SELECT *, len(units) AS n, list_transform(range(0, 4), lambda k: CAST('0x' || substr(digest, 8 * k + 1, 8) AS BIGINT)) AS h FROM tokens),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, coalesce(array_to_string(units[1 : a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1 : b], ''), '') AS middle, coalesce(array_to_string(units[b + 1 : n], ''), '') AS suffix FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(prefix || middle || suffix) AS restored_sha256 FROM parts
"""

ORACLE = {"op8_line_dedup": OP8, "op11_lexical_search": OP11, "op12_fill_middle": OP12, "op2_mix_sources": OP2, "op4_warc": OP4, "op5_license_scan": OP5, "op7_url_filter": OP7}
