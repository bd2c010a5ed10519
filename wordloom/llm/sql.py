"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from wordloom.llm.licenses import TEMPLATES, VARIANTS
from wordloom.llm.queries import RULES

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w,
         2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s
), o AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS rest FROM w
), f AS (
  SELECT *, cap::DOUBLE * rest <= (total - before) * w AS filled FROM o
), t AS (
  SELECT source, source_size, CASE WHEN filled THEN cap::DOUBLE ELSE
         (total - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ())::DOUBLE / nullif(sum(CASE WHEN filled THEN 0 ELSE w END) OVER (), 0)::DOUBLE * w END AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS part,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN part > 0 AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

_DRAW = "-ln((('0x' || substr(md5(k || '#{i}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE)"
_SCORES = [_DRAW.format(i=i) for i in range(9)]
SHARD = f"""
WITH b AS (
  SELECT doc_id, text, CASE WHEN doc_id IS NULL THEN '~' ELSE '=' || doc_id::VARCHAR END AS k,
         encode(coalesce(text, ''))::BIT AS bits, strlen(coalesce(text, '')) AS n FROM documents
), c AS (
  SELECT doc_id, k, (n + 1)::BIGINT AS size, xor(list_reduce(
           list_transform(range(0, 8 * n), lambda i: get_bit(bits, ((i // 8) * 8 + 7 - i % 8)::INT)::BIGINT),
           lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
         md5(k) AS h, [{", ".join(_SCORES[:8])}] AS eight, [{", ".join(_SCORES)}] AS nine
  FROM b
), p AS (
  SELECT *, (list_position(eight, list_min(eight)) - 1)::INT AS shard, (list_position(nine, list_min(nine)) - 1)::INT AS grown_shard FROM c
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY h, k, text_crc32, size) - 1)::BIGINT AS slot, grown_shard FROM p
"""

_WORDS = r"list_filter(string_split_regex(lower({t}), '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+'), lambda x: x <> '')"
_SHINGLES = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))"
_SOME = f"CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE {_SHINGLES} END"

NEAR = f"""
WITH RECURSIVE t AS (
  SELECT text, min(doc_id) AS d FROM documents WHERE text IS NOT NULL GROUP BY text
), w AS (
  SELECT d, text, {_WORDS.format(t='text')} AS w FROM t
), s AS (
  SELECT d, unnest({_SOME}) AS s FROM w WHERE len(w) > 0
), c AS (
  SELECT d, s, count(*) AS n FROM s GROUP BY d, s
), z AS (
  SELECT d, sum(n) AS total FROM c GROUP BY d
), l AS (
  SELECT a.d AS a, b.d AS b FROM c a JOIN c b ON a.s = b.s AND a.d <> b.d
  JOIN z x ON x.d = a.d JOIN z y ON y.d = b.d
  GROUP BY a.d, b.d, x.total, y.total
  HAVING sum(least(a.n, b.n)) / (x.total + y.total - sum(least(a.n, b.n))) >= 0.8
), r(d, root) AS (
  SELECT d, d FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.d
), m AS (
  SELECT d, min(root) AS class_id FROM r GROUP BY d
), common AS (
  SELECT a.d, sum(least(a.n, b.n)) AS common, any_value(x.total + y.total) AS sizes FROM m JOIN c a ON a.d = m.d JOIN c b ON b.d = class_id AND b.s = a.s
  JOIN z x ON x.d = m.d JOIN z y ON y.d = class_id WHERE m.d <> class_id GROUP BY a.d
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CASE WHEN documents.text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY documents.text IS NULL, class_id) END::BIGINT AS class_rows,
       CASE WHEN class_id IS NULL OR class_id = t.d THEN 1.0 ELSE coalesce(common::DOUBLE / (sizes - common)::DOUBLE, 0.0) END::DOUBLE AS similarity
FROM documents LEFT JOIN t USING (text) LEFT JOIN m ON m.d = t.d LEFT JOIN common ON common.d = t.d
"""

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
URLS = rf"""
WITH rules(h, p, v) AS (VALUES {_RULE_ROWS}), u AS (
  SELECT row_number() OVER () AS i, page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), m AS (
  SELECT i, arg_max(h || p, length(h || p) * 100000 + length(h)) AS rule, arg_max(v, length(h || p) * 100000 + length(h)) AS verdict
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (i)
"""

LEAKS = f"""
WITH i AS (
  SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark
), it AS (
  SELECT item_id, greatest(1, len(w) - 4) AS n, {_SOME} AS s FROM i WHERE len(w) >= 1
), ic AS (
  SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, n, unnest(s) AS s FROM it) GROUP BY ALL
), d AS (
  SELECT doc_id, text, {_WORDS.format(t='text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents)
), dp AS (
  SELECT doc_id, text, greatest(1, len(w) - 4) AS m, unnest({_SOME}) AS s, unnest(range(0, greatest(1, len(w) - 4))) AS pos FROM d WHERE len(w) >= 1
), hit AS (
  SELECT doc_id, text, m, pos, s, item_id, n, c FROM dp JOIN ic USING (s)
), win AS (
  SELECT DISTINCT doc_id, text, item_id, least(pos, m - least(m, n)) AS start FROM hit
), got AS (
  SELECT doc_id, text, item_id, start, m, n, s, least(count(*), any_value(c)) AS k
  FROM win JOIN hit USING (doc_id, text, item_id) WHERE pos >= start AND pos < start + n GROUP BY ALL
), sim AS (
  SELECT doc_id, text, item_id, start, sum(k)::DOUBLE / (least(m, n) + n - sum(k))::DOUBLE AS similarity
  FROM got GROUP BY doc_id, text, item_id, start, m, n
)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, struct_pack(a := similarity, b := -start))::INT AS start
FROM sim WHERE similarity >= 0.8 - 1e-12 GROUP BY doc_id, text, item_id
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}/{}', '{}')".format(n, n, i, t.replace("'", "''")) for n, own in TEMPLATES.items() for i, t in enumerate(own))
_TOKENS = "list_filter(string_split_regex(lower({t}), '[^0-9a-z]+'), lambda x: x <> '')"
_VARIANTS = ", ".join(f"'{w}'" for w in VARIANTS)
# Notices on single lines and in whole texts, and stated identifiers; no table here holds wrapped notices or whole licences.
LICENSES = rf"""
WITH tpl(license, template, text) AS (VALUES {_TEMPLATE_ROWS}), tt AS (
  SELECT license, template, w, count(*) AS tf FROM (SELECT license, template, unnest({_TOKENS.format(t='text')}) AS w FROM tpl) GROUP BY ALL
), docs AS (
  SELECT doc_id, text, concat_ws('/', source, 'p' || floor(doc_id / 64)::BIGINT,
           CASE WHEN doc_id % 64 <> 0 THEN 'm' || floor(doc_id / 8)::BIGINT END) AS folder,
         CASE WHEN doc_id % 8 = 0 THEN 'LICENSE.' || doc_id ELSE 'f' || doc_id || '.txt' END AS name FROM documents
), n AS (
  SELECT count(text) AS n FROM docs
), df AS (
  SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS.format(t='text')})) AS w FROM docs) GROUP BY w
), idf AS (
  SELECT w, ln((1 + n)::DOUBLE / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT w FROM tt UNION SELECT w FROM df) LEFT JOIN df USING (w), n
), tw AS (
  SELECT license, template, w, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS weight,
         regexp_full_match(w, '[0-9]+') OR w IN ({_VARIANTS}) AS sign FROM tt JOIN idf USING (w)
), signs AS (
  SELECT template, count(*) FILTER (sign) AS signs, coalesce(list(w) FILTER (w IN ({_VARIANTS})), []) AS variants FROM tw GROUP BY template
), units AS (
  SELECT doc_id, unnest(list_concat([text], string_split_regex(text, '[\r\n]+'))) AS unit,
         unnest(range(0, 1 + len(string_split_regex(text, '[\r\n]+')))) AS u FROM docs WHERE text IS NOT NULL
), tok AS (
  SELECT doc_id, u, w, count(*) AS tf FROM (SELECT doc_id, u, unnest({_TOKENS.format(t='unit')}) AS w FROM units) GROUP BY ALL
), x AS (
  SELECT doc_id, u, w, tf * idf AS x FROM tok JOIN idf USING (w)
), norm AS (
  SELECT doc_id, u, sqrt(sum(x * x)) AS norm, coalesce(list(w) FILTER (w IN ({_VARIANTS})), []) AS own FROM x GROUP BY ALL
), best AS (
  SELECT doc_id, license, CASE license WHEN 'Proprietary' THEN 0 ELSE 1 END AS rank, max(sim) AS sim FROM (
    SELECT doc_id, u, license, template, round(sum(x * weight) / any_value(norm), 6) AS sim, count(*) FILTER (sign) AS met, any_value(own) AS own
    FROM x JOIN tw USING (w) JOIN norm USING (doc_id, u) GROUP BY doc_id, u, license, template) JOIN signs USING (template)
  WHERE sim >= 0.7 AND met = signs AND len(list_filter(own, lambda x: NOT list_contains(variants, x))) = 0 GROUP BY ALL
  UNION ALL SELECT doc_id, s, 3, 1.0 FROM (SELECT doc_id, regexp_replace(regexp_extract(text,
    'SPDX-License-Identifier:[ \t]*([0-9A-Za-z.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[0-9A-Za-z.+()-]+)*)', 1), '[ \t]+', ' ', 'g') AS s FROM docs) WHERE s <> ''
), own AS (
  SELECT doc_id, any_value(b.license) AS license, any_value(b.sim) AS sim, any_value(b.rank) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, sim DESC, license) AS place FROM best) b WHERE place = 1 GROUP BY doc_id
), home AS (
  SELECT folder AS home, arg_min(license, struct_pack(c := -rank, a := -sim, b := license)) AS license,
         arg_min(sim, struct_pack(c := -rank, a := -sim, b := license)) AS sim
  FROM own JOIN docs USING (doc_id) WHERE regexp_matches(name, '(?i)^(licen[cs]e|copying|notice)([._-].*)?$') GROUP BY folder
), near AS (
  SELECT folder, max(home) AS home FROM (SELECT DISTINCT folder FROM docs) JOIN home ON folder = home OR starts_with(folder, home || '/') GROUP BY folder
)
SELECT d.doc_id, d.folder || '/' || d.name AS path, coalesce(o.license, h.license) AS license, coalesce(o.sim, h.sim) AS similarity,
       CASE WHEN o.license IS NOT NULL THEN 'header' WHEN h.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN o.license IS NULL THEN h.home END AS declared_in
FROM docs d LEFT JOIN own o USING (doc_id) LEFT JOIN near USING (folder) LEFT JOIN home h ON h.home = near.home
"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""

ORACLE = {"op1_mix_sources": MIX, "op3_shard": SHARD, "op4_near_duplicates": NEAR, "op5_url_rules": URLS,
          "op6_license_scan": LICENSES, "op8_decontaminate": LEAKS, "op10_warc": WARC}
