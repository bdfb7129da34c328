"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_OP2 = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^([^?#]*)', 1) AS hp FROM u
), h AS (
  SELECT page_id, translate(regexp_extract(hp, '^([^/]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(hp, '/') > 0 THEN substr(hp, strpos(hp, '/')) ELSE '' END AS path
  FROM p
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.com/de/', 'example.com', '/de/', 'block'),
         ('example.net/en/', 'example.net', '/en/', 'allow'), ('org/fr/', 'org', '/fr/', 'allow')
)
SELECT page_id, host, path,
  (SELECT rule FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC, length(rhost) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) ORDER BY length(rule) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM h
"""

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text, coalesce(md5(text), '') AS copy FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
n AS (SELECT rid, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars FROM w),
sym AS (SELECT rid, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
lines AS (SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM d),
worded AS (SELECT rid, host, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS k
           FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT rid, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n_dup_lines FROM worded GROUP BY rid),
pos AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) > 3),
tri AS (SELECT rid, i, array_to_string(ws[i:i+2], ' ') AS t FROM pos),
many AS (SELECT rid, t FROM tri GROUP BY rid, t HAVING count(*) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM tri JOIN many USING (rid, t)) GROUP BY rid),
size AS (SELECT host, count(DISTINCT copy) AS docs FROM d GROUP BY host),
freq AS (SELECT worded.host, norm, count(DISTINCT copy) AS c FROM worded JOIN d USING (rid) GROUP BY worded.host, norm),
over AS (SELECT f.host, f.norm FROM freq f JOIN size s ON f.host IS NOT DISTINCT FROM s.host WHERE c > 5 AND c > sqrt(docs)),
gone AS (SELECT rid, sum(k) AS lost FROM worded x JOIN over o ON x.host IS NOT DISTINCT FROM o.host AND x.norm = o.norm GROUP BY rid),
j AS (
  SELECT d.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(n_words - coalesce(lost, 0) AS BIGINT) AS words_left
  FROM d JOIN n USING (rid) JOIN sym USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 * n_words AND words_left >= 50 AS kept, words_left
FROM j
"""


_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(ws)) AS k, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS t
        FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
spot AS (SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS t
       FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, ks WHERE len(ws) >= k)),
hits AS (SELECT rid, spot.k, i, item FROM spot JOIN win ON spot.k = win.k AND spot.t = win.t),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, i, k FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""


def _op4() -> str:
    """Row by row cumulative sums instead of ranges; the parameters as in mixing."""
    from . import mixing as m

    domains = " ".join(f"WHEN '{s}' THEN '{d}'" for s, d in m.DOMAINS.items())
    weights = ", ".join(f"('{'/'.join(k)}', {v})" for k, v in m.WEIGHTS.items())
    weight = lambda path, wild: f"coalesce((SELECT w FROM weights WHERE p = {path}), (SELECT w FROM weights WHERE p = {wild}), 1)"

    def level(name: str, children: str, parent: str, label: str) -> str:
        return f"""
{name}_r AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / w, {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (PARTITION BY {parent} ORDER BY CAST(capacity AS DOUBLE) / w, {label} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead FROM ({children})),
{name}_f AS (SELECT *, capacity * ahead <= (total - before) * w AS isfull FROM {name}_r),
{name} AS (SELECT *, CASE WHEN isfull THEN capacity ELSE least(capacity, ((total - coalesce(sum(capacity) FILTER (isfull) OVER (PARTITION BY {parent}), 0)) * w)
  // sum(w) FILTER (NOT isfull) OVER (PARTITION BY {parent})) END AS budget FROM {name}_f)"""

    return f"""
WITH weights(p, w) AS (VALUES {weights}),
d AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS src, CASE source {domains} ELSE '{m.DEFAULT_DOMAIN}' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, language, src, sum(n_tokens) AS tokens, sum(n_tokens) * {m.MAX_EPOCHS} AS capacity FROM d GROUP BY ALL),
la AS (SELECT domain, language, sum(capacity) AS capacity FROM leaf GROUP BY ALL),
dm AS (SELECT domain, sum(capacity) AS capacity FROM la GROUP BY ALL),
tot AS (SELECT least(sum(tokens) * {m.SHARE[0]} // {m.SHARE[1]}, sum(capacity)) AS total FROM leaf),
{level("bd", f"SELECT dm.*, total, {weight('dm.domain', "'*'")} AS w FROM dm, tot", "1", "domain")},
{level("bl", f"SELECT la.*, bd.budget AS total, {weight("la.domain || '/' || la.language", "'*/' || la.language")} AS w FROM la JOIN bd USING (domain)", "domain", "language")},
{level("bs", f"SELECT leaf.*, bl.budget AS total, {weight("leaf.domain || '/' || leaf.language || '/' || leaf.src", "'*/' || leaf.language || '/' || leaf.src")} AS w FROM leaf JOIN bl USING (domain, language)", "domain, language", "src")},
b AS (SELECT domain, language, src, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM bs),
o AS (SELECT d.*, budget, whole, rest, CAST('0x' || substr(md5('{m.SEED}:' || (whole + 1)::BIGINT || ':' || doc_id), 1, 15) AS BIGINT) AS key FROM d JOIN b USING (domain, language, src)),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, src ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS until FROM o)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, language, src, n_tokens, CAST(budget AS BIGINT) AS leaf_budget
FROM (SELECT *, unnest(range(1, (whole + CASE WHEN rest > 0 AND until < rest THEN 1 ELSE 0 END)::BIGINT + 1)) AS epoch FROM c)
"""


_OP12 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT rid, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
base AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS n_lang, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(base.n, 0) + 2 * v.v) AS p,
      1 + (1000000000 * (kept.n + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN base ON base.lang = g.lang AND base.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


_OP11 = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0::BIGINT] || [0] || [0] || [0] || [0] || [0] || [0] || [0]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
size AS (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id),
r AS (
  SELECT ids.conv_id, o.pos, role, text FROM ids JOIN o ON o.conv_id = base WHERE o.pos < h
  UNION ALL
  SELECT ids.conv_id, o.pos - h + least(h, coalesce(size.n, 0)), role, text FROM ids JOIN o USING (conv_id) LEFT JOIN size ON size.conv_id = base WHERE o.pos >= h
),
m AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS size FROM ids
  UNION ALL
  SELECT conv_id, pos + 1 AS depth, sha256(to_json(list(md5(to_json([role, text]))) OVER (PARTITION BY conv_id ORDER BY pos))) AS node, length(text) AS size FROM r
),
l AS (SELECT conv_id, max(depth) AS last FROM m GROUP BY conv_id),
n AS (SELECT node, min(conv_id) AS own, min(depth) AS depth, count(*) AS n_convs, min(size) AS size FROM m GROUP BY node),
up AS (SELECT DISTINCT m.node, p.node AS parent FROM m JOIN m p ON p.conv_id = m.conv_id AND p.depth = m.depth - 1),
kids AS (SELECT parent AS node, count(*) AS n FROM up GROUP BY parent),
one AS (SELECT n.node, n.own, n.size * (n_convs - 1) AS saved, kids.n IS NULL AS leaf FROM n LEFT JOIN kids USING (node)),
under AS (SELECT a.node AS top, one.* FROM one JOIN n d USING (node) JOIN m a ON a.conv_id = d.own AND a.depth <= d.depth),
sums AS (SELECT top AS node, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM under GROUP BY top),
ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id) WHERE depth = last GROUP BY node)
SELECT n.own AS conv_id, CAST(n.depth AS BIGINT) AS depth, p.own AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN up USING (node) LEFT JOIN n p ON p.node = up.parent LEFT JOIN kids ON kids.node = n.node JOIN sums ON sums.node = n.node LEFT JOIN ends ON ends.node = n.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": _OP2, "op3_decontaminate": _OP3, "op4_mix_sources": _op4(), "op10_quality_rules": _OP10, "op11_conversation_trie": _OP11, "op12_source_divergence": _OP12}
