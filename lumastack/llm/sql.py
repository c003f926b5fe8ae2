"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .url_filter import RULES


def _rules(column: str) -> str:
    """The longest fitting rule's text or decision, as CASE arms from the longest rule down."""
    arms = sorted(RULES, key=lambda r: (len(r[0] + r[1]), r), reverse=True)
    value = {"rule": lambda h, p, v: h + p, "own": lambda h, p, v: v}[column]
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(h, p, v)}'" for h, p, v in arms) + " END"


OP1 = f"""WITH RECURSIVE u AS (SELECT page_id, url, html, strpos(url, '://') > 0 has, substr(url, strpos(url, '://') + 3) rest FROM pages),
b AS (SELECT page_id, url, html, has, CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END host,
 CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END path FROM u),
t AS (SELECT url, path, has, regexp_extract(url, '^([^?#]*)', 1) whole, regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) origin, regexp_extract(url, '^((?s:.*?):)//', 1) scheme,
 regexp_extract(coalesce(html, ''), '(?i)<link\\b[^>]*?\\brel\\s*=\\s*["'']?canonical\\b[^>]*>') rel, regexp_extract(coalesce(html, ''), '(?i)<meta\\b[^>]*?\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>') meta,
 CASE WHEN has AND host <> '' THEN 'page://' || regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') ELSE '' END plain FROM b WHERE url IS NOT NULL),
k AS (SELECT url, origin, scheme, whole, has, list_filter(string_split(regexp_extract(path, '^((?s:.*)/)', 1), '/'), lambda x: x <> '') folders, unnest([regexp_extract(rel, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1), regexp_extract(meta, '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>;]+)', 1), plain]) link FROM t),
f AS (SELECT *, folders[1:greatest(len(folders) - len(regexp_extract(link, '^((?:\\.\\./)*)', 1)) // 3, 0)] rest FROM k WHERE link <> ''),
e AS (SELECT DISTINCT url a, CASE WHEN starts_with(link, '//') THEN CASE WHEN has THEN scheme || link END WHEN starts_with(link, '/') THEN CASE WHEN has THEN origin || link END
 WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN strpos(link, '://') > 0 THEN link END WHEN strpos(link, '://') > 0 THEN link WHEN starts_with(link, '#') THEN NULL WHEN starts_with(link, '?') THEN CASE WHEN has THEN whole || link END
 WHEN has THEN origin || '/' || CASE WHEN len(rest) > 0 THEN array_to_string(rest, '/') || '/' ELSE '' END || regexp_replace(link, '^(?:\\./|(?:\\.\\./)+)', '') END b FROM f),
s AS (SELECT a, b FROM e WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND a <> b),
r(node, lab) AS (SELECT a, a FROM s UNION SELECT s.b, r.lab FROM r JOIN s ON r.node = s.a),
l AS (SELECT node, min(lab) lab FROM r GROUP BY 1),
j AS (SELECT *, {_rules("rule")} AS rule, {_rules("own")} own FROM b),
c AS (SELECT lab, CASE WHEN count(*) FILTER (own = 'allow') > 0 THEN 'allow' ELSE 'block' END alias_verdict FROM j JOIN l ON l.node = j.url WHERE own IS NOT NULL GROUP BY 1)
SELECT page_id, host, path, j.rule, coalesce(own, alias_verdict, 'allow') verdict, alias_verdict FROM j LEFT JOIN l ON l.node = j.url LEFT JOIN c ON c.lab = l.lab"""

OP5 = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) p FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) f FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) p FROM g JOIN m USING (k) WHERE f < doc_id),
r AS (SELECT doc_id, list(p) ps FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(len(ps), 0) AS BIGINT) n_removed,
 sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(coalesce(ps, []), i)], ' ')) kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""

OP6 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) h FROM documents),
g AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) k FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) p FROM d WHERE len(h) >= 100)),
m AS (SELECT k, min(doc_id) f FROM g GROUP BY 1),
q AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END fresh FROM g JOIN m USING (k) WHERE f < doc_id),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) n FROM q),
s AS (SELECT doc_id, n, min(p) lo, max(p) + 50 hi FROM i GROUP BY 1, 2),
x AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) past FROM s),
r AS (SELECT x.doc_id, count(*) n_spans, sum(hi - lo) gone, string_agg(substr(h, 2 * past + 1, 2 * (lo - past)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) kept FROM x JOIN d ON d.doc_id = x.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) n_bytes, CAST(coalesce(gone, 0) AS BIGINT) n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""

OP8 = """WITH v AS (SELECT vec_id, [floor(64 * CAST(e AS DOUBLE)) FOR e IN embedding] x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
s AS (SELECT q.vec_id query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

OP11 = """WITH i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term FROM i),
iq AS (SELECT item_id, text, term, count(*) times FROM q GROUP BY 1, 2, 3),
d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') terms FROM documents),
z AS (SELECT CAST(count(*) AS BIGINT) n, CAST(sum(len(terms)) AS BIGINT) l FROM d WHERE len(terms) > 0),
m AS (SELECT r, doc_id, 100 - 75 + (75 * CAST(len(terms) AS BIGINT) * z.n) // z.l m FROM d, z WHERE len(terms) > 0),
f AS (SELECT r, term, count(*) tf FROM (SELECT r, unnest(terms) term FROM d) WHERE term IN (SELECT term FROM iq) GROUP BY 1, 2),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(z.n) + 2) / (2 * count(*) + 1))) AS BIGINT) w FROM f, z GROUP BY 1),
s AS (SELECT item_id, iq.text, m.r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score FROM iq JOIN f USING (term) JOIN w USING (term) JOIN m ON m.r = f.r GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) <= 10"""

#: CRC-32 of an ASCII text ``s``: bytes and 8 shifts each, folded from the left.
_CRC32 = "xor(list_reduce(list_prepend(4294967295, flatten([[CAST(ord(s[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, len(s) + 1)])), lambda c, y: CASE WHEN y >= 0 THEN xor(c, y) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"

OP12 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') role, coalesce(text, '') text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 seq FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 base, {_CRC32} % 4 h FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) s FROM t)),
b AS (SELECT c.conv_id, 0 own, seq, role, text FROM c JOIN t ON t.conv_id = c.base AND seq < h UNION ALL SELECT t.conv_id, 1, seq, role, text FROM t JOIN c ON t.conv_id = c.conv_id AND seq >= h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, seq) depth, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text) turn_md5, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) words FROM b),
p AS (SELECT conv_id, 0 depth, '' node, NULL parent, 0 words FROM c UNION ALL SELECT conv_id, depth, string_agg(turn_md5, '') OVER w, coalesce(string_agg(turn_md5, '') OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words FROM o WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) ends FROM p),
n AS (SELECT node, any_value(parent) parent, any_value(depth) depth, min(conv_id) conv_id, count(*) n_convs, any_value(words) words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) ends_sha256 FROM e GROUP BY 1),
k AS (SELECT n.*, u.conv_id parent_conv_id, (SELECT count(*) FROM n x WHERE x.parent = n.node) n_children FROM n LEFT JOIN n u ON u.node = n.parent),
s AS (SELECT p.node, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) n_leaves, sum((n_convs - 1) * k.words) saved_tokens FROM k JOIN p ON p.conv_id = k.conv_id AND p.depth <= k.depth GROUP BY 1)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) n_leaves, CAST(saved_tokens AS BIGINT) saved_tokens, ends_sha256 FROM k JOIN s USING (node)"""

ORACLE_SQL = {
    "op1_redirect_equivalence": OP1,
    "op5_debruijn_compaction": OP5,
    "op6_lyndon_suffix_groups": OP6,
    "op8_approximation_files": OP8,
    "op11_interval_maxima_search": OP11,
    "op12_screened_prefix_trie": OP12,
}
