"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from quarry.llm import url_filters

_RULES = """(VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
    ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, rule_verdict)"""


#: As in ``url_filters``, without a look-ahead: an unquoted word ends at a space, a slash or the tag's end.
_LINK = r"""(?i)<link\s[^>]*rel\s*=\s*(?:(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?')[^>]*>|canonical(?:[\s/][^>]*)?>)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rest(url: str) -> str:
    return f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _folded(path: str) -> str:
    """A path without . and .. segments."""
    parts = f"string_split({path}, '/')"
    kept = (f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}[2:], lambda s: [s])), lambda acc, x: CASE WHEN x[1] = '.' THEN acc "
            "WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 0)] ELSE list_concat(acc, x) END)")
    tail = f"CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE []::VARCHAR[] END"
    return f"(CASE WHEN contains({path}, '/.') THEN '/' || array_to_string(list_concat({kept}, {tail}), '/') ELSE {path} END)"


def _node(url: str) -> str:
    query = f"regexp_extract({_rest(url)}, '^[^?#]*(\\?[^#]*)', 1)"
    return f"(CASE WHEN {_host(url)} <> '' THEN {_host(url)} || {_folded(_path(url))} || {query} END)"


def _resolved(to: str, url: str) -> str:
    site = f"(regexp_extract({url}, '^([^:]*://)', 1) || {_host(url)})"
    folder = f"regexp_replace({_path(url)}, '[^/]*$', '')"
    return (f"(CASE WHEN {to} = '' THEN NULL WHEN regexp_matches({to}, {_quoted(url_filters._SCHEME + '//')}) THEN {to} "
            f"WHEN regexp_matches({to}, {_quoted(url_filters._SCHEME)}) THEN NULL WHEN starts_with({to}, '//') THEN 'http:' || {to} "
            f"WHEN starts_with({to}, '/') THEN {site} || {to} WHEN starts_with({to}, '#') THEN {url} WHEN starts_with({to}, '?') THEN {site} || {_path(url)} || {to} "
            f"ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {to} END)")


def _tags(tag: str, value: str) -> str:
    return f"list_transform(regexp_extract_all(html, {_quoted(tag)}), lambda t: regexp_extract(t, {_quoted(value)}, 1))"


#: Components by the nodes reachable from each node that an edge touches.
OP4 = rf"""
WITH RECURSIVE p AS (
  SELECT page_id, url, coalesce(html, '') AS html FROM pages
), u AS (
  SELECT page_id, coalesce({_host('url')}, '') AS host, coalesce({_path('url')}, '') AS path, {_node('url')} AS node FROM p
), t AS (
  SELECT url, replace(regexp_extract(html, {_quoted(url_filters._BASE)}, 1), '&amp;', '&') AS base,
         unnest(list_concat({_tags(_LINK, url_filters._HREF)}, {_tags(url_filters._META, url_filters._TARGET)})) AS raw
  FROM p
), w AS (
  SELECT url, replace(raw, '&amp;', '&') AS goal, coalesce({_resolved('base', 'url')}, url) AS base FROM t
), e AS (
  SELECT DISTINCT {_node('url')} AS a, {_node('whole')} AS b FROM (SELECT url, {_resolved('goal', 'base')} AS whole FROM w)
), g AS (
  SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM g UNION SELECT r.node, g.b FROM reach r JOIN g ON r.other = g.a
), ruled AS (
  SELECT node, arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT other AS node, regexp_extract(other, '^([^/?]*)', 1) AS host, regexp_extract(other, '^[^/?]*([^?]*)', 1) AS path FROM reach) n, {_RULES}
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY node
), shared AS (
  SELECT r.node, CASE WHEN bool_or(d.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach r JOIN ruled d ON r.other = d.node GROUP BY r.node
), own AS (
  SELECT page_id, host, path, node, (SELECT arg_max(rule_host || rule_path, length(rule_host || rule_path)) FROM {_RULES}
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule FROM u
)
SELECT page_id, host, path, rule, coalesce((SELECT rule_verdict FROM {_RULES} WHERE rule_host || rule_path = rule), s.verdict, 'allow') AS verdict
FROM own LEFT JOIN shared s ON own.node = s.node
"""

def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit (fixed value: its polynomial, reversed)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda acc, op: CASE WHEN op >= 0 THEN xor(acc, op) "
            "ELSE xor(acc >> 1, (acc & 1) * 3988292384) END), 4294967295)")


#: Prefixes by their whole text, every ancestor of every node.
OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c0 AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM t GROUP BY conv_id
), c AS (
  SELECT a.conv_id, a.base, a.h, least(a.h, coalesce(b.n, 0)) AS begun FROM c0 a LEFT JOIN c0 b ON b.conv_id = a.base
), built AS (
  SELECT c.conv_id, t.pos, t.r, t.x FROM c JOIN t ON t.conv_id = c.base WHERE t.pos < c.h
  UNION ALL SELECT c.conv_id, t.pos - c.h + c.begun, t.r, t.x FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.pos >= c.h
), path AS (
  SELECT conv_id, 0 AS depth, '' AS node, 0 AS chars FROM c
  UNION ALL SELECT conv_id, pos + 1, md5(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY conv_id ORDER BY pos)), length(x) FROM built
), ends AS (
  SELECT conv_id, max(depth) AS depth, arg_max(node, depth) AS node FROM path GROUP BY conv_id
), lists AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM ends GROUP BY node
), n AS (
  SELECT node, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(chars) AS saved FROM path GROUP BY node
), up AS (
  SELECT n.*, p.node AS parent FROM n LEFT JOIN path p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), kids AS (
  SELECT parent AS node, count(*) AS n_children FROM up WHERE parent IS NOT NULL GROUP BY parent
), below AS (
  SELECT p.node, sum(n.saved) AS saved, count(*) FILTER (WHERE k.node IS NULL) AS leaves
  FROM n JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY p.node
)
SELECT up.conv_id, up.depth::BIGINT AS depth, a.conv_id AS parent_conv_id, up.n_convs, coalesce(k.n_children, 0) AS n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, coalesce(l.ends, sha256('')) AS ends_sha256
FROM up LEFT JOIN n a ON a.node = up.parent LEFT JOIN kids k ON k.node = up.node JOIN below b ON b.node = up.node LEFT JOIN lists l ON l.node = up.node
"""


def _leaf(text: str) -> str:
    def field(c: str) -> str:
        return f"coalesce(strlen({c}) || ':' || {c}, '-')"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _levels(name: str, leaves: str, key: str) -> str:
    """All levels of the trees of ``leaves(key, pos, d)``, one per key."""
    return f"""{name} AS (
  SELECT {key}, 0 AS level, pos, d, count(*) OVER (PARTITION BY {key}) AS n FROM {leaves}
  UNION ALL SELECT {key}, level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (max(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY {key}, level, pos // 8
)"""


def _folded(name: str, start: str, nodes: str, key: str) -> str:
    """``start(doc, key, pos, d, proof)`` folded level by level."""
    return f"""{name} AS (
  SELECT doc, {key}, 0 AS level, pos, d, proof FROM {start}
  UNION ALL SELECT f.doc, f.{key}, f.level + 1, f.pos // 8, sha256(string_agg(CASE WHEN s.pos = f.pos THEN f.d ELSE s.d END, '' ORDER BY s.pos)),
         any_value(f.proof) || coalesce(string_agg(CASE WHEN s.pos <> f.pos THEN s.d END, '' ORDER BY s.pos), '')
  FROM {name} f JOIN {nodes} s ON s.{key} = f.{key} AND s.level = f.level AND s.pos // 8 = f.pos // 8 WHERE s.n > 1
  GROUP BY f.doc, f.{key}, f.level, f.pos
)"""


OP13 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS doc, doc_id, coalesce('=' || lang, '') AS grp, {_leaf('text')} AS d,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM d
), {_levels('lower_nodes', 'leaves', 'grp')}, subroots AS (
  SELECT grp, d, row_number() OVER (ORDER BY grp) - 1 AS pos, 0 AS one FROM lower_nodes WHERE n = 1
), {_levels('upper_nodes', 'subroots', 'one')}, first AS (
  SELECT doc, grp, pos, coalesce(changed, d) AS d, '' AS proof FROM leaves
), {_folded('in_group', 'first', 'lower_nodes', 'grp')}, done AS (
  SELECT f.doc, 0 AS one, s.pos, f.d, f.proof FROM in_group f JOIN subroots s USING (grp)
  WHERE f.level = (SELECT max(level) FROM lower_nodes x WHERE x.grp = f.grp)
), {_folded('in_all', 'done', 'upper_nodes', 'one')}, root AS (
  SELECT d FROM upper_nodes WHERE n = 1
)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, root.d AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = root.d AS verified
FROM leaves l JOIN subroots s USING (grp) JOIN in_all f USING (doc), root WHERE f.level = (SELECT max(level) FROM upper_nodes)
"""

ORACLE: dict[str, str] = {"op4_redirect_equivalence": OP4, "op12_half_depth_trie": OP12, "op13_midstate_tree": OP13}
