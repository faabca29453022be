"""DuckDB SQL for each registered query (same column names as the Spark side)."""

from __future__ import annotations

from quarry.plans import oracle_views as V

ORACLE: dict[str, str] = {}

ORACLE["t1_code_files"] = f"""{V.CODE}
SELECT repo, path, rel_path, ext, language, size_bytes, line_count, sha FROM code_files"""

ORACLE["p6_prose_files"] = f"""{V.PROSE}
SELECT repo, path, language, size_bytes, line_count FROM prose_files"""

ORACLE["t1_symbols"] = f"""{V.CODE}
SELECT path, language, symbol, kind, ord FROM code_symbols"""

ORACLE["a1_symbol_index"] = f"""{V.CODE},
post AS (SELECT DISTINCT symbol, path FROM code_symbols)
SELECT p.symbol, p.path, c.n_files
FROM post p JOIN (SELECT symbol, count(*)::INTEGER AS n_files FROM post GROUP BY symbol) c USING (symbol)"""

ORACLE["a1_prose_symbol_index"] = f"""{V.PROSE},
post AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[A-Z][a-z]{{3,}}')) AS symbol, path FROM prose_files)
SELECT symbol, count(*)::INTEGER AS n_files, min(path) AS first_path, max(path) AS last_path
FROM post GROUP BY symbol"""

ORACLE["t1_followed_index"] = f"""WITH {V.CODE_FILES},
changed AS (SELECT repo, path, language, CASE fate WHEN 0 THEN '' WHEN 2 THEN replace(content, 'e(x', 'eZ(x') ELSE content END AS content
            FROM (SELECT *, ('0x' || substr(md5('42:change:' || path), 1, 8))::BIGINT % 8 AS fate FROM code_files) WHERE fate <> 1),
{V.CODE_SYMBOL_LISTS.replace('FROM code_files)', 'FROM changed)')}
SELECT DISTINCT symbol, path FROM code_symbols"""

ORACLE["a2_corpus_stats"] = f"""{V.CODE}
SELECT 'files' AS metric, count(*) AS value FROM code_files
UNION ALL
SELECT 'symbols' AS metric, count(DISTINCT symbol) AS value FROM code_symbols"""

ORACLE["f9_imports"] = f"""{V.CODE},
lists AS (
  SELECT path, language,
    CASE WHEN language = 'go' THEN list_transform(regexp_extract_all(content, 'import\\s+(?:"[^"]+"|`[^`]+`)'),
                                                  lambda m: regexp_extract(m, '["`]([^"`]+)["`]$', 1))
         WHEN language = 'python' THEN regexp_extract_all(content, '(?m)(?:^|\\n)\\s*(?:import|from)\\s+(\\S+)', 1)
         WHEN language IN ('cpp', 'c') THEN regexp_extract_all(content, '#include\\s*[<"]([^>"]+)[>"]', 1)
         ELSE [] END AS mods
  FROM code_files)
SELECT path, language, unnest(mods) AS module, (unnest(generate_series(1, len(mods))) - 1)::INTEGER AS ord FROM lists"""

ORACLE["r5_reference_index"] = f"""{V.CODE}
SELECT identifier, path, count(*)::BIGINT AS n
FROM (SELECT path, unnest(regexp_extract_all(content, '[A-Za-z_]\\w*')) AS identifier FROM code_files)
GROUP BY identifier, path"""


# --------------------------------------------------------------- M4/M5 rewrite

def _hex(h: str, start: int, length: int = 8) -> str:
    return f"('0x' || substr({h}, {start}, {length}))::BIGINT"


_H = "md5('42:new_name:' || old)"
NEW_NAME = (f"CASE WHEN {_hex(_H, 1)} % 10 < 7 THEN old || '_' || "
            f"['Renamed','Legacy','V2','Updated','New','Modified'][{_hex(_H, 9)} % 6 + 1] "
            f"ELSE ['Old','Legacy','Compat','Wrapper'][{_hex(_H, 17)} % 4 + 1] || '_' || old END")

RENAME = f"""{V.CODE_REC},
keys AS (SELECT DISTINCT symbol FROM code_symbols),
ranked AS (SELECT symbol, row_number() OVER (ORDER BY md5('42:rename:' || symbol), symbol) AS rank FROM keys),
rmap0 AS (SELECT symbol AS old, rank FROM ranked WHERE rank <= (SELECT greatest(1, floor(count(*) * 0.05::DOUBLE)) FROM keys)),
rmap AS (SELECT old, {NEW_NAME} AS new, rank FROM rmap0),
pairs AS (SELECT p.path, r.old, r.new, r.rank FROM (SELECT DISTINCT symbol, path FROM code_symbols) p JOIN rmap r ON p.symbol = r.old),
ordered AS (SELECT path, old, new, row_number() OVER (PARTITION BY path ORDER BY rank) AS i FROM pairs),
rec AS (
  SELECT f.path, f.content, 0 AS i FROM code_files f WHERE f.path IN (SELECT path FROM pairs)
  UNION ALL
  SELECT r.path, regexp_replace(r.content, '\\b' || o.old || '\\b', o.new, 'g'), r.i + 1
  FROM rec r JOIN ordered o ON o.path = r.path AND o.i = r.i + 1),
final AS (SELECT path, max(i)::INTEGER AS n_pairs, arg_max(content, i) AS content FROM rec GROUP BY path)"""

ORACLE["k1_t2_rename_map"] = f"{RENAME}\nSELECT old, new, rank FROM rmap"
ORACLE["t2_rename_files"] = f"{RENAME}\nSELECT path, n_pairs, md5(content) AS content_md5 FROM final"
ORACLE["a3_rename_stats"] = f"""{RENAME},
cf AS (SELECT f.path, f.content AS old_content, x.content AS new_content FROM final x JOIN code_files f USING (path))
SELECT 'renames' AS metric, count(*) AS value FROM rmap
UNION ALL SELECT 'files_changed', count(*) FROM pairs
UNION ALL SELECT 'files_rewritten', count(*) FROM final
UNION ALL SELECT 'files_modified', count(*) FILTER (WHERE new_content <> old_content) FROM cf"""

MIGRATE = f"""{V.CODE_REC},
keys AS (SELECT DISTINCT symbol FROM code_symbols),
chosen AS (SELECT symbol, rank FROM (
    SELECT symbol, row_number() OVER (ORDER BY md5('42:api:' || symbol), symbol) AS rank
    FROM keys WHERE length(symbol) > 3 AND regexp_matches(symbol, '^\\p{{Lu}}')) WHERE rank <= 10),
definers AS (SELECT DISTINCT p.symbol, p.path FROM code_symbols p JOIN chosen c USING (symbol)),
first AS (SELECT symbol, min(path) AS definition_file FROM definers GROUP BY symbol),
usages AS (SELECT d.symbol, d.path FROM definers d JOIN first f USING (symbol) WHERE d.path <> f.definition_file),
uranked AS (SELECT symbol, path,
    row_number() OVER (PARTITION BY symbol ORDER BY md5('42:migrate:' || symbol || ':' || path), path) AS rk,
    count(*) OVER (PARTITION BY symbol) AS n FROM usages),
picked AS (SELECT symbol, path FROM uranked WHERE rk <= floor(n * 0.6::DOUBLE)),
record AS (
  SELECT c.symbol, c.symbol || 'V2' AS v2_symbol, f.definition_file,
         (SELECT count(*) FROM usages u WHERE u.symbol = c.symbol)::INTEGER AS total_callsites,
         (SELECT count(*) FROM picked p WHERE p.symbol = c.symbol)::INTEGER AS migrated_callsites
  FROM chosen c JOIN first f USING (symbol)),
actions AS (
  SELECT symbol, definition_file AS path, 'define' AS action FROM first
  UNION ALL SELECT symbol, path, 'migrate' AS action FROM picked)"""

ORACLE["t3_api_migrations"] = f"{MIGRATE}\nSELECT * FROM record"
ORACLE["t3_migration_actions"] = f"{MIGRATE}\nSELECT symbol, path, action FROM actions"

# T3 rewrite: actions applied per file in (rank, step) order.  Go clone
# and Python clone (F21) are regexes RE2 can run; migrate is a
# whole-word replace.
ORACLE["t3_migrate_rewrite"] = f"""{MIGRATE},
acts AS (
  SELECT a.path, a.action, a.symbol AS old, a.symbol || 'V2' AS new,
         row_number() OVER (PARTITION BY a.path ORDER BY c.rank, CASE a.action WHEN 'define' THEN 0 ELSE 1 END) AS i
  FROM actions a JOIN chosen c USING (symbol)),
rec AS (
  SELECT f.path, f.language, f.content, f.content AS original, 0 AS i FROM code_files f WHERE f.path IN (SELECT path FROM acts)
  UNION ALL
  SELECT r.path, r.language,
    CASE
      WHEN a.action = 'migrate' THEN regexp_replace(r.content, '\\b' || a.old || '\\b', a.new, 'g')
      WHEN r.language = 'go' THEN (
        WITH m AS (SELECT regexp_extract(r.content, '(?s)(func\\s+' || a.old || '\\s*\\([^)]*\\)\\s*[^{{]*\\{{[^}}]*\\}})', 1) AS o)
        SELECT CASE WHEN o = '' THEN r.content ELSE replace(r.content, o, o || chr(10) || chr(10) || replace(o, 'func ' || a.old, 'func ' || a.new)) END FROM m)
      WHEN r.language = 'python' THEN (
        WITH m AS (SELECT regexp_extract(r.content, '(?m)(def\\s+' || a.old || '\\s*\\([^)]*\\):[^\\n]*(?:\\n(?:    [^\\n]*|\\n)*)*)', 1) AS o)
        SELECT CASE WHEN o = '' THEN r.content ELSE replace(r.content, o, o || chr(10) || chr(10) || replace(o, 'def ' || a.old, 'def ' || a.new)) END FROM m)
      ELSE r.content END,
    r.original, r.i + 1
  FROM rec r JOIN acts a ON a.path = r.path AND a.i = r.i + 1)
SELECT path, md5(arg_max(content, i)) AS content_md5, arg_max(content, i) <> any_value(original) AS changed
FROM rec GROUP BY path"""


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _wrap_sql():
    from quarry.operators.transforms import WRAPPER_TEMPLATES
    return " UNION ALL ".join(f"SELECT '{k}' AS language, {_sql_str(v)} AS template"
                              for k, v in WRAPPER_TEMPLATES.items())


WRAP = f"""{V.CODE},
keys AS (SELECT DISTINCT symbol FROM code_symbols),
chosen AS (SELECT symbol, rank FROM (
    SELECT symbol, row_number() OVER (ORDER BY md5('42:wrap:' || symbol), symbol) AS rank FROM keys) WHERE rank <= 8),
first AS (SELECT c.symbol, c.rank, min(p.path) AS original_file
          FROM chosen c JOIN (SELECT DISTINCT symbol, path FROM code_symbols) p USING (symbol) GROUP BY ALL),
rec AS (SELECT f.symbol, f.rank, f.original_file,
               regexp_replace(f.original_file, '(\\.[^./]+)$', '_wrapper\\1') AS wrapper_file,
               cf.language, cf.repo, cf.rel_path
        FROM first f JOIN code_files cf ON cf.path = f.original_file WHERE cf.language IN ('go', 'python')),
tpl AS ({_wrap_sql()}),
gen AS (SELECT r.*, replace(replace(replace(t.template, '{{symbol}}', r.symbol), '{{symbol_lower}}', lower(r.symbol)),
                           '{{module}}', regexp_extract(r.original_file, '([^/]+)\\.[^./]+$', 1)) AS content,
               row_number() OVER (PARTITION BY r.wrapper_file ORDER BY r.rank DESC) AS w
        FROM rec r JOIN tpl t USING (language))"""

ORACLE["t4_wrapper_layers"] = f"""{WRAP}
SELECT symbol, original_file, wrapper_file, 'caller -> ' || wrapper_file || ' -> ' || original_file AS call_chain FROM rec"""

ORACLE["t4_wrapper_files"] = f"""{WRAP}
SELECT repo, wrapper_file AS path, substr(wrapper_file, length(original_file) - length(rel_path) + 1) AS rel_path,
       language, strlen(content)::BIGINT AS size_bytes, {V.line_count_sql('content')}::INTEGER AS line_count,
       sha256(content) AS sha
FROM gen WHERE w = 1"""

_LIT = "replace(replace(content, '\"INFO\"', '\"DEBUG\"'), '''error''', '''warn''')"
_HDR = (f"CASE WHEN starts_with({_LIT}, '//') OR starts_with({_LIT}, '#') THEN '// LEGACY VERSION - DO NOT USE' || chr(10) || {_LIT} "
        f"WHEN starts_with({_LIT}, '/*') THEN '/* LEGACY VERSION */' || chr(10) || {_LIT} ELSE {_LIT} END")
DRIFT_SQL = f"regexp_replace(regexp_replace({_HDR}, '\\b1024\\b', '1000', 'g'), '\\b60\\b', '65', 'g')"

DUP = f"""{V.CODE},
td AS (SELECT *, left(path, length(path) - length(rel_path) - 1) AS repo_root, split_part(rel_path, '/', 1) AS top_dir
       FROM code_files WHERE contains(rel_path, '/')),
counts AS (SELECT repo, repo_root, top_dir, count(*) AS n_files FROM td GROUP BY ALL),
small AS (SELECT * FROM counts WHERE n_files < 100 AND NOT starts_with(top_dir, '.')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5('42:dup:' || repo || ':' || top_dir), top_dir) AS rk,
                  count(*) OVER (PARTITION BY repo) AS gs FROM small),
chosen AS (SELECT repo, repo_root, top_dir FROM ranked WHERE rk <= least(2, gs)),
copies AS (SELECT td.*, td.top_dir || '_legacy' AS new_top FROM td JOIN chosen USING (repo, repo_root, top_dir)),
drifted AS (
  SELECT repo_root || '/' || new_top || '/' || substr(rel_path, length(top_dir) + 2) AS path, path AS original_path,
         repo_root, top_dir, new_top, content AS old_content,
         CASE WHEN regexp_matches(path, '\\.(go|py|cpp|h)$') THEN {DRIFT_SQL} ELSE content END AS content,
         regexp_matches(path, '\\.(go|py|cpp|h)$') AS rewritable
  FROM copies),
dfiles AS (SELECT *, rewritable AND content <> old_content AS modified FROM drifted)"""

ORACLE["t5_duplication_map"] = f"""{DUP}
SELECT c.repo_root || '/' || c.top_dir AS original_path, c.repo_root || '/' || c.top_dir || '_legacy' AS duplicate_path,
       coalesce((SELECT string_agg(d.path, '|' ORDER BY d.path) FROM dfiles d
                 WHERE d.modified AND d.repo_root = c.repo_root AND d.top_dir = c.top_dir), '') AS modified_files
FROM chosen c"""

ORACLE["t5_duplicate_files"] = f"""{DUP}
SELECT path, original_path, modified, sha256(content) AS sha FROM dfiles"""

ORACLE["r2_drift_audit"] = f"""{DUP},
a AS (SELECT path, unnest(string_split(content, chr(10))) AS line, 1 AS d FROM dfiles
      UNION ALL SELECT path, unnest(string_split(old_content, chr(10))) AS line, -1 AS d FROM dfiles),
per AS (SELECT path, line, sum(d) AS net FROM a GROUP BY ALL),
ch AS (SELECT path, sum(greatest(net, 0))::BIGINT AS changed_lines FROM per GROUP BY path),
nl AS (SELECT path, original_path, len(string_split(content, chr(10)))::BIGINT AS n_lines FROM dfiles)
SELECT nl.path, nl.original_path, nl.n_lines, ch.changed_lines,
       round(ch.changed_lines / greatest(nl.n_lines, 1), 9) AS changed_share
FROM nl JOIN ch USING (path)"""

ORACLE["a7_dir_file_count"] = f"""{V.CODE}
SELECT repo, top_dir, n_files, n_files < 100 AND NOT starts_with(top_dir, '.') AS small
FROM (SELECT repo, split_part(rel_path, '/', 1) AS top_dir, count(*) AS n_files
      FROM code_files WHERE contains(rel_path, '/') GROUP BY ALL)"""

ORACLE["w2_stratified_fraction"] = f"""{V.CODE},
r AS (SELECT language, path,
        row_number() OVER (PARTITION BY language ORDER BY md5('42:w2:' || language || ':' || path), path) AS rank,
        count(*) OVER (PARTITION BY language) AS group_size FROM code_files)
SELECT language, path, rank, group_size FROM r WHERE rank <= floor(group_size * 0.6::DOUBLE)"""

ORACLE["d7_shard_select"] = f"""{V.CODE}
SELECT path, size_bytes FROM code_files WHERE ('0x' || substr(md5(path), 1, 15))::BIGINT % 8 = 3"""


# ----------------------------------------------------- M6/M7 lineage, validation
ORACLE["r1_snapshot_diff"] = f"""{RENAME},
after AS (SELECT c.path, coalesce(sha256(f.content), c.sha) AS sha FROM code_files c LEFT JOIN final f USING (path))
SELECT coalesce(b.path, a.path) AS path,
       CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'removed'
            WHEN b.sha <> a.sha THEN 'modified' ELSE 'same' END AS status
FROM code_files b FULL OUTER JOIN after a ON a.path = b.path"""

ORACLE["d8_changed_repos"] = f"""{RENAME},
after AS (SELECT c.repo, c.path, coalesce(sha256(f.content), c.sha) AS sha FROM code_files c LEFT JOIN final f USING (path)),
changed AS ((SELECT repo, path, sha FROM after EXCEPT SELECT repo, path, sha FROM code_files)
  UNION (SELECT repo, path, sha FROM code_files EXCEPT SELECT repo, path, sha FROM after))
SELECT repo, count(*) AS n_files FROM after WHERE repo IN (SELECT repo FROM changed) GROUP BY repo"""

_EDGE_RE = "(?:func|def|int) (\\w+)\\([^)]*\\)[^\\n]*\\n\\s*return (\\w+)\\(x\\)"
ORACLE["r3_call_chain"] = f"""{V.CODE_REC},
edges AS (SELECT DISTINCT unnest(regexp_extract_all(content, '{_EDGE_RE}', 1)) AS caller,
                          unnest(regexp_extract_all(content, '{_EDGE_RE}', 2)) AS callee FROM code_files),
roots AS (SELECT symbol AS root FROM (
   SELECT symbol, row_number() OVER (ORDER BY md5('42:wrap:' || symbol), symbol) AS r
   FROM (SELECT DISTINCT symbol FROM code_symbols)) WHERE r <= 8),
walk(root, node, depth) USING KEY (root, node) AS (
   SELECT root, root, 0 FROM roots
   UNION
   SELECT DISTINCT w.root, e.callee, w.depth + 1 FROM walk w JOIN edges e ON e.caller = w.node
   WHERE NOT EXISTS (SELECT 1 FROM recurring.walk v WHERE v.root = w.root AND v.node = e.callee))
SELECT root, node, depth FROM walk"""

_walk = ORACLE["r3_call_chain"]
ORACLE["r3_call_paths"] = _walk[:_walk.rindex("\nSELECT root")] + """,
towards AS (SELECT w.root, w.node, w.depth, min(p.node) AS pointer FROM walk w JOIN edges e ON e.callee = w.node
            JOIN walk p ON p.root = w.root AND p.node = e.caller AND p.depth = w.depth - 1 GROUP BY ALL),
paths(root, node, depth, path) AS (
   SELECT root, node, depth, root FROM walk WHERE depth = 0
   UNION ALL
   SELECT p.root, t.node, t.depth, p.path || ' > ' || t.node FROM paths p JOIN towards t ON t.root = p.root AND t.pointer = p.node)
SELECT root, node, depth, path FROM paths"""

ORACLE["r6_rename_audit"] = f"""{RENAME},
after AS (SELECT c.path, coalesce(f.content, c.content) AS content FROM code_files c LEFT JOIN final f USING (path)),
uses AS (SELECT path, identifier, count(*) AS n
         FROM (SELECT path, unnest(regexp_extract_all(content, '[A-Za-z_]\\w*')) AS identifier FROM after) GROUP BY ALL),
named AS (SELECT r.old, r.new, u.path, u.n AS n_old, 0 AS n_new FROM rmap r JOIN uses u ON u.identifier = r.old
          UNION ALL SELECT r.old, r.new, u.path, 0, u.n FROM rmap r JOIN uses u ON u.identifier = r.new),
per AS (SELECT old, new, path, sum(n_old) AS n_old, sum(n_new) AS n_new FROM named GROUP BY ALL),
tot AS (SELECT old, new, count(*) AS files, count(*) FILTER (WHERE n_old > 2) AS files_left,
               count(*) FILTER (WHERE n_old <= 2 AND n_new >= 1) AS files_done FROM per GROUP BY ALL)
SELECT r.old, r.new, coalesce(files, 0) AS files, coalesce(files_left, 0) AS files_left, coalesce(files_done, 0) AS files_done,
       coalesce(round(files_done / files, 9), 1.0)::DOUBLE AS coverage
FROM rmap r LEFT JOIN tot t ON t.old = r.old AND t.new = r.new"""

ORACLE["r4_exact_copies"] = f"""{V.PROSE},
h AS (SELECT path, md5(trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))) AS group_hash FROM prose_files),
s AS (SELECT group_hash, count(*) AS group_size FROM h GROUP BY group_hash HAVING count(*) > 1)
SELECT path, group_hash, group_size FROM h JOIN s USING (group_hash)"""

ORACLE["t6_validate_corpus"] = f"""{V.CODE},
c AS (SELECT repo, count(*) FILTER (WHERE ends_with(path, '.go')) AS go, count(*) FILTER (WHERE ends_with(path, '.py')) AS py,
             count(*) FILTER (WHERE ends_with(path, '.cpp')) AS cpp FROM code_files GROUP BY repo),
s AS (SELECT repo, bool_and(NOT regexp_matches(content, '(?m)^def (True|False|None)\\(')) AS python_ok,
             count(*) AS python_files,
             count(*) FILTER (WHERE regexp_matches(content, '(?m)^def (True|False|None)\\(')) AS syntax_errors
      FROM code_files WHERE language = 'python' GROUP BY repo)
SELECT c.repo, go, py, cpp,
       CASE WHEN go > greatest(py, cpp) THEN 'go' WHEN py > greatest(go, cpp) THEN 'python' WHEN cpp > 0 THEN 'cpp' END AS primary_language,
       python_ok, python_files, syntax_errors
FROM c LEFT JOIN s USING (repo)"""

ORACLE["c7_check_compilation"] = f"""{V.CODE},
f AS (SELECT repo, path, content, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM code_files WHERE ends_with(path, '.py'))
SELECT repo, bool_and(NOT regexp_matches(content, '(?m)^def (True|False|None)\\(')) AS compile_ok FROM f WHERE r <= 5 GROUP BY repo"""

ORACLE["a6_primary_language_prose"] = f"""{V.PROSE},
c AS (SELECT repo, count(*) FILTER (WHERE ends_with(path, '.go')) AS go, count(*) FILTER (WHERE ends_with(path, '.py')) AS py,
             count(*) FILTER (WHERE ends_with(path, '.cpp')) AS cpp FROM prose_files GROUP BY repo)
SELECT repo, go, py, cpp,
       CASE WHEN go > greatest(py, cpp) THEN 'go' WHEN py > greatest(go, cpp) THEN 'python' WHEN cpp > 0 THEN 'cpp' END AS primary_language
FROM c"""


ORACLE["p8_errors_by_repo"] = f"""{V.TREE},
{V.TREE_SYMBOLS}
SELECT t.repo, count(*) AS n_files, count(*) FILTER (WHERE fate = 0) AS read_errors,
       count(*) FILTER (WHERE fate = 1 AND language = 'python') AS analysis_errors,
       coalesce((SELECT sum(len(syms)) FROM tree_symbol_lists s WHERE s.repo = t.repo), 0)::BIGINT AS n_symbols
FROM tree_scanned t GROUP BY t.repo"""

_LISTED = "count(*) FILTER (WHERE ends_with(path, '.go')) AS {0}go, count(*) FILTER (WHERE ends_with(path, '.py')) AS {0}py, count(*) FILTER (WHERE ends_with(path, '.cpp')) AS {0}cpp"
_PRIMARY = "CASE WHEN go > greatest(py, cpp) THEN 'go' WHEN py > greatest(go, cpp) THEN 'python' WHEN cpp > 0 THEN 'cpp' END AS primary_language"
ORACLE["a5_listed_languages"] = f"""{V.TREE},
c AS (SELECT repo, {_LISTED.format('')} FROM tree GROUP BY repo),
s AS (SELECT repo, {_LISTED.format('scanned_')} FROM tree_scanned GROUP BY repo)
SELECT repo, go, py, cpp, {_PRIMARY}, coalesce(scanned_go, 0) AS scanned_go, coalesce(scanned_py, 0) AS scanned_py, coalesce(scanned_cpp, 0) AS scanned_cpp
FROM c LEFT JOIN s USING (repo)"""

ORACLE["a7_listed_directories"] = f"""{V.TREE}
SELECT repo, top_dir, count(*) AS n_files, count(s.path) AS n_scanned, count(*) < 20 AND NOT starts_with(top_dir, '.') AS small
FROM tree t LEFT JOIN (SELECT path FROM tree_scanned) s USING (path) GROUP BY repo, top_dir"""

ORACLE["t6_listed_validation"] = f"""{V.TREE},
c AS (SELECT repo, {_LISTED.format('')} FROM tree GROUP BY repo),
s AS (SELECT repo, bool_and(NOT {V.TREE_BAD}) AS python_ok, count(*) AS python_files, count(*) FILTER (WHERE {V.TREE_BAD}) AS syntax_errors
      FROM tree WHERE language = 'python' AND fate <> 0 GROUP BY repo)
SELECT c.repo, go, py, cpp, {_PRIMARY}, python_ok, python_files, syntax_errors FROM c LEFT JOIN s USING (repo)"""

ORACLE["c7_listed_compilation"] = f"""{V.TREE},
f AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path) AS r FROM tree WHERE ends_with(path, '.py') AND fate <> 0)
SELECT repo, bool_and(NOT {V.TREE_BAD}) AS compile_ok FROM f WHERE r <= 5 GROUP BY repo"""


# ------------------------------------------------- function-level queries
_PAGE = """pf AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS repo,
         regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS upath
  FROM pages),
pf2 AS (SELECT *, repo || CASE WHEN upath = '' THEN '/' ELSE upath END AS path FROM pf),
pf3 AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM pf2),
pf4 AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]+)$', 1) AS sfx FROM pf3)"""

ORACLE["p4_page_files"] = f"""WITH {_PAGE}
SELECT repo, path, regexp_replace(sfx, '^\\.', '') AS ext,
  CASE lower(sfx) WHEN '.go' THEN 'go' WHEN '.py' THEN 'python' WHEN '.cpp' THEN 'cpp' WHEN '.cxx' THEN 'cpp'
    WHEN '.cc' THEN 'cpp' WHEN '.h' THEN 'cpp' WHEN '.hpp' THEN 'cpp' WHEN '.hxx' THEN 'cpp' WHEN '.c' THEN 'c'
    WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' ELSE 'unknown' END AS language,
  regexp_matches(name, '\\.(go|py|cpp|h|hpp|c|java|js|ts)$')
    AND NOT regexp_matches(regexp_extract(path, '^(.*)/[^/]*$', 1), 'vendor/|node_modules/|third_party/|\\.git/|test/|tests/|_test\\.|\\.test\\.|generated/')
    AND NOT regexp_matches(name, 'vendor/|node_modules/|third_party/|\\.git/|test/|tests/|_test\\.|\\.test\\.|generated/') AS scanned,
  name
FROM pf4"""

ORACLE["f9_page_links"] = """SELECT page_id, (unnest(generate_series(1, len(l))) - 1) AS ord, unnest(l) AS target
FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages)"""

_KW = "['call','trace','path','flow','implementation','function','method']"
ORACLE["f34_keyword_ratio"] = f"""SELECT conv_id, turn,
  round(len(list_filter({_KW}, lambda k: contains(lower(text), k))) / 7.0, 9) AS ratio
FROM conversations WHERE role = 'assistant'"""

ORACLE["f33_path_steps"] = f"""{V.PROSE},
s AS (SELECT path, lower(content) AS low,
        [path, rel_path || '::' || regexp_extract(content, '([A-Z][a-z]+)', 1),
         regexp_extract(content, '([A-Z][a-z]+)', 1), 'x->y'] AS steps FROM prose_files),
h AS (SELECT path, steps, list_filter(steps, lambda st:
        CASE WHEN contains(st, '::') OR contains(st, '->') OR contains(st, '.')
             THEN len(list_filter(regexp_split_to_array(st, '[:>.]'), lambda p: trim(p) <> '' AND contains(low, lower(trim(p))))) > 0
             ELSE contains(low, lower(st)) END) AS hit FROM s)
SELECT path, round(len(hit) / len(steps), 9) AS accuracy, len(hit) AS hits FROM h"""

ORACLE["f36_line_band"] = """WITH n AS (
  SELECT page_id, list_transform(regexp_extract_all(url, '\\b(\\d+)\\b', 1), lambda d: TRY_CAST(d AS DECIMAL(38,0))) AS ints FROM pages),
f AS (SELECT page_id, ints, list_filter(ints, lambda x: x IS NOT NULL AND x >= 495 AND x <= 515)[1] AS first FROM n)
SELECT page_id, len(ints) AS n_ints,
  (CASE WHEN first IS NULL THEN 0.0 WHEN first >= 498 AND first <= 512 THEN 1.0 ELSE 0.75 END)::DOUBLE AS band_score FROM f"""

_FIX = "|".join(f"(?:{p})" for p in ["if.*null", "null.*check", "!= null", "== null", "try.*catch", "error.*handle",
                                      "validate", "bounds.*check", "len.*check", "size.*check"])
ORACLE["j6_bug_lines"] = f"""{V.PROSE},
s AS (SELECT path, string_split(content, chr(10))[2:4] AS sl FROM prose_files)
SELECT path, len(sl) AS n_lines, regexp_matches(lower(array_to_string(sl, chr(10))), '{_FIX}') AS fix FROM s"""

ORACLE["f17_count_word"] = f"""{V.PROSE}
SELECT path, len(regexp_extract_all(content, '\\bthe\\b'))::INTEGER AS n_the,
       len(regexp_extract_all(content, '\\bla\\b'))::INTEGER AS n_la FROM prose_files"""

_GREP = f"""{V.PROSE},
l AS (SELECT repo, path, unnest(string_split(content, chr(10))) AS line,
             unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no
      FROM prose_files)"""
_NOISE = "(contains(path || ':' || line, '//') OR contains(path || ':' || line, '#') OR contains(path || ':' || line, '\"') OR contains(path || ':' || line, ''''))"
ORACLE["s15_grep_lines"] = f"""{_GREP}
SELECT path, line_no, {_NOISE} AS noise FROM l
WHERE regexp_matches(path, '\\.(go|py|cpp)$') AND contains(line, 'Est')"""

ORACLE["w3_first_hits"] = f"""{_GREP},
h AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS r FROM l WHERE contains(line, 'Est'))
SELECT repo, count(*) AS hits, least(count(*) FILTER (WHERE {_NOISE}), 10) AS false_positives FROM h WHERE r <= 50 GROUP BY repo"""

ORACLE["f16_new_name"] = f"""{V.CODE}
SELECT old AS symbol, {NEW_NAME} AS new_name FROM (SELECT DISTINCT symbol AS old FROM code_symbols)"""

ORACLE["p9_api_candidates"] = f"""{V.CODE}
SELECT DISTINCT symbol FROM code_symbols WHERE length(symbol) > 3 AND regexp_matches(symbol, '^\\p{{Lu}}')"""

ORACLE["f29_drift_prose"] = f"""{V.PROSE},
d AS (SELECT path, content AS old, CASE WHEN regexp_matches(path, '\\.(go|py|cpp|h)$') THEN {DRIFT_SQL} ELSE content END AS new FROM prose_files)
SELECT path, md5(new) AS drifted_md5, new <> old AS modified FROM d"""

ORACLE["d1_performance_band"] = """SELECT CASE WHEN l_discount * 10 * 100.0 >= 90 THEN 'Expert' WHEN l_discount * 10 * 100.0 >= 75 THEN 'Proficient'
  WHEN l_discount * 10 * 100.0 >= 60 THEN 'Competent' WHEN l_discount * 10 * 100.0 >= 40 THEN 'Developing' ELSE 'Novice' END AS band,
  count(*) AS n FROM lineitem GROUP BY band"""

ORACLE["d2_overtime_events"] = """WITH m AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS elapsed FROM events GROUP BY user_id)
SELECT user_id, round(elapsed, 6) AS elapsed,
  CASE WHEN (elapsed - 10.0) / 10.0 <= 0 THEN 1.0 WHEN (elapsed - 10.0) / 10.0 <= 0.25 THEN 0.9
       WHEN (elapsed - 10.0) / 10.0 <= 0.5 THEN 0.75 WHEN (elapsed - 10.0) / 10.0 <= 1.0 THEN 0.5 ELSE 0.0 END::DOUBLE AS factor
FROM m"""

ORACLE["f4_rich_symbols"] = f"WITH {V.RICH_FILES},\n{V.RICH_SYMBOLS}\nSELECT path, language, symbol, kind FROM code_symbols"

ORACLE["f29_rich_drift"] = f"""WITH {V.RICH_FILES},
d AS (SELECT path, content AS old, CASE WHEN regexp_matches(path, '\\.(go|py|cpp|h)$') THEN {DRIFT_SQL} ELSE content END AS new FROM rich)
SELECT path, md5(new) AS drifted_md5, new <> old AS modified FROM d"""

ORACLE["d2_overtime_lines"] = """WITH m AS (SELECT l_quantity::DOUBLE AS elapsed, count(*) AS n FROM lineitem GROUP BY 1)
SELECT elapsed, n, CASE WHEN (elapsed - 12.0) / 12.0 <= 0 THEN 1.0 WHEN (elapsed - 12.0) / 12.0 <= 0.25 THEN 0.9
       WHEN (elapsed - 12.0) / 12.0 <= 0.5 THEN 0.75 WHEN (elapsed - 12.0) / 12.0 <= 1.0 THEN 0.5 ELSE 0.0 END::DOUBLE AS factor FROM m"""

ORACLE["r1_changed_snapshot"] = f"""{V.CODE},
f AS (SELECT path, sha, content, ('0x' || substr(md5('42:change:' || path), 1, 8))::BIGINT % 8 AS fate,
             ('0x' || substr(md5('42:newer:' || path), 1, 8))::BIGINT % 9 = 0 AS newer FROM code_files),
b AS (SELECT path, sha FROM f WHERE NOT newer),
a AS (SELECT path, sha256(CASE fate WHEN 0 THEN '' WHEN 2 THEN replace(content, 'e(x', 'eZ(x') ELSE content END) AS sha FROM f WHERE fate <> 1)
SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.sha IS NULL THEN 'added' WHEN a.sha IS NULL THEN 'removed'
       WHEN b.sha <> a.sha THEN 'modified' ELSE 'same' END AS status FROM b FULL OUTER JOIN a ON a.path = b.path"""

_REPOS = """repos AS (
  SELECT ['core', 'extended', 'xl'][n % 3 + 1] AS tier, source AS name, 'git://' || source AS url, lang AS language, loc AS approximate_loc, n % 4 AS weight,
         CASE WHEN n % 5 > 0 THEN ['mit', 'bsd-3-clause', 'apache-2.0'][n % 3 + 1] END AS license, CASE WHEN n % 2 = 0 THEN n ELSE 1 END AS depth
  FROM (SELECT lang, source, sum(n_chars)::BIGINT AS loc, regexp_extract(source, '([0-9]+)$', 1)::INTEGER AS n FROM documents GROUP BY lang, source))"""
ORACLE["s4_nested_manifest"] = f"""WITH {_REPOS}
SELECT name, url, depth, 'src/' || name || '/' AS folder, tier, language FROM repos WHERE tier <> 'xl'"""
ORACLE["d9_licence_totals"] = f"""WITH {_REPOS}
SELECT license, tier, count(*) AS repos, sum(approximate_loc)::BIGINT AS approximate_loc, sum(weight)::BIGINT AS weight
FROM (SELECT coalesce(license, 'unknown') AS license, tier, approximate_loc, weight FROM repos) GROUP BY ROLLUP (license, tier)"""

ORACLE["d9_corpus_rollup"] = f"""{V.CODE}
SELECT repo, language, count(*) AS files, sum(line_count)::BIGINT AS lines FROM code_files GROUP BY ROLLUP (repo, language)"""


ORACLE["a9_transform_summary"] = f"""SELECT 42 AS seed,
  (SELECT n FROM ({RENAME} SELECT count(*) AS n FROM rmap)) AS renames,
  (SELECT n FROM ({MIGRATE} SELECT count(*) AS n FROM record)) AS api_migrations,
  (SELECT n FROM ({WRAP} SELECT count(*) AS n FROM rec)) AS wrapper_layers,
  (SELECT n FROM ({DUP} SELECT count(*) AS n FROM chosen)) AS duplications"""


# --------------------------------------------------------------- scoring
SUBS = """subs AS (
  SELECT conv_id AS submission_id, count(*) FILTER (WHERE role = 'assistant') > 0 AS patch_applied,
         count(*) % 2 = 0 AS compile_ok, count(*) * 3.5 AS elapsed_minutes
  FROM conversations GROUP BY conv_id)"""


def _texts(n_commits: int) -> str:
    return f"""tfiles AS (SELECT conv_id, string_agg(text || chr(10), '' ORDER BY turn) AS ft
            FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
tcom AS (SELECT conv_id, string_agg(subj, chr(10) ORDER BY turn DESC) || chr(10) AS ct
         FROM (SELECT conv_id, turn, split_part(text, chr(10), 1) AS subj,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r
               FROM conversations WHERE role = 'user') WHERE r <= {n_commits} GROUP BY conv_id),
texts AS (SELECT coalesce(f.conv_id, c.conv_id) AS submission_id, coalesce(ft, '') || coalesce(ct, '') AS text
          FROM tfiles f FULL OUTER JOIN tcom c USING (conv_id))"""


def _attempts(tasks: str) -> str:
    return f"""tnum AS (SELECT task_id, row_number() OVER (ORDER BY md5('42:task:' || task_id), task_id) AS task_no FROM {tasks}),
slots AS (SELECT submission_id, ('0x' || substr(md5('42:slot:' || submission_id || ':' || j), 1, 12))::BIGINT
                 % (SELECT count(*) FROM {tasks}) + 1 AS task_no
          FROM (SELECT submission_id, unnest([0, 1, 2]) AS j FROM subs)),
snum AS (SELECT submission_id, row_number() OVER (ORDER BY md5('42:submission:' || submission_id), submission_id) AS sub_no FROM subs),
turns AS (SELECT task_id, ('0x' || substr(md5('42:turn:' || task_id), 1, 12))::BIGINT % (SELECT count(*) FROM subs) + 1 AS sub_no
          FROM {tasks}),
attempts AS (SELECT s.submission_id, t.task_id FROM slots s JOIN tnum t USING (task_no)
             UNION SELECT s.submission_id, t.task_id FROM turns t JOIN snum s USING (sub_no))"""


_STEP_HIT = ("CASE WHEN contains(st, '::') OR contains(st, '->') OR contains(st, '.') "
             "THEN len(list_filter(regexp_split_to_array(st, '[:>.]'), lambda p: trim(p) <> '' AND contains(low, lower(trim(p))))) > 0 "
             "ELSE contains(low, lower(st)) END")

def _c1_sql(extra: str = "", over: str = "ctasks", more: str = "") -> str:
    return f"""{WRAP},
ctasks AS (SELECT printf('cross_file_reasoning_%02d', rank) AS task_id, symbol, original_file, wrapper_file FROM rec),
{SUBS},
{_texts(5)},
{extra}{_attempts(over)},
sc AS (SELECT a.submission_id, a.task_id, coalesce(x.text, '') AS text, lower(coalesce(x.text, '')) AS low,
              t.original_file AS f,
              ['caller', t.wrapper_file || '::' || t.symbol || 'Wrapper', t.original_file || '::' || t.symbol] AS steps
       FROM attempts a JOIN ctasks t USING (task_id) LEFT JOIN texts x USING (submission_id)),
sc2 AS (SELECT *, f <> '' AND (contains(low, lower(regexp_extract(f, '([^/]*)$', 1))) OR contains(text, f)) AS ff,
               len(list_filter(steps, lambda st: {_STEP_HIT})) / len(steps) AS acc,
               len(list_filter({_KW}, lambda k: contains(low, k))) / 7.0 AS kw FROM sc)
SELECT submission_id, task_id, 'cross_file_reasoning' AS type,
       round(CASE WHEN text = '' THEN 0.0
                  ELSE least((CASE WHEN ff THEN 0.25 ELSE 0.0 END) + acc * 0.5 + least(kw, 1.0) * 0.25, 1.0) END, 12) AS score,
       0 AS n_errors, CASE WHEN text <> '' THEN acc ELSE 0.0 END AS acc{more}
FROM sc2"""


ORACLE["c1_score_cross_file"] = _c1_sql()

_NOISE_L = ("(contains(path || ':' || line, '//') OR contains(path || ':' || line, '#') "
            "OR contains(path || ':' || line, '\"') OR contains(path || ':' || line, ''''))")

def _c2_sql(extra: str = "", over: str = "rtasks", more: str = "") -> str:
    return f"""{RENAME},
after AS (SELECT c.path, coalesce(f.content, c.content) AS content FROM code_files c LEFT JOIN final f USING (path)),
rtasks AS (SELECT printf('refactor_rename_%02d', rank) AS task_id, old, new FROM rmap),
{SUBS},
{extra}{_attempts(over)},
chg AS (SELECT t.task_id, t.old, t.new, p.path FROM rtasks t JOIN (SELECT DISTINCT symbol, path FROM code_symbols) p ON p.symbol = t.old),
chk AS (SELECT c.task_id, count(*) AS checked,
               count(*) FILTER (WHERE a.content IS NOT NULL
                                  AND len(regexp_extract_all(a.content, '\\b' || c.old || '\\b')) <= 2
                                  AND len(regexp_extract_all(a.content, '\\b' || c.new || '\\b')) >= 1) AS correct
        FROM chg c LEFT JOIN after a USING (path) GROUP BY c.task_id),
src AS (SELECT path, content FROM after WHERE regexp_matches(path, '\\.(go|py|cpp)$')),
cand AS (SELECT t.task_id, t.new, s.path FROM rtasks t JOIN src s ON contains(s.content, t.new)),
lines AS (SELECT c.task_id, c.new, c.path, unnest(string_split(s.content, chr(10))) AS line,
                 unnest(generate_series(0, len(string_split(s.content, chr(10))) - 1)) AS line_no
          FROM cand c JOIN src s USING (path)),
hits AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY path, line_no) AS r FROM lines WHERE contains(line, new)),
fp AS (SELECT task_id, least(count(*) FILTER (WHERE {_NOISE_L}), 10) AS fp FROM hits WHERE r <= 50 GROUP BY task_id),
sc AS (SELECT a.submission_id, a.task_id, s.patch_applied, s.compile_ok, coalesce(k.checked, 0) AS checked,
              coalesce(k.correct, 0) AS correct, coalesce(f.fp, 0)::INTEGER AS fp
       FROM attempts a JOIN (SELECT task_id FROM rtasks) rt USING (task_id) LEFT JOIN chk k USING (task_id)
       LEFT JOIN fp f USING (task_id) LEFT JOIN subs s USING (submission_id))
SELECT submission_id, task_id, 'refactor_rename' AS type,
       round(CASE WHEN NOT patch_applied THEN 0.0
                  ELSE least(greatest(0.0, correct / greatest(checked, 1) - least(fp * 0.1::DOUBLE, 0.3::DOUBLE)
                                      + CASE WHEN compile_ok THEN 0.1 ELSE 0.0 END), 1.0) END, 12) AS score,
       CASE WHEN NOT patch_applied THEN 1 ELSE 0 END AS n_errors, fp{more}
FROM sc"""


ORACLE["c2_score_rename"] = _c2_sql()

def _c3_sql(extra: str = "", over: str = "atasks", more: str = "") -> str:
    return f"""{MIGRATE},
after AS (SELECT * FROM ({RENAME}
          SELECT c.path, coalesce(f.content, c.content) AS content FROM code_files c LEFT JOIN final f USING (path))),
atasks AS (SELECT printf('api_upgrade_%02d', c.rank) AS task_id, r.symbol, r.v2_symbol FROM record r JOIN chosen c USING (symbol)),
{SUBS},
{extra}{_attempts(over)},
cs AS (SELECT t.task_id, t.symbol, t.v2_symbol, u.path, p.path IS NOT NULL AS needs
       FROM atasks t JOIN usages u USING (symbol) LEFT JOIN picked p ON p.symbol = u.symbol AND p.path = u.path),
cf AS (SELECT c.*, a.content IS NOT NULL AS present,
              len(regexp_extract_all(a.content, '\\b' || c.symbol || '\\s*\\(')) = 0
              AND len(regexp_extract_all(a.content, '\\b' || c.v2_symbol || '\\s*\\(')) > 0 AS found
       FROM cs c LEFT JOIN after a USING (path)),
chk AS (SELECT task_id, count(*) AS total, count(*) FILTER (WHERE needs) AS expected,
               count(*) FILTER (WHERE present AND needs AND found) AS actual,
               count(*) FILTER (WHERE present AND NOT needs AND NOT found) AS preserved FROM cf GROUP BY task_id),
sc AS (SELECT a.submission_id, a.task_id, s.patch_applied, s.compile_ok, coalesce(total, 0) AS total, coalesce(expected, 0) AS expected,
              coalesce(actual, 0) AS actual, coalesce(preserved, 0) AS preserved
       FROM attempts a JOIN (SELECT task_id FROM atasks) att USING (task_id) LEFT JOIN chk USING (task_id)
       LEFT JOIN subs s USING (submission_id))
SELECT submission_id, task_id, 'api_upgrade' AS type,
       round(CASE WHEN NOT patch_applied THEN 0.0
                  ELSE least(actual / greatest(expected, 1) * 0.7 + preserved / greatest(total - expected, 1) * 0.3, 1.0) END, 12) AS score,
       CASE WHEN NOT patch_applied THEN 1 ELSE 0 END AS n_errors{more}
FROM sc"""


ORACLE["c3_score_api"] = _c3_sql()

def _c4_sql(extra: str = "", over: str = "btasks", more: str = "") -> str:
    return f"""{V.PROSE},
after AS (SELECT * FROM ({RENAME}
          SELECT c.path, coalesce(f.content, c.content) AS content FROM code_files c LEFT JOIN final f USING (path))),
held AS (SELECT b.item_id, b.text, d.path, left(d.content, instr(d.content, b.text) - 1) AS ahead
       FROM benchmark b JOIN prose_files d ON contains(d.content, b.text) WHERE length(b.text) > 0),
loc AS (SELECT item_id, path, unnest([s, s + k]) AS line_no
        FROM (SELECT item_id, path, (length(ahead) - length(replace(ahead, chr(10), '')) + 1)::INTEGER AS s,
                     (length(text) - length(replace(text, chr(10), '')))::INTEGER AS k FROM held)),
firstf AS (SELECT item_id, min(path) AS file FROM loc GROUP BY item_id),
rng AS (SELECT l.item_id, f.file, min(l.line_no) AS s, max(l.line_no) AS e
        FROM loc l JOIN firstf f ON f.item_id = l.item_id AND l.path = f.file GROUP BY l.item_id, f.file),
btasks AS (SELECT printf('bug_localization_%02d', item_id) AS task_id, file, s, e FROM rng),
{SUBS},
{_texts(3)},
{extra}{_attempts(over)},
fx AS (SELECT t.task_id,
              regexp_matches(lower(array_to_string(CASE WHEN least(n, e) > greatest(s - 1, 0)
                                                        THEN ls[greatest(s - 1, 0) + 1 : least(n, e)] ELSE [] END, chr(10))),
                             '{_FIX}') AS fix_found
       FROM btasks t JOIN (SELECT path, string_split(content, chr(10)) AS ls,
                                  len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END AS n
                           FROM after) a ON a.path = t.file),
sc AS (SELECT a.submission_id, a.task_id, t.file, t.s, t.e, s.patch_applied, coalesce(fx.fix_found, false) AS fix_found,
              coalesce(x.text, '') AS text
       FROM attempts a JOIN btasks t USING (task_id) LEFT JOIN subs s USING (submission_id)
       LEFT JOIN texts x USING (submission_id) LEFT JOIN fx USING (task_id)),
sc2 AS (SELECT *, CASE WHEN contains(text, file) OR contains(text, regexp_extract(file, '([^/]*)$', 1)) THEN 1.0 ELSE 0.0 END AS file_score,
               list_filter(list_transform(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'),
                                                      lambda w: regexp_full_match(w, '\\p{{Nd}}+')),
                                          lambda d: TRY_CAST(d AS DECIMAL(38,0))),
                           lambda n: n IS NOT NULL AND n >= s - 5 AND n <= e + 5)[1] AS first FROM sc),
sc3 AS (SELECT *, CASE WHEN first IS NULL THEN 0.0 WHEN first >= s - 2 AND first <= e + 2 THEN 1.0 ELSE 0.75 END AS loc FROM sc2)
SELECT submission_id, task_id, 'bug_localization' AS type,
       round(least(file_score * 0.4 + loc * 0.3 + CASE WHEN patch_applied AND fix_found THEN 0.3 ELSE 0.0 END, 1.0), 12)::DOUBLE AS score,
       0 AS n_errors, loc::DOUBLE AS loc{more}
FROM sc3"""


ORACLE["c4_score_bug"] = _c4_sql()


# Submissions' own trees: the derived patches laid over the after-patch corpus.
def _patch_sql(targets: str, helped: str, harmed: str) -> str:
    """patched: (submission_id, path, content) of the highest task; ``targets``
    gives task_id, path and what the texts need."""
    return f"""pv AS (SELECT DISTINCT a.submission_id, t.*,
              ('0x' || substr(md5('42:patch:' || a.submission_id || ':' || t.task_id || ':' || t.path), 1, 12))::BIGINT % 4 AS v
       FROM attempts a JOIN ({targets}) t USING (task_id)),
pc AS (SELECT pv.submission_id, pv.task_id, pv.path, CASE v WHEN 1 THEN {helped} WHEN 2 THEN {harmed} END AS content
       FROM pv JOIN after USING (path) WHERE v > 0),
patched AS (SELECT submission_id, path, content FROM (
    SELECT *, row_number() OVER (PARTITION BY submission_id, path ORDER BY task_id DESC) AS r FROM pc) WHERE r = 1),
"""


_R_TARGETS = "SELECT task_id, path, old, new FROM chg"
_R_PATCH = _patch_sql(_R_TARGETS, "regexp_replace(content, '\\b' || new || '\\b', old, 'g')", "content || '// ' || new || chr(10)")
_R_BASE = f"""{RENAME},
after AS (SELECT c.path, coalesce(f.content, c.content) AS content, coalesce(sha256(f.content), c.sha) AS sha
          FROM code_files c LEFT JOIN final f USING (path)),
rtasks AS (SELECT printf('refactor_rename_%02d', rank) AS task_id, old, new FROM rmap),
{SUBS},
{_attempts('rtasks')},
chg AS (SELECT t.task_id, t.old, t.new, p.path FROM rtasks t JOIN (SELECT DISTINCT symbol, path FROM code_symbols) p ON p.symbol = t.old),
{_R_PATCH}"""

ORACLE["c2_patched_rename"] = f"""{_R_BASE}chk AS (
  SELECT a.submission_id, a.task_id, count(*) AS checked,
         count(*) FILTER (WHERE x.content IS NOT NULL AND len(regexp_extract_all(x.content, '\\b' || c.old || '\\b')) <= 2
                            AND len(regexp_extract_all(x.content, '\\b' || c.new || '\\b')) >= 1) AS correct
  FROM attempts a JOIN chg c USING (task_id) LEFT JOIN patched o ON o.submission_id = a.submission_id AND o.path = c.path
  LEFT JOIN after b ON b.path = c.path,
  LATERAL (SELECT CASE WHEN o.path IS NOT NULL THEN o.content ELSE b.content END AS content) x
  GROUP BY a.submission_id, a.task_id),
src AS (SELECT path, content FROM after WHERE regexp_matches(path, '\\.(go|py|cpp)$')),
tree AS (SELECT a.submission_id, a.task_id, t.new, s.path, s.content
         FROM attempts a JOIN rtasks t USING (task_id) JOIN src s ON contains(s.content, t.new)
         WHERE NOT EXISTS (SELECT 1 FROM patched o WHERE o.submission_id = a.submission_id AND o.path = s.path)
         UNION ALL
         SELECT a.submission_id, a.task_id, t.new, o.path, o.content
         FROM attempts a JOIN rtasks t USING (task_id) JOIN patched o ON o.submission_id = a.submission_id
         WHERE contains(o.content, t.new) AND regexp_matches(o.path, '\\.(go|py|cpp)$')),
lines AS (SELECT submission_id, task_id, new, path, unnest(string_split(content, chr(10))) AS line,
                 unnest(generate_series(0, len(string_split(content, chr(10))) - 1)) AS line_no FROM tree),
hits AS (SELECT *, row_number() OVER (PARTITION BY submission_id, task_id ORDER BY path, line_no) AS r FROM lines WHERE contains(line, new)),
fp AS (SELECT submission_id, task_id, least(count(*) FILTER (WHERE {_NOISE_L}), 10) AS fp FROM hits WHERE r <= 50 GROUP BY ALL),
sc AS (SELECT a.submission_id, a.task_id, s.patch_applied, s.compile_ok, coalesce(k.checked, 0) AS checked,
              coalesce(k.correct, 0)::INTEGER AS correct, coalesce(f.fp, 0)::INTEGER AS fp
       FROM attempts a LEFT JOIN chk k USING (submission_id, task_id) LEFT JOIN fp f USING (submission_id, task_id)
       LEFT JOIN subs s USING (submission_id))
SELECT submission_id, task_id, 'refactor_rename' AS type,
       round(CASE WHEN NOT patch_applied THEN 0.0
                  ELSE least(greatest(0.0, correct / greatest(checked, 1) - least(fp * 0.1::DOUBLE, 0.3::DOUBLE)
                                      + CASE WHEN compile_ok THEN 0.1 ELSE 0.0 END), 1.0) END, 12) AS score,
       CASE WHEN NOT patch_applied THEN 1 ELSE 0 END AS n_errors, correct, fp
FROM sc"""

ORACLE["j4_submission_trees"] = f"""{_R_BASE}x AS (
  SELECT o.submission_id, sha256(o.content) AS own, b.sha FROM patched o LEFT JOIN after b USING (path))
SELECT submission_id, count(*) FILTER (WHERE own <> sha) AS modified, count(*) FILTER (WHERE sha IS NULL AND own IS NOT NULL) AS added,
       count(*) FILTER (WHERE sha IS NOT NULL AND own IS NULL) AS deleted FROM x GROUP BY submission_id"""

_A_MOVED = "regexp_replace(content, '\\b' || symbol || '\\s*\\(', v2_symbol || '(', 'g')"
ORACLE["c3_patched_api"] = f"""{MIGRATE},
after AS (SELECT * FROM ({RENAME}
          SELECT c.path, coalesce(f.content, c.content) AS content FROM code_files c LEFT JOIN final f USING (path))),
atasks AS (SELECT printf('api_upgrade_%02d', c.rank) AS task_id, r.symbol, r.v2_symbol FROM record r JOIN chosen c USING (symbol)),
{SUBS},
{_attempts('atasks')},
cs AS (SELECT t.task_id, t.symbol, t.v2_symbol, u.path, p.path IS NOT NULL AS needs
       FROM atasks t JOIN usages u USING (symbol) LEFT JOIN picked p ON p.symbol = u.symbol AND p.path = u.path),
{_patch_sql("SELECT task_id, path, symbol, v2_symbol FROM cs", _A_MOVED, _A_MOVED)}cf AS (
  SELECT a.submission_id, c.*, x.content IS NOT NULL AS present,
         len(regexp_extract_all(x.content, '\\b' || c.symbol || '\\s*\\(')) = 0
         AND len(regexp_extract_all(x.content, '\\b' || c.v2_symbol || '\\s*\\(')) > 0 AS found
  FROM attempts a JOIN cs c USING (task_id) LEFT JOIN patched o ON o.submission_id = a.submission_id AND o.path = c.path
  LEFT JOIN after b ON b.path = c.path, LATERAL (SELECT CASE WHEN o.path IS NOT NULL THEN o.content ELSE b.content END AS content) x),
chk AS (SELECT submission_id, task_id, count(*) AS total, count(*) FILTER (WHERE needs) AS expected,
               count(*) FILTER (WHERE present AND needs AND found) AS actual,
               count(*) FILTER (WHERE present AND NOT needs AND NOT found) AS preserved FROM cf GROUP BY ALL),
sc AS (SELECT a.submission_id, a.task_id, s.patch_applied, coalesce(total, 0) AS total, coalesce(expected, 0) AS expected,
              coalesce(actual, 0)::INTEGER AS actual, coalesce(preserved, 0)::INTEGER AS preserved
       FROM attempts a LEFT JOIN chk USING (submission_id, task_id) LEFT JOIN subs s USING (submission_id))
SELECT submission_id, task_id, 'api_upgrade' AS type,
       round(CASE WHEN NOT patch_applied THEN 0.0
                  ELSE least(actual / greatest(expected, 1) * 0.7 + preserved / greatest(total - expected, 1) * 0.3, 1.0) END, 12) AS score,
       CASE WHEN NOT patch_applied THEN 1 ELSE 0 END AS n_errors, actual, preserved
FROM sc"""


def _cited_texts(n_commits: int, cited: str) -> str:
    """``_texts`` with the derived citing answers after the assistant's turns."""
    return f"""{_texts(n_commits).replace('texts AS (', 'plain AS (', 1).replace("submission_id, coalesce(ft, '') || coalesce(ct, '') AS text", "submission_id, coalesce(ft, '') AS ft, coalesce(ct, '') AS ct")},
cited AS (SELECT submission_id, string_agg(t || chr(10), '' ORDER BY t) AS xt FROM ({cited}) GROUP BY submission_id),
texts AS (SELECT coalesce(p.submission_id, c.submission_id) AS submission_id, coalesce(ft, '') || coalesce(xt, '') || coalesce(ct, '') AS text
          FROM plain p FULL OUTER JOIN cited c USING (submission_id))"""


_CITE = "('0x' || substr(md5('42:cite:' || a.submission_id || ':' || a.task_id), 1, 12))::BIGINT % 3"
_C1_CITED = f"""SELECT a.submission_id, CASE {_CITE} WHEN 1 THEN 'The caller takes the path over ' || t.wrapper_file || '::' || t.symbol || 'Wrapper to '
           || t.original_file || '::' || t.symbol || ', a call flow of function and method; trace the implementation'
         ELSE 'see ' || t.original_file || '::' || t.symbol END AS t
  FROM attempts a JOIN ctasks t USING (task_id) WHERE {_CITE} > 0"""
_c1 = _c1_sql(more=", text <> '' AND ff AS file_found")
ORACLE["c1_cited_path"] = _c1.replace(f"{_texts(5)},\n{_attempts('ctasks')}", f"{_attempts('ctasks')},\n{_cited_texts(5, _C1_CITED)}")

ORACLE["f34_cited_keywords"] = "\nUNION ALL\n".join(f"""SELECT submission_id, '{kind}' AS kind, round(len(list_filter({_KW}, lambda k: contains(lower(text), k))) / 7.0, 9) AS ratio FROM (
{WRAP},
ctasks AS (SELECT printf('cross_file_reasoning_%02d', rank) AS task_id, symbol, original_file, wrapper_file FROM rec),
{SUBS},
{_attempts('ctasks')},
{_cited_texts(n, cited)}
SELECT * FROM texts)""" for kind, n, cited in (("reasoning", 5, _C1_CITED), ("bug", 3, "SELECT submission_id, '' AS t FROM subs WHERE false")))

_C4_CITED = f"""SELECT a.submission_id, CASE {_CITE} WHEN 1 THEN 'lines ' || t.s || ' to ' || t.e || ' of ' || t.file || ' hold a copied passage'
         ELSE 'near line ' || (t.e + 4) || ' of ' || regexp_extract(t.file, '([^/]*)$', 1) END AS t
  FROM attempts a JOIN btasks t USING (task_id) WHERE {_CITE} > 0"""
_B_FIXED = ("array_to_string(list_transform(string_split(content, chr(10)), lambda l, i: CASE WHEN i = s THEN 'if (x == null) return; ' || l ELSE l END), chr(10))")
_c4 = _c4_sql(more=", file_score::DOUBLE AS file, loc::DOUBLE AS location, CASE WHEN patch_applied AND fix_found THEN 1.0 ELSE 0.0 END::DOUBLE AS fix")
_c4 = _c4.replace(f"{_texts(3)},\n{_attempts('btasks')},\n", f"{_attempts('btasks')},\n{_cited_texts(3, _C4_CITED)},\n"
                  + _patch_sql("SELECT task_id, file AS path, s FROM btasks", _B_FIXED, "''"))
_c4 = _c4.replace("fx AS (SELECT t.task_id,", "fx AS (SELECT att.submission_id, t.task_id,").replace("FROM btasks t JOIN (SELECT path, string_split(content, chr(10)) AS ls,", """FROM attempts att JOIN btasks t USING (task_id) JOIN (SELECT submission_id, path, string_split(content, chr(10)) AS ls,""")
_c4 = _c4.replace("FROM after) a ON a.path = t.file),", """FROM (SELECT x.submission_id, x.path, CASE WHEN o.path IS NOT NULL THEN o.content ELSE b.content END AS content
                                 FROM (SELECT DISTINCT submission_id, file AS path FROM attempts JOIN btasks USING (task_id)) x
                                 LEFT JOIN patched o USING (submission_id, path) LEFT JOIN after b USING (path)))
                   a ON a.submission_id = att.submission_id AND a.path = t.file),""").replace("LEFT JOIN fx USING (task_id)", "LEFT JOIN fx USING (submission_id, task_id)")
ORACLE["c4_patched_bug"] = _c4.replace("0 AS n_errors, loc::DOUBLE AS loc, file_score", "0 AS n_errors, file_score")


_ALL_TASKS = f"""all_tasks AS (
  SELECT * FROM ({WRAP} SELECT printf('cross_file_reasoning_%02d', rank) AS task_id, 'cross_file_reasoning' AS type,
                 'medium' AS difficulty, 10 AS max_time_minutes, symbol AS start_symbol, NULL::VARCHAR AS symbol_to_rename,
                 NULL::VARCHAR AS new_name, NULL::VARCHAR AS old_api, NULL::VARCHAR AS new_api FROM rec)
  UNION ALL
  SELECT * FROM ({RENAME} SELECT printf('refactor_rename_%02d', rank), 'refactor_rename', 'hard', 15, NULL, old, new, NULL, NULL FROM rmap)
  UNION ALL
  SELECT * FROM ({MIGRATE} SELECT printf('api_upgrade_%02d', c.rank), 'api_upgrade', 'hard', 20, NULL, NULL, NULL,
                 r.symbol || '(x)', r.v2_symbol || '(x)' FROM record r JOIN chosen c USING (symbol))
  UNION ALL
  SELECT * FROM (WITH {V.PROSE_FILES},
      loc AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN prose_files d ON contains(d.content, b.text) WHERE length(b.text) > 0)
      SELECT printf('bug_localization_%02d', item_id), 'bug_localization', 'expert', 25, NULL, NULL, NULL, NULL, NULL FROM loc))"""

ORACLE["t8_tasks"] = f"WITH {_ALL_TASKS}\nSELECT * FROM all_tasks"
ORACLE["a10_task_summary"] = f"WITH {_ALL_TASKS}\nSELECT count(*) AS total_tasks, count(DISTINCT type) AS task_types FROM all_tasks"

# declarations of the code view stand on lines of their own (in C and C++ a returned call reads like one); a call is the
# first use with a bracket
def _line_of(text: str, pattern: str) -> str:
    return f"(list_position(list_transform(string_split({text}, chr(10)), lambda l: regexp_matches(l, {pattern})), true))"


_DECL = "'^(func|def|int|  return) ' || {0} || '\\('"
ORACLE["t8_truth_lines"] = f"""SELECT * FROM ({RENAME}
  SELECT printf('refactor_rename_%02d', r.rank) AS task_id, p.path AS file, {_line_of('c.content', _DECL.format('r.old'))}::INTEGER AS line, r.old AS symbol
  FROM rmap r JOIN (SELECT DISTINCT symbol, path FROM code_symbols) p ON p.symbol = r.old JOIN code_files c ON c.path = p.path)
UNION ALL
SELECT * FROM ({MIGRATE}
  SELECT printf('api_upgrade_%02d', c.rank) AS task_id, u.path AS file,
         CASE WHEN u.path IS NULL THEN 0 ELSE {_line_of('f.content', "'\\b' || c.symbol || '\\s*\\('")}::INTEGER END AS line, c.symbol
  FROM chosen c LEFT JOIN usages u USING (symbol) LEFT JOIN code_files f ON f.path = u.path)"""

ORACLE["j6_passage_lines"] = f"""{V.PROSE},
held AS (SELECT b.item_id, b.text, d.path, d.content, left(d.content, instr(d.content, b.text) - 1) AS ahead
       FROM benchmark b JOIN prose_files d ON contains(d.content, b.text) WHERE length(b.text) > 0),
rng AS (SELECT item_id, path, content, (length(ahead) - length(replace(ahead, chr(10), '')) + 1)::INTEGER AS s,
               (length(ahead) - length(replace(ahead, chr(10), '')) + 1 + length(text) - length(replace(text, chr(10), '')))::INTEGER AS e FROM held),
ls AS (SELECT item_id, path, s, e, unnest(string_split(content, chr(10))[s:e]) AS line FROM rng)
SELECT item_id, path, s AS first_line, e AS last_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars,
       bool_or(regexp_matches(lower(line), '{_FIX}')) AS fix FROM ls GROUP BY ALL"""

ORACLE["s9_answer_text"] = f"""SELECT submission_id, 'reasoning' AS kind, md5(text) AS text_md5 FROM (WITH {_texts(5)} SELECT * FROM texts)
UNION ALL
SELECT submission_id, 'bug' AS kind, md5(text) AS text_md5 FROM (WITH {_texts(3)} SELECT * FROM texts)"""


ORACLE["d10_file_rename"] = f"""{V.CODE},
r AS (SELECT path, rel_path, sha, row_number() OVER (ORDER BY md5('42:file_rename:' || path), path) AS rank FROM code_files)
SELECT regexp_replace(path, '([^/]*?)(\\.[^./]+)?$', '\\1_renamed\\2') AS path,
       regexp_replace(rel_path, '([^/]*?)(\\.[^./]+)?$', '\\1_renamed\\2') AS rel_path, sha
FROM r WHERE rank <= (SELECT greatest(1, floor(count(*) * 0.08::DOUBLE)) FROM code_files)"""



# The four scorers over attempts numbered across ALL tasks; C6 on top.
def _score_all_sql() -> str:
    extra = _ALL_TASKS + ",\n"
    parts = [f"SELECT submission_id, task_id, type, score, n_errors FROM ({fn(extra, 'all_tasks')})"
             for fn in (_c1_sql, _c2_sql, _c3_sql, _c4_sql)]
    return "\nUNION ALL\n".join(parts)


ORACLE["c5_score_all"] = _score_all_sql()

ORACLE["c6_report"] = f"""WITH scores AS ({_score_all_sql()}),
{SUBS},
s AS (SELECT sc.*, sb.elapsed_minutes,
             CASE sc.type WHEN 'cross_file_reasoning' THEN 10 WHEN 'refactor_rename' THEN 15
                          WHEN 'api_upgrade' THEN 20 WHEN 'bug_localization' THEN 25 END AS lim,
             coalesce(CASE regexp_replace(sc.task_id, '_?[^_]*$', '')
                        WHEN 'cross_file_reasoning' THEN 1.0 WHEN 'refactor_rename' THEN 1.2
                        WHEN 'api_upgrade' THEN 1.5 WHEN 'bug_localization' THEN 2.0 END, 1.0)::DOUBLE AS w
      FROM scores sc LEFT JOIN subs sb USING (submission_id)),
p AS (SELECT *, CASE WHEN lim IS NULL OR elapsed_minutes IS NULL THEN 1.0
                     WHEN (elapsed_minutes - lim) / lim <= 0 THEN 1.0 WHEN (elapsed_minutes - lim) / lim <= 0.25 THEN 0.9
                     WHEN (elapsed_minutes - lim) / lim <= 0.5 THEN 0.75 WHEN (elapsed_minutes - lim) / lim <= 1.0 THEN 0.5
                     ELSE 0.0 END AS pen FROM s),
a AS (SELECT submission_id, sum(score * w) AS ws, sum(w) AS wsum, sum(score * pen * w) AS wps,
             count(*) AS tasks_scored, sum(n_errors)::BIGINT AS errors FROM p GROUP BY submission_id),
o AS (SELECT *, CASE WHEN wsum > 0 THEN ws / wsum ELSE 0.0 END AS overall,
                CASE WHEN wsum > 0 THEN wps / wsum ELSE 0.0 END AS adjusted FROM a)
SELECT submission_id, round(overall, 9) AS overall_score, round(adjusted, 9) AS adjusted_score, tasks_scored, errors,
       errors = 0 AS success,
       CASE WHEN round(overall, 9) * 100.0 >= 90 THEN 'Expert' WHEN round(overall, 9) * 100.0 >= 75 THEN 'Proficient'
            WHEN round(overall, 9) * 100.0 >= 60 THEN 'Competent' WHEN round(overall, 9) * 100.0 >= 40 THEN 'Developing' ELSE 'Novice' END AS band
FROM o"""

# The documented formulas over the parts of the same scores.  The root
# cause of every task on a passage is 'copied passage'.
_DOCUMENTED = {
    _c1_sql: "CASE WHEN text <> '' THEN acc ELSE 0.0 END",
    _c2_sql: "CASE WHEN patch_applied THEN correct / greatest(checked, 1) * CASE WHEN NOT compile_ok THEN 0.5::DOUBLE "
             "WHEN fp > 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END ELSE 0.0 END",
    _c3_sql: "CASE WHEN patch_applied THEN actual / greatest(expected, 1) - greatest(total - expected - preserved, 0) * 0.1::DOUBLE "
             "- CASE WHEN compile_ok THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END ELSE 0.0 END",
    _c4_sql: "file_score * 0.4::DOUBLE + loc * 0.3::DOUBLE + CASE WHEN contains(lower(text), 'copied passage') THEN 1.0 "
             "WHEN contains(lower(text), 'copied') OR contains(lower(text), 'passage') THEN 0.5 ELSE 0.0 END * 0.3::DOUBLE",
}
ORACLE["d3_d6_document_rules"] = "\nUNION ALL\n".join(
    f"SELECT submission_id, task_id, type, score, document_score FROM "
    f"({fn(_ALL_TASKS + ',\n', 'all_tasks', f', round(least(greatest(({doc})::DOUBLE, 0.0), 1.0), 12)::DOUBLE AS document_score')})"
    for fn, doc in _DOCUMENTED.items())
