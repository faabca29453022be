"""SQL text of the corpus views, for independent checks in a SQL engine.

The registered queries compare Spark results with plain SQL run by DuckDB on
the same parquet tables.  These CTE fragments rebuild the corpus views of
``quarry.sources.corpus`` in that dialect (``list_transform``, RE2 regexes).
"""

NL = "chr(10)"

_NAME = "regexp_extract(l, '^([A-Z][a-z]+)', 1)"
_CALLEE = "regexp_extract(l, '(?s)^[A-Z][a-z]+.*?[^A-Za-z]([A-Z][a-z]+)', 1)"
_CALL = f"(CASE WHEN {_CALLEE} <> '' THEN {_CALLEE} || '(x)' ELSE 'x' END)"

_GO = (f"CASE WHEN {_NAME} <> '' THEN 'func ' || {_NAME} || '(x int) int {{' || {NL} || chr(9) || 'return ' || {_CALL}"
       f" || ' // ' || l || {NL} || '}}' ELSE '// ' || l END")
_PY = (f"CASE WHEN {_NAME} <> '' THEN 'def ' || {_NAME} || '(x):' || {NL} || '    return ' || {_CALL}"
       f" || '  # ' || l ELSE '# ' || l END")
_CPP = (f"CASE WHEN {_NAME} <> '' THEN 'int ' || {_NAME} || '(int x) {{' || {NL} || '  return ' || {_CALL}"
        f" || '; // ' || l || {NL} || '}}' ELSE '// ' || l END")


def _body(render: str) -> str:
    return f"array_to_string(list_transform(string_split(text, {NL}), lambda l: {render}), {NL})"


_HEADER_GO = f"'// Code generated from document ' || doc_id || '.' || {NL} || 'package ' || source || {NL} || {NL} || 'import \"fmt\"' || {NL} || {NL}"
_HEADER_PY = f"'# Generated from document ' || doc_id || '.' || {NL} || 'import os, sys' || {NL} || 'from ' || source || ' import ' || lang || {NL} || {NL}"
_HEADER_CPP = f"'// Generated from document ' || doc_id || '.' || {NL} || '#include \"' || source || '/' || lang || '.h\"' || {NL} || '#include <vector>' || {NL} || {NL}"
_HEADER_C = f"'/* Generated from document ' || doc_id || '. */' || {NL} || '#include <stdio.h>' || {NL} || {NL}"

_EXT = "CASE lang WHEN 'en' THEN 'py' WHEN 'fr' THEN 'go' WHEN 'de' THEN 'cpp' WHEN 'es' THEN 'c' ELSE 'txt' END"
_LANGUAGE = "CASE ext WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'cpp' THEN 'cpp' WHEN 'c' THEN 'c' ELSE 'unknown' END"

BREAK_RE = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]"


def line_count_sql(c: str) -> str:
    return (f"(len(regexp_extract_all({c}, '{BREAK_RE}')) + CASE WHEN {c} <> '' AND NOT regexp_matches({c}, "
            f"'({BREAK_RE})$') THEN 1 ELSE 0 END)")


DOC_PATHS = f"""doc_paths AS (
  SELECT doc_id, source, lang, text, ext,
         source AS repo, lang || '/' || doc_id || '.' || ext AS rel_path,
         'src/' || source || '/' || lang || '/' || doc_id || '.' || ext AS path,
         {_LANGUAGE} AS language
  FROM (SELECT *, {_EXT} AS ext FROM documents))"""

CODE_FILES = f"""{DOC_PATHS},
code_raw AS (
  SELECT repo, path, rel_path, ext, language,
    CASE lang
      WHEN 'fr' THEN {_HEADER_GO} || {_body(_GO)} || {NL}
      WHEN 'en' THEN {_HEADER_PY} || {_body(_PY)} || {NL}
      WHEN 'de' THEN {_HEADER_CPP} || {_body(_CPP)} || {NL}
      WHEN 'es' THEN {_HEADER_C} || {_body(_CPP)} || {NL}
      ELSE text END AS content
  FROM doc_paths),
code_files AS (
  SELECT repo, path, rel_path, ext, language, content,
         strlen(content)::BIGINT AS size_bytes, {line_count_sql('content')}::INTEGER AS line_count,
         sha256(content) AS sha
  FROM code_raw)"""

PROSE_FILES = f"""{DOC_PATHS},
prose_files AS (
  SELECT repo, path, rel_path, ext, language, text AS content,
         strlen(text)::BIGINT AS size_bytes, {line_count_sql('text')}::INTEGER AS line_count,
         sha256(text) AS sha
  FROM doc_paths)"""

# symbols of the code view: Go regexes, Python defs (AST = defs of the
# generated code; the regex fallback when a def name is a keyword), C/C++
# function pattern with Python's Unicode \w, names alnum and longer than 1.
_W = "[\\p{L}\\p{N}_]"
_CPP_FUNC = f"(?m)(?:^|\\n)\\s*(?:[{_W[1:-1]}:]+\\s+)*({_W}+)\\s*\\([^)]*\\)\\s*[{{;]"
CODE_SYMBOL_LISTS = f"""code_symbol_lists AS (
  SELECT repo, path, language,
    CASE
      WHEN language = 'go' THEN
        list_transform(regexp_extract_all(content, 'func\\s+(\\w+)\\s*\\(', 1), lambda s: {{'symbol': s, 'kind': 'function'}})
        || list_transform(regexp_extract_all(content, 'type\\s+(\\w+)\\s+(?:struct|interface)', 1), lambda s: {{'symbol': s, 'kind': 'type'}})
        || list_transform(regexp_extract_all(content, 'func\\s+\\([^)]+\\)\\s+(\\w+)\\s*\\(', 1), lambda s: {{'symbol': s, 'kind': 'method'}})
      WHEN language = 'python' AND regexp_matches(content, '(?m)^def (True|False|None)\\(') THEN
        list_transform(regexp_extract_all(content, 'def\\s+(\\w+)\\s*\\(', 1), lambda s: {{'symbol': s, 'kind': 'function'}})
        || list_transform(regexp_extract_all(content, 'class\\s+(\\w+)\\s*[:(]', 1), lambda s: {{'symbol': s, 'kind': 'class'}})
      WHEN language = 'python' THEN
        list_transform(regexp_extract_all(content, '(?m)^def (\\w+)\\(', 1), lambda s: {{'symbol': s, 'kind': 'function'}})
      WHEN language IN ('cpp', 'c') THEN
        list_filter(
          list_transform(regexp_extract_all(content, '{_CPP_FUNC}', 1), lambda s: {{'symbol': s, 'kind': 'function'}})
          || list_transform(regexp_extract_all(content, 'class\\s+({_W}+)(?:\\s*:|[^;]*{{)', 1), lambda s: {{'symbol': s, 'kind': 'class'}})
          || list_transform(regexp_extract_all(content, 'struct\\s+({_W}+)(?:\\s*:|[^;]*{{)', 1), lambda s: {{'symbol': s, 'kind': 'struct'}}),
          lambda x: length(x.symbol) > 1 AND regexp_full_match(x.symbol, '[\\p{{L}}\\p{{N}}]+'))
      ELSE []
    END AS syms
  FROM code_files),
code_symbols AS (
  SELECT repo, path, language, s.symbol AS symbol, s.kind AS kind, (ord - 1)::INTEGER AS ord
  FROM (SELECT repo, path, language, unnest(syms) AS s, unnest(generate_series(1, len(syms))) AS ord
        FROM code_symbol_lists))"""

CODE = f"WITH {CODE_FILES},\n{CODE_SYMBOL_LISTS}"
PROSE = f"WITH {PROSE_FILES}"

CODE_REC = f"WITH RECURSIVE {CODE_FILES},\n{CODE_SYMBOL_LISTS}"


# The tree view: the code view placed by a hash of doc_id, all files of it.
def _part(start: int, n: int) -> str:
    return f"(('0x' || substr(md5('42:tree:' || doc_id), {start}, 8))::BIGINT % {n})"


def _tree_sql() -> str:
    from quarry.sources.corpus import BROKEN, TANGLED, TREE_FOLDERS
    folders = "[" + ", ".join(f"'{f}'" for f in TREE_FOLDERS) + "]"
    code = CODE_FILES[CODE_FILES.index("CASE lang\n"):CODE_FILES.index("ELSE text END AS content")] + "ELSE text END"
    broken = "'" + BROKEN.replace("\n", "' || chr(10)")
    return f"""WITH tree0 AS (
  SELECT doc_id, source AS repo, source, lang, text, {_part(17, 16)} AS fate,
         CASE WHEN {_part(9, 10)} = 1 THEN 'md' ELSE {_EXT} END AS ext,
         {folders}[{_part(1, len(TREE_FOLDERS))} + 1] || '/' || lang || '/' || doc_id || CASE WHEN {_part(9, 10)} = 0 THEN '_test' ELSE '' END AS stem
  FROM documents),
tree AS (
  SELECT repo, 'src/' || source || '/' || stem || '.' || ext AS path, stem || '.' || ext AS rel_path, {_LANGUAGE} AS language, fate,
         split_part(stem, '/', 1) AS top_dir,
         CASE WHEN fate = 0 THEN NULL
              WHEN ext = 'py' AND fate = 1 THEN 'x = ' || repeat('-', {TANGLED}) || '1' || chr(10)
              WHEN ext = 'py' AND fate = 2 THEN ({code}) || {broken} ELSE ({code}) END AS content
  FROM tree0),
tree_scanned AS (
  SELECT * FROM tree WHERE regexp_matches(path, '\\.(go|py|cpp|h|hpp|c|java|js|ts)$')
    AND NOT regexp_matches(regexp_extract(path, '^(.*)/[^/]*$', 1), 'vendor/|node_modules/|third_party/|\\.git/|test/|tests/|_test\\.|\\.test\\.|generated/')
    AND NOT regexp_matches(regexp_extract(path, '([^/]*)$', 1), 'vendor/|node_modules/|third_party/|\\.git/|test/|tests/|_test\\.|\\.test\\.|generated/'))"""


TREE = _tree_sql()
#: A Python file of the tree that does not parse.
TREE_BAD = "(fate IN (1, 2) OR regexp_matches(content, '(?m)^def (True|False|None)\\('))"
TREE_SYMBOLS = (CODE_SYMBOL_LISTS[:CODE_SYMBOL_LISTS.index("),\ncode_symbols AS")].replace("code_symbol_lists AS", "tree_symbol_lists AS")
                .replace("FROM code_files", "FROM tree_scanned WHERE fate <> 0 AND NOT (language = 'python' AND fate = 1)")
                .replace("regexp_matches(content, '(?m)^def (True|False|None)\\(')", TREE_BAD) + ")")


# The rich view: declarations at the end of some files.
def _rich_sql() -> str:
    from quarry.sources.corpus import RICH

    def text(t: str) -> str:
        quoted = "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
        return f"replace({quoted}, '{{id}}', doc_id::VARCHAR)"
    cases = " ".join(f"WHEN ext = '{ext}' AND pick = {n} THEN {text(t)}" for ext, texts in RICH.items() for n, t in enumerate(texts))
    return f"""{CODE_FILES},
rich AS (
  SELECT repo, path, language, content || CASE {cases} ELSE '' END AS content
  FROM (SELECT c.*, d.doc_id, ('0x' || substr(md5('42:rich:' || d.doc_id), 1, 8))::BIGINT % 4 AS pick FROM code_files c JOIN doc_paths d USING (path)))"""


RICH_FILES = _rich_sql()
_VALID = "list_transform(regexp_extract_all(content, '(?m)^def (\\w+)\\(', 1), lambda s: {'symbol': s, 'kind': 'function'})"
RICH_SYMBOLS = (CODE_SYMBOL_LISTS.replace("FROM code_files)", "FROM rich)")
                .replace("regexp_matches(content, '(?m)^def (True|False|None)\\(')", "regexp_matches(content, '(?m)^def (True|False|None)\\(|^def broken[0-9]+\\(:')")
                .replace(_VALID, _VALID.replace("^def", "^ *def") + """
        || list_transform(regexp_extract_all(content, '(?m)^class (\\w+)', 1), lambda s: {'symbol': s, 'kind': 'class'})
        || list_transform(regexp_extract_all(content, '(?m)^(LIMIT|level|kind) = ', 1), lambda s: {'symbol': s, 'kind': 'variable'})"""))
