"""Corpus views: turn tables into the canonical ``files`` table.

``files(repo, path, rel_path, ext, language, content, size_bytes, line_count,
sha, read_error)`` is what every operator reads.  Besides the file-system
scan (``sources.filesystem``) there are three views over the driver tables:

* ``prose_files(documents)``: SURVEY 7.1 view, content is the document text.
* ``code_files(documents)``: the same documents rendered as small Go, Python
  and C/C++ sources, one function per line that starts with a capitalised
  word; the function returns a call of the next capitalised word of the line,
  the line itself stays behind as a comment.  The rendering is plain
  ``split``/``transform``/``regexp_extract`` so every engine that speaks SQL
  can rebuild it; its size grows with ``documents``.
* ``page_files(pages)``: web pages keyed by URL path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX

# Fixed test-data mapping of SURVEY 7.1: document language -> file suffix.
LANG_EXT = {"en": "py", "fr": "go", "de": "cpp", "es": "c"}

FILES_COLUMNS = ["repo", "path", "rel_path", "ext", "language", "content",
                 "size_bytes", "line_count", "sha", "read_error"]


def finish_files(df: DataFrame) -> DataFrame:
    """Add derived columns (P4-P7) to (repo, path, rel_path, content)."""
    return (df
            .withColumn("ext", F.regexp_replace(TX.suffix("path"), r"^\.", ""))
            .withColumn("language", TX.detect_language("path"))
            .withColumn("size_bytes", TX.size_bytes("content"))
            .withColumn("line_count", TX.line_count("content"))
            .withColumn("sha", F.sha2(F.col("content"), 256))
            .withColumn("read_error", F.lit(None).cast("string"))
            .select(*FILES_COLUMNS))


def _ext_of_lang(lang: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANG_EXT.items() for x in kv])
    return F.coalesce(F.try_element_at(m, lang), F.lit("txt"))


def _doc_paths(docs: DataFrame) -> DataFrame:
    ext = _ext_of_lang(F.col("lang"))
    rel = F.concat_ws("/", F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit("."), ext))
    return (docs
            .withColumn("repo", F.col("source"))
            .withColumn("rel_path", rel)
            .withColumn("path", F.concat_ws("/", F.lit("src"), F.col("source"), rel)))


def prose_files(documents: DataFrame) -> DataFrame:
    """SURVEY 7.1 corpus view: content = document text."""
    d = _doc_paths(documents.select("doc_id", "source", "lang", "text"))
    return finish_files(d.select("repo", "path", "rel_path", F.col("text").alias("content")))


# ----------------------------------------------------------------- code view

NAME_RE = r"^([A-Z][a-z]+)"
CALLEE_RE = r"(?s)^[A-Z][a-z]+.*?[^A-Za-z]([A-Z][a-z]+)"


def _parse_line(line: Column) -> Column:
    """Per line, the two regexes run once: (l, name, callee)."""
    return F.struct(line.alias("l"), F.regexp_extract(line, NAME_RE, 1).alias("n"),
                    F.regexp_extract(line, CALLEE_RE, 1).alias("c"))


def _render_line(lang: str, p: Column) -> Column:
    line, name, callee = p["l"], p["n"], p["c"]
    call = F.when(callee != "", F.concat(callee, F.lit("(x)"))).otherwise(F.lit("x"))
    if lang == "go":
        fn = F.concat(F.lit("func "), name, F.lit("(x int) int {\n\treturn "), call,
                      F.lit(" // "), line, F.lit("\n}"))
        other = F.concat(F.lit("// "), line)
    elif lang == "python":
        fn = F.concat(F.lit("def "), name, F.lit("(x):\n    return "), call, F.lit("  # "), line)
        other = F.concat(F.lit("# "), line)
    else:
        fn = F.concat(F.lit("int "), name, F.lit("(int x) {\n  return "), call, F.lit("; // "),
                      line, F.lit("\n}"))
        other = F.concat(F.lit("// "), line)
    return F.when(name != "", fn).otherwise(other)


def _header(lang: str) -> Column:
    doc, src, lg = F.col("doc_id").cast("string"), F.col("source"), F.col("lang")
    if lang == "go":
        return F.concat(F.lit("// Code generated from document "), doc, F.lit(".\npackage "), src,
                        F.lit('\n\nimport "fmt"\n\n'))
    if lang == "python":
        return F.concat(F.lit("# Generated from document "), doc, F.lit(".\nimport os, sys\nfrom "),
                        src, F.lit(" import "), lg, F.lit("\n\n"))
    if lang == "cpp":
        return F.concat(F.lit("// Generated from document "), doc, F.lit('.\n#include "'), src,
                        F.lit("/"), lg, F.lit('.h"\n#include <vector>\n\n'))
    return F.concat(F.lit("/* Generated from document "), doc, F.lit(". */\n#include <stdio.h>\n\n"))


def _renderer(lang: str):
    return lambda line: _render_line(lang, line)


def code_content(lang_col: Column, text_col: Column) -> Column:
    lines = F.transform(TX.split_lines(text_col), _parse_line)
    branches = None
    for dl, ext in LANG_EXT.items():
        lang = {"py": "python", "go": "go", "cpp": "cpp", "c": "c"}[ext]
        body = F.array_join(F.transform(lines, _renderer(lang)), "\n")
        value = F.concat(_header(lang), body, F.lit("\n"))
        branches = F.when(lang_col == dl, value) if branches is None else branches.when(lang_col == dl, value)
    return branches.otherwise(text_col)


def code_files(documents: DataFrame) -> DataFrame:
    """Code-shaped corpus view over ``documents`` (see module doc)."""
    d = _doc_paths(documents.select("doc_id", "source", "lang", "text"))
    d = d.withColumn("content", code_content(F.col("lang"), F.col("text")))
    return finish_files(d.select("repo", "path", "rel_path", "content"))


# ----------------------------------------------------------------- tree view

#: Top folders of the tree view; some are excluded from scans, one is hidden.
TREE_FOLDERS = ["pkg", "pkg", "pkg", "lib", "lib", "vendor", "tests", ".cache", "docs", "core", "cmd", "generated"]
#: Texts a document may get instead: one that no parser can follow, one with invalid syntax.
TANGLED, BROKEN = 60_000, "def broken(:\n"


def tree_files(documents: DataFrame) -> DataFrame:
    """The code view as a whole tree: files in scanned, excluded and hidden
    folders, tests and notes, some unreadable, some that break their analysis.
    A hash of doc_id places each; ``files`` columns, not yet filtered."""
    h = F.md5(F.concat(F.lit("42:tree:"), F.col("doc_id").cast("string")))
    part = lambda start, n: F.pmod(F.conv(F.substring(h, start, 8), 16, 10).cast("long"), F.lit(n)).cast("int")
    d = (_doc_paths(documents.select("doc_id", "source", "lang", "text"))
         .withColumns({"folder": part(1, len(TREE_FOLDERS)), "name": part(9, 10), "fate": part(17, 16)}))
    ext = F.when(F.col("name") == 1, "md").otherwise(_ext_of_lang(F.col("lang")))
    stem = F.concat(F.col("doc_id").cast("string"), F.when(F.col("name") == 0, "_test").otherwise(""))
    rel = F.concat_ws("/", F.element_at(F.array(*map(F.lit, TREE_FOLDERS)), F.col("folder") + 1), F.col("lang"), F.concat(stem, F.lit("."), ext))
    code = code_content(F.col("lang"), F.col("text"))
    python = ext == "py"
    text = (F.when(python & (F.col("fate") == 1), F.concat(F.lit("x = "), F.repeat(F.lit("-"), TANGLED), F.lit("1\n")))
            .when(python & (F.col("fate") == 2), F.concat(code, F.lit(BROKEN))).otherwise(code))
    d = d.select("repo", F.concat_ws("/", F.lit("src"), F.col("source"), rel).alias("path"), rel.alias("rel_path"), "fate", text.alias("text"))
    lost = F.col("fate") == 0
    out = finish_files(d.withColumn("content", F.when(~lost, F.col("text"))).select("repo", "path", "rel_path", "content"))
    error = F.when(F.col("content").isNull(), "unreadable")
    return out.withColumn("read_error", error).withColumn("size_bytes", F.coalesce("size_bytes", F.lit(0).cast("long"))).select(*FILES_COLUMNS)


# ----------------------------------------------------------------- rich view

#: Declarations added at the end of some files of the rich view, by extension; {id} is the document's number.
RICH = {
    "go": ("type Box{id} struct {\n\tv int\n}\n\nfunc (b Box{id}) Get{id}() int {\n\treturn b.v + 60\n}\n", "type Shape{id} interface {\n}\n"),
    "py": ("class Shape{id}:\n    def grow(self):\n        return 60\n\n\nLIMIT = 1024\nlevel = \"INFO\"\nkind = 'error'\n",
           "def broken{id}(:\nclass Odd{id}(object):\n"),
    "cpp": ("class Box{id} {\npublic:\n  int v;\n};\nstruct Pair{id} {\n  int a;\n};\n", "// level \"INFO\" 60 1024\n"),
    "c": ("struct Pair{id} {\n  int a;\n};\n", "// level \"INFO\" 60 1024\n"),
}


def rich_files(documents: DataFrame) -> DataFrame:
    """The code view with types, methods, classes, assignments and invalid
    syntax: a hash of doc_id picks what stands at the end of a file."""
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("42:rich:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(4))
    d = _doc_paths(documents.select("doc_id", "source", "lang", "text")).withColumn("pick", pick)
    extra = F.lit("")
    for ext, texts in RICH.items():
        for n, text in enumerate(texts):
            extra = F.when((_ext_of_lang(F.col("lang")) == ext) & (F.col("pick") == n), F.replace(F.lit(text), F.lit("{id}"), F.col("doc_id").cast("string"))).otherwise(extra)
    d = d.withColumn("content", F.concat(code_content(F.col("lang"), F.col("text")), extra))
    return finish_files(d.select("repo", "path", "rel_path", "content"))


# ---------------------------------------------------------------- pages view

def page_files(pages: DataFrame) -> DataFrame:
    """Pages as files: repo = host, path = host + URL path, content = html."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    upath = F.regexp_extract("url", r"^[a-z]+://[^/?#]+(/[^?#]*)?", 1)
    path = F.concat(host, F.when(upath == "", F.lit("/")).otherwise(upath))
    df = pages.select(host.alias("repo"), path.alias("path"),
                      F.regexp_replace(upath, r"^/", "").alias("rel_path"),
                      F.col("html").alias("content"), "page_id")
    return finish_files(df)


def page_links(pages: DataFrame) -> DataFrame:
    """``href`` targets of each page, in page order (import role, F9-like)."""
    return (pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))
                         .alias("ord", "target")))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give per-row heavy work (regex over whole files, Python parsers) at
    least ``defaultParallelism`` tasks.  A scan of one large row group is one
    partition; a cluster-sized scan already has many and is left alone, so
    the extra round-robin shuffle only happens on small inputs."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def load_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_spread(spark, sf_dir: str, name: str) -> DataFrame:
    return spread(load_table(spark, sf_dir, name))
