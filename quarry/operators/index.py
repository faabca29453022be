"""Symbol / import extraction and the inverted indexes (T1 core, A1, A2, U4, R5).

``symbols`` stays long-form (one row per extracted name); arrays are only
built on request, because a common name (``main``, ``__init__``) can be
defined in a large share of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import extract as X
from quarry.operators.joins import bounded_broadcast, join_small
from quarry.plans.registry import DEFAULT_EXTRACTORS, ExtractorRegistry
from quarry.session import bound_batches, cut_lineage


def checked_symbols_expr(registry: ExtractorRegistry | None = None,
                         content: str = "content", language: str = "language") -> Column:
    """F8 dispatch as one expression over (content, language), with the error
    of a failed analysis (P8).

    Native extractors form a CASE.  All Python-side extractors share ONE
    pandas UDF that is fed ``CASE WHEN language IN (python-side languages)
    THEN content END``: other rows cross Arrow as nulls, and the file is
    scanned once.
    """
    reg = registry or DEFAULT_EXTRACTORS
    lang, c = F.col(language), F.col(content)
    expr = None

    def when(cond, val):
        return F.when(cond, val) if expr is None else expr.when(cond, val)
    py_side = {name: ex.fn for name, ex in reg.by_language.items() if not ex.native}
    for name, ex in reg.by_language.items():
        if ex.native:
            expr = when(lang == name, F.struct(ex.fn(c).cast(X.SYMBOL_ARRAY).alias("symbols"), F.lit(None).cast("string").alias("error")))
    if py_side:
        langs = sorted(py_side)
        expr = when(lang.isin(langs), X.checked_udf(py_side)(F.when(lang.isin(langs), c), F.when(lang.isin(langs), lang)))
    empty = F.lit(None).cast(X.CHECKED)
    return empty if expr is None else expr.otherwise(empty)


def extract_symbols(files: DataFrame, registry: ExtractorRegistry | None = None) -> DataFrame:
    """symbols(repo, path, language, symbol, kind, ord) in extraction order; a
    file whose analysis fails gives none."""
    bound_batches(files.sparkSession)
    arr = checked_symbols_expr(registry)["symbols"]
    return _symbol_rows(files.select("repo", "path", "language", arr.alias("arr")))


def _symbol_rows(analysed: DataFrame) -> DataFrame:
    # an outer explode: before the other one Spark filters by the array's size and analyses every text once more for that
    return (analysed.select("repo", "path", "language", F.posexplode_outer("arr").alias("ord", "s")).filter("ord is not null")
            .select("repo", "path", "language", F.col("s.symbol").alias("symbol"),
                    F.col("s.kind").alias("kind"), F.col("ord").cast("int").alias("ord")))


def analyse(files: DataFrame, registry: ExtractorRegistry | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols, rejected) in one pass over the texts.  ``rejected(repo,
    path, language, stage, error)`` are the files that could not be read
    (``read_error``) or whose analysis failed; the others go on."""
    bound_batches(files.sparkSession)
    r = checked_symbols_expr(registry)
    seen = cut_lineage(files.select("repo", "path", "language", "read_error", r.alias("r"))
                       .select("repo", "path", "language", "read_error", F.col("r.symbols").alias("arr"), F.col("r.error").alias("error")))
    bad = seen.filter("read_error is not null or error is not null")
    rejected = bad.select("repo", "path", "language", F.when(F.col("read_error").isNotNull(), "read").otherwise("analyse").alias("stage"),
                          F.coalesce("read_error", "error").alias("error"))
    return _symbol_rows(seen.filter("read_error is null and error is null")), rejected


#: Languages whose declarations have lines.
PLACED_LANGUAGES = ("go", "python", "cpp", "c")


def declarations(files: DataFrame) -> DataFrame:
    """The position index (repo, path, language, symbol, kind, first_line,
    last_line): where each extracted name is declared."""
    bound_batches(files.sparkSession)
    known = files.filter(F.col("language").isin(*PLACED_LANGUAGES) & F.col("content").isNotNull())
    return (known.select("repo", "path", "language", F.explode_outer(X.declarations_udf("content", "language")).alias("d")).filter("d is not null")
            .select("repo", "path", "language", "d.symbol", "d.kind", "d.first_line", "d.last_line"))


def first_declarations(placed: DataFrame) -> DataFrame:
    """(symbol, path, line, last_line): the first declaration of each name in each file."""
    at = F.min(F.struct("first_line", "last_line")).alias("at")
    return placed.groupBy("symbol", "path").agg(at).select("symbol", "path", F.col("at.first_line").alias("line"), F.col("at.last_line").alias("last_line"))


def first_match_line(content, pattern) -> Column:
    """The line (from 1) of the first match of a pattern in a text, 0 without one."""
    c = F.col(content) if isinstance(content, str) else content
    place = F.regexp_instr(c, pattern)
    before = F.left(c, place - 1)
    return F.when(place > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("int")


def errors_by_repo(files: DataFrame, symbols: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per repo: files, files that could not be read, files whose analysis
    failed, and symbols of the others."""
    e = rejected.groupBy("repo").agg(F.count_if(F.col("stage") == "read").alias("read_errors"), F.count_if(F.col("stage") == "analyse").alias("analysis_errors"))
    s = symbols.groupBy("repo").agg(F.count(F.lit(1)).alias("n_symbols"))
    return (files.groupBy("repo").agg(F.count(F.lit(1)).alias("n_files")).join(e, "repo", "left").join(s, "repo", "left")
            .fillna(0, ["read_errors", "analysis_errors", "n_symbols"]))


def extract_imports(files: DataFrame) -> DataFrame:
    """imports(repo, path, language, module, ord)."""
    return (files.select("repo", "path", "language",
                         F.posexplode(X.imports_expr("content", "language")).alias("ord", "module"))
            .withColumn("ord", F.col("ord").cast("int")))


def symbol_postings(symbols: DataFrame) -> DataFrame:
    """U4: distinct (symbol, path).  Shuffled on both columns, so one hot
    symbol is spread over many partitions."""
    return symbols.select("symbol", "path").distinct()


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """n_files per symbol; partial (map-side) aggregation, skew-safe."""
    return symbol_postings(symbols).groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n_files"))


def symbol_index_long(symbols: DataFrame) -> DataFrame:
    """A1 long-form: (symbol, path, n_files)."""
    post = symbol_postings(symbols)
    return post.join(symbol_counts(symbols), "symbol")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """A1 in the reference's shape: symbol -> sorted array of files.

    Arrays are built after ``distinct`` so duplicates never travel; the final
    array of one symbol is one row by definition of this shape.  Prefer
    ``symbol_index_long`` for joins.
    """
    return (symbol_postings(symbols).groupBy("symbol")
            .agg(F.sort_array(F.collect_list("path")).alias("paths"))
            .withColumn("n_files", F.size("paths").cast("int")))


def corpus_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A2: number of files and number of distinct symbols, as (metric, value)."""
    n_files = files.agg(F.count(F.lit(1)).alias("value")).select(F.lit("files").alias("metric"), "value")
    n_syms = symbols.agg(F.countDistinct("symbol").alias("value")).select(F.lit("symbols").alias("metric"), "value")
    return n_files.unionByName(n_syms)


IDENT_ASCII = r"[A-Za-z_]\w*"
IDENT_UNICODE = r"(?U)[\p{L}_][\w]*"


def _uses(rows: DataFrame) -> DataFrame:
    """(identifier, path, n) of ``rows(path, words)`` with sorted words: the runs
    of equal ones."""
    w = F.col("words")
    starts = F.when(F.size(w) > 0, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.get(w, i).eqNullSafe(F.get(w, i - 1))))
    ends = F.concat(F.slice("starts", F.lit(2), F.greatest(F.size("starts") - 1, F.lit(0))), F.array(F.size(w)))
    runs = F.zip_with("starts", ends, lambda i, j: F.struct(F.get(w, i).alias("identifier"), (j - i).cast("long").alias("n")))
    found = rows.withColumn("starts", starts).select("path", F.explode_outer(runs).alias("u"))
    return found.filter("u is not null").select("u.identifier", "path", "u.n")


def reference_index(files: DataFrame, unicode: bool = False) -> DataFrame:
    """Identifier -> (path, n) for every use, not only definitions.

    A file's uses are counted within its row, so nothing is shuffled; only the
    uses of paths that several rows have are added up by (identifier, path)."""
    words = F.regexp_extract_all("content", F.lit(IDENT_UNICODE if unicode else IDENT_ASCII), 0)
    repeated = bounded_broadcast(files.groupBy("path").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
                                 .select(F.col("path").alias("repeated_path")))
    several = not repeated.isEmpty()
    again = F.col("path").eqNullSafe(F.col("repeated_path"))
    once = files.select("path", "content")
    if several:
        once = once.join(repeated, again, "left_anti")
    out = _uses(once.select("path", F.sort_array(words).alias("words")))
    if several:
        many = files.select("path", "content").join(repeated, again, "left_semi").select("path", F.explode(words).alias("identifier"))
        out = out.unionByName(many.groupBy("identifier", "path").agg(F.count(F.lit(1)).cast("long").alias("n")))
    return out


#: Uses of an old name that a renamed file may keep (fixed value of the rename check).
LEFT_OVER_MAX = 2


def rename_audit(rename_map: DataFrame, references: DataFrame) -> DataFrame:
    """Per (old, new) of ``rename_map``, from the reference index of the
    whole corpus: files that use either name, files_left (the old name more than
    ``LEFT_OVER_MAX`` times), files_done (not left and the new name is used) and
    coverage = done / files (1.0 where no file uses either).  Counts per
    (pair, file) are aggregated before they meet in a pair."""
    pairs = rename_map.select("old", "new").distinct()
    names = pairs.select("old", "new", F.explode(F.array("old", "new")).alias("identifier")).distinct()
    used = (join_small(references, names, "identifier")
            .groupBy("old", "new", "path").agg(
                F.sum(F.when(F.col("identifier") == F.col("old"), F.col("n")).otherwise(0)).alias("n_old"),
                F.sum(F.when(F.col("identifier") == F.col("new"), F.col("n")).otherwise(0)).alias("n_new")))
    left = F.col("n_old") > LEFT_OVER_MAX
    per = used.groupBy("old", "new").agg(F.count("path").alias("files"), F.count_if(left).alias("files_left"),
                                         F.count_if(~left & (F.col("n_new") >= 1)).alias("files_done"))
    out = pairs.join(per, ["old", "new"], "left").fillna(0, ["files", "files_left", "files_done"])
    return out.withColumn("coverage", F.when(F.col("files") > 0, F.round(F.col("files_done") / F.col("files"), 9)).otherwise(1.0))
