"""Corpus validation.

Only the Python syntax check runs code (``ast`` in a pandas UDF, on Python
rows only); counts and the primary-language rule are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import extract as X
from quarry.functions import text as TX


def lang_counts(files: DataFrame) -> DataFrame:
    """A5: per repo, files ending .go / .py / .cpp (headers not counted)."""
    name = TX.basename("path")
    return files.groupBy("repo").agg(
        F.count_if(name.endswith(".go")).alias("go"),
        F.count_if(name.endswith(".py")).alias("py"),
        F.count_if(name.endswith(".cpp")).alias("cpp"))


def primary_language(go, py, cpp) -> F.Column:
    """Go if go > max(py, cpp); python if py > max(go, cpp); cpp if any
    cpp; else none (a go/py tie with no cpp gives none)."""
    g, p, c = F.col(go), F.col(py), F.col(cpp)
    return (F.when(g > F.greatest(p, c), F.lit("go"))
            .when(p > F.greatest(g, c), F.lit("python"))
            .when(c > 0, F.lit("cpp"))
            .otherwise(F.lit(None).cast("string")))


def python_syntax(files: DataFrame) -> DataFrame:
    """F43 per Python file: (repo, path, ok, message)."""
    py = files.filter(F.col("language") == "python")
    r = py.select("repo", "path", X.py_syntax_udf("content", "path").alias("r"))
    return r.select("repo", "path", F.col("r.ok").alias("ok"), F.col("r.message").alias("message"))


def repo_syntax_report(files: DataFrame) -> DataFrame:
    """All Python files of a repo parse; error count and all messages by
    path, joined with '; '."""
    s = python_syntax(files)
    first = (s.filter(~F.col("ok"))
             .groupBy("repo").agg(F.array_join(F.sort_array(F.collect_list(F.struct("path", "message")))
                                               .getField("message"), "; ").alias("messages")))
    agg = s.groupBy("repo").agg(F.bool_and("ok").alias("python_ok"), F.count(F.lit(1)).alias("python_files"),
                                F.count_if(~F.col("ok")).alias("syntax_errors"))
    return agg.join(first, "repo", "left")


def validate_corpus(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Per repo counts (A5), primary language (A6) and Python syntax.
    The counts are of all files of a ``listing(repo, path)`` where one is given,
    scanned or not, and ``files`` are then the Python files read for it."""
    counts = lang_counts(files if listing is None else listing).withColumn("primary_language", primary_language("go", "py", "cpp"))
    return counts.join(repo_syntax_report(files), "repo", "left")


def python_listing(listing: DataFrame) -> DataFrame:
    """The files of a listing whose text T6 and C7 need."""
    return listing.filter(TX.basename("path").endswith(".py"))


def first_python(listing: DataFrame, first_n: int = 5) -> DataFrame:
    """The first ``first_n`` .py files of each repo by path, before any is read."""
    w = Window.partitionBy("repo").orderBy("path")
    return python_listing(listing).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first_n).drop("_r")


def check_compilation(files: DataFrame, first_n: int = 5) -> DataFrame:
    """C7 (Python part): the first ``first_n`` .py files of a repo (by path,
    W4) all parse.  ``row_number() <= n`` is planned as a group limit, so no
    task sorts a whole repository."""
    first = first_python(files.select("repo", "path", "content"), first_n)
    r = first.select("repo", X.py_syntax_udf("content", "path").alias("r"))
    return r.groupBy("repo").agg(F.bool_and("r.ok").alias("compile_ok"))
