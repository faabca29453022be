"""Corpus rewrites as table jobs.

Each job returns a ``Result`` of DataFrames: the new version of ``files``
(the input is never changed in place, S14), the record table the reference
writes as JSON, and the rows that were touched.  Sampling is stateless
(``sampling.hash_key``), so re-running a job or a lost task gives the same
choice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import rewrite as RW
from quarry.functions import text as TX
from quarry.functions.diff import line_changes_udf
from quarry.operators import index as IX
from quarry.operators import sampling as S
from quarry.operators.joins import fits_broadcast, join_small
from quarry.session import cut_lineage
from quarry.sources.corpus import FILES_COLUMNS


@dataclass
class Result:
    files: DataFrame          # new version of the corpus
    record: DataFrame         # what was done (artifact table)
    touched: DataFrame        # rewritten / generated rows
    details: DataFrame | None = None


def refresh_derived(df: DataFrame) -> DataFrame:
    """Recompute P5-P7 columns after ``content`` changed."""
    return (df.withColumn("size_bytes", TX.size_bytes("content"))
              .withColumn("line_count", TX.line_count("content"))
              .withColumn("sha", F.sha2(F.col("content"), 256))
              .select(*FILES_COLUMNS))


def replace_rows(files: DataFrame, new_rows: DataFrame) -> DataFrame:
    """New rows win on a path clash (anti join, then union); the new
    paths are broadcast after a size check, so the corpus is not shuffled."""
    keep = join_small(files, new_rows.select("path"), "path", "left_anti")
    return keep.select(*FILES_COLUMNS).unionByName(new_rows.select(*FILES_COLUMNS))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A sample-derived table that is materialised already (rename map, renamed
    files): broadcast when its bytes are under the bound, else a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df) else df


# ----------------------------------------------------------------------- T2

def rename_symbols(files: DataFrame, symbols: DataFrame, p: float = 0.05, seed: int = 42,
                   mode: str = "word", boundary: str = "unicode") -> Result:
    """Rename ``max(1, int(n*p))`` sampled symbols in the files that define
    them (X15).  ``mode='word'``: sequential whole-word renames in sample order,
    native; ``mode='parity'``: the reference's per-language head rewrites."""
    keys = symbols.select("symbol").distinct()
    sample, _ = S.sample_fraction(keys, "symbol", p, seed, op="rename")
    # the sample is read by the pair join and by the record: materialise the
    # k rows once instead of re-running distinct + top-k over all keys
    rmap = cut_lineage(sample.select(F.col("symbol").alias("old"), RW.new_name("symbol", seed).alias("new"), "rank"))
    post = IX.symbol_postings(symbols)
    pairs = (post.join(_maybe_broadcast(rmap), post["symbol"] == rmap["old"])
             .select("path", "old", "new", "rank"))
    per_file = pairs.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("rank", "old", "new"))).alias("pairs"))
    touched = join_small(files, per_file, "path")
    if mode == "word":
        new_content = RW.apply_word_renames("content", "pairs", boundary)
    elif mode == "parity":
        new_content = RW.apply_parity_renames("content", "language", "pairs")
    else:
        raise ValueError(mode)
    touched = touched.withColumn("new_content", new_content)
    rewritten = refresh_derived(touched.withColumn("content", F.col("new_content")))
    details = pairs
    return Result(files=replace_rows(files, rewritten), record=rmap, touched=touched, details=details)


def rename_stats(result: Result) -> DataFrame:
    """A3/A18 as (metric, value) rows: renames; (symbol, file) pairs counted
    as the reference counts them (X10); distinct files rewritten; files whose
    text really changed."""
    pairs, t = result.details, result.touched

    def metric(name, df, expr):
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    return (metric("renames", result.record, F.count(F.lit(1)))
            .unionByName(metric("files_changed", pairs, F.count(F.lit(1))))
            .unionByName(metric("files_rewritten", t, F.count(F.lit(1))))
            .unionByName(metric("files_modified", t, F.count_if(F.col("new_content") != F.col("content")))))


# ----------------------------------------------------------------------- T3

def api_candidates(keys: DataFrame) -> DataFrame:
    """Length > 3 and an upper-case first letter."""
    return keys.filter((F.length("symbol") > 3) & F.col("symbol").rlike(r"^\p{Lu}"))


def migrate_api(files: DataFrame, symbols: DataFrame, n: int = 10, fraction: float = 0.6,
                seed: int = 42) -> Result:
    """T3, re-aimed as a staged rollout: for ``min(n, candidates)`` sampled
    symbols, the first defining file (by path, W1) gets a V2 copy of the
    function and ``int(fraction * usages)`` of the other defining files (W2)
    switch to the V2 name."""
    keys = symbols.select("symbol").distinct()
    chosen = cut_lineage(S.sample_n(api_candidates(keys), "symbol", n, seed, op="api"))   # <= n rows, read 5 times
    post = IX.symbol_postings(symbols)
    definers = post.join(F.broadcast(chosen), "symbol")            # chosen: <= n rows
    first = definers.groupBy("symbol").agg(F.min("path").alias("definition_file"))
    usages = definers.join(F.broadcast(first), "symbol").filter(F.col("path") != F.col("definition_file"))
    picked = S.sample_per_group(usages.select("symbol", "path"), "symbol", "path", p=fraction,
                                seed=seed, op="migrate")
    totals = usages.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("total_callsites"))
    migrated = picked.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("migrated_callsites"))
    record = (chosen.join(first, "symbol")
              .join(totals, "symbol", "left").join(migrated, "symbol", "left")
              .select("symbol", RW.v2_name("symbol").alias("v2_symbol"), "definition_file",
                      F.coalesce("total_callsites", F.lit(0)).alias("total_callsites"),
                      F.coalesce("migrated_callsites", F.lit(0)).alias("migrated_callsites"),
                      "rank"))
    actions = (first.join(F.broadcast(chosen), "symbol")
               .select(F.col("definition_file").alias("path"), "symbol", "rank", F.lit(0).alias("step"),
                       F.lit("define").alias("action"))
               .unionByName(picked.join(F.broadcast(chosen.select("symbol")), "symbol")
                            .select("path", "symbol", "rank", F.lit(1).alias("step"), F.lit("migrate").alias("action"))))
    per_file = actions.groupBy("path").agg(F.sort_array(F.collect_list(
        F.struct("rank", "step", "action", F.col("symbol").alias("old"), RW.v2_name("symbol").alias("new"))))
        .alias("actions"))
    touched = join_small(files, per_file, "path").withColumn(
        "new_content", RW.apply_migrations("content", "language", "actions"))
    rewritten = refresh_derived(touched.withColumn("content", F.col("new_content")))
    return Result(files=replace_rows(files, rewritten), record=record, touched=touched,
                  details=actions.select("symbol", "path", "action"))


def migrated_files_record(result: Result) -> DataFrame:
    """The reference's ``migrated_files`` list per symbol (artifact shape).
    Only for writing a bounded record; jobs use the long ``details`` table."""
    mig = result.details.filter(F.col("action") == "migrate")
    return mig.groupBy("symbol").agg(F.sort_array(F.collect_list("path")).alias("migrated_files"))


# ----------------------------------------------------------------------- T4

# Our own wrapper templates (F25); {symbol}, {symbol_lower} and {module} are
# substituted per row.
WRAPPER_TEMPLATES = {
    "go": (
        "// Code generated as an indirection layer for {symbol}.\n"
        "package main\n\n"
        "import \"log\"\n\n"
        "// {symbol}Wrapper forwards to {symbol} from {module} and logs the call.\n"
        "func {symbol}Wrapper(args ...interface{{}}) interface{{}} {\n"
        "\tlog.Printf(\"enter {symbol}\")\n"
        "\tdefer log.Printf(\"leave {symbol}\")\n"
        "\treturn {symbol}(args...)\n"
        "}\n"
    ).replace("{{}}", "{}"),
    "python": (
        "\"\"\"Indirection layer for {symbol} (from {module}).\"\"\"\n\n"
        "import functools\n"
        "import logging\n\n"
        "log = logging.getLogger(__name__)\n\n\n"
        "class {symbol}Wrapper:\n"
        "    \"\"\"Calls the wrapped {symbol} and logs around it.\"\"\"\n\n"
        "    def __init__(self, target):\n"
        "        self.target = target\n"
        "        functools.update_wrapper(self, target)\n\n"
        "    def __call__(self, *args, **kwargs):\n"
        "        log.debug(\"enter {symbol}\")\n"
        "        try:\n"
        "            return self.target(*args, **kwargs)\n"
        "        finally:\n"
        "            log.debug(\"leave {symbol}\")\n\n\n"
        "def wrap_{symbol_lower}(target):\n"
        "    return {symbol}Wrapper(target)\n"
    ),
}


def add_wrappers(files: DataFrame, symbols: DataFrame, n: int = 8, seed: int = 42) -> Result:
    """T4: for ``min(n, symbols)`` sampled symbols whose first defining file is
    Go or Python (P13), generate ``<stem>_wrapper<suffix>`` next to it."""
    spark = files.sparkSession
    keys = symbols.select("symbol").distinct()
    chosen = cut_lineage(S.sample_n(keys, "symbol", n, seed, op="wrap"))                 # <= n rows
    post = IX.symbol_postings(symbols)
    first = (post.join(F.broadcast(chosen), "symbol").groupBy("symbol", "rank")
             .agg(F.min("path").alias("original_file")))
    lang = files.select(F.col("path").alias("original_file"), "language", "repo")
    cand = lang.join(F.broadcast(first), "original_file").filter(F.col("language").isin("go", "python"))  # <= n rows
    record = cand.select("symbol", "original_file", RW.wrapper_path("original_file").alias("wrapper_file"),
                         "language", "repo", "rank")
    record = record.withColumn("call_chain", RW.call_chain("wrapper_file", "original_file"))
    tpl = spark.createDataFrame(list(WRAPPER_TEMPLATES.items()), "language string, template string")
    gen = record.join(F.broadcast(tpl), "language")
    content = F.col("template")
    for key, val in (("{symbol}", F.col("symbol")), ("{symbol_lower}", F.lower("symbol")),
                     ("{module}", TX.stem("original_file"))):
        content = F.replace(content, F.lit(key), val)
    # Two symbols wrapped from one file share the wrapper path; the
    # later one in sample order wins, as the later write does.
    from pyspark.sql import Window
    w = Window.partitionBy("wrapper_file").orderBy(F.col("rank").desc())
    gen = gen.withColumn("_w", F.row_number().over(w)).filter("_w = 1")
    rows = (files.select(F.col("path").alias("original_file"), "rel_path").join(F.broadcast(gen), "original_file")
            .select("repo", F.col("wrapper_file").alias("path"),
                    F.expr("substring(wrapper_file, length(original_file) - length(rel_path) + 1)").alias("rel_path"),
                    content.alias("content")))
    rows = rows.withColumn("ext", F.regexp_replace(TX.suffix("path"), r"^\.", "")) \
               .withColumn("language", TX.detect_language("path")) \
               .withColumn("read_error", F.lit(None).cast("string"))
    rows = refresh_derived(rows)
    return Result(files=replace_rows(files, rows),
                  record=record.select("symbol", "original_file", "wrapper_file", "call_chain", "rank"),
                  touched=rows)


# ----------------------------------------------------------------------- T5

def top_dirs(files: DataFrame) -> DataFrame:
    """Files with their repository root and top-level directory (files
    directly in the root have none)."""
    root = F.expr("left(path, length(path) - length(rel_path) - 1)")
    return (files.filter(F.col("rel_path").contains("/"))
            .withColumn("repo_root", root)
            .withColumn("top_dir", F.substring_index("rel_path", "/", 1)))


def duplicate_with_drift(files: DataFrame, repos: DataFrame | None = None, k: int = 2,
                         max_files: int = 100, seed: int = 42, listing: DataFrame | None = None) -> Result:
    """T5, re-aimed as labelled near-copy generation: per repository pick
    ``min(k, n)`` top-level directories with fewer than ``max_files`` files
    (P10, K4), copy them to ``<dir>_legacy`` and drift the copies (F27-F29).
    The sizes are those of a ``listing(repo, path, rel_path)`` of all files,
    scanned or not, where one is given."""
    td = top_dirs(files)
    listed = td if listing is None else top_dirs(listing)
    if repos is not None:                                           # J15
        listed = listed.join(repos.select(F.col("name").alias("repo")).distinct(), "repo", "left_semi")
    counts = listed.groupBy("repo", "repo_root", "top_dir").agg(F.count(F.lit(1)).alias("n_files"))   # A7
    small = counts.filter((F.col("n_files") < max_files) & ~F.col("top_dir").startswith("."))      # P10
    chosen = S.sample_per_group(small, "repo", "top_dir", n=k, seed=seed, op="dup")                # K4
    chosen = chosen.select("repo", "repo_root", "top_dir", "rank")
    copies = join_small(td, chosen, ["repo", "repo_root", "top_dir"])      # <= k per repository
    new_top = F.concat(F.col("top_dir"), F.lit(RW.LEGACY_DIR_SUFFIX))
    rest = F.expr("substring(rel_path, length(top_dir) + 2)")
    new_rel = F.concat(new_top, F.lit("/"), rest)
    drifted = F.when(RW.is_rewritable("path"), RW.drift("content")).otherwise(F.col("content"))
    copies = (copies.withColumn("original_path", F.col("path"))
              .withColumn("new_content", drifted)
              .withColumn("modified", RW.is_rewritable("path") & (F.col("new_content") != F.col("content"))))
    rows = (copies.select("repo", F.concat_ws("/", "repo_root", new_rel).alias("path"), new_rel.alias("rel_path"),
                          "ext", "language", F.col("new_content").alias("content"), "read_error",
                          "original_path", F.col("content").alias("old_content"), "modified",
                          "top_dir", "repo_root"))
    record = chosen.select(F.concat_ws("/", "repo_root", "top_dir").alias("original_path"),
                           F.concat_ws("/", "repo_root", new_top).alias("duplicate_path"), "repo", "rank")
    # an earlier copy of a chosen directory goes first, with files the new copy doesn't have
    target = chosen.select("repo", "repo_root", F.concat("top_dir", F.lit(RW.LEGACY_DIR_SUFFIX)).alias("top_dir"))
    earlier = join_small(top_dirs(files), target, ["repo", "repo_root", "top_dir"]).select("path")
    kept = join_small(files, earlier, "path", "left_anti")
    return Result(files=replace_rows(kept, refresh_derived(rows)), record=record,
                  touched=rows)


def drift_audit(result: Result) -> DataFrame:
    """R2: per copied file, lines of the copy that are not in the original
    (multiset difference) and their share.  Lines are exploded and counted
    per (path, line) with map-side combine; no pairwise comparison."""
    t = result.touched
    a = t.select("path", F.explode(TX.split_lines("content")).alias("line"), F.lit(1).alias("d"))
    b = t.select("path", F.explode(TX.split_lines("old_content")).alias("line"), F.lit(-1).alias("d"))
    per_line = (a.unionByName(b).groupBy("path", "line")
                .agg(F.sum("d").alias("net")))
    changed = per_line.groupBy("path").agg(F.sum(F.greatest(F.col("net"), F.lit(0))).cast("long").alias("changed_lines"))
    n = t.select("path", "original_path", F.size(TX.split_lines("content")).cast("long").alias("n_lines"))
    return (n.join(changed, "path")
            .withColumn("changed_share", F.round(F.col("changed_lines") / F.greatest("n_lines", F.lit(1)), 9)))


def aligned_audit(result: Result) -> DataFrame:
    """R2 with the lines in their order: per copied file the lines that stay in
    line with the original, and those moved, added and removed.  Both texts
    stand in one row, so nothing is shuffled."""
    t = result.touched.select("path", "original_path", line_changes_udf("old_content", "content").alias("d"))
    return t.select("path", "original_path", "d.*")


def duplication_record(result: Result) -> DataFrame:
    """duplication_map with the reference's ``modified_files`` list (the list
    of one directory is bounded by ``max_files``)."""
    mod = (result.touched.filter("modified")
           .select(F.concat_ws("/", "repo_root", F.concat("top_dir", F.lit(RW.LEGACY_DIR_SUFFIX))).alias("duplicate_path"),
                   "path"))
    lists = mod.groupBy("duplicate_path").agg(F.sort_array(F.collect_list("path")).alias("modified_files"))
    return (result.record.join(lists, "duplicate_path", "left")
            .withColumn("modified_files", F.coalesce("modified_files", F.array().cast("array<string>"))))


# ---------------------------------------------------------------------- D10

def rename_files(files: DataFrame, p: float = 0.08, seed: int = 42) -> Result:
    """``max(1, int(n*p))`` sampled files get ``<stem>_renamed<suffix>``
    in the same directory; record (old_path, new_path)."""
    sample, _ = S.sample_fraction(files.select("path"), "path", p, seed, op="file_rename")
    d = TX.dirname("path")
    name = F.concat(TX.stem("path"), F.lit("_renamed"), TX.suffix("path"))
    new_path = F.when(d == "", name).otherwise(F.concat(d, F.lit("/"), name))
    record = cut_lineage(sample.select(F.col("path").alias("old_path"), new_path.alias("new_path"), "rank"))
    moved = (files.join(_maybe_broadcast(record), F.col("path") == F.col("old_path"))
             .withColumn("rel_path", F.concat(F.expr("left(rel_path, length(rel_path) - length(substring_index(old_path, '/', -1)))"),
                                              TX.basename("new_path")))
             .withColumn("path", F.col("new_path")).select(*FILES_COLUMNS))
    kept = files.join(_maybe_broadcast(record.select(F.col("old_path").alias("path"))), "path", "left_anti")
    return Result(files=kept.select(*FILES_COLUMNS).unionByName(moved), record=record, touched=moved)
