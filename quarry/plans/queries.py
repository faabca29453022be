"""Registered queries: one callable per operator of SURVEY section 2.

Every query reads the driver tables (or corpus views Spark derives from
them) in full; ``oracle_sql.py`` holds the SQL that checks each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import index as IX
from quarry.plans import tables as TB
from quarry.sources import corpus as C

QUERIES: dict = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ------------------------------------------------------------------ M0/M3 index

@query("t1_code_files")
def t1_code_files(spark: SparkSession, sf: str) -> DataFrame:
    """Code view files with P4-P7 columns (content summarised by sha)."""
    return TB.code_files(spark, sf).select("repo", "path", "rel_path", "ext", "language",
                                           "size_bytes", "line_count", "sha")


@query("p6_prose_files")
def p6_prose_files(spark, sf):
    """SURVEY 7.1 prose view: size in bytes (P5), splitlines count."""
    return TB.prose_files(spark, sf).select("repo", "path", "language", "size_bytes", "line_count")


@query("t1_symbols")
def t1_symbols(spark, sf):
    """F1-F8 over the code view: every extracted name with kind and order."""
    return TB.code_symbols(spark, sf).select("path", "language", "symbol", "kind", "ord")


@query("a1_symbol_index")
def a1_symbol_index(spark, sf):
    """A1 long form over the code view: (symbol, path, n_files)."""
    return IX.symbol_index_long(TB.code_symbols(spark, sf))


@query("a1_prose_symbol_index")
def a1_prose_symbol_index(spark, sf):
    """A1 over the prose view (R8 prose extractor): files per symbol with the
    first and last path, all from partial aggregates (no per-key lists)."""
    post = IX.symbol_postings(TB.prose_symbols(spark, sf))
    return post.groupBy("symbol").agg(F.count(F.lit(1)).cast("int").alias("n_files"),
                                      F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def _corpus_changes(files):
    """The code view's next version: a hash of the path empties a file, gives it
    other names or deletes it; the others stay."""
    fate = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("42:change:"), "path")), 1, 8), 16, 10).cast("long"), F.lit(8))
    c = files.withColumn("fate", fate)
    text = F.when(F.col("fate") == 0, "").when(F.col("fate") == 2, F.replace("content", F.lit("e(x"), F.lit("eZ(x"))).otherwise(F.col("content"))
    rest = c.filter("fate <> 1").withColumn("content", text)
    return C.finish_files(rest.select("repo", "path", "rel_path", "content"))


@query("t1_followed_index")
def t1_followed_index(spark, sf):
    """T1 + D8: the index of the code view, brought to a version with edits and
    deletions by its changes alone."""
    import uuid

    from quarry.session import ensure_checkpoint_dir
    from quarry.streaming.changes import SymbolTable
    held = SymbolTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}")
    files = TB.code_files(spark, sf)
    held.refresh(files, "first")
    held.refresh(_corpus_changes(files), "second")
    return IX.symbol_postings(held.symbols())


@query("a2_corpus_stats")
def a2_corpus_stats(spark, sf):
    files = TB.code_files(spark, sf)
    return IX.corpus_stats(files, IX.extract_symbols(files))


@query("f9_imports")
def f9_imports(spark, sf):
    """F9-F11 over the code view."""
    return IX.extract_imports(TB.code_files(spark, sf)).select("path", "language", "module", "ord")


@query("r5_reference_index")
def r5_reference_index(spark, sf):
    """Every identifier use per file."""
    return IX.reference_index(TB.code_files(spark, sf))


# --------------------------------------------------------------- M4/M5 rewrite
from quarry.operators import sampling as S  # noqa: E402
from quarry.operators import transforms as TR  # noqa: E402


def _frozen(spark, sf):
    """Code view and its symbols, materialised once (the frozen index every
    transform reads, X13) so the plan does not re-run the extractors per branch."""
    from quarry.session import cut_lineage
    files = cut_lineage(TB.code_files(spark, sf))
    return files, cut_lineage(IX.extract_symbols(files))


def _renamed(spark, sf):
    files, syms = _frozen(spark, sf)
    return TR.rename_symbols(files, syms, p=0.05, seed=42, mode="word", boundary="ascii")


@query("k1_t2_rename_map")
def k1_t2_rename_map(spark, sf):
    """K1 + F16: the sampled symbols and their new names, in sample order."""
    return _renamed(spark, sf).record.select("old", "new", "rank")


@query("t2_rename_files")
def t2_rename_files(spark, sf):
    """Files rewritten by the sequential whole-word renames."""
    t = _renamed(spark, sf).touched
    return t.select("path", F.size("pairs").cast("int").alias("n_pairs"),
                    F.md5("new_content").alias("content_md5"))


@query("a3_rename_stats")
def a3_rename_stats(spark, sf):
    return TR.rename_stats(_renamed(spark, sf))


def _migrated(spark, sf):
    files, syms = _frozen(spark, sf)
    return TR.migrate_api(files, syms, n=10, fraction=0.6, seed=42)


@query("t3_api_migrations")
def t3_api_migrations(spark, sf):
    """T3 record: P9 + K2 + W1 + W2 counts per migrated API."""
    return _migrated(spark, sf).record.select("symbol", "v2_symbol", "definition_file",
                                              "total_callsites", "migrated_callsites")


@query("t3_migration_actions")
def t3_migration_actions(spark, sf):
    """Which file gets the V2 definition and which usages migrate."""
    return _migrated(spark, sf).details


@query("t3_migrate_rewrite")
def t3_migrate_rewrite(spark, sf):
    """T3 rewrite (F20/F21 clone, F22 migrate) of every touched file."""
    t = _migrated(spark, sf).touched
    return t.select("path", F.md5("new_content").alias("content_md5"),
                    (F.col("new_content") != F.col("content")).alias("changed"))


def _wrapped(spark, sf):
    files, syms = _frozen(spark, sf)
    return TR.add_wrappers(files, syms, n=8, seed=42)


@query("t4_wrapper_layers")
def t4_wrapper_layers(spark, sf):
    """T4 record: K3 + W1 + P13 + F24 + F26."""
    return _wrapped(spark, sf).record.select("symbol", "original_file", "wrapper_file", "call_chain")


@query("t4_wrapper_files")
def t4_wrapper_files(spark, sf):
    """Generated wrapper rows."""
    return _wrapped(spark, sf).touched.select("repo", "path", "rel_path", "language", "size_bytes",
                                              "line_count", "sha")


def _duplicated(spark, sf):
    return TR.duplicate_with_drift(TB.code_files(spark, sf), k=2, max_files=100, seed=42)


@query("t5_duplication_map")
def t5_duplication_map(spark, sf):
    """T5 record: A7 + P10 + K4 + P12 (modified files joined by '|')."""
    rec = TR.duplication_record(_duplicated(spark, sf))
    return rec.select("original_path", "duplicate_path", F.array_join("modified_files", "|").alias("modified_files"))


@query("t5_duplicate_files")
def t5_duplicate_files(spark, sf):
    """T5 rows: copied paths with drifted content."""
    t = _duplicated(spark, sf).touched
    return t.select("path", "original_path", "modified", F.sha2("content", 256).alias("sha"))


@query("r2_drift_audit")
def r2_drift_audit(spark, sf):
    """R2: changed lines of every drifted copy against its original."""
    return TR.drift_audit(_duplicated(spark, sf))


@query("r2_aligned_diff")
def r2_aligned_diff(spark, sf):
    """R2 in line: what stays, moves, comes and goes in every drifted copy."""
    return TR.aligned_audit(_duplicated(spark, sf))


@query("a7_dir_file_count")
def a7_dir_file_count(spark, sf):
    """A7 + P10: files per top-level directory and whether it may be copied."""
    td = TR.top_dirs(TB.code_files(spark, sf))
    return (td.groupBy("repo", "top_dir").agg(F.count(F.lit(1)).alias("n_files"))
            .withColumn("small", (F.col("n_files") < 100) & ~F.col("top_dir").startswith(".")))


@query("w2_stratified_fraction")
def w2_stratified_fraction(spark, sf):
    """W2 on a large grouping: per language, int(0.6 n) files chosen by hash."""
    files = TB.code_files(spark, sf).select("language", "path")
    picked = S.sample_per_group(files, "language", "path", p=0.6, seed=42, op="w2")
    return picked.select("language", "path", "rank", "group_size")


@query("d7_shard_select")
def d7_shard_select(spark, sf):
    """Files of shard 3 of 8."""
    return S.shard_select(TB.code_files(spark, sf).select("path", "size_bytes"), "path", 3, 8)


# ------------------------------------------------------------------ M8 scoring
from quarry.functions import scoring as SC  # noqa: E402
from quarry.operators import scoring as SCO  # noqa: E402

def _score_cols():
    return ["submission_id", "task_id", "type", "score", F.size("errors").alias("n_errors")]


@query("t8_tasks")
def t8_tasks(spark, sf):
    """Tasks derived from the transform records and located passages."""
    return TB.scoring_context(spark, sf)["tasks"].select("task_id", "type", "difficulty", "max_time_minutes",
                                                         "start_symbol", "symbol_to_rename", "new_name",
                                                         "old_api", "new_api")


@query("f1_declaration_lines")
def f1_declaration_lines(spark, sf):
    """The position index of the code view: where each name is declared."""
    return IX.declarations(TB.code_files(spark, sf)).select("path", "symbol", "kind", "first_line")


@query("t8_truth_lines")
def t8_truth_lines(spark, sf):
    """The truth of rename and upgrade tasks with its lines."""
    c = TB.scoring_context(spark, sf, kinds=["refactor_rename", "api_upgrade"], placed=True)
    r = c["truth_renames"].select("task_id", "file", "line", F.col("old").alias("symbol"))
    a = c["truth_callsites"].select("task_id", "file", "line", F.expr("left(old_call, length(old_call) - 3)").alias("symbol"))
    return r.unionByName(a)


@query("j6_passage_lines")
def j6_passage_lines(spark, sf):
    """The lines of every located passage, by an interval join of truth
    ranges and lines, and whether one holds a fix pattern (F38)."""
    from quarry.operators import ranges as RG
    from quarry.operators import tasks as TK
    prose = TB.prose_files(spark, sf)
    loc = TK.passage_locations(TB.table(spark, sf, "benchmark"), prose)
    found = loc.groupBy("item_id", "path").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    lines = RG.lines_in_ranges(found, prose)
    return lines.groupBy("item_id", "path", "first_line", "last_line").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"), F.bool_or(SC.has_fix_pattern(F.lower("line"))).alias("fix"))


@query("s9_answer_text")
def s9_answer_text(spark, sf):
    """Answer texts assembled in the fixed source order + commits."""
    return TB.scoring_context(spark, sf)["texts"].select("submission_id", "kind", F.md5("text").alias("text_md5"))


@query("c1_score_cross_file")
def c1_score_cross_file(spark, sf):
    c = TB.scoring_context(spark, sf, kinds=["cross_file_reasoning"])
    s = SCO.score_cross_file(c["attempts"], c["tasks"], c["truth_paths"], c["texts"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.call_chain_accuracy").cast("double").alias("acc"))


@query("c2_score_rename")
def c2_score_rename(spark, sf):
    c = TB.scoring_context(spark, sf, kinds=["refactor_rename"])
    s = SCO.score_rename(c["attempts"], c["tasks"], c["truth_renames"], c["files"], c["submissions"],
                         "ascii", c["all_files"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.false_positives").cast("int").alias("fp"))


@query("c3_score_api")
def c3_score_api(spark, sf):
    c = TB.scoring_context(spark, sf, kinds=["api_upgrade"])
    s = SCO.score_api(c["attempts"], c["tasks"], c["truth_callsites"], c["files"], c["submissions"], "ascii")
    return s.select(*_score_cols())


@query("c4_score_bug")
def c4_score_bug(spark, sf):
    c = TB.scoring_context(spark, sf, kinds=["bug_localization"])
    s = SCO.score_bug(c["attempts"], c["tasks"], c["truth_bugs"], c["files"], c["submissions"], c["texts"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.location_score").cast("double").alias("loc"))


@query("c5_score_all")
def c5_score_all(spark, sf):
    return SCO.score_all(TB.scoring_context(spark, sf)).select(*_score_cols())


def _patched(spark, sf, kind):
    return TB.scoring_context(spark, sf, kinds=[kind], patched=True)


@query("c1_cited_path")
def c1_cited_path(spark, sf):
    """C1 on answers that name steps of the call path."""
    c = _patched(spark, sf, "cross_file_reasoning")
    s = SCO.score_cross_file(c["attempts"], c["tasks"], c["truth_paths"], c["texts"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.call_chain_accuracy").cast("double").alias("acc"),
                    F.get_json_object("details", "$.implementation_file_found").cast("boolean").alias("file_found"))


@query("c2_patched_rename")
def c2_patched_rename(spark, sf):
    """C2 on every submission's own tree."""
    c = _patched(spark, sf, "refactor_rename")
    s = SCO.score_rename(c["attempts"], c["tasks"], c["truth_renames"], c["files"], c["submissions"], "ascii", c["all_files"], c["changed"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.correctly_modified").cast("int").alias("correct"),
                    F.get_json_object("details", "$.false_positives").cast("int").alias("fp"))


@query("c3_patched_api")
def c3_patched_api(spark, sf):
    """C3 on every submission's own tree."""
    c = _patched(spark, sf, "api_upgrade")
    s = SCO.score_api(c["attempts"], c["tasks"], c["truth_callsites"], c["files"], c["submissions"], "ascii", c["changed"])
    return s.select(*_score_cols(), F.get_json_object("details", "$.actual_upgrades").cast("int").alias("actual"),
                    F.get_json_object("details", "$.preserved_legacy").cast("int").alias("preserved"))


@query("c4_patched_bug")
def c4_patched_bug(spark, sf):
    """C4 on every submission's own tree and on answers that name files and lines."""
    c = _patched(spark, sf, "bug_localization")
    s = SCO.score_bug(c["attempts"], c["tasks"], c["truth_bugs"], c["files"], c["submissions"], c["texts"], c["changed"])
    return s.select(*_score_cols(), *[F.get_json_object("details", f"$.{k}_score").cast("double").alias(k) for k in ("file", "location", "fix")])


@query("j4_submission_trees")
def j4_submission_trees(spark, sf):
    """What each submission's patch modifies, adds and deletes in the base."""
    from quarry.operators import overlay as OV
    c = _patched(spark, sf, "refactor_rename")
    return OV.tree_summary(c["files"], c["changed"])


@query("c6_report")
def c6_report(spark, sf):
    """C6 + A17 + D1 + D2 per submission."""
    c = TB.scoring_context(spark, sf)
    return SCO.report(SCO.score_all(c), c["tasks"], c["submissions"])


# ----------------------------------------------------- M6/M7 lineage, validation
from quarry.operators import lineage as LN  # noqa: E402
from quarry.operators import validate as VA  # noqa: E402


@query("r1_snapshot_diff")
def r1_snapshot_diff(spark, sf):
    """Code view before/after the T2 renames plus the T5 copies."""
    files, syms = _frozen(spark, sf)
    ren = TR.rename_symbols(files, syms, p=0.05, seed=42, mode="word", boundary="ascii")
    return LN.snapshot_diff(files, ren.files).select("path", "status")


@query("d8_changed_repos")
def d8_changed_repos(spark, sf):
    """Repositories whose files changed with the T2 renames."""
    files, syms = _frozen(spark, sf)
    ren = TR.rename_symbols(files, syms, p=0.05, seed=42, mode="word", boundary="ascii")
    return LN.changed_repos(files, ren.files)


@query("r3_call_chain")
def r3_call_chain(spark, sf):
    """All nodes reachable from the symbols that the wrapper step samples
    (K3), where the cross-file tasks start."""
    files = TB.code_files(spark, sf)
    keys = IX.extract_symbols(files).select("symbol").distinct()
    roots = S.sample_n(keys, "symbol", 8, 42, op="wrap").select(F.col("symbol").alias("root"))
    return LN.call_chain(LN.call_edges(files), roots)


@query("r3_call_paths")
def r3_call_paths(spark, sf):
    """One shortest call path from each sampled symbol to every symbol it reaches."""
    files = TB.code_files(spark, sf)
    keys = IX.extract_symbols(files).select("symbol").distinct()
    roots = S.sample_n(keys, "symbol", 8, 42, op="wrap").select(F.col("symbol").alias("root"))
    return LN.call_paths(LN.call_edges(files), roots).select("root", "node", "depth", F.array_join("path", " > ").alias("path"))


@query("r6_rename_audit")
def r6_rename_audit(spark, sf):
    """Per renamed pair the files of the whole renamed corpus that still
    use the old name, those that are done, and the coverage."""
    ren = _renamed(spark, sf)
    return IX.rename_audit(ren.record, IX.reference_index(ren.files))


@query("r1_changed_snapshot")
def r1_changed_snapshot(spark, sf):
    """R1 between two versions with files that came, went, changed and stayed."""
    files = TB.code_files(spark, sf)
    newer = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("42:newer:"), "path")), 1, 8), 16, 10).cast("long"), F.lit(9)) == 0
    return LN.snapshot_diff(files.filter(~newer), _corpus_changes(files)).select("path", "status")


@query("r4_exact_copies")
def r4_exact_copies(spark, sf):
    """R4 exact: documents sharing a normalised text."""
    return LN.exact_copies(TB.prose_files(spark, sf))


@query("r4_near_copies")
def r4_near_copies(spark, sf):
    """R4 near: MinHash/LSH representative of each near-copy document."""
    return LN.near_copies(TB.prose_files(spark, sf), threshold=0.8)


@query("t6_validate_corpus")
def t6_validate_corpus(spark, sf):
    """A5 counts, A6 primary language, A8 Python syntax per repo."""
    v = VA.validate_corpus(TB.code_files(spark, sf))
    return v.select("repo", "go", "py", "cpp", "primary_language", "python_ok", "python_files", "syntax_errors")


@query("a8_syntax_messages")
def a8_syntax_messages(spark, sf):
    """All syntax messages of a repo's Python files, beside their count."""
    v = VA.repo_syntax_report(TB.code_files(spark, sf))
    return v.select("repo", "python_files", "syntax_errors", "messages")


def _tree(spark, sf):
    return C.tree_files(C.load_spread(spark, sf, "documents"))


@query("p8_errors_by_repo")
def p8_errors_by_repo(spark, sf):
    """Scanned files of the tree view, those that can't be read, those
    whose analysis fails, and the symbols of the others."""
    files = _tree(spark, sf).filter(TX.is_scanned("path"))
    return IX.errors_by_repo(files, *IX.analyse(files))


@query("a5_listed_languages")
def a5_listed_languages(spark, sf):
    """A5 + A6 over all files of the tree, beside those that are scanned."""
    listing = _tree(spark, sf).select("repo", "path")
    scanned = VA.lang_counts(listing.filter(TX.is_scanned("path"))).toDF("repo", "scanned_go", "scanned_py", "scanned_cpp")
    c = VA.lang_counts(listing).withColumn("primary_language", VA.primary_language("go", "py", "cpp"))
    return c.join(scanned, "repo", "left").fillna(0, ["scanned_go", "scanned_py", "scanned_cpp"])


@query("a7_listed_directories")
def a7_listed_directories(spark, sf):
    """A7 + P10 over all files of the tree, beside those that are scanned."""
    td = TR.top_dirs(_tree(spark, sf).select("repo", "path", "rel_path"))
    return (td.groupBy("repo", "top_dir").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(TX.is_scanned("path")).alias("n_scanned"))
            .withColumn("small", (F.col("n_files") < 20) & ~F.col("top_dir").startswith(".")))


@query("t6_listed_validation")
def t6_listed_validation(spark, sf):
    """T6 over all files of the tree: counts from the listing, syntax of every
    readable .py file wherever it lies."""
    tree = _tree(spark, sf)
    v = VA.validate_corpus(VA.python_listing(tree).filter("read_error is null"), tree.select("repo", "path"))
    return v.select("repo", "go", "py", "cpp", "primary_language", "python_ok", "python_files", "syntax_errors")


@query("c7_listed_compilation")
def c7_listed_compilation(spark, sf):
    """C7 + W4 over all files of the tree: the first five readable .py files
    are chosen from the listing, and only they are read."""
    tree = _tree(spark, sf)
    from quarry.operators.joins import join_small
    first = VA.first_python(tree.filter("read_error is null").select("repo", "path"))
    return VA.check_compilation(join_small(tree, first.select("path"), "path", "left_semi"))


@query("c7_check_compilation")
def c7_check_compilation(spark, sf):
    """C7 + W4: the first five .py files of each repo parse."""
    return VA.check_compilation(TB.code_files(spark, sf))


@query("a6_primary_language_prose")
def a6_primary_language_prose(spark, sf):
    """A5 + A6 over the prose view."""
    c = VA.lang_counts(TB.prose_files(spark, sf))
    return c.withColumn("primary_language", VA.primary_language("go", "py", "cpp"))


# ------------------------------------------------- function-level queries
from quarry.functions import rewrite as RW  # noqa: E402
from quarry.functions import scoring as SC  # noqa: E402


@query("p4_page_files")
def p4_page_files(spark, sf):
    """P1-P4 over page URLs: host as repo, URL path as file path."""
    f = C.page_files(C.load_spread(spark, sf, "pages"))
    return f.select("repo", "path", "ext", "language", TX.is_scanned("path").alias("scanned"),
                    TX.basename("path").alias("name"))


@query("f9_page_links")
def f9_page_links(spark, sf):
    """Import-role extraction over pages: every href in page order."""
    return C.page_links(C.load_spread(spark, sf, "pages"))


@query("f34_keyword_ratio")
def f34_keyword_ratio(spark, sf):
    """F34 over assistant turns."""
    c = C.load_spread(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.round(SC.keyword_ratio(F.lower("text")), 9).alias("ratio"))


@query("f33_path_steps")
def f33_path_steps(spark, sf):
    """F33 + A16: call-path steps built from each document's path and first
    capitalised word, matched against the lower-cased text."""
    d = TB.prose_files(spark, sf)
    first = F.regexp_extract("content", r"([A-Z][a-z]+)", 1)
    steps = F.array(F.col("path"), F.concat(F.col("rel_path"), F.lit("::"), first), first, F.lit("x->y"))
    return d.select("path", F.round(SC.path_accuracy(steps, F.lower("content")), 9).alias("accuracy"),
                    F.size(F.filter(steps, lambda s: SC.path_step_hit(s, F.lower("content")))).alias("hits"))


@query("f36_line_band")
def f36_line_band(spark, sf):
    """integers of each URL against the band [500, 510]."""
    p = C.load_spread(spark, sf, "pages")
    return p.select("page_id", F.size(SC.ints_in_text("url")).alias("n_ints"),
                    SC.line_band("url", F.lit(500), F.lit(510)).alias("band_score"))


@query("j6_bug_lines")
def j6_bug_lines(spark, sf):
    """Lines 2-4 of each document, joined and lower-cased, hold a
    fix pattern."""
    d = TB.prose_files(spark, sf)
    sl = F.slice(TX.split_lines("content"), 2, 3)
    return d.select("path", F.size(sl).alias("n_lines"), SC.has_fix_pattern(F.lower(F.array_join(sl, "\n"))).alias("fix"))


@query("f17_count_word")
def f17_count_word(spark, sf):
    """F17 with the ASCII boundary: whole-word 'the' and 'la' per document."""
    d = TB.prose_files(spark, sf)
    return d.select("path", TX.count_word("content", F.lit("the"), "ascii").alias("n_the"),
                    TX.count_word("content", F.lit("la"), "ascii").alias("n_la"))


@query("s15_grep_lines")
def s15_grep_lines(spark, sf):
    """S15 + F42: lines of .go/.py/.cpp files containing 'Est', with the
    comment/string heuristic on 'path:line'."""
    d = TB.prose_files(spark, sf).filter(TX.basename("path").rlike(r"\.(go|py|cpp)$"))
    lines = d.select("path", F.posexplode(TX.split_lines("content")).alias("line_no", "line"))
    hits = lines.filter(F.col("line").contains("Est"))
    return hits.select("path", (F.col("line_no") + 1).alias("line_no"), SC.noise_line("path", "line").alias("noise"))


@query("w3_first_hits")
def w3_first_hits(spark, sf):
    """W3 + A13: per repository the first 50 hits of 'Est' (by path, line),
    and the capped count of noise lines among them."""
    d = TB.prose_files(spark, sf)
    lines = d.select("repo", "path", F.posexplode(TX.split_lines("content")).alias("line_no", "line"))
    hits = lines.filter(F.col("line").contains("Est"))
    from pyspark.sql import Window
    w = Window.partitionBy("repo").orderBy("path", "line_no")
    first = hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= 50)
    return first.groupBy("repo").agg(F.count(F.lit(1)).alias("hits"),
                                     F.least(F.count_if(SC.noise_line("path", "line")), F.lit(10)).alias("false_positives"))


@query("f16_new_name")
def f16_new_name(spark, sf):
    """F16 over every distinct symbol of the code view."""
    keys = TB.code_symbols(spark, sf).select("symbol").distinct()
    return keys.select("symbol", RW.new_name("symbol", 42).alias("new_name"))


@query("p9_api_candidates")
def p9_api_candidates(spark, sf):
    """Symbols long enough and capitalised to be API candidates."""
    keys = TB.code_symbols(spark, sf).select("symbol").distinct()
    return TR.api_candidates(keys)


@query("f29_drift_prose")
def f29_drift_prose(spark, sf):
    """F27-F29 applied to every document (P11 on the path)."""
    d = TB.prose_files(spark, sf)
    out = F.when(RW.is_rewritable("path"), RW.drift("content")).otherwise(F.col("content"))
    return d.select("path", F.md5(out).alias("drifted_md5"), (out != F.col("content")).alias("modified"))


@query("d1_performance_band")
def d1_performance_band(spark, sf):
    """Band of score = 10 x discount, counted per band."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(SC.performance_band(F.col("l_discount") * 10).alias("band")).agg(
        F.count(F.lit(1)).alias("n"))


@query("d2_overtime_events")
def d2_overtime_events(spark, sf):
    """Per user, active minutes (first to last event) against a 10 minute
    limit."""
    ev = spark.read.parquet(f"{sf}/events.parquet")
    mins = ev.groupBy("user_id").agg(
        ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 60e6)
        .alias("elapsed"))
    return mins.select("user_id", F.round("elapsed", 6).alias("elapsed"),
                       SC.overtime_factor("elapsed", F.lit(10.0)).alias("factor"))


def _rich(spark, sf):
    return C.rich_files(C.load_spread(spark, sf, "documents"))


@query("f4_rich_symbols")
def f4_rich_symbols(spark, sf):
    """F1-F7 where every kind occurs: functions, types, methods, classes,
    variables, structs, and names read from invalid syntax."""
    return IX.extract_symbols(_rich(spark, sf)).select("path", "language", "symbol", "kind")


@query("f29_rich_drift")
def f29_rich_drift(spark, sf):
    """F27-F30 where every rule applies: headers, levels, sizes and times."""
    d = _rich(spark, sf)
    out = F.when(RW.is_rewritable("path"), RW.drift("content")).otherwise(F.col("content"))
    return d.select("path", F.md5(out).alias("drifted_md5"), (out != F.col("content")).alias("modified"))


@query("d2_overtime_lines")
def d2_overtime_lines(spark, sf):
    """D2 over line items: a minute per piece against a limit of 12, so that
    every band of overtime occurs."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    return li.groupBy(F.col("l_quantity").cast("double").alias("elapsed")).agg(F.count(F.lit(1)).alias("n")).select(
        "elapsed", "n", SC.overtime_factor("elapsed", F.lit(12.0)).alias("factor"))


@query("f34_cited_keywords")
def f34_cited_keywords(spark, sf):
    """F34 + F32 over the answers that cite steps of a call path."""
    c = TB.scoring_context(spark, sf, kinds=["cross_file_reasoning"], patched=True)
    return c["texts"].select("submission_id", "kind", F.round(SC.keyword_ratio(F.lower("text")), 9).alias("ratio"))


@query("d9_corpus_rollup")
def d9_corpus_rollup(spark, sf):
    """D9 roll-up (ROLLUP) of lines and files per repository and language."""
    f = TB.code_files(spark, sf)
    return (f.rollup("repo", "language").agg(F.count(F.lit(1)).alias("files"),
                                              F.sum("line_count").alias("lines")))


def _manifests(spark, sf):
    """Nested manifests of the sources of ``documents``, one JSON text per
    language: the source's number places it in a tier and gives it a licence."""
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    d = (C.load_table(spark, sf, "documents").groupBy("lang", "source").agg(F.sum("n_chars").alias("loc"))
         .select("lang", F.struct(F.col("source").alias("name"), F.concat(F.lit("git://"), "source").alias("url"), F.col("lang").alias("language"),
                                  F.col("loc").alias("approximate_loc"), F.pmod(n, F.lit(4)).alias("weight"),
                                  F.when(n % 5 > 0, F.element_at(F.array(*map(F.lit, ("mit", "bsd-3-clause", "apache-2.0"))), F.pmod(n, F.lit(3)) + 1)).alias("license"),
                                  F.when(n % 2 == 0, n).alias("depth")).alias("r"), F.pmod(n, F.lit(3)).alias("t")))
    lists = d.groupBy("lang").agg(*[F.collect_list(F.when(F.col("t") == i, F.col("r"))).alias(f"{t}_repos") for i, t in enumerate(("core", "extended", "xl"))])
    return lists.select(F.concat("lang", F.lit(".json")).alias("file"),
                        F.to_json(F.struct(F.struct(F.lit("1.0").alias("version")).alias("metadata"), "core_repos", "extended_repos", "xl_repos")).alias("value"))


@query("s4_nested_manifest")
def s4_nested_manifest(spark, sf):
    """S4 + U1 + F45 from nested manifests: core, then extended repositories."""
    from quarry.sources import manifest as MF
    repos, _ = MF.repos_from_json(_manifests(spark, sf))
    return MF.load_repository_config(repos, core_only=False)


@query("d9_licence_totals")
def d9_licence_totals(spark, sf):
    """D9 from nested manifests: repositories, lines and weight per licence and tier."""
    from quarry.sources import manifest as MF
    repos, _ = MF.repos_from_json(_manifests(spark, sf))
    return MF.license_rollup(repos)


@query("a10_task_summary")
def a10_task_summary(spark, sf):
    """A10 over the tasks T8 derives."""
    from quarry.operators import tasks as TK2
    return TK2.task_summary(TB.scoring_context(spark, sf)["tasks"])




@query("a9_transform_summary")
def a9_transform_summary(spark, sf):
    """T7 + A9: the whole transform chain over the code view (word renames,
    ASCII boundary), summarised."""
    from quarry.plans import jobs as JB
    res = JB.apply_all(TB.code_files(spark, sf), JB.Settings(rename_mode="word", boundary="ascii"))
    return res["summary"]


@query("d3_d6_document_rules")
def d3_d6_document_rules(spark, sf):
    """The documented formulas beside the engine's scores."""
    c = TB.scoring_context(spark, sf)
    return SCO.document_rules(SCO.score_all(c), c).select("submission_id", "task_id", "type", "score",
                                                            "document_score")


@query("d10_file_rename")
def d10_file_rename(spark, sf):
    """8 % of the code-view files renamed to <stem>_renamed<suffix>."""
    res = TR.rename_files(TB.code_files(spark, sf), p=0.08, seed=42)
    return res.touched.select("path", "rel_path", "sha")


@query("f12_f13_rename_parity")
def f12_f13_rename_parity(spark, sf):
    """F12/F13 parity mode on the code view: the per-language head rewrites
    (X6/X17) as native expressions, touched files only.  Rows-only; the tests
    check the heads."""
    files, syms = _frozen(spark, sf)
    t = TR.rename_symbols(files, syms, p=0.05, seed=42, mode="parity").touched
    return t.select("path", F.size("pairs").cast("int").alias("n_pairs"), F.md5("new_content").alias("content_md5"))
