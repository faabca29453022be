"""Scoring of many submissions at once.

Inputs are tables: ``attempts(submission_id, task_id)`` says which tasks a
submission is scored on; ``submissions(submission_id, patch_applied,
compile_ok, elapsed_minutes)``; ``texts(submission_id, kind, text)`` is the
answer text (S9/S10); ``files`` is the corpus after the patch, or the base that
the submissions' own trees share (``changed``, see ``overlay``).  Everything
that depends only on the task and the corpus (file checks, grep hits, fix
patterns) is computed once per task and joined to the attempts; every join is
an equi-join on a key.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scoring as SC
from quarry.functions import text as TX
from quarry.operators import overlay as OV
from quarry.operators.joins import bounded_broadcast
from quarry.session import cut_lineage

SCORE_COLUMNS = ["submission_id", "task_id", "type", "score", "max_score", "details", "errors"]


def _errors(*pairs) -> F.Column:
    """ARRAY of messages whose condition holds (in order)."""
    return F.filter(F.array(*[F.when(c, m) for c, m in pairs]), lambda x: x.isNotNull())


def _out(df: DataFrame, score, details, errors) -> DataFrame:
    return df.select("submission_id", "task_id", "type",
                     F.round(score.cast("double"), 12).alias("score"), F.lit(1.0).alias("max_score"),
                     F.to_json(details).alias("details"), errors.alias("errors"))


# ------------------------------------------------------------------ S9/S10

def answer_text(agent_text: DataFrame, kind: str = "reasoning") -> DataFrame:
    """S9 (``kind='reasoning'``) / S10 (``'bug'``): the known answer files in
    their fixed order, then the last N commit subjects; each piece followed
    by a newline.  ``agent_text(submission_id, source_name, ord, text)``."""
    names = SC.REASONING_SOURCES if kind == "reasoning" else SC.BUG_SOURCES
    n_commits = SC.REASONING_COMMITS if kind == "reasoning" else SC.BUG_COMMITS
    order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    files = (agent_text.filter(F.col("source_name").isin(names))
             .withColumn("grp", F.lit(0)).withColumn("o", F.try_element_at(order, F.col("source_name"))))
    w = Window.partitionBy("submission_id").orderBy(F.col("ord").desc())
    commits = (agent_text.filter(F.col("source_name") == "commit")
               .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n_commits).drop("_r")
               .withColumn("grp", F.lit(1)).withColumn("o", F.lit(0)))
    # a commit log is one piece: its subjects newest first, one per line
    clog = (commits.groupBy("submission_id")
            .agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("neg"), "text")), asc=False).alias("c"))
            .select("submission_id", F.lit(1).alias("grp"), F.lit(0).alias("o"), F.lit(0).alias("ord"),
                    F.array_join(F.transform("c", lambda x: x["text"]), "\n").alias("text")))
    pieces = (files.select("submission_id", "grp", "o", "ord", "text")
              .unionByName(clog))
    return (pieces.groupBy("submission_id")
            .agg(F.sort_array(F.collect_list(F.struct("grp", "o", "ord", "text"))).alias("p"))
            .select("submission_id", F.lit(kind).alias("kind"),
                    F.concat_ws("", F.transform("p", lambda x: F.concat(x["text"], F.lit("\n")))).alias("text")))


def _with_content(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (with a ``file`` column) LEFT JOIN the corpus text.  ``files``
    is expected to be the truth slice of the corpus the scoring context
    builds once (``task_files``); the join is then between small tables."""
    return rows.join(files.select(F.col("path").alias("file"), "content"), "file", "left")


def _long(truth: DataFrame, array_col: str, fields: list[str]) -> DataFrame:
    """Truth rows in long form (task_id, fields...): nested truth (the
    reference's shape) is exploded; long truth is used as is.  A task whose
    list is empty has one row of NULLs."""
    if array_col in truth.columns:
        e = truth.select("task_id", F.explode_outer(array_col).alias("_c"))
        return e.select("task_id", *[F.col("_c")[f].alias(f) for f in fields])
    return truth.select("task_id", *fields)


# ------------------------------------------------------------------------ C1

def score_cross_file(attempts: DataFrame, tasks: DataFrame, truth: DataFrame, texts: DataFrame) -> DataFrame:
    a = (attempts.join(tasks.filter(F.col("type") == "cross_file_reasoning")
                       .select("task_id", "type", "ground_truth"), "task_id")
         .join(truth.withColumn("_has_truth", F.lit(True)), "task_id", "left")
         .join(texts.filter(F.col("kind") == "reasoning").select("submission_id", "text"), "submission_id", "left"))
    no_truth = F.col("_has_truth").isNull()
    no_path = ~no_truth & (F.coalesce(F.size("expected_call_path"), F.lit(0)) <= 0)
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    exp_file = F.coalesce(F.col("expected_implementation_file"), F.lit(""))
    file_found = (exp_file != "") & SC.mentions_file(text, exp_file)
    acc = SC.path_accuracy("expected_call_path", low)
    raw = (F.when(file_found, 0.25).otherwise(0.0) + acc * 0.5
           + F.least(SC.keyword_ratio(low), F.lit(1.0)) * 0.25)
    has_text = text != ""
    error = no_truth | no_path
    score = F.when(error | ~has_text, F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))
    details = F.struct(
        (has_text & ~error & (raw > 0.5)).alias("expected_path_found"),
        (has_text & ~error & file_found).alias("implementation_file_found"),
        F.when(has_text & ~error, acc).otherwise(F.lit(0.0)).alias("call_chain_accuracy"),
        F.when(has_text, F.lit("text_found")).otherwise(F.lit("none_found")).alias("agent_output_format"),
        error.alias("error"))
    errors = _errors((no_truth, F.concat(F.lit("Ground truth file not found: "), F.coalesce("ground_truth", F.lit("")))),
                     (no_path, F.lit("No expected call path in ground truth")))
    return _out(a, score, details, errors)


# ------------------------------------------------------------------------ C2

def rename_check(boundary: str = "unicode") -> Callable[[F.Column], dict]:
    """F17 + A12: what one expected file counts for (a missing one as missed)."""
    return lambda content: {"correctly_modified": F.coalesce(
        (TX.count_word(content, "symbol_to_rename", boundary) <= 2) & (TX.count_word(content, "new_name", boundary) >= 1),
        F.lit(False)).cast("int")}


def rename_file_checks(tasks: DataFrame, truth: DataFrame, files: DataFrame, boundary: str = "unicode") -> DataFrame:
    """J4 per (task, expected file) on the corpus."""
    t = (tasks.filter(F.col("type") == "refactor_rename")
         .select("task_id", "symbol_to_rename", "new_name").join(_long(truth, "expected_changes", ["file"]), "task_id"))
    return _with_content(t, files).select(*t.columns, *[e.alias(c) for c, e in rename_check(boundary)(F.col("content")).items()])


def rename_task_checks(tasks: DataFrame, truth: DataFrame, files: DataFrame, boundary: str = "unicode") -> DataFrame:
    """A11 per task."""
    return _rename_totals(rename_file_checks(tasks, truth, files, boundary))


def _rename_totals(per_file: DataFrame) -> DataFrame:
    return (per_file.groupBy("task_id").agg(
        F.count("file").cast("int").alias("files_checked"),
        F.count_if(F.col("file").isNotNull() & (F.col("correctly_modified") > 0)).cast("int").alias("correctly_modified")))


PROBE_GRAM = 3


def _runs(text) -> F.Column:
    """Distinct runs of a text without white space."""
    return F.filter(F.array_distinct(F.split(text, r"\s+", -1)), lambda w: w != "")


def _grams_of(text, n: int) -> F.Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                                        lambda i: F.substring(text, i, n)))


def names_in_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """(word, new_name) of ``words(word)``, distinct, that hold the longest run
    of a name as a substring.  Words and names meet on the name's gram of
    ``PROBE_GRAM`` characters that the fewest words hold (shorter runs are their
    own gram) and are verified, so a frequent gram brings no candidates where a
    rarer one tells."""
    longest = F.element_at(F.array_sort(F.transform(_runs(F.col("new_name")), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1)["w"]
    probes = cut_lineage(names.select("new_name").distinct().withColumn("probe", longest))
    lengths = [r["k"] for r in probes.select(F.least(F.length("probe"), F.lit(PROBE_GRAM)).alias("k")).distinct().collect()]   # 3 at most
    found = None
    for n in sorted(lengths):
        of = probes.filter(F.length("probe") >= n if n == PROBE_GRAM else F.length("probe") == n)
        grams = bounded_broadcast(of.select("new_name", "probe", F.explode(_grams_of(F.col("probe"), n)).alias("gram")))
        held = words.select("word", F.explode(_grams_of(F.col("word"), n)).alias("gram"))
        often = held.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        rarest = (grams.join(often, "gram", "left").groupBy("new_name", "probe")
                  .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram")))
        hit = (held.join(bounded_broadcast(rarest), "gram").filter(F.col("word").contains(F.col("probe"))).select("word", "new_name"))
        found = hit if found is None else found.unionByName(hit)
    return found if found is not None else words.select("word", F.col("word").alias("new_name")).limit(0)


def rename_false_positives(tasks: DataFrame, files: DataFrame, first_n: int = 50, cap: int = 10) -> DataFrame:
    """A13 per task: of the first ``first_n`` lines (by path, line) of
    .go/.py/.cpp files that contain the new name, those that look like a
    comment or string (F42), capped."""
    return _noise_totals(tasks, rename_hits(tasks, files), first_n, cap)


def _noise_totals(tasks: DataFrame, lines: DataFrame, first_n: int = 50, cap: int = 10) -> DataFrame:
    w = Window.partitionBy("task_id").orderBy("path", "line_no")
    first = lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first_n)   # WindowGroupLimit
    fp = first.groupBy("task_id").agg(F.least(F.count_if(SC.noise_line("path", "line")), F.lit(cap)).cast("int")
                                      .alias("false_positives"))
    return (tasks.filter(F.col("type") == "refactor_rename").select("task_id")
            .join(fp, "task_id", "left").fillna(0, ["false_positives"]))


def rename_hits(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(task_id, new_name, path, line_no, line): every line of .go/.py/.cpp
    files that contains the task's new name.

    The name is searched as a substring.  A line that contains it contains its
    longest run without white space inside one word, so the distinct words of
    the corpus (partial aggregation, no text) are searched first, and only
    files with such a word are read by lines.  A name of white space alone
    finds nothing."""
    t = tasks.filter(F.col("type") == "refactor_rename").select("task_id", "new_name")
    names = t.filter(F.size(_runs(F.col("new_name"))) > 0)
    src = files.filter(TX.basename("path").rlike(r"\.(go|py|cpp)$")).select("path", "content")
    words = src.select("path", F.explode(_runs(F.col("content"))).alias("word"))
    vocabulary = cut_lineage(words.select("word").distinct())
    holders = names_in_words(names, vocabulary)
    cand = words.join(bounded_broadcast(holders), "word").select("new_name", "path").distinct()
    cand = cut_lineage(cand.join(names, "new_name").select("task_id", "new_name", "path"))
    need = bounded_broadcast(cand.select("path").distinct())
    return (src.join(need, "path").join(cand, "path")
            .select("task_id", "new_name", "path", F.posexplode(TX.split_lines("content")).alias("line_no", "line"))
            .filter(F.col("line").contains(F.col("new_name"))))


def score_rename(attempts: DataFrame, tasks: DataFrame, truth: DataFrame, files: DataFrame,
                 submissions: DataFrame, boundary: str = "unicode",
                 all_files: DataFrame | None = None, changed: DataFrame | None = None) -> DataFrame:
    """C2.  ``files`` serves the expected-change checks; the false-positive
    grep reads ``all_files`` (the whole corpus) when given.  ``changed`` are the
    files the submissions' own trees change (``overlay.latest``)."""
    t = tasks.filter(F.col("type") == "refactor_rename").select("task_id", "type", "ground_truth",
                                                                 "symbol_to_rename", "new_name")
    per_file = rename_file_checks(tasks, truth, files, boundary)
    lines = rename_hits(tasks, all_files if all_files is not None else files)
    if changed is not None:      # read for the tasks and again for the trees
        per_file, lines = cut_lineage(per_file), cut_lineage(lines)
    per_task = (t.join(truth.select("task_id").distinct().withColumn("_has_truth", F.lit(True)), "task_id", "left")
                .join(_rename_totals(per_file), "task_id", "left")
                .join(_noise_totals(tasks, lines), "task_id", "left"))
    a = attempts.join(per_task, "task_id").join(submissions, "submission_id", "left")
    if changed is not None:
        a = (a.join(OV.deltas(per_file, attempts, changed, rename_check(boundary)), ["submission_id", "task_id"], "left")
             .join(OV.rename_noise(t, lines, attempts, changed), ["submission_id", "task_id"], "left")
             .withColumn("correctly_modified", F.coalesce("correctly_modified", F.lit(0)) + F.coalesce("d_correctly_modified", F.lit(0)))
             .withColumn("false_positives", F.coalesce("own_false_positives", "false_positives")))
    applied = F.coalesce(F.col("patch_applied"), F.lit(False))
    no_truth = applied & F.col("_has_truth").isNull()
    no_names = applied & ~no_truth & ((F.coalesce("symbol_to_rename", F.lit("")) == "") |
                                      (F.coalesce("new_name", F.lit("")) == ""))
    error = ~applied | no_truth | no_names
    checked = F.coalesce("files_checked", F.lit(0))
    correct = F.coalesce("correctly_modified", F.lit(0))
    fp = F.coalesce("false_positives", F.lit(0))
    comp = F.coalesce(F.col("compile_ok"), F.lit(False))
    raw = F.greatest(F.lit(0.0), TX.ratio_safe(correct, checked) - F.least(fp * 0.1, F.lit(0.3))
                     + F.when(comp, 0.1).otherwise(0.0))
    score = F.when(error, F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))
    details = F.struct(checked.alias("files_checked"), correct.alias("correctly_modified"),
                       (checked - correct).alias("missed_references"), fp.alias("false_positives"),
                       comp.alias("compilation_success"), error.alias("error"))
    errors = _errors((~applied, F.lit("No patch was applied")),
                     (no_truth, F.concat(F.lit("Ground truth file not found: "), F.coalesce("ground_truth", F.lit("")))),
                     (no_names, F.lit("Missing symbol names in task definition")))
    return _out(a, score, details, errors)


# ------------------------------------------------------------------------ C3

def api_check(boundary: str = "unicode") -> Callable[[F.Column], dict]:
    """F18 + A15: what one callsite's file counts for; a missing file for
    neither counter (P15)."""
    def check(content):
        found = (TX.count_calls(content, "old_func", boundary) == 0) & (TX.count_calls(content, "new_func", boundary) > 0)
        needs = F.coalesce(F.col("needs_upgrade"), F.lit(False))
        return {"actual_upgrades": F.coalesce(content.isNotNull() & needs & found, F.lit(False)).cast("int"),
                "preserved_legacy": F.coalesce(content.isNotNull() & ~needs & ~found, F.lit(False)).cast("int")}
    return check


def api_file_checks(tasks: DataFrame, truth: DataFrame, files: DataFrame, boundary: str = "unicode") -> DataFrame:
    """J5 per (task, callsite) on the corpus."""
    t = (tasks.filter(F.col("type") == "api_upgrade")
         .select("task_id", TX.api_name("old_api").alias("old_func"), TX.api_name("new_api").alias("new_func"))
         .join(_long(truth, "callsites", ["file", "needs_upgrade"]), "task_id"))
    return _with_content(t, files).select(*t.columns, *[e.alias(c) for c, e in api_check(boundary)(F.col("content")).items()])


def api_task_checks(tasks: DataFrame, truth: DataFrame, files: DataFrame, boundary: str = "unicode") -> DataFrame:
    """A14 per task; callsites in missing files stay in the denominators."""
    return _api_totals(api_file_checks(tasks, truth, files, boundary))


def _api_totals(per_file: DataFrame) -> DataFrame:
    return per_file.groupBy("task_id").agg(
        F.count("file").cast("int").alias("total_callsites"),
        F.count_if(F.col("file").isNotNull() & F.coalesce(F.col("needs_upgrade"), F.lit(False))).cast("int").alias("expected_upgrades"),
        F.sum("actual_upgrades").cast("int").alias("actual_upgrades"),
        F.sum("preserved_legacy").cast("int").alias("preserved_legacy"))


def score_api(attempts: DataFrame, tasks: DataFrame, truth: DataFrame, files: DataFrame,
              submissions: DataFrame, boundary: str = "unicode", changed: DataFrame | None = None) -> DataFrame:
    t = tasks.filter(F.col("type") == "api_upgrade").select(
        "task_id", "type", "ground_truth", "old_api", "new_api",
        TX.api_name(F.coalesce("old_api", F.lit(""))).alias("old_func"),
        TX.api_name(F.coalesce("new_api", F.lit(""))).alias("new_func"))
    per_file = api_file_checks(tasks, truth, files, boundary)
    if changed is not None:
        per_file = cut_lineage(per_file)
    per_task = (t.join(truth.select("task_id").distinct().withColumn("_has_truth", F.lit(True)), "task_id", "left")
                .join(_api_totals(per_file), "task_id", "left"))
    a = attempts.join(per_task, "task_id").join(submissions, "submission_id", "left")
    if changed is not None:
        a = a.join(OV.deltas(per_file, attempts, changed, api_check(boundary)), ["submission_id", "task_id"], "left").withColumns(
            {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0)) for c in ("actual_upgrades", "preserved_legacy")})
    applied = F.coalesce(F.col("patch_applied"), F.lit(False))
    no_truth = applied & F.col("_has_truth").isNull()
    no_api = applied & ~no_truth & ((F.coalesce("old_api", F.lit("")) == "") | (F.coalesce("new_api", F.lit("")) == ""))
    no_func = applied & ~no_truth & ~no_api & ((F.col("old_func") == "") | (F.col("new_func") == ""))
    error = ~applied | no_truth | no_api | no_func
    total = F.coalesce("total_callsites", F.lit(0))
    expected = F.coalesce("expected_upgrades", F.lit(0))
    actual = F.coalesce("actual_upgrades", F.lit(0))
    preserved = F.coalesce("preserved_legacy", F.lit(0))
    up_acc = TX.ratio_safe(actual, expected)
    raw = up_acc * 0.7 + TX.ratio_safe(preserved, total - expected) * 0.3
    score = F.when(error, F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))
    details = F.struct(total.alias("total_callsites"), expected.alias("expected_upgrades"),
                       actual.alias("actual_upgrades"), up_acc.alias("upgrade_accuracy"),
                       preserved.alias("preserved_legacy"), error.alias("error"))
    errors = _errors((~applied, F.lit("No patch was applied")),
                     (no_truth, F.concat(F.lit("Ground truth file not found: "), F.coalesce("ground_truth", F.lit("")))),
                     (no_api, F.lit("Missing API definitions in task")),
                     (no_func, F.lit("Could not extract function names from API signatures")))
    return _out(a, score, details, errors)


# ------------------------------------------------------------------------ C4

def line_range_text(content: F.Column, first: F.Column, last: F.Column) -> F.Column:
    """the lines ``first`` to ``last`` (from 1) of a text, joined."""
    lines = TX.split_lines(content)
    n = F.size(lines) - F.when(content.endswith("\n"), 1).otherwise(0)
    start = F.greatest(first - 1, F.lit(0))
    end = F.least(n, last)
    return F.array_join(F.when(end > start, F.slice(lines, start + 1, end - start)).otherwise(F.array().cast("array<string>")), "\n")


def bug_check(content: F.Column) -> dict:
    """whether the expected lines of the expected file, joined and
    lower-cased, hold a fix pattern."""
    text = line_range_text(content, F.try_element_at("lr", F.lit(1)), F.try_element_at("lr", F.lit(2)))
    return {"fix_found": F.coalesce((F.size("lr") >= 2) & SC.has_fix_pattern(F.lower(text)), F.lit(False)).cast("int")}


def bug_fix_checks(truth: DataFrame, files: DataFrame) -> DataFrame:
    """J6 per task on the corpus."""
    b = truth.select("task_id", F.col("bug_location.file").alias("file"),
                     F.col("bug_location.line_range").alias("lr"))
    return _with_content(b, files).select(*b.columns, *[e.alias(c) for c, e in bug_check(F.col("content")).items()])


def score_bug(attempts: DataFrame, tasks: DataFrame, truth: DataFrame, files: DataFrame,
              submissions: DataFrame, texts: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    t = tasks.filter(F.col("type") == "bug_localization").select("task_id", "type", "ground_truth")
    per_file = bug_fix_checks(truth, files)
    if changed is not None:
        per_file = cut_lineage(per_file)
    per_task = (t.join(truth.select("task_id", F.col("bug_location.file").alias("exp_file"),
                                    F.col("bug_location.line_range").alias("lr"))
                       .withColumn("_has_truth", F.lit(True)), "task_id", "left")
                .join(per_file.select("task_id", "fix_found"), "task_id", "left"))
    a = (attempts.join(per_task, "task_id").join(submissions, "submission_id", "left")
         .join(texts.filter(F.col("kind") == "bug").select("submission_id", "text"), "submission_id", "left"))
    if changed is not None:
        a = a.join(OV.deltas(per_file, attempts, changed, bug_check), ["submission_id", "task_id"], "left").withColumn(
            "fix_found", F.coalesce("fix_found", F.lit(0)) + F.coalesce("d_fix_found", F.lit(0)))
    a = a.withColumn("fix_found", F.coalesce("fix_found", F.lit(0)) > 0)
    applied = F.coalesce(F.col("patch_applied"), F.lit(False))
    no_truth = F.col("_has_truth").isNull()
    no_file = ~no_truth & (F.coalesce("exp_file", F.lit("")) == "")
    error = no_truth | no_file
    text = F.coalesce(F.col("text"), F.lit(""))
    file_score = F.when(SC.mentions_file_bug(text, F.col("exp_file")), 1.0).otherwise(0.0)
    has_lr = F.coalesce(F.size("lr"), F.lit(0)) >= 2
    loc = F.when(has_lr, SC.line_band(text, F.try_element_at("lr", F.lit(1)), F.try_element_at("lr", F.lit(2)))).otherwise(F.lit(0.0))
    fix = F.when(applied & F.coalesce("fix_found", F.lit(False)), 1.0).otherwise(0.0)
    raw = file_score * 0.4 + loc * 0.3 + fix * 0.3
    score = F.when(error, F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))
    ne = ~error
    details = F.struct((ne & (file_score > 0)).alias("correct_file"), (ne & (loc > 0.5)).alias("correct_line_range"),
                       (ne & applied & F.coalesce("fix_found", F.lit(False))).alias("fix_applied"),
                       F.when(ne, file_score).otherwise(0.0).alias("file_score"),
                       F.when(ne, loc).otherwise(0.0).alias("location_score"),
                       F.when(ne, fix).otherwise(0.0).alias("fix_score"), error.alias("error"))
    errors = _errors((no_truth, F.concat(F.lit("Ground truth file not found: "), F.coalesce("ground_truth", F.lit("")))),
                     (no_file, F.lit("No expected bug file in ground truth")))
    return _out(a, score, details, errors)


# ------------------------------------------------------------------- C5/R7

SCORERS: dict[str, Callable[..., DataFrame]] = {}


def register_scorer(task_type: str, fn: Callable[..., DataFrame]) -> None:
    """``fn(ctx) -> task_scores rows`` for one task type."""
    SCORERS[task_type] = fn


register_scorer("cross_file_reasoning", lambda c: score_cross_file(c["attempts"], c["tasks"], c["truth_paths"], c["texts"]))
register_scorer("refactor_rename", lambda c: score_rename(c["attempts"], c["tasks"], c["truth_renames"], c["files"],
                                                          c["submissions"], c.get("boundary", "unicode"),
                                                          c.get("all_files"), c.get("changed")))
register_scorer("api_upgrade", lambda c: score_api(c["attempts"], c["tasks"], c["truth_callsites"], c["files"],
                                                   c["submissions"], c.get("boundary", "unicode"), c.get("changed")))
register_scorer("bug_localization", lambda c: score_bug(c["attempts"], c["tasks"], c["truth_bugs"], c["files"],
                                                        c["submissions"], c["texts"], c.get("changed")))


def score_all(ctx: dict) -> DataFrame:
    """C5 + J10: every attempt gives one row; a task type without a scorer
    gives a zero row with an error (U5)."""
    parts = [fn(ctx) for fn in SCORERS.values()]
    known = list(SCORERS)
    unknown = (ctx["attempts"].join(ctx["tasks"].select("task_id", "type"), "task_id")
               .filter(~F.coalesce(F.col("type"), F.lit("")).isin(known)))
    u = unknown.select("submission_id", "task_id", "type", F.lit(0.0).alias("score"), F.lit(1.0).alias("max_score"),
                       F.to_json(F.struct(F.concat(F.lit("Unknown task type: "), F.coalesce("type", F.lit("")))
                                          .alias("error"))).alias("details"),
                       F.array(F.concat(F.lit("No scorer for task type: "), F.coalesce("type", F.lit("")))).alias("errors"))
    out = u
    for p in parts:
        out = out.unionByName(p)
    return out.select(*SCORE_COLUMNS)


# ------------------------------------------------------------------- C6

def report(task_scores: DataFrame, tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """C6/A17/A18/D1/D2 per submission: weighted overall score, error count,
    band (of the rounded score that is shown: a sum's last digit depends on the
    order of its rows), and the overall score after the documented overtime
    penalty."""
    s = (task_scores.join(tasks.select("task_id", "max_time_minutes"), "task_id", "left")
         .join(submissions.select("submission_id", "elapsed_minutes"), "submission_id", "left"))
    w = SC.task_weight("task_id")
    pen = F.when(F.col("max_time_minutes").isNull() | F.col("elapsed_minutes").isNull(), F.lit(1.0)) \
        .otherwise(SC.overtime_factor("elapsed_minutes", F.col("max_time_minutes").cast("double")))
    agg = s.groupBy("submission_id").agg(
        F.sum(F.col("score") * w).alias("ws"), F.sum(w).alias("wsum"),
        F.sum(F.col("score") * pen * w).alias("wps"),
        F.count(F.lit(1)).alias("tasks_scored"),
        F.sum(F.size("errors")).cast("long").alias("errors"))
    # a submission without tasks has a report of its own: nothing scored, nothing wrong
    agg = agg.join(submissions.select("submission_id").distinct(), "submission_id", "full_outer").fillna(
        0, ["ws", "wsum", "wps", "tasks_scored", "errors"])
    overall = F.when(F.col("wsum") > 0, F.col("ws") / F.col("wsum")).otherwise(F.lit(0.0))
    adjusted = F.when(F.col("wsum") > 0, F.col("wps") / F.col("wsum")).otherwise(F.lit(0.0))
    return agg.select("submission_id", F.round(overall, 9).alias("overall_score"),
                      F.round(adjusted, 9).alias("adjusted_score"), "tasks_scored", "errors",
                      (F.col("errors") == 0).alias("success"), SC.performance_band(F.round(overall, 9)).alias("band"))


def report_json(task_scores: DataFrame, tasks: DataFrame, submissions: DataFrame) -> DataFrame:
    """One JSON document per submission (results nested, bounded by the
    tasks of that submission)."""
    rows = task_scores.groupBy("submission_id").agg(
        F.sort_array(F.collect_list(F.struct("task_id", "type", "score", "max_score", "details", "errors")))
        .alias("results"))
    rep = report(task_scores, tasks, submissions)
    return rep.join(rows, "submission_id").select(
        "submission_id", F.to_json(F.struct(*[c for c in rep.columns], "results")).alias("json"))


# ------------------------------------------------------------------ D3-D6

def _d(name: str, typ: str = "double") -> F.Column:
    return F.get_json_object("details", f"$.{name}").cast(typ)


def document_rules(task_scores: DataFrame, ctx: dict | None = None) -> DataFrame:
    """The rules document's formulas, next to the engine's score.

    D3 cross-file: correct steps / all steps.  D4 rename: updated / total x
    cleanliness (1.0 clean, 0.8 when false positives were found, 0.5 when the
    code does not compile).  D5 upgrade: upgraded / expected, -10 % per legacy
    callsite that was upgraded anyway, -50 % when the submission's code does not
    compile (needs ``ctx``; signature checks are not observable and give no
    deduction).  D6 bug:
    0.4 file + 0.3 location + 0.3 diagnosis, diagnosis 1.0 when the answer
    names the root cause, 0.5 when it names one of its words (> 3 letters).
    """
    t = task_scores
    broken = F.lit(0.0)
    if ctx is not None and "submissions" in ctx:
        t = t.join(ctx["submissions"].select("submission_id", F.col("compile_ok").alias("_compiles")), "submission_id", "left")
        broken = F.when(F.coalesce("_compiles", F.lit(False)), 0.0).otherwise(0.5)
    rename = (_d("correctly_modified") / F.greatest(_d("files_checked"), F.lit(1.0))) * \
        F.when(~_d("compilation_success", "boolean"), 0.5).when(_d("false_positives") > 0, 0.8).otherwise(1.0)
    wrong = F.greatest(_d("total_callsites") - _d("expected_upgrades") - _d("preserved_legacy"), F.lit(0.0))
    api = _d("actual_upgrades") / F.greatest(_d("expected_upgrades"), F.lit(1.0)) - wrong * 0.1 - broken
    doc = (F.when(F.col("type") == "cross_file_reasoning", _d("call_chain_accuracy"))
           .when(F.col("type") == "refactor_rename", rename)
           .when(F.col("type") == "api_upgrade", api))
    out = t.withColumn("document_score", F.when(F.size("errors") > 0, F.lit(0.0)).otherwise(SC.clamp01(doc)))
    if ctx is not None and "truth_bugs" in ctx:
        diag = _diagnosis(ctx)
        out = out.join(diag, ["submission_id", "task_id"], "left").withColumn(
            "document_score",
            F.when(F.size("errors") > 0, F.lit(0.0))
            .when(F.col("type") == "bug_localization",
                   SC.clamp01(_d("file_score") * 0.4 + _d("location_score") * 0.3
                              + F.coalesce("diagnosis", F.lit(0.0)) * 0.3))
            .otherwise(F.col("document_score"))).drop("diagnosis")
    return out.drop("_compiles").withColumn("document_score", F.round("document_score", 12))


def _diagnosis(ctx: dict) -> DataFrame:
    b = ctx["truth_bugs"].select("task_id", F.lower(F.col("bug_location.root_cause")).alias("rc"))
    a = (ctx["attempts"].join(b, "task_id")
         .join(ctx["texts"].filter(F.col("kind") == "bug").select("submission_id", F.lower("text").alias("low")),
               "submission_id", "left"))
    low = F.coalesce(F.col("low"), F.lit(""))
    words = F.filter(F.split("rc", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    grade = (F.when((F.col("rc") != "") & low.contains(F.col("rc")), 1.0)
             .when(F.exists(words, lambda w: low.contains(w)), 0.5).otherwise(0.0))
    return a.select("submission_id", "task_id", grade.alias("diagnosis"))
