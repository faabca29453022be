"""Task and ground-truth generation (T8, S12, A10) and the test-data answers.

Tasks are derived from the transform records instead of being constants:
wrapper layers -> cross-file tasks, rename map -> rename tasks, API
migrations -> upgrade tasks, and passages located in the corpus -> bug
localisation tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import sampling as S
from quarry.operators.index import first_match_line
from quarry.operators.joins import bounded_broadcast, join_small
from quarry.session import cut_lineage

# Fixed per-type settings of the four task kinds (limits in minutes).
TASK_KINDS = {
    "cross_file_reasoning": ("medium", 10),
    "refactor_rename": ("hard", 15),
    "api_upgrade": ("hard", 20),
    "bug_localization": ("expert", 25),
}

TASK_COLUMNS = ["task_id", "type", "goal", "description", "difficulty", "max_time_minutes", "ground_truth",
                "start_symbol", "symbol_to_rename", "new_name", "old_api", "new_api", "error_message", "symptoms"]


def _task(df: DataFrame, kind: str, goal, **cols) -> DataFrame:
    diff, limit = TASK_KINDS[kind]
    out = df.withColumn("type", F.lit(kind)).withColumn("goal", goal) \
        .withColumn("description", goal).withColumn("difficulty", F.lit(diff)) \
        .withColumn("max_time_minutes", F.lit(limit)) \
        .withColumn("ground_truth", F.concat(F.lit("truth/"), F.col("task_id"), F.lit(".json")))
    for c in TASK_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, cols.get(c, F.lit(None).cast("array<string>" if c == "symptoms" else "string")))
    return out.select(*TASK_COLUMNS)


def _tid(kind: str, rank) -> F.Column:
    """``<kind>_NN`` (two digits at least, never truncated)."""
    return F.format_string(kind + "_%02d", F.col(rank).cast("long"))


def cross_file_tasks(wrappers: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = wrappers.withColumn("task_id", _tid("cross_file_reasoning", "rank"))
    tasks = _task(w, "cross_file_reasoning", F.concat(F.lit("Trace the call path of "), F.col("symbol")),
                  start_symbol=F.col("symbol"))
    truth = w.select("task_id",
                     F.array(F.lit("caller"),
                             F.concat(F.col("wrapper_file"), F.lit("::"), F.col("symbol"), F.lit("Wrapper")),
                             F.concat(F.col("original_file"), F.lit("::"), F.col("symbol"))).alias("expected_call_path"),
                     F.col("original_file").alias("expected_implementation_file"),
                     F.array(F.lit(1), F.lit(1)).alias("expected_line_range"))
    return tasks, truth


def rename_tasks(rename_map: DataFrame, symbols: DataFrame, placed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rename tasks and their truth in long form: one row per expected
    change (task_id, file, line, old, new); a task without files keeps one
    row with a NULL file.  ``placed(symbol, path, line)`` gives the lines of
    the declarations, else they are 0."""
    r = rename_map.withColumn("task_id", _tid("refactor_rename", "rank"))
    tasks = _task(r.withColumn("symbol_to_rename", F.col("old")).withColumn("new_name", F.col("new")),
                  "refactor_rename", F.concat(F.lit("Rename "), F.col("old"), F.lit(" to "), F.col("new")))
    definers = symbols.select(F.col("symbol").alias("old"), F.col("path").alias("file")).distinct()
    truth = r.select("task_id", "old", "new").join(definers, "old", "left")
    if placed is None:
        truth = truth.withColumn("line", F.lit(0))
    else:
        at = placed.select(F.col("symbol").alias("old"), F.col("path").alias("file"), "line")
        truth = truth.join(at, ["old", "file"], "left").withColumn("line", F.coalesce("line", F.lit(0)))
    return tasks, truth.select("task_id", "file", "line", "old", "new")


def api_tasks(record: DataFrame, actions: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Upgrade tasks and their truth in long form: one row per callsite
    (task_id, file, line, needs_upgrade, old_call, new_call, reason) plus
    the recorded totals (ignored by the scorer, X14).  With ``files`` the line
    is that of the first call (or declaration) of the symbol in the file, else 0."""
    r = record.withColumn("task_id", _tid("api_upgrade", "rank"))
    tasks = _task(r.withColumn("old_api", F.concat(F.col("symbol"), F.lit("(x)")))
                  .withColumn("new_api", F.concat(F.col("v2_symbol"), F.lit("(x)"))),
                  "api_upgrade", F.concat(F.lit("Move callers of "), F.col("symbol"), F.lit(" to "), F.col("v2_symbol")))
    mig = actions.filter(F.col("action") == "migrate").select("symbol", F.col("path").alias("file"),
                                                              F.lit(True).alias("needs"))
    users = (symbols.select("symbol", F.col("path").alias("file")).distinct()
             .join(F.broadcast(r.select("symbol", "definition_file")), "symbol")   # <= n migrated symbols
             .filter(F.col("file") != F.col("definition_file"))
             .join(mig, ["symbol", "file"], "left"))
    truth = (r.select("task_id", "symbol", "v2_symbol", "total_callsites",
                      F.col("migrated_callsites").alias("expected_upgrades"))
             .join(users.select("symbol", "file", "needs"), "symbol", "left")
             .select("task_id", "file", F.col("symbol"),
                     F.when(F.col("file").isNotNull(), F.coalesce("needs", F.lit(False))).alias("needs_upgrade"),
                     F.concat(F.col("symbol"), F.lit("(x)")).alias("old_call"),
                     F.concat(F.col("v2_symbol"), F.lit("(x)")).alias("new_call"),
                     F.when(F.col("needs").isNotNull(), F.lit("migrated")).otherwise(F.lit("legacy")).alias("reason"),
                     "total_callsites", "expected_upgrades"))
    if files is None:
        placed = truth.withColumn("line", F.lit(0))
    else:
        rows = cut_lineage(truth)            # <= n migrated symbols and their files
        text = join_small(files.select(F.col("path").alias("file"), "content"), rows.select("file").distinct(), "file", "left_semi")
        call = F.concat(F.lit(f"(?<![{TX.ASCII_WORD}])"), TX.quote_regex("symbol"), F.lit("\\s*\\("))
        placed = rows.join(text, "file", "left").withColumn("line", F.coalesce(first_match_line("content", call), F.lit(0)))
    return tasks, placed.select("task_id", "file", "line", *[c for c in truth.columns if c not in ("task_id", "file", "symbol")])


GRAM_WORDS = 8


def _grams(words, n: int) -> F.Column:
    """Distinct hashes of the runs of ``n`` words of an array."""
    last = F.size(words) - F.lit(n)
    return F.when(last >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                                                          lambda i: F.xxhash64(F.slice(words, i + 1, n)))))


def passage_locations(benchmark: DataFrame, prose_files: DataFrame) -> DataFrame:
    """(item_id, path, line_no): the first and the last line of the first
    verbatim occurrence of each benchmark passage in each file that holds it.

    A file that holds a passage holds the runs of its inner words (the first
    and the last word may go on in the file), so passages and files meet in an
    equi-join on hashes of ``GRAM_WORDS`` words (one word where a passage is
    shorter), of each passage by the gram that the fewest files hold; what meets
    is verified on the texts.  Passages without an inner word meet by their
    text itself, as a stated query set.  Null and empty passages are nowhere."""
    words = lambda c: F.split(c, r"\s+", -1)
    b = benchmark.filter(F.length("text") > 0).select("item_id", F.col("text").alias("passage")).distinct()
    inner = words(F.col("passage"))
    b = b.withColumn("inner", F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0))))
    d = prose_files.select("path", words(F.col("content")).alias("words"))
    met = None
    for n, of in ((GRAM_WORDS, F.size("inner") >= GRAM_WORDS), (1, F.size("inner").between(1, GRAM_WORDS - 1))):
        wanted = bounded_broadcast(b.filter(of).select("item_id", "passage", F.explode(_grams(F.col("inner"), n)).alias("gram")))
        found = d.select("path", F.explode(_grams(F.col("words"), n)).alias("gram")).join(wanted, "gram")
        met = found if met is None else met.unionByName(found)
    met = cut_lineage(met.select("item_id", "passage", "gram", "path"))
    rarest = (met.groupBy("item_id", "passage", "gram").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("item_id", "passage").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram")))
    cand = met.join(rarest, ["item_id", "passage", "gram"]).select("item_id", "passage", "path")
    files = prose_files.select("path", "content")
    hit = join_small(files, cand, "path").filter(F.col("content").contains(F.col("passage")))
    short = bounded_broadcast(b.filter(F.size("inner") == 0).select("item_id", "passage"))
    hit = hit.unionByName(files.join(short, F.col("content").contains(F.col("passage"))).select(*hit.columns))
    lines = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    before = F.expr("substring(content, 1, locate(passage, content) - 1)")
    first = hit.select("item_id", "path", (lines(before) + 1).alias("s"), lines(F.col("passage")).alias("k"))
    return first.select("item_id", "path", F.explode(F.array(F.col("s").cast("int"), (F.col("s") + F.col("k")).cast("int"))).alias("line_no"))


def bug_tasks(benchmark: DataFrame, prose_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return bug_tasks_from_locations(passage_locations(benchmark, prose_files))


def bug_tasks_from_locations(loc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One bug task per located passage: the first file (by path) and the
    line range of the passage in it; the other files are related files."""
    first = loc.groupBy("item_id").agg(F.min("path").alias("file"))
    rng = (loc.join(first, ["item_id"]).filter(F.col("path") == F.col("file"))
           .groupBy("item_id", "file").agg(F.min("line_no").alias("s"), F.max("line_no").alias("e")))
    r = rng.withColumn("task_id", _tid("bug_localization", "item_id"))
    tasks = _task(r, "bug_localization", F.concat(F.lit("Locate the passage of item "), F.col("item_id").cast("string")),
                  error_message=F.concat(F.lit("passage "), F.col("item_id").cast("string"), F.lit(" misplaced")))
    truth = r.select("task_id", F.struct(F.col("file"), F.array(F.col("s"), F.col("e")).alias("line_range"),
                                         F.lit("copied passage").alias("root_cause"),
                                         F.lit("remove the copy").alias("fix_description")).alias("bug_location"))
    return tasks, truth


def task_summary(tasks: DataFrame) -> DataFrame:
    """A10: total and distinct types (the id/type list is ``tasks`` itself)."""
    return tasks.agg(F.count(F.lit(1)).alias("total_tasks"), F.countDistinct("type").alias("task_types"))


def truth_target(task_id) -> F.Column:
    """Truth file routed by a substring of the task id; any other task has
    a file of its own, by its id."""
    t = F.col(task_id) if isinstance(task_id, str) else task_id
    return (F.when(t.contains("cross_file"), F.lit("expected_symbol_paths"))
            .when(t.contains("refactor"), F.lit("expected_refactor_targets"))
            .when(t.contains("api_upgrade"), F.lit("expected_api_migration_results"))
            .when(t.contains("bug_localization"), F.lit("expected_bug_locations"))
            .otherwise(t))


# ------------------------------------------------------- test-data answers

def submissions_from_conversations(conversations: DataFrame) -> DataFrame:
    """submissions(submission_id, patch_applied, compile_ok, elapsed_minutes)
    from conversations: a patch exists when an assistant spoke, it compiles
    when the conversation has an even number of turns."""
    return conversations.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("n_assist"), F.count(F.lit(1)).alias("n_turns")) \
        .select(F.col("conv_id").alias("submission_id"), (F.col("n_assist") > 0).alias("patch_applied"),
                (F.pmod(F.col("n_turns"), F.lit(2)) == 0).alias("compile_ok"),
                (F.col("n_turns") * 3.5).alias("elapsed_minutes"))


def agent_text_from_conversations(conversations: DataFrame) -> DataFrame:
    """agent_text: assistant turns are the answer file (REASONING.md for the
    reasoning text, BUG_ANALYSIS.md for the bug text), user turns the commit
    subjects (first line of the turn)."""
    c = conversations.select(F.col("conv_id").alias("submission_id"), F.col("turn").cast("int").alias("ord"), "role", "text")
    files = c.filter(F.col("role") == "assistant")
    commits = c.filter(F.col("role") == "user").select("submission_id", "ord",
                                                       F.lit("commit").alias("source_name"),
                                                       F.substring_index("text", "\n", 1).alias("text"))
    return (files.select("submission_id", "ord", F.lit("REASONING.md").alias("source_name"), "text")
            .unionByName(files.select("submission_id", "ord", F.lit("BUG_ANALYSIS.md").alias("source_name"), "text"))
            .unionByName(commits))


def attempts_for(submissions: DataFrame, tasks: DataFrame, per_submission: int = 3, seed: int = 42) -> DataFrame:
    """attempts(submission_id, task_id): each submission tries
    ``per_submission`` tasks picked by hash slot, and each task is given to one
    submission picked the same way, so that every loaded task is scored.  Both
    are equi-joins on a number, linear in both sides, never a product."""
    n_tasks, n_subs = tasks.count(), submissions.count()
    if n_tasks == 0 or n_subs == 0:
        return submissions.select("submission_id", F.lit(None).cast("string").alias("task_id")).limit(0)

    def numbered(df: DataFrame, key: str, op: str, number: str) -> DataFrame:
        hashed = df.select(key).withColumn("_h", S.hash_key(seed, op, key))
        return S.exact_rank(hashed, [], "_h", [key], bucket_chars=2, rank_col=number, size_col=None).select(number, key)

    def pick(n: int, op: str, *keys) -> F.Column:
        return (F.pmod(S.hash_int(S.hash_key(seed, op, *keys), 1, 12), F.lit(n)) + 1).cast("long")

    slots = submissions.select("submission_id", F.explode(F.sequence(F.lit(0), F.lit(per_submission - 1))).alias("j"))
    tried = (slots.withColumn("task_no", pick(n_tasks, "slot", "submission_id", "j"))
             .join(numbered(tasks, "task_id", "task", "task_no"), "task_no"))
    given = (tasks.select("task_id", pick(n_subs, "turn", "task_id").alias("sub_no"))
             .join(numbered(submissions, "submission_id", "submission", "sub_no"), "sub_no"))
    return tried.select("submission_id", "task_id").unionByName(given.select("submission_id", "task_id")).distinct()
