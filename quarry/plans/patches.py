"""Patches and citing answers for the test data.

The driver tables hold no patches, so each submission's own files and the
places its answers name are derived from its attempts: a hash of
(submission, task, file) says whether a file of the task's truth stays, is
changed (in a way that helps or harms the score) or is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as TX
from quarry.operators import sampling as S
from quarry.operators.joins import bounded_broadcast

SEED = 42
FIXED_LINE = "if (x == null) return; "


def _choice(op: str, n: int, *keys: str) -> Column:
    return F.pmod(S.hash_int(S.hash_key(SEED, op, *keys), 1, 12), F.lit(n))


def _edits(rows: DataFrame, files: DataFrame, kind: str, **args: Column) -> DataFrame:
    """(submission_id, path, edit) of the files that a submission changes: what
    ``apply_edit`` does there, without the text."""
    v = rows.withColumn("v", _choice("patch", 4, "submission_id", "task_id", "path")).filter("v > 0")
    held = bounded_broadcast(files.select("path").distinct())
    field = lambda name, typ: args.get(name, F.lit(None)).cast(typ).alias(name)
    edit = F.struct(F.col("task_id").alias("layer"), "v", F.lit(kind).alias("kind"), field("old", "string"), field("new", "string"), field("first", "int"))
    return v.join(held, "path", "left_semi").select("submission_id", "path", edit.alias("edit"))


def rename_edits(attempts: DataFrame, truth: DataFrame, files: DataFrame) -> DataFrame:
    """Helps nothing: the rename undone, or another comment with the new name."""
    rows = attempts.join(truth.filter("file is not null").select("task_id", F.col("file").alias("path"), "old", "new"), "task_id")
    return _edits(rows, files, "rename", old=F.col("old"), new=F.col("new"))


def api_edits(attempts: DataFrame, tasks: DataFrame, truth: DataFrame, files: DataFrame) -> DataFrame:
    """Calls moved to the new function, wanted or not."""
    names = tasks.select("task_id", TX.api_name("old_api").alias("old"), TX.api_name("new_api").alias("new"))
    rows = attempts.join(truth.filter("file is not null").select("task_id", F.col("file").alias("path")), "task_id").join(names, "task_id")
    return _edits(rows, files, "api", old=F.col("old"), new=F.col("new"))


def bug_edits(attempts: DataFrame, truth: DataFrame, files: DataFrame) -> DataFrame:
    """A null check in the first line of the range, or an empty file."""
    rows = attempts.join(truth.select("task_id", F.col("bug_location.file").alias("path"), F.col("bug_location.line_range")[0].alias("first")), "task_id")
    return _edits(rows, files, "bug", first=F.col("first"))


def apply_edit(content: Column, edit: Column) -> Column:
    """The edited text: 1 the helpful one, 2 the harmful one, 3 (null) deleted."""
    helps, harms = edit["v"] == 1, edit["v"] == 2
    rename, api, bug = (edit["kind"] == k for k in ("rename", "api", "bug"))
    called = F.concat(F.lit(f"(?<![{TX.ASCII_WORD}])"), TX.quote_regex(edit["old"]), F.lit("\\s*\\("))
    moved = F.regexp_replace(content, called, F.concat(TX.escape_replacement(edit["new"]), F.lit("(")))
    fixed = F.array_join(F.transform(TX.split_lines(content), lambda line, i: F.when(i == edit["first"] - 1, F.concat(F.lit(FIXED_LINE), line)).otherwise(line)), "\n")
    return (F.when(rename & helps, TX.replace_word(content, edit["new"], edit["old"], "ascii"))
            .when(rename & harms, F.concat(content, F.lit("// "), edit["new"], F.lit("\n")))
            .when(api & (helps | harms), moved).when(bug & helps, fixed).when(bug & harms, F.lit("")))


def cited_paths(attempts: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers that name the steps of the call path, or its last one."""
    rows = attempts.join(truth, "task_id").withColumn("v", _choice("cite", 3, "submission_id", "task_id")).filter("v > 0")
    steps = F.col("expected_call_path")
    text = F.when(F.col("v") == 1, F.concat(F.lit("The caller takes the path over "), steps[1], F.lit(" to "), steps[2],
                                            F.lit(", a call flow of function and method; trace the implementation"))).otherwise(F.concat(F.lit("see "), steps[2]))
    return rows.select("submission_id", F.lit(1000).alias("ord"), F.lit("SOLUTION.md").alias("source_name"), text.alias("text"))


def cited_bugs(attempts: DataFrame, truth: DataFrame) -> DataFrame:
    """Answers that name the file and its lines, or lines nearby."""
    rows = attempts.join(truth, "task_id").withColumn("v", _choice("cite", 3, "submission_id", "task_id")).filter("v > 0")
    file, lines = F.col("bug_location.file"), F.col("bug_location.line_range")
    text = F.when(F.col("v") == 1, F.concat(F.lit("lines "), lines[0], F.lit(" to "), lines[1], F.lit(" of "), file, F.lit(" hold a copied passage"))) \
        .otherwise(F.concat(F.lit("near line "), lines[1] + 4, F.lit(" of "), TX.basename(file)))
    return rows.select("submission_id", F.lit(1000).alias("ord"), F.lit("DIAGNOSIS.md").alias("source_name"), text.alias("text"))
