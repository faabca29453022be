"""Submissions' own trees as a sparse overlay over one base corpus.

``changes(submission_id, path, content, layer)`` holds the files that a
submission's patch changes, and nothing else; null content is a deleted file.
Of several changes of one file the one of the highest layer holds.  A file of
a submission's tree is its change if there is one, else the base file: the
most specific row wins.

What a submission does to a file may also be held as an edit of the base's text
(``Edits``): the text is then made where it is read, once for all submissions
with this edit, and is never stored.

No tree is ever built.  What depends on a file alone is computed once on the
base, per task; only files that a submission changed are checked again, and
the difference is added to the task's result for that submission.  The work is
that of the base plus that of the changed files, not submissions x files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scoring as SC
from quarry.functions import text as TX
from quarry.operators.joins import bounded_broadcast, join_small

KEY = ["submission_id", "path"]


def latest(changes: DataFrame) -> DataFrame:
    """One row per (submission_id, path): the change of the highest layer (of
    equal layers the one with the greatest content; a deletion is least)."""
    best = F.max(F.struct("layer", F.col("content").isNotNull().alias("present"), "content")).alias("best")
    return changes.groupBy(*KEY).agg(best).select(*KEY, F.col("best.content").alias("content"))


class Held:
    """Changes that hold their own text."""

    def __init__(self, changed: DataFrame):
        mine = changed.withColumn("edit", F.struct("submission_id"))
        self.rows, self._texts = mine.select(*KEY, "edit"), mine.select("path", "edit", "content")

    def contents(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self._texts, ["path", "edit"])


class Edits:
    """Changes as edits of base texts: ``edits(submission_id, path, edit)``, of
    several edits of one file the greatest holds (its first field is the layer).
    ``render(content, edit)`` is the text, null where the edit deletes the file;
    where several base rows have one path, the greatest of their texts."""

    def __init__(self, edits: DataFrame, base: DataFrame, render: Callable[[Column, Column], Column]):
        self.rows = _kept(edits.groupBy(*KEY).agg(F.max("edit").alias("edit")))
        self._base, self._render = base, render

    def contents(self, wanted: DataFrame) -> DataFrame:
        held = self._base.groupBy("path").agg(F.collect_set(F.struct("content")).alias("_held"))
        def made(row):
            text = self._render(row["content"], F.col("edit"))
            return F.struct(text.isNotNull().alias("present"), text.alias("content"))
        return wanted.join(held, "path").withColumn("content", F.array_max(F.transform("_held", made))["content"]).drop("_held")


Changed = DataFrame | Held | Edits


def _changed(changed: Changed) -> Held | Edits:
    """``rows(submission_id, path, edit)`` without texts; ``contents`` gives
    rows with a path and an edit their ``content``."""
    return Held(changed) if isinstance(changed, DataFrame) else changed


def resolve(wanted: DataFrame, base: DataFrame, changed: DataFrame) -> DataFrame:
    """``wanted(submission_id, path, ...)`` with the ``content`` of the
    submission's tree (null: no such file) and ``origin`` (own, base, none).
    Only rows without a change meet the base."""
    own = changed.select(*KEY, F.col("content").alias("own_content"), F.lit(True).alias("own"))
    rows = wanted.join(own, KEY, "left")
    mine = rows.filter("own").withColumn("content", F.col("own_content")).withColumn("origin", F.lit("own"))
    need = rows.filter("own is null")
    held = join_small(base.select("path", "content"), need.select("path").distinct(), "path", "left_semi")
    rest = need.join(held, "path", "left").withColumn("origin", F.when(F.col("content").isNull(), "none").otherwise("base"))
    cols = [*wanted.columns, "content", "origin"]
    return mine.select(*cols).unionByName(rest.select(*cols))


def deltas(per_file: DataFrame, attempts: DataFrame, changed: Changed,
           check: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(submission_id, task_id, d_<counter>...): how the sums of the counters
    over a task's files differ in the submission's tree from the base.

    ``per_file(task_id, file, ..., <counter>...)`` are the base results;
    ``check(content)`` computes the same counters from a file's text and the
    other columns.  Changes meet the files of tasks by path, then the attempts;
    each edit that met a task is checked once, for all submissions that share it."""
    changed = _changed(changed)
    counters = list(check(F.lit("")))
    base = per_file.withColumnsRenamed({c: f"base_{c}" for c in counters}).withColumnRenamed("file", "path")
    inputs = [c for c in base.columns if c not in {f"base_{c}" for c in counters}]
    hit = (changed.rows.join(base.filter("path is not null"), "path").join(attempts, ["submission_id", "task_id"], "left_semi")
           .select("submission_id", "task_id", F.struct("edit", *inputs).alias("what"), *[f"base_{c}" for c in counters]))
    made = changed.contents(hit.select("what").distinct().select("what", "what.*"))
    checked = made.select("what", *[e.alias(f"new_{c}") for c, e in check(F.col("content")).items()])
    new = hit.join(checked, "what")
    return new.groupBy("submission_id", "task_id").agg(
        *[F.sum(F.col(f"new_{c}") - F.col(f"base_{c}")).cast("int").alias(f"d_{c}") for c in counters])


# ------------------------------------------------------- the grep of C2

def _flags(lines: DataFrame, keys: list[str], first_n: int) -> DataFrame:
    """Per file the first ``first_n`` hit lines as noise flags, in order."""
    w = Window.partitionBy(*keys, "path").orderBy("line_no")
    top = lines.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first_n)
    return top.groupBy(*keys, "path").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", SC.noise_line("path", "line").alias("noise")))), lambda x: x["noise"]).alias("flags"))


def _own_flags(content: str, name: str, path: str, first_n: int) -> Column:
    """``_flags`` of one text."""
    hits = F.slice(F.filter(TX.split_lines(content), lambda line: line.contains(F.col(name))), 1, first_n)
    return F.transform(hits, lambda line: SC.noise_line(path, line))


def rename_noise(tasks: DataFrame, base_lines: DataFrame, attempts: DataFrame, changed: Changed,
                 first_n: int = 50, cap: int = 10) -> DataFrame:
    """(submission_id, task_id, own_false_positives) of the attempts whose
    submission changes a file with a hit, before or after: A13 over its tree.

    ``base_lines(task_id, path, line_no, line)`` are the hits of the base.  A
    file counts by its first ``first_n`` hits; of the base's files a tree needs
    the first ``first_n`` and as many more as it replaces.  Each edit is searched
    once for all names that a submission with it looks for."""
    changed = _changed(changed)
    names = tasks.select("task_id", "new_name").filter(F.trim("new_name") != "")
    mine = attempts.join(names, "task_id").select("submission_id", "task_id", "new_name")
    files = changed.rows.filter(TX.basename("path").rlike(r"\.(go|py|cpp)$"))
    base = _flags(base_lines, ["task_id"], first_n)
    # a changed file meets the names of its submission's tasks
    sought = files.join(mine, "submission_id").select("submission_id", "task_id", F.struct("path", "edit").alias("what"), "new_name")
    wanted = sought.groupBy("what").agg(F.collect_set("new_name").alias("names")).select("what.*", "names")
    found = (changed.contents(wanted).filter("content is not null").select("path", "edit", "content", F.explode("names").alias("new_name"))
             .filter(F.col("content").contains(F.col("new_name")))
             .select(F.struct("path", "edit").alias("what"), "new_name", _own_flags("content", "new_name", "path", first_n).alias("flags"))
             .filter(F.size("flags") > 0))
    own = sought.join(found, ["what", "new_name"]).select("submission_id", "task_id", "what.path", "flags")
    replaced = files.select(*KEY).join(base.select("task_id", "path"), "path").join(mine.select("submission_id", "task_id"), ["submission_id", "task_id"], "left_semi")
    own, replaced = _kept(own), _kept(replaced)
    affected = (own.select("submission_id", "task_id").unionByName(replaced.select("submission_id", "task_id")).distinct()
                .join(replaced.groupBy("submission_id", "task_id").agg(F.count(F.lit(1)).alias("gone")), ["submission_id", "task_id"], "left")
                .fillna(0, ["gone"]))
    most = first_n + (affected.agg(F.max("gone")).first()[0] or 0)
    by_path = Window.partitionBy("task_id").orderBy("path")
    near = base.withColumn("_f", F.row_number().over(by_path)).filter(F.col("_f") <= most)
    kept = (near.join(affected, "task_id").filter(F.col("_f") <= F.col("gone") + first_n)
            .join(replaced, ["submission_id", "task_id", "path"], "left_anti").select("submission_id", "task_id", "path", "flags"))
    before = Window.partitionBy("submission_id", "task_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    tree = kept.unionByName(own).withColumn("_before", F.coalesce(F.sum(F.size("flags")).over(before), F.lit(0)))
    part = F.slice("flags", F.lit(1), F.greatest(F.lit(first_n) - F.col("_before"), F.lit(0)).cast("int"))
    n = tree.groupBy("submission_id", "task_id").agg(F.sum(F.size(F.filter(part, lambda x: x))).alias("n"))
    return affected.join(n, ["submission_id", "task_id"], "left").select(
        "submission_id", "task_id", F.least(F.coalesce("n", F.lit(0)), F.lit(cap)).cast("int").alias("own_false_positives"))


def _kept(df: DataFrame) -> DataFrame:
    from quarry.session import cut_lineage
    return cut_lineage(df)


def tree_summary(base: DataFrame, changed: Changed) -> DataFrame:
    """Per submission: files it modifies, adds and deletes (a change that
    equals the base counts as none), from paths and digests only."""
    changed = _changed(changed)
    of = F.struct("path", "edit").alias("what")
    digests = changed.contents(changed.rows.select("path", "edit").distinct()).select(of, F.sha2("content", 256).alias("own_sha"))
    mine = changed.rows.select(*KEY, of).join(digests, "what").select(*KEY, "own_sha")
    need = bounded_broadcast(mine.select("path").distinct())
    held = base.select("path", "sha").join(need, "path", "left_semi")
    rows = mine.join(held, "path", "left")
    return rows.groupBy("submission_id").agg(
        F.count_if(F.col("own_sha") != F.col("sha")).alias("modified"),
        F.count_if(F.col("sha").isNull() & F.col("own_sha").isNotNull()).alias("added"),
        F.count_if(F.col("sha").isNotNull() & F.col("own_sha").isNull()).alias("deleted"))
