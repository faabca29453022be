"""Loading the driver tables and the corpus views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.plans.registry import prose_extractors
from quarry.sources import corpus as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return C.load_table(spark, sf_dir, name)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_files(C.load_spread(spark, sf_dir, "documents"))


def prose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prose_files(C.load_spread(spark, sf_dir, "documents"))


def code_symbols(spark: SparkSession, sf_dir: str, files: DataFrame | None = None) -> DataFrame:
    return IX.extract_symbols(files if files is not None else code_files(spark, sf_dir))


def prose_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IX.extract_symbols(prose_files(spark, sf_dir), prose_extractors())


#: Columns of the truth of a task kind that is not loaded.
_NO_TRUTH = {
    "cross_file_reasoning": "task_id string, expected_call_path array<string>, expected_implementation_file string, "
                            "expected_line_range array<int>",
    "refactor_rename": "task_id string, file string, line int, old string, new string",
    "api_upgrade": "task_id string, file string, line int, needs_upgrade boolean, old_call string, "
                   "new_call string, reason string, total_callsites int, expected_upgrades int",
    "bug_localization": "task_id string, bug_location struct<file:string,line_range:array<int>,root_cause:string,"
                        "fix_description:string>",
}
_TRUTHS = {"truth_paths": "cross_file_reasoning", "truth_renames": "refactor_rename", "truth_callsites": "api_upgrade",
           "truth_bugs": "bug_localization"}


class ScoringContext(dict):
    """Tasks, truths, answers and the after-patch corpus derived from the
    driver tables (see ``operators.tasks``); each is made when it is first
    read, once, so a job stores only what it reads.

    The after-patch corpus is the code view with the T2 renames applied; all
    records use the index built before the rename (X13).  ``patched`` gives the
    submissions trees of their own over it (``plans.patches``); ``placed`` gives
    the truth the lines of declarations and calls."""

    def __init__(self, spark: SparkSession, sf_dir: str, boundary: str, files: DataFrame | None, symbols: DataFrame | None,
                 kinds: list[str] | None, patched: bool, placed: bool):
        super().__init__(boundary=boundary)
        self.spark, self.sf_dir, self.patched, self.placed = spark, sf_dir, patched, placed
        self.kinds = kinds or list(_NO_TRUTH)
        if files is not None:
            self["corpus"] = files
        if symbols is not None:
            self["symbols"] = symbols

    def __contains__(self, key) -> bool:
        return super().__contains__(key) or hasattr(self, f"_{key}")

    def get(self, key, default=None):
        return self[key] if key in self else default

    def __missing__(self, key):
        from quarry.session import cut_lineage
        made = getattr(self, f"_{key}")()
        self[key] = made if key in ("corpus", "records", "changes", "changed") else cut_lineage(made) if made is not None else None
        return self[key]

    def _corpus(self):
        return code_files(self.spark, self.sf_dir)

    def _symbols(self):
        return IX.extract_symbols(self["corpus"])

    def _placed(self):
        """Lines of the declarations, None where the truth needs none."""
        return IX.first_declarations(IX.declarations(self["corpus"])) if self.placed else None

    def _renamed(self):
        from quarry.operators import transforms as TR
        return TR.rename_symbols(self["corpus"], self["symbols"], p=0.05, seed=42, mode="word", boundary=self["boundary"])

    def _records(self) -> dict:
        """kind -> (tasks, truth)"""
        from quarry.operators import tasks as TK
        from quarry.operators import transforms as TR
        from quarry.session import cut_lineage
        files, parts = self["corpus"], {}
        if "cross_file_reasoning" in self.kinds:
            parts["cross_file_reasoning"] = TK.cross_file_tasks(cut_lineage(TR.add_wrappers(files, self["symbols"], n=8, seed=42).record))
        if "refactor_rename" in self.kinds:
            parts["refactor_rename"] = TK.rename_tasks(self._renamed().record, self["symbols"], self.get("placed"))
        if "api_upgrade" in self.kinds:
            mig = TR.migrate_api(files, self["symbols"], n=10, fraction=0.6, seed=42)
            parts["api_upgrade"] = TK.api_tasks(cut_lineage(mig.record), cut_lineage(mig.details), self["symbols"],
                                                   files if self.placed else None)
        if "bug_localization" in self.kinds:
            loc = cut_lineage(TK.passage_locations(table(self.spark, self.sf_dir, "benchmark"), prose_files(self.spark, self.sf_dir)))
            parts["bug_localization"] = TK.bug_tasks_from_locations(loc)
        return parts

    def _tasks(self):
        first, *rest = [t for t, _ in self["records"].values()]
        for t in rest:
            first = first.unionByName(t)
        return first

    def _truth(self, kind: str):
        if kind in self["records"]:
            return self["records"][kind][1]
        return self.spark.createDataFrame([], _NO_TRUTH[kind])

    def _truth_paths(self):
        return self._truth("cross_file_reasoning")

    def _truth_renames(self):
        return self._truth("refactor_rename")

    def _truth_callsites(self):
        return self._truth("api_upgrade")

    def _truth_bugs(self):
        return self._truth("bug_localization")

    def _submissions(self):
        from quarry.operators import tasks as TK
        return TK.submissions_from_conversations(C.load_spread(self.spark, self.sf_dir, "conversations"))

    def _attempts(self):
        from quarry.operators import tasks as TK
        return TK.attempts_for(self["submissions"], self["tasks"])

    def _texts(self):
        from quarry.operators import scoring as SCO
        from quarry.operators import tasks as TK
        from quarry.plans import patches as PA
        at = TK.agent_text_from_conversations(C.load_spread(self.spark, self.sf_dir, "conversations"))
        if self.patched:
            at = (at.unionByName(PA.cited_paths(self["attempts"], self["truth_paths"]))
                  .unionByName(PA.cited_bugs(self["attempts"], self["truth_bugs"])))
        return SCO.answer_text(at, "reasoning").unionByName(SCO.answer_text(at, "bug"))

    def _all_files(self):
        return self._renamed().files

    def _files(self):
        """The slice of the corpus any truth row points at: one size-checked
        semi-join for all scorers instead of one corpus lookup per scorer."""
        from quarry.operators.joins import join_small
        needed = (self["truth_renames"].select(F.col("file").alias("path"))
                  .unionByName(self["truth_callsites"].select(F.col("file").alias("path")))
                  .unionByName(self["truth_bugs"].select(F.col("bug_location.file").alias("path")))
                  .filter(F.col("path").isNotNull()).distinct())
        after = self["all_files"] if "refactor_rename" in self.kinds else self._renamed().files
        return join_small(after, needed, "path", "left_semi")

    def _changes(self):
        """Edits of all submissions, None without trees of their own."""
        from quarry.plans import patches as PA
        if not self.patched:
            return None
        made = (PA.rename_edits(self["attempts"], self["truth_renames"], self["files"])
                .unionByName(PA.bug_edits(self["attempts"], self["truth_bugs"], self["files"])))
        if "api_upgrade" in self.kinds:
            made = made.unionByName(PA.api_edits(self["attempts"], self["tasks"], self["truth_callsites"], self["files"]))
        return made

    def _changed(self):
        from quarry.operators import overlay as OV
        from quarry.plans import patches as PA
        return OV.Edits(self["changes"], self["files"], PA.apply_edit) if self.patched else None


def scoring_context(spark: SparkSession, sf_dir: str, boundary: str = "ascii",
                    files: DataFrame | None = None, symbols: DataFrame | None = None,
                    kinds: list[str] | None = None, patched: bool = False, placed: bool = False) -> ScoringContext:
    return ScoringContext(spark, sf_dir, boundary, files, symbols, kinds, patched, placed)
