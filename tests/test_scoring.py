import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as SC
from quarry.operators import scoring as SCO
from quarry.operators.tasks import TASK_COLUMNS
from tests.conftest import files_df

TASK_SCHEMA = ", ".join(f"{c} {'array<string>' if c == 'symptoms' else ('int' if c == 'max_time_minutes' else 'string')}"
                        for c in TASK_COLUMNS)


def _tasks(spark, rows):
    full = [tuple(r.get(c) for c in TASK_COLUMNS) for r in rows]
    return spark.createDataFrame(full, TASK_SCHEMA)


def _ctx(spark, tasks, subs, attempts, texts=(), files=(), paths=(), renames=(), callsites=(), bugs=()):
    return {
        "tasks": _tasks(spark, tasks),
        "submissions": spark.createDataFrame(subs, "submission_id string, patch_applied boolean, compile_ok boolean, elapsed_minutes double"),
        "attempts": spark.createDataFrame(attempts, "submission_id string, task_id string"),
        "texts": spark.createDataFrame(list(texts), "submission_id string, kind string, text string"),
        "files": files_df(spark, list(files)) if files else files_df(spark, [("src/r/none.go", "")]),
        "truth_paths": spark.createDataFrame(list(paths), "task_id string, expected_call_path array<string>, "
                                             "expected_implementation_file string, expected_line_range array<int>"),
        "truth_renames": spark.createDataFrame(list(renames), "task_id string, files_to_modify array<string>, "
                                               "expected_changes array<struct<file:string,line:int,old:string,new:string>>"),
        "truth_callsites": spark.createDataFrame(list(callsites), "task_id string, total_callsites int, expected_upgrades int, "
                                                 "callsites array<struct<file:string,line:int,needs_upgrade:boolean,old_call:string,new_call:string,reason:string>>"),
        "truth_bugs": spark.createDataFrame(list(bugs), "task_id string, bug_location struct<file:string,line_range:array<int>,"
                                            "root_cause:string,fix_description:string>, related_files array<string>"),
    }


def _scores(ctx):
    return {(r["submission_id"], r["task_id"]): (round(r["score"], 6), list(r["errors"]))
            for r in SCO.score_all(ctx).collect()}


def test_cross_file_cases(spark):
    t = [{"task_id": "cross_file_reasoning_01", "type": "cross_file_reasoning", "ground_truth": "g"}]
    paths = [("cross_file_reasoning_01", ["AAA", "BBB", "CCC", "DDD"], "ff", [1, 2])]
    subs = [("s0", True, True, 1.0), ("s1", True, True, 1.0), ("s2", True, True, 1.0)]
    att = [(s, "cross_file_reasoning_01") for s, *_ in subs]
    kw = " ".join(SC.ANALYSIS_KEYWORDS)
    texts = [("s1", "reasoning", "ff AAA BBB\n"), ("s2", "reasoning", f"ff AAA BBB CCC DDD {kw}\n")]
    got = _scores(_ctx(spark, t, subs, att, texts, paths=paths))
    assert got[("s0", "cross_file_reasoning_01")] == (0.0, [])
    assert got[("s1", "cross_file_reasoning_01")] == (0.5, [])
    assert got[("s2", "cross_file_reasoning_01")] == (1.0, [])


def test_rename_cases(spark):
    t = [{"task_id": "refactor_rename_01", "type": "refactor_rename", "ground_truth": "g",
          "symbol_to_rename": "OldName", "new_name": "NewName"}]
    ch = [("f1", 0, "OldName", "NewName"), ("f2", 0, "OldName", "NewName")]
    ren = [("refactor_rename_01", ["src/r/a.go", "src/r/b.go"],
            [("src/r/a.go",) + c[1:] for c in ch[:1]] + [("src/r/b.go",) + c[1:] for c in ch[1:]])]
    files = [("src/r/a.go", "func NewName() {}\n"), ("src/r/b.go", "OldName OldName OldName\n")]
    subs = [("s0", False, True, 1.0), ("s1", True, True, 1.0)]
    att = [("s0", "refactor_rename_01"), ("s1", "refactor_rename_01")]
    got = _scores(_ctx(spark, t, subs, att, files=files, renames=ren))
    assert got[("s0", "refactor_rename_01")] == (0.0, ["No patch was applied"])
    assert got[("s1", "refactor_rename_01")] == (0.6, [])
    noisy = [("src/r/a.go", "func NewName() {}\n"), ("src/r/b.go", "x := NewName()\n"),
             ("src/r/c.py", "\n".join(f"# NewName {i}" for i in range(12)) + "\n")]
    subs2 = [("s2", True, False, 1.0)]
    got2 = _scores(_ctx(spark, t, subs2, [("s2", "refactor_rename_01")], files=noisy, renames=ren))
    assert got2[("s2", "refactor_rename_01")] == (0.7, [])


def test_api_cases(spark):
    t = [{"task_id": "api_upgrade_01", "type": "api_upgrade", "ground_truth": "g",
          "old_api": "FooMethod(a)", "new_api": "FooMethodV2(a, b)"}]
    cs = [("api_upgrade_01", 15, 12, [("src/r/a.go", 1, True, "x", "y", "r"), ("src/r/b.go", 1, False, "x", "y", "r")])]
    files = [("src/r/a.go", "FooMethodV2(1, 2)\n"), ("src/r/b.go", "FooMethod(1)\n")]
    subs = [("s1", True, True, 1.0)]
    got = _scores(_ctx(spark, t, subs, [("s1", "api_upgrade_01")], files=files, callsites=cs))
    assert got[("s1", "api_upgrade_01")] == (1.0, [])
    got = _scores(_ctx(spark, t, subs, [("s1", "api_upgrade_01")], files=[("src/r/z.go", "")], callsites=cs))
    assert got[("s1", "api_upgrade_01")] == (0.0, [])


def test_bug_cases_and_unknown_type(spark):
    t = [{"task_id": "bug_localization_01", "type": "bug_localization", "ground_truth": "g"},
         {"task_id": "mystery_01", "type": "mystery", "ground_truth": "g"}]
    lines = [f"line {i}" for i in range(1, 200)]
    lines[155] = "if x == null { check }"
    files = [("src/r/pkg/h.go", "\n".join(lines) + "\n")]
    bugs = [("bug_localization_01", ("src/r/pkg/h.go", [156, 158], "rc", "fd"), [])]
    subs = [("s1", False, True, 1.0), ("s2", True, True, 1.0)]
    att = [("s1", "bug_localization_01"), ("s2", "bug_localization_01"), ("s1", "mystery_01")]
    texts = [("s1", "bug", "the bug is in h.go near 157\n"), ("s2", "bug", "h.go at line 162\n")]
    got = _scores(_ctx(spark, t, subs, att, texts, files=files, bugs=bugs))
    assert got[("s1", "bug_localization_01")] == (0.7, [])
    assert got[("s2", "bug_localization_01")] == (0.925, [])
    assert got[("s1", "mystery_01")] == (0.0, ["No scorer for task type: mystery"])


def test_line_band_first_in_band_decides(spark):
    df = spark.createDataFrame([("152 then 157",), ("157",), ("170",)], "t string")
    got = [r["b"] for r in df.select(SC.line_band("t", F.lit(156), F.lit(158)).alias("b")).collect()]
    assert got == [0.75, 1.0, 0.0]


def test_weighted_report_and_penalty(spark):
    ts = spark.createDataFrame(
        [("s", "cross_file_reasoning_01", "cross_file_reasoning", 0.756, 1.0, "{}", []),
         ("s", "refactor_rename_01", "refactor_rename", 0.923, 1.0, "{}", []),
         ("s", "api_upgrade_01", "api_upgrade", 0.834, 1.0, "{}", []),
         ("s", "bug_localization_01", "bug_localization", 0.892, 1.0, "{}", [])],
        "submission_id string, task_id string, type string, score double, max_score double, details string, errors array<string>")
    tasks = _tasks(spark, [{"task_id": t, "max_time_minutes": 10} for t in
                           ["cross_file_reasoning_01", "refactor_rename_01", "api_upgrade_01", "bug_localization_01"]])
    subs = spark.createDataFrame([("s", True, True, 10.0)], "submission_id string, patch_applied boolean, compile_ok boolean, elapsed_minutes double")
    r = SCO.report(ts, tasks, subs).first()
    assert r["overall_score"] == pytest.approx(0.8594035088, abs=1e-9)
    assert r["band"] == "Proficient" and r["success"]
    df = spark.createDataFrame([(e,) for e in [10.0, 12.0, 14.0, 18.0, 21.0]], "e double")
    got = [r["f"] for r in df.select(SC.overtime_factor("e", F.lit(10.0)).alias("f")).collect()]
    assert got == [1.0, 0.9, 0.75, 0.5, 0.0]


def test_document_rules(spark):
    ts = spark.createDataFrame(
        [("s", "cross_file_reasoning_01", "cross_file_reasoning", 0.6, 1.0, '{"call_chain_accuracy": 0.75}', []),
         ("s", "refactor_rename_01", "refactor_rename", 0.6, 1.0,
          '{"files_checked": 4, "correctly_modified": 3, "false_positives": 2, "compilation_success": true}', []),
         ("s", "api_upgrade_01", "api_upgrade", 0.9, 1.0,
          '{"total_callsites": 5, "expected_upgrades": 2, "actual_upgrades": 2, "preserved_legacy": 2}', []),
         ("t", "refactor_rename_01", "refactor_rename", 0.0, 1.0, '{"error": true}', ["No patch was applied"])],
        "submission_id string, task_id string, type string, score double, max_score double, details string, errors array<string>")
    got = {(r["submission_id"], r["type"]): r["document_score"] for r in SCO.document_rules(ts).collect()}
    assert got[("s", "cross_file_reasoning")] == 0.75
    assert got[("s", "refactor_rename")] == pytest.approx(0.75 * 0.8)
    assert got[("s", "api_upgrade")] == pytest.approx(0.9)
    assert got[("t", "refactor_rename")] == 0.0


def test_a_submission_without_tasks_has_a_report(spark):
    ts = spark.createDataFrame([("s", "cross_file_reasoning_01", "cross_file_reasoning", 0.5, 1.0, "{}", ["wrong"])],
                               "submission_id string, task_id string, type string, score double, max_score double, details string, errors array<string>")
    tasks = _tasks(spark, [{"task_id": "cross_file_reasoning_01", "max_time_minutes": 10}])
    subs = spark.createDataFrame([("s", True, True, 1.0), ("idle", True, True, 99.0)], "submission_id string, patch_applied boolean, compile_ok boolean, elapsed_minutes double")
    got = {r.submission_id: (r.overall_score, r.adjusted_score, r.tasks_scored, r.errors, r.success, r.band) for r in SCO.report(ts, tasks, subs).collect()}
    assert got == {"s": (0.5, 0.5, 1, 1, False, "Developing"), "idle": (0.0, 0.0, 0, 0, True, "Novice")}


def test_truth_is_routed_and_summed_up(spark):
    import json
    import os
    import tempfile

    from quarry.operators.tasks import truth_target
    from quarry.sources.artifacts import write_tasks_truth
    ids = ["cross_file_reasoning_01", "refactor_rename_02", "api_upgrade_03", "bug_localization_04", "debug_05", "mystery_06"]
    df = spark.createDataFrame([(i, "api_upgrade" if "api" in i else "other") for i in ids], "task_id string, type string")
    got = {r.task_id: r.t for r in df.select("task_id", truth_target("task_id").alias("t")).collect()}
    assert got == dict(zip(ids, ["expected_symbol_paths", "expected_refactor_targets", "expected_api_migration_results", "expected_bug_locations", "debug_05", "mystery_06"]))
    d = tempfile.mkdtemp(prefix="quarry-tasks-", dir="/tmp")
    write_tasks_truth(df, df, d)
    assert {x for x in os.listdir(d + "/truth") if x.startswith("target=")} == {f"target={t}" for t in got.values()}
    part = [f for f in os.listdir(d + "/task_summary") if f.endswith(".json")]
    with open(f"{d}/task_summary/{part[0]}") as f:
        assert json.load(f) == {"total_tasks": 6, "task_types": ["api_upgrade", "other"]}
    assert spark.read.json(d + "/task_summary_tasks").count() == 6
