import json
import os
import tempfile

from quarry.operators import scoring as SCO
from quarry.plans import jobs as JB
from quarry.sources import artifacts as AR
from tests.conftest import files_df


def test_apply_all_and_save_records(spark):
    files = files_df(spark, [
        ("src/r/pkg/a.go", "// a\npackage a\n\nfunc Alpha(x int) int {\n\treturn Beta(x)\n}\n"),
        ("src/r/pkg/b.go", "package a\n\nfunc Beta(x int) int {\n\treturn x\n}\n\nfunc Alpha() {}\n"),
        ("src/r/lib/m.py", "# m\ndef Gamma(x):\n    return x\n\nLIMIT = 60\n"),
        ("src/r/lib/n.py", "def Gamma():\n    pass\n")])
    res = JB.apply_all(files, JB.Settings(rename_fraction=0.25, api_migrations=2, wrapper_layers=2))
    summary = res["summary"].first().asDict()
    assert summary["seed"] == 42 and summary["renames"] == 1 and summary["api_migrations"] == 2
    assert summary["duplications"] == 2                      # two top-level dirs, k = 2
    paths = {r["path"] for r in res["files"].collect()}
    assert {"src/r/pkg_legacy/a.go", "src/r/lib_legacy/m.py"} <= paths
    val = {r["repo"]: r for r in res["validation"].collect()}
    assert val["r"]["go"] >= 2 and val["r"]["py"] >= 2
    out = tempfile.mkdtemp(prefix="quarry-records-", dir="/tmp")
    JB.save_records(res, out)
    meta = [json.loads(line) for f in os.listdir(out + "/metadata") if f.endswith(".json")
            for line in open(os.path.join(out, "metadata", f))]
    assert meta[0]["renames"] == 1
    assert spark.read.json(out + "/rename_map").count() == 1


def test_report_json_and_truth_routing(spark):
    ts = spark.createDataFrame(
        [("s", "api_upgrade_01", "api_upgrade", 1.0, 1.0, "{}", []),
         ("s", "bug_localization_01", "bug_localization", 0.5, 1.0, "{}", ["x"])],
        "submission_id string, task_id string, type string, score double, max_score double, details string, errors array<string>")
    tasks = spark.createDataFrame([("api_upgrade_01", 20), ("bug_localization_01", 25)],
                                  "task_id string, max_time_minutes int")
    subs = spark.createDataFrame([("s", True, True, 5.0)],
                                 "submission_id string, patch_applied boolean, compile_ok boolean, elapsed_minutes double")
    doc = json.loads(SCO.report_json(ts, tasks, subs).first()["json"])
    assert abs(doc["overall_score"] - (1.0 * 1.5 + 0.5 * 2.0) / 3.5) < 1e-9
    assert doc["errors"] == 1 and doc["success"] is False and len(doc["results"]) == 2
    out = tempfile.mkdtemp(prefix="quarry-truth-", dir="/tmp")
    truths = spark.createDataFrame([("api_upgrade_01", 1), ("cross_file_reasoning_02", 2), ("misc_1", 3)],
                                   "task_id string, v int")
    AR.write_tasks_truth(tasks, truths, out)
    routed = {r["task_id"]: r["target"] for r in spark.read.json(out + "/truth").collect()}
    assert routed == {"api_upgrade_01": "expected_api_migration_results",
                      "cross_file_reasoning_02": "expected_symbol_paths", "misc_1": "misc_1"}
