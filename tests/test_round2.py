"""Cases that earlier versions got wrong."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import files_df
from quarry.functions import text as TX
from quarry.operators import lineage as LN
from quarry.operators import transforms as TR
from quarry.operators import validate as VA
from quarry.sources import artifacts as AR
from quarry.sources import filesystem as FS


def test_scan_below_a_folder_named_like_the_root(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="quarry-scan-", dir="/tmp"), "src", "mirror", "src")
    for repo in ("repo1", "repo2"):
        os.makedirs(f"{root}/{repo}/pkg")
        with open(f"{root}/{repo}/pkg/a.go", "w") as f:
            f.write("package a\n")
    got = FS.scan_sources(spark, [root]).collect()
    assert sorted((r["repo"], r["rel_path"]) for r in got) == [("repo1", "pkg/a.go"), ("repo2", "pkg/a.go")]


def test_decode_keeps_a_replacement_character_of_the_file(spark):
    raw = spark.createDataFrame([(bytearray("a\uFFFDb".encode() + b"\xff\xfec"),)], "raw binary")
    assert raw.select(TX.decode_text("raw").alias("t")).first()["t"] == "a\uFFFDbc"


def test_indented_artifact_is_read_and_a_malformed_one_fails(spark):
    d = tempfile.mkdtemp(prefix="quarry-art-", dir="/tmp")
    with open(d + "/indented.json", "w") as f:
        json.dump({"x": "1", "y": "2"}, f, indent=2)
    with open(d + "/lines.json", "w") as f:
        f.write('{"x": "1"}\n{"y": "2"}\n')
    with open(d + "/bad.json", "w") as f:
        f.write('{"x": ')
    for name in ("indented", "lines"):
        assert sorted(map(tuple, AR.read_artifact(spark, f"{d}/{name}.json").collect())) == [("x", "1"), ("y", "2")]
    with pytest.raises(Exception):
        AR.read_artifact(spark, d + "/bad.json").collect()


def test_changed_repos_sees_swaps_and_renames(spark):
    before = files_df(spark, [("src/r/a.py", "one"), ("src/r/b.py", "two"), ("src/q/a.py", "x"), ("src/s/a.py", "x")])
    after = files_df(spark, [("src/r/a.py", "two"), ("src/r/b.py", "one"), ("src/q/c.py", "x"), ("src/s/a.py", "x")])
    assert sorted(map(tuple, LN.changed_repos(before, after).collect())) == [("q", 1), ("r", 2)]


def test_all_syntax_messages_are_reported(spark):
    files = files_df(spark, [(f"src/r/f{i}.py", "def broken(:\n") for i in range(8)] + [("src/r/ok.py", "x = 1\n")])
    row = VA.repo_syntax_report(files).first()
    assert row["syntax_errors"] == 8 and not row["python_ok"] and sum(f"f{i}.py" in row["messages"] for i in range(8)) == 8


def test_an_earlier_copy_of_a_directory_is_replaced(spark):
    files = files_df(spark, [("src/r/pkg/a.go", "package a\n"), ("src/r/pkg_legacy/old.go", "package old\n")])
    result = TR.duplicate_with_drift(files, k=5)
    kept = {r["path"] for r in result.files.select(F.col("path")).collect()}
    assert "src/r/pkg_legacy" in {r["duplicate_path"] for r in result.record.collect()}
    assert "src/r/pkg_legacy/old.go" not in kept and "src/r/pkg_legacy/a.go" in kept


def test_every_task_is_attempted(spark):
    from quarry.operators import tasks as TK
    tasks = spark.createDataFrame([(f"refactor_rename_{i:02d}",) for i in range(40)], "task_id string")
    subs = spark.createDataFrame([(i,) for i in range(5)], "submission_id long")
    got = TK.attempts_for(subs, tasks).collect()
    assert {r["task_id"] for r in got} == {f"refactor_rename_{i:02d}" for i in range(40)}
    assert {r["submission_id"] for r in got} == set(range(5)) and len(got) <= 40 + 15
    assert TK.attempts_for(subs.limit(0), tasks).count() == 0 and TK.attempts_for(subs, tasks.limit(0)).count() == 0


def test_breakage_takes_half_of_an_upgrade_score(spark):
    from quarry.operators import scoring as SC
    details = '{"total_callsites": 4, "expected_upgrades": 4, "actual_upgrades": 3, "preserved_legacy": 0}'
    rows = spark.createDataFrame([(i, "api_upgrade_01", "api_upgrade", 1.0, 1.0, details, []) for i in (1, 2)],
                                 "submission_id long, task_id string, type string, score double, max_score double, details string, errors array<string>")
    subs = spark.createDataFrame([(1, True), (2, False)], "submission_id long, compile_ok boolean")
    got = {r["submission_id"]: r["document_score"] for r in SC.document_rules(rows, {"submissions": subs}).collect()}
    assert got == {1: 0.75, 2: 0.25}


def test_passages_are_found_wherever_they_stand(spark):
    from quarry.operators import tasks as TK
    long = "one two three four five six seven eight nine ten eleven"
    files = spark.createDataFrame([("a", f"x\npre{long}post\ny"), ("b", f"{long}"), ("c", "one two three"), ("d", None),
                                   ("e", long.replace("six", "6") + "\nq\nred\nblue green")], "path string, content string")
    items = spark.createDataFrame([(1, long), (2, "wo thr"), (3, "red\nblue green"), (4, ""), (5, None), (6, "absent words are here")],
                                  "item_id long, text string")
    got = {(r.item_id, r.path, r.line_no) for r in TK.passage_locations(items, files).collect()}
    assert got == {(1, "a", 2), (1, "b", 1), (2, "a", 2), (2, "b", 1), (2, "c", 1), (2, "e", 1), (3, "e", 3), (3, "e", 4)}


def test_new_names_are_searched_as_substrings(spark):
    from quarry.operators import scoring as SC
    files = spark.createDataFrame([("src/r/a.go", "x // Old_FooBar\ny(Old_Élan) // z"), ("src/r/b.py", "# aOld_Foo\n# Old _Foo"),
                                   ("src/r/c.txt", "# Old_Foo"), ("src/r/d.cpp", "two  words // two words\nx # V"), ("src/r/e.py", None)],
                                  "path string, content string")
    names = ["Old_Foo", "Old_", "Old_É", "two words", "V", "absent", " ", "", None]
    tasks = spark.createDataFrame([(f"t{i}", "refactor_rename", n) for i, n in enumerate(names)], "task_id string, type string, new_name string")
    got = {r["task_id"]: r["false_positives"] for r in SC.rename_false_positives(tasks, files).collect()}
    assert [got[f"t{i}"] for i in range(len(names))] == [2, 3, 1, 1, 1, 0, 0, 0, 0]
    assert SC.rename_false_positives(tasks.limit(0), files).count() == 0
    assert SC.rename_false_positives(tasks, files, first_n=1).where("false_positives > 1").count() == 0


def test_call_chain_goes_to_the_end(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("n20", "n0")], "caller string, callee string")
    roots = spark.createDataFrame([("n0",), ("alone",)], "root string")
    got = {(r["root"], r["node"]): r["depth"] for r in LN.call_chain(edges, roots).collect()}
    assert got == {("alone", "alone"): 0, **{("n0", f"n{i}"): i for i in range(21)}}


def test_rename_audit_counts_files_left_and_done(spark):
    from quarry.operators import index as IX
    files = spark.createDataFrame([("a", "New New"), ("b", "Old Old Old New"), ("c", "Old Old New"), ("d", "Old"), ("e", "Newer"), ("f", None)],
                                  "path string, content string")
    pairs = spark.createDataFrame([("Old", "New"), ("Gone", "Nowhere")], "old string, new string")
    got = {r["old"]: tuple(r)[2:] for r in IX.rename_audit(pairs, IX.reference_index(files)).collect()}
    assert got == {"Old": (4, 1, 2, 0.5), "Gone": (0, 0, 0, 1.0)}


def test_broadcast_is_bounded_by_bytes(spark):
    from quarry.operators.joins import bounded_broadcast, fits_broadcast
    one = spark.createDataFrame([("k", ["x" * 1000] * 10)], "path string, pairs array<string>")
    assert fits_broadcast(one, 20_000) and not fits_broadcast(one, 5_000) and fits_broadcast(one.limit(0), 0)
    big = spark.createDataFrame([("k",)], "path string")
    for bound, held in ((20_000, True), (5_000, False)):
        plan = big.join(bounded_broadcast(one, bound), "path")._jdf.queryExecution().optimizedPlan().toString()
        assert ("strategy=broadcast" in plan) == held


def test_registered_query_gives_all_syntax_messages(spark, monkeypatch):
    from quarry.plans import queries as Q
    from tests.conftest import files_df
    texts = {"src/a/x.py": "def True(:\n", "src/a/b.py": "x = (\n", "src/a/ok.py": "x = 1\n", "src/b/ok.py": "y = 2\n", "src/a/z.go": "def True("}
    monkeypatch.setattr(Q.TB, "code_files", lambda spark, sf: files_df(spark, list(texts.items())))
    got = {r.repo: r for r in Q.QUERIES["a8_syntax_messages"](spark, "").collect()}
    want = []
    for path in ("src/a/b.py", "src/a/x.py"):
        try:
            compile(texts[path], path, "exec")
        except SyntaxError as e:
            want.append(e.msg)
    parts = got["a"].messages.split("; ")
    assert len(parts) == got["a"].syntax_errors == 2 and all(w in p for w, p in zip(want, parts))
    assert got["b"].messages is None and got["b"].syntax_errors == 0 and got["a"].python_files == 3
