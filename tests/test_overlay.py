"""Submissions' own trees: an overlay over one base, against whole trees built by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import overlay as OV
from quarry.operators import scoring as SCO
from tests.conftest import files_df
from tests.test_scoring import _ctx, _scores

CHANGES = "submission_id string, path string, content string, layer string"


def test_two_submissions_on_one_task_differ(spark):
    t = [{"task_id": "refactor_rename_01", "type": "refactor_rename", "ground_truth": "g", "symbol_to_rename": "OldName", "new_name": "NewName"},
         {"task_id": "api_upgrade_01", "type": "api_upgrade", "ground_truth": "g", "old_api": "Foo(a)", "new_api": "FooV2(a, b)"},
         {"task_id": "bug_localization_01", "type": "bug_localization", "ground_truth": "g"}]
    ren = [("refactor_rename_01", [], [(f, 0, "OldName", "NewName") for f in ("src/r/a.go", "src/r/b.go")])]
    api = [("api_upgrade_01", 2, 2, [(f, 1, n, "x", "y", "r") for f, n in (("src/r/c.go", True), ("src/r/d.go", True), ("src/r/e.go", False))])]
    bugs = [("bug_localization_01", ("src/r/h.go", [2, 3], "rc", "fd"), [])]
    files = [("src/r/a.go", "func NewName() {}\n"), ("src/r/b.go", "OldName OldName OldName\n"), ("src/r/c.go", "Foo(1)\n"), ("src/r/d.go", "FooV2(1)\n"),
             ("src/r/e.go", "Foo(2)\n"), ("src/r/h.go", "one\ntwo\nthree\n")]
    subs = [(s, True, False, 1.0) for s in ("s0", "s1", "s2")]
    att = [(s, x["task_id"]) for s, *_ in subs for x in t]
    ctx = _ctx(spark, t, subs, att, files=files, renames=ren, callsites=api, bugs=bugs)
    changes = [("s1", "src/r/b.go", "NewName\n", "1"), ("s1", "src/r/c.go", "FooV2(1)\n", "1"), ("s1", "src/r/h.go", "one\nif x == null {}\nthree\n", "1"),
               ("s2", "src/r/a.go", None, "1"), ("s2", "src/r/e.go", "FooV2(2)\n", "1"), ("s2", "src/r/new.py", "# NewName\n# NewName", "1"),
               # an earlier layer is covered by a later one, also by a deletion
               ("s2", "src/r/d.go", "FooV2(9)\n", "1"), ("s2", "src/r/d.go", None, "2"), ("s9", "src/r/a.go", None, "1")]
    ctx["changed"] = OV.latest(spark.createDataFrame(changes, CHANGES))
    got = {k: v[0] for k, v in _scores(ctx).items()}
    r, a, b = (x["task_id"] for x in t)
    assert (got["s0", r], got["s1", r], got["s2", r]) == (0.5, 1.0, 0.0)
    assert (got["s0", a], got["s1", a], got["s2", a]) == (0.65, 1.0, 0.0)
    assert (got["s0", b], got["s1", b], got["s2", b]) == (0.0, 0.3, 0.0)
    assert {k[0] for k in got} == {"s0", "s1", "s2"}


@pytest.mark.parametrize("seed", range(3))
def test_noise_of_trees_equals_grep_of_whole_trees(spark, seed):
    rng = random.Random(seed)
    line = lambda: rng.choice(["x", "NewOne()", "# NewOne", "// NewTwo", 'NewTwo "q"', "NewTwo", "y"])
    text = lambda n: "\n".join(line() for _ in range(rng.randint(0, n)))
    base = {f"src/r/f{i:02d}.{rng.choice(['go', 'py', 'txt'])}": text(12) for i in range(30)}
    changes = {(s, p): rng.choice([None, text(30)]) for s in ("s1", "s2", "s3") for p in [*rng.sample(sorted(base), rng.choice([1, 4, 12])), "src/r/a0.py"]}
    names = {"t1": "NewOne", "t2": "NewTwo", "t3": "Absent"}
    tasks = spark.createDataFrame([(k, "refactor_rename", v) for k, v in names.items()], "task_id string, type string, new_name string")
    attempts = spark.createDataFrame([(s, t) for s in ("s0", "s1", "s2", "s3") for t in names], "submission_id string, task_id string")
    changed = OV.latest(spark.createDataFrame([(*k, v, "1") for k, v in changes.items()], CHANGES))
    lines = SCO.rename_hits(tasks, files_df(spark, list(base.items())))
    got = {(r.submission_id, r.task_id): r.own_false_positives for r in OV.rename_noise(tasks, lines, attempts, changed, first_n=8, cap=6).collect()}

    def grep(tree, name):
        hits = [(p, x) for p in sorted(tree) if re.search(r"\.(go|py|cpp)$", p) for x in tree[p].split("\n") if name in x][:8]
        return min(6, sum(any(c in f"{p}:{x}" for c in ("//", "#", '"', "'")) for p, x in hits))
    for s in ("s1", "s2", "s3"):
        tree = {p: v for p, v in {**base, **{p: v for (o, p), v in changes.items() if o == s}}.items() if v is not None}
        for t, name in names.items():
            assert got.get((s, t), grep(base, name)) == grep(tree, name)
    assert not [k for k in got if k[0] == "s0"] and len(got) >= 3


def test_most_specific_row_wins(spark):
    base = files_df(spark, [("src/r/a.py", "base a"), ("src/r/b.py", "base b")])
    changed = OV.latest(spark.createDataFrame([("s1", "src/r/a.py", "own a", "1"), ("s1", "src/r/b.py", None, "1"), ("s2", "src/r/n.py", "new", "1"),
                                               ("s2", "src/r/a.py", "base a", "1")], CHANGES))
    wanted = spark.createDataFrame([(s, p) for s in ("s1", "s2") for p in ("src/r/a.py", "src/r/b.py", "src/r/n.py", "src/r/z.py")], "submission_id string, path string")
    got = {(r.submission_id, r.path[-4:]): (r.content, r.origin) for r in OV.resolve(wanted, base, changed).collect()}
    assert got == {("s1", "a.py"): ("own a", "own"), ("s1", "b.py"): (None, "own"), ("s1", "n.py"): (None, "none"), ("s1", "z.py"): (None, "none"),
                   ("s2", "a.py"): ("base a", "own"), ("s2", "b.py"): ("base b", "base"), ("s2", "n.py"): ("new", "own"), ("s2", "z.py"): (None, "none")}
    trees = {r.submission_id: tuple(r)[1:] for r in OV.tree_summary(base, changed).collect()}
    assert trees == {"s1": (1, 0, 1), "s2": (0, 1, 0)}
    none = changed.limit(0)
    assert OV.tree_summary(base, none).count() == 0 and OV.resolve(wanted, base, none).where(F.col("origin") == "own").count() == 0


def test_registered_queries_reach_every_outcome(spark):
    """Trees and citing answers bring scores that one shared corpus never gives."""
    from quarry.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    c2 = QUERIES["c2_patched_rename"](spark, sf).collect()
    by_task = {}
    for r in c2:
        by_task.setdefault(r.task_id, set()).add(r.correct)
    assert any(len(v) > 1 for v in by_task.values())
    assert max(r.score for r in QUERIES["c3_patched_api"](spark, "/root/testdata/sf0.01").collect()) > 0.3
    c4 = QUERIES["c4_patched_bug"](spark, sf).collect()
    assert {r.fix for r in c4} == {0.0, 1.0} and {r.file for r in c4} == {0.0, 1.0} and {r.location for r in c4} == {0.0, 0.75, 1.0}
    c1 = QUERIES["c1_cited_path"](spark, sf).collect()
    assert {r.file_found for r in c1} == {True, False} and max(r.score for r in c1) == 1.0


def test_edits_of_base_texts_equal_held_texts(spark):
    """changes kept as edits give what their texts would give, and no text is stored."""
    from quarry.plans import patches as PA
    base = [("src/r/a.py", "Foo(1)\n# NewOne\nx\n"), ("src/r/b.go", "NewOne()\nif x\n"), ("src/r/c.go", "y\n"), ("src/r/c.go", "NewOne z\n"), ("src/r/d.cpp", "NewOne\n")]
    files = files_df(spark, base)
    rng = random.Random(5)
    args = {"rename": ("OldOne", "NewOne", None), "api": ("Foo", "FooV2", None), "bug": (None, None, 2)}
    rows = [(f"s{s}", p, (f"t{layer}", rng.choice([1, 2, 3]), kind, *args[kind]))
            for s in range(6) for p, _ in dict(base).items() for layer in rng.sample(range(4), 2) for kind in (rng.choice(sorted(args)),)]
    edits = spark.createDataFrame(rows, "submission_id string, path string, edit struct<layer:string,v:long,kind:string,old:string,new:string,first:int>")
    texts = edits.join(files.select("path", "content"), "path").select("submission_id", "path", PA.apply_edit(F.col("content"), F.col("edit")).alias("content"), "edit.layer")
    held, made = OV.latest(texts), OV.Edits(edits, files, PA.apply_edit)
    assert "content" not in made.rows.columns and made.rows.count() == held.count() == 24
    tasks = spark.createDataFrame([("t0", "refactor_rename", "OldOne", "NewOne"), ("t1", "refactor_rename", "Foo", "FooV2")], "task_id string, type string, symbol_to_rename string, new_name string")
    truth = spark.createDataFrame([(t, p) for t in ("t0", "t1") for p in ("src/r/a.py", "src/r/c.go", "src/r/none.go")], "task_id string, file string")
    attempts = spark.createDataFrame([(f"s{s}", t) for s in range(7) for t in ("t0", "t1")], "submission_id string, task_id string")
    per_file, lines = SCO.rename_file_checks(tasks, truth, files, "ascii"), SCO.rename_hits(tasks, files)
    for of in (lambda c: OV.deltas(per_file, attempts, c, SCO.rename_check("ascii")), lambda c: OV.rename_noise(tasks, lines, attempts, c), lambda c: OV.tree_summary(files, c)):
        want, got = (sorted(map(tuple, of(c).collect())) for c in (held, made))
        assert got == want and want
