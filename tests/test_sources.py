import json
import os
import tempfile

from quarry.sources import artifacts as AR
from quarry.sources import filesystem as FS
from quarry.sources import manifest as MF


def _tree(root, files):
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())


def test_scan_sources(spark):
    d = tempfile.mkdtemp(prefix="quarry-scan-", dir="/tmp")
    src = os.path.join(d, "src")
    _tree(src, {"repo1/vendor/a.go": "package a\n", "repo1/vendor/x/b.go": "package b\n",
                "repo1/latest/x/c.go": "package c\n", "repo1/pkg/d_test.go": "package d\n",
                "repo1/pkg/e.py": b"\xff\xffx = 1\r\n", "repo1/notes.md": "# no\n",
                "repo2/main.cc": "int main(){}\n", "repo2/lib/f.h": "int f();\n"})
    files = FS.scan_sources(spark, [src, os.path.join(d, "missing")])
    got = {r["path"]: r for r in files.collect()}
    assert set(got) == {"src/repo1/vendor/a.go", "src/repo1/pkg/e.py", "src/repo2/lib/f.h"}
    e = got["src/repo1/pkg/e.py"]
    assert (e["repo"], e["rel_path"], e["content"], e["size_bytes"], e["line_count"]) == \
        ("repo1", "pkg/e.py", "x = 1\n", 6, 1)
    assert sorted(r["repo"] for r in FS.discover_repos(files).collect()) == ["repo1", "repo2"]


def test_manifest(spark):
    d = tempfile.mkdtemp(prefix="quarry-manifest-", dir="/tmp")
    rows = [{"tier": "core", "name": "alpha", "url": "u1", "language": "go", "approximate_loc": 10, "weight": 3},
            {"tier": "extended", "name": "beta", "url": "u2", "language": "python", "approximate_loc": 5,
             "weight": 1, "depth": 2},
            {"tier": "xl", "name": "gamma", "url": "u3", "language": "go", "approximate_loc": 7, "weight": 2}]
    with open(os.path.join(d, "repos.json"), "w") as f:
        json.dump(rows, f)
    repos = MF.read_manifest(spark, os.path.join(d, "repos.json"))
    core = MF.load_repository_config(repos, core_only=True).collect()
    assert [(r["name"], r["depth"], r["folder"]) for r in core] == [("alpha", 1, "src/alpha/")]
    both = MF.load_repository_config(repos, core_only=False)
    assert sorted(r["name"] for r in both.collect()) == ["alpha", "beta"]
    files = spark.createDataFrame([("alpha",)], "repo string")
    assert [r["name"] for r in MF.missing_repos(both, files).collect()] == ["beta"]
    roll = {(r["tier"], r["language"]): r["approximate_loc"] for r in MF.manifest_rollup(repos).collect()}
    assert roll[(None, None)] == 22 and roll[("core", "go")] == 10


def test_artifact_round_trip(spark):
    d = tempfile.mkdtemp(prefix="quarry-art-", dir="/tmp")
    df = spark.createDataFrame([("a", "a_New"), ("b", "Old_b")], "old string, new string")
    AR.write_table(df, d + "/rename_map", fmt="json")
    back = spark.read.json(d + "/rename_map")
    assert sorted((r["old"], r["new"]) for r in back.collect()) == [("a", "a_New"), ("b", "Old_b")]
    with open(d + "/obj.json", "w") as f:
        f.write(json.dumps({"x": "1", "y": "2"}) + "\n")
    kv = sorted((r["key"], r["value"]) for r in AR.read_artifact(spark, d + "/obj.json").collect())
    assert kv == [("x", "1"), ("y", "2")]
    assert AR.read_artifact(spark, d + "/missing.json").count() == 0
    keyed = AR.as_keyed_object(df, "old", ["new"]).first()["record"]
    assert keyed["a"]["new"] == "a_New"


def test_nested_manifests_and_what_is_wrong_with_them(spark):
    d = tempfile.mkdtemp(prefix="quarry-manifest-", dir="/tmp")
    good = {"metadata": {"version": "1.0"}, "core_repos": [{"name": "a", "url": "u", "language": "go", "approximate_loc": 10, "weight": 3, "license": "mit"},
                                                          {"name": "b", "url": "v", "approximate_loc": "many", "depth": 4}, {"url": "nameless"}],
            "extended_repos": [{"name": "c", "url": "w", "license": "mit", "approximate_loc": 5, "notes": "x"}], "xl_repos": "none", "build": {"core_repos": []}}
    for name, text in (("good.json", json.dumps(good, indent=2)), ("bad.json", '{"core_repos": ['), ("empty.json", "{}"), ("list.json", "[1, 2]")):
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    repos, rejected = MF.read_nested_manifest(spark, d)
    assert sorted((r.tier, r.name, r.approximate_loc, r.depth) for r in repos.collect()) == [("core", "a", 10, None), ("core", "b", None, 4), ("extended", "c", 5, None)]
    assert sorted((r.file, r.tier or "", r.error.split()[0]) for r in rejected.collect()) == [("bad.json", "", "no"), ("good.json", "core", "a"), ("good.json", "xl", "the")]
    config = {r.name: (r.depth, r.folder) for r in MF.load_repository_config(repos, core_only=False).collect()}
    assert config == {"a": (1, "src/a/"), "b": (4, "src/b/"), "c": (1, "src/c/")}
    totals = {(r.license, r.tier): (r.repos, r.approximate_loc) for r in MF.license_rollup(repos).collect()}
    assert totals[("mit", None)] == (2, 15) and totals[("unknown", "core")] == (1, None) and totals[(None, None)] == (3, 15)
