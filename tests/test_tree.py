"""Trees with bad files: every problem is a row, and the job ends."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import transforms as TR
from quarry.operators import validate as VA
from quarry.sources import corpus as C
from quarry.sources import tree as TREE
from tests.conftest import files_df
from tests.test_sources import _tree


@pytest.fixture(scope="module")
def root():
    src = os.path.join(tempfile.mkdtemp(prefix="quarry-tree-", dir="/tmp"), "src")
    _tree(src, {"repo1/pkg/a.go": "func Alpha(x int) {\n}\n", "repo1/pkg/b.py": b"\xff\xffdef beta():\r\n    pass\r", "repo1/vendor/v/c.go": "func Gamma() {}\n",
                "repo1/pkg/big.go": "// " + "x" * 5000, "repo1/notes.md": "# no\n", "repo2/lib/d.py": "x = " + "-" * 60_000 + "1\n",
                "repo2/lib/e.py": "def epsilon(:\n", "repo2/.cache/f.py": "def zeta(): pass\n", "loose.go": "package none\n"})
    os.symlink(os.path.join(src, "nowhere"), os.path.join(src, "repo2/lib/gone.py"))
    os.symlink(os.path.join(src, "repo2"), os.path.join(src, "repo2/lib/loop"))
    os.mkfifo(os.path.join(src, "repo2/lib/pipe.go"))
    return src


def scan(spark, root, **options):
    return TREE.scan_tree(spark, [root], maxFileBytes=70_000, **options)


def test_bad_files_are_rows(spark, root):
    rows = TREE.scan_tree(spark, [root], maxFileBytes=4000).collect()
    got = {r.path: r for r in rows}
    assert {p for p, r in got.items() if r.read_error} == {"src/repo1/pkg/big.go", "src/repo2/lib/gone.py", "src/repo2/lib/d.py", "src/repo2/lib/pipe.go"}
    assert got["src/repo1/pkg/big.go"].content is None and "over the bound" in got["src/repo1/pkg/big.go"].read_error
    assert got["src/repo1/pkg/b.py"].content == "def beta():\n    pass\n" and got["src/repo1/pkg/b.py"].repo == "repo1"
    assert "src/repo1/vendor/v/c.go" not in got and "src/repo1/notes.md" not in got and "src/loose.go" not in got
    assert not any("loop" in p for p in got)      # folders behind links are not followed


def test_a_file_that_goes_between_listing_and_reading(spark, root):
    listing = TREE.list_tree(spark, [root]).filter("path like 'src/repo1/%.go'")
    gone = os.path.join(root, "repo1/pkg/late.go")
    with open(gone, "w") as f:
        f.write("package late\n")
    held = spark.createDataFrame(listing.collect(), listing.schema)
    os.remove(gone)
    got = {r.path: r for r in TREE.read_listed(held, root).collect()}
    assert got["src/repo1/pkg/late.go"].content is None and got["src/repo1/pkg/late.go"].read_error
    assert got["src/repo1/pkg/a.go"].content.startswith("func Alpha") and got["src/repo1/pkg/a.go"].read_error is None
    assert TREE.read_listed(held.limit(0), root).count() == 0


def test_filters_reach_the_listing_and_bytes_plan_partitions(spark, root):
    reader = TREE.TreeReader({"root": root, "maxPartitionBytes": "3000"})
    parts = reader.partitions()
    sizes = [sum(r[3] for r in p.rows) for p in parts]
    assert len(parts) > 3 and all(s <= 3000 or len(p.rows) == 1 for s, p in zip(sizes, parts))
    pushed = TREE.TreeReader({"root": root})
    rest = list(pushed.pushFilters([TREE.EqualTo(("repo",), "repo1"), TREE.StringStartsWith(("path",), "src/repo1/pkg"), TREE.LessThan(("size_bytes",), 1000)]))
    assert [type(f).__name__ for f in rest] == ["EqualTo"]
    assert sorted(r[0] for p in pushed.partitions() for r in p.rows) == ["src/repo1/pkg/a.go", "src/repo1/pkg/b.py"]
    listing = TREE.list_tree(spark, [root])
    one = listing.filter("repo = 'repo1' and size_bytes < 1000 and path like 'src/repo1/pkg/%'")
    assert sorted(r.path for r in one.collect()) == ["src/repo1/pkg/a.go", "src/repo1/pkg/b.py"]
    assert "content" not in listing.columns and TREE.list_tree(spark, [root + "-missing"]).count() == 0


def test_errors_are_counted_per_repo(spark, root):
    files = scan(spark, root)
    symbols, rejected = IX.analyse(files)
    assert {(r.path, r.stage) for r in rejected.collect()} == {("src/repo2/lib/gone.py", "read"), ("src/repo2/lib/pipe.go", "read"),
                                                                 ("src/repo2/lib/d.py", "analyse")}
    got = {r.repo: tuple(r)[1:] for r in IX.errors_by_repo(files, symbols, rejected).collect()}
    # invalid syntax is no failure: it is read by patterns
    assert got == {"repo1": (3, 0, 0, 2), "repo2": (5, 2, 1, 2)}
    assert IX.extract_symbols(files).where("path like '%d.py'").count() == 0


def test_counts_are_of_all_files(spark, root):
    listing = TREE.list_tree(spark, [root])
    python = TREE.read_listed(VA.python_listing(listing).filter("read_error is null"), root)
    files = python.withColumn("language", F.lit("python"))
    got = {r.repo: r for r in VA.validate_corpus(files, listing).collect()}
    assert (got["repo1"].go, got["repo1"].py, got["repo1"].primary_language, got["repo1"].python_ok) == (3, 1, "go", True)
    assert (got["repo2"].py, got["repo2"].python_files, got["repo2"].syntax_errors, got["repo2"].primary_language) == (4, 3, 2, "python")
    assert "src/repo2/lib/e.py: " in got["repo2"].messages and "Syntax error in" not in got["repo2"].messages
    first = VA.first_python(listing.filter("read_error is null"), 1).collect()
    assert sorted(r.path for r in first) == ["src/repo1/pkg/b.py", "src/repo2/.cache/f.py"]


def test_directory_sizes_are_those_of_the_listing(spark):
    files = files_df(spark, [("src/r/pkg/a.go", "package a\n"), ("src/r/lib/a.go", "package a\n")])
    listing = spark.createDataFrame([("r", f"src/r/pkg/n{i}.md", f"pkg/n{i}.md") for i in range(5)] + [("r", "src/r/lib/a.go", "lib/a.go")],
                                    "repo string, path string, rel_path string")
    chosen = lambda **k: {r.duplicate_path for r in TR.duplicate_with_drift(files, k=5, max_files=4, **k).record.collect()}
    assert chosen() == {"src/r/pkg_legacy", "src/r/lib_legacy"} and chosen(listing=listing) == {"src/r/lib_legacy"}


def test_tree_view_reaches_every_case(spark):
    from quarry.plans.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    tree = C.tree_files(C.load_table(spark, sf, "documents")).collect()
    assert {r.read_error for r in tree} == {None, "unreadable"} and {r.rel_path.split("/")[0] for r in tree} == {*C.TREE_FOLDERS}
    errors = QUERIES["p8_errors_by_repo"](spark, sf).collect()
    assert sum(r.read_errors for r in errors) > 0 and sum(r.analysis_errors for r in errors) > 0 and sum(r.n_symbols for r in errors) > 0
    listed = QUERIES["a5_listed_languages"](spark, sf).collect()
    assert any(r.py > r.scanned_py for r in listed) and len({r.primary_language for r in listed}) > 1
    assert {r.python_ok for r in QUERIES["t6_listed_validation"](spark, sf).collect()} >= {True, False}
