"""Where names are declared, and lines in ranges, against plain loops."""

import random
import re

from quarry.functions import extract as X
from quarry.operators import index as IX
from quarry.operators import ranges as RG
from quarry.operators import tasks as TK
from quarry.sources import corpus as C
from tests.conftest import files_df

GO = "package a\n\nfunc Alpha(x int) int {\n\tif x > 0 {\n\t\treturn 1\n\t}\n\treturn 0\n}\n\ntype Box struct {\n\tv int\n}\n\nfunc (b Box) Get() int {\n\treturn b.v\n}\n"
PY = "import os\n\n\nclass Shape:\n    area = 1\n\n    def grow(self):\n        return (1 +\n                2)\n\n\nx = y = 3\n"
CPP = "int proto(int x);\nint Main(int x) {\n  for (;;) {\n  }\n}\nstruct Pair {\n  int a;\n};\n"


def test_declarations_have_their_lines():
    assert X.declarations_of(GO, "go") == [("Alpha", "function", 3, 8), ("Box", "type", 10, 12), ("Get", "method", 14, 16)]
    assert X.declarations_of(PY, "python") == [("Shape", "class", 4, 9), ("x", "variable", 12, 12), ("y", "variable", 12, 12),
                                               ("area", "variable", 5, 5), ("grow", "function", 7, 9)]
    assert X.declarations_of("def broken(:\n  class Odd:\n", "python") == [("broken", "function", 1, 1), ("Odd", "class", 2, 2)]
    got = X.declarations_of(CPP, "cpp")
    assert ("proto", "function", 1, 1) in got and ("Main", "function", 2, 5) in got and ("Pair", "struct", 6, 8) in got
    assert X.declarations_of("func Open(x int) {\n\tnever closed\n", "go") == [("Open", "function", 1, 1)]
    assert X.declarations_of("", "go") == [] and X.declarations_of(None, "go") is None


def test_position_index_of_the_code_view(spark):
    """Every extracted name has a place, and stands on its line."""
    files = C.code_files(C.load_table(spark, "/root/testdata/sf0.001", "documents"))
    text = {r.path: r.content.split("\n") for r in files.collect()}
    placed = IX.declarations(files).collect()
    names = sorted((r.path, r.symbol, r.kind) for r in IX.extract_symbols(files).collect())
    assert sorted((r.path, r.symbol, r.kind) for r in placed) == names
    for r in placed:
        assert re.search(rf"\b{r.symbol}\b", text[r.path][r.first_line - 1]) and 0 < r.first_line <= r.last_line <= len(text[r.path])


def test_lines_in_ranges_against_a_loop(spark):
    rng = random.Random(5)
    texts = {f"f{i}": "\n".join(f"line {k}" for k in range(1, rng.choice([0, 1, 5, 300]) + 1)) + rng.choice(["", "\n"]) for i in range(12)}
    spans = [(i, rng.choice([*texts, "missing"]), rng.randint(1, 310), rng.randint(0, 310)) for i in range(60)] + [(99, "f0", 7, 6), (98, "f1", 1, 10_000)]
    ranges = spark.createDataFrame(spans, "id int, path string, first_line int, last_line int")
    files = spark.createDataFrame([*texts.items(), ("null", None)], "path string, content string")
    got = {(r.id, r.line_no, r.line) for r in RG.lines_in_ranges(ranges, files).collect()}
    want = set()
    for i, path, lo, hi in spans:
        lines = texts.get(path, "").split("\n")
        lines = lines[:-1] if lines[-1] == "" and texts.get(path, "").endswith("\n") else lines if path in texts else []
        want |= {(i, n, x) for n, x in enumerate(lines, 1) if lo <= n <= hi}
    assert got == want and len(want) > 100
    assert RG.lines_in_ranges(ranges.limit(0), files).count() == 0


def test_truth_holds_real_lines(spark):
    files = files_df(spark, [("src/r/a.go", GO), ("src/r/b.go", "package b\n\nfunc Other(x int) int {\n\treturn Alpha(x)\n}\n"), ("src/r/c.go", "// none\nfunc  Alpha (y int) {\n}\n")])
    symbols = IX.extract_symbols(files)
    placed = IX.first_declarations(IX.declarations(files))
    renames = spark.createDataFrame([("Alpha", "Beta", 1), ("Gone", "New", 2)], "old string, new string, rank long")
    _, truth = TK.rename_tasks(renames, symbols, placed)
    assert sorted((r.task_id, r.file or "", r.line) for r in truth.collect()) == [
        ("refactor_rename_01", "src/r/a.go", 3), ("refactor_rename_01", "src/r/c.go", 2), ("refactor_rename_02", "", 0)]
    record = spark.createDataFrame([("Alpha", "AlphaV2", "src/r/a.go", 1, 1, 1)], "symbol string, v2_symbol string, definition_file string, "
                                   "total_callsites int, migrated_callsites int, rank long")
    actions = spark.createDataFrame([("Alpha", "src/r/c.go", "migrate")], "symbol string, path string, action string")
    _, calls = TK.api_tasks(record, actions, symbols, files)
    assert [(r.file, r.line, r.needs_upgrade) for r in calls.collect()] == [("src/r/c.go", 2, True)]
    _, plain = TK.api_tasks(record, actions, symbols)
    assert [r.line for r in plain.collect()] == [0] and plain.columns == calls.columns
