from pyspark.sql import functions as F

from quarry.functions import rewrite as RW
from quarry.functions import text as TX
from quarry.operators import index as IX
from quarry.operators import transforms as TR
from tests.conftest import files_df

HEAD = "func (h *RequestHandler) Handle(req string) {\n\treturn\n}\n"


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first()["r"]


def test_parity_rename_reproduces_head_substring_quirk(spark):
    c, o, n = F.col("c"), F.col("o"), F.col("n")
    assert one(spark, RW.rename_go(c, o, n), c=HEAD, o="Handle", n="Handle_Legacy").startswith(
        "func (h *RequestHandle_Legacyr) Handle_Legacy(req")            # X6
    assert one(spark, TX.replace_word(c, o, n), c=HEAD, o="Handle", n="Handle_Legacy").startswith(
        "func (h *RequestHandler) Handle_Legacy(req")


def test_parity_rename_go_keeps_other_receivers(spark):
    src = ("type Run struct {}\nfunc  Run (x Runner) {}\nfunc (r *Runner) Walk() { Run(1) }\n"
           "func (a RunRun, b Run) Run(x Runner) { Runner(Run) }\nx := Runner{}\n")
    assert one(spark, RW.rename_go(F.col("c"), F.col("o"), F.col("n")), c=src, o="Run", n="Go") == (
        "type Go struct {}\nfunc Go(x Runner) {}\nfunc (r *Runner) Walk() { Go(1) }\n"
        "func (a GoGo, b Go) Go(x Runner) { Runner(Go) }\nx := Runner{}\n")


def test_parity_rename_python(spark):
    src = "class  Foo(Base):\n    pass\ndef Foo (x):\n    return Foo, Foobar\n"
    assert one(spark, RW.rename_python(F.col("c"), F.col("o"), F.col("n")), c=src, o="Foo", n="$1_Foo") == (
        "class  $1_Foo(Base):\n    pass\ndef $1_Foo(x):\n    return $1_Foo, Foobar\n")
    assert one(spark, RW.rename_python(F.col("c"), F.col("o"), F.col("n")), c="class a:\n", o="a", n="bb") == "clbbss bb:\n"


def test_clone_functions(spark):
    go = "package a\n\nfunc Foo(x int) int {\n\treturn x\n}\n\nfunc Bar() {}\n"
    out = one(spark, RW.clone_go_function(F.col("c"), F.col("o"), F.col("n")), c=go, o="Foo", n="FooV2")
    assert out == go.replace("}\n\nfunc Bar", "}\n\nfunc FooV2(x int) int {\n\treturn x\n}\n\nfunc Bar")
    py = "def Foo(x):\n    return x\n\nother = 1\n"
    assert RW.clone_python_function(py, "Foo", "FooV2") == (
        "def Foo(x):\n    return x\n\n\n\ndef FooV2(x):\n    return x\n\nother = 1\n")
    assert RW.clone_python_function("def Foo(): pass", "Foo", "FooV2") == "def Foo(): pass\n\ndef FooV2(): pass"
    assert RW.clone_python_function("def Foo() -> int:\n    return 1\n", "Foo", "FooV2").count("def") == 1


def test_migrations_by_language(spark):
    steps = "array(named_struct('action', 'define', 'old', 'Foo', 'new', 'FooV2'), named_struct('action', 'migrate', 'old', 'Bar', 'new', 'BarV2'))"
    rows = [("python", "def Foo():\n    Bar()\n"), ("go", "func Foo() { Bar() }\n"), ("cpp", "int Foo() { Bar(); }\n"), ("go", None)]
    df = spark.createDataFrame(rows, "language string, content string").withColumn("actions", F.expr(steps))
    got = [r["r"] for r in df.select(RW.apply_migrations("content", "language", "actions").alias("r")).collect()]
    assert got == ["def Foo():\n    BarV2()\n\n\ndef FooV2():\n    BarV2()\n",
                   "func Foo() { BarV2() }\n\nfunc FooV2() { BarV2() }\n", "int Foo() { BarV2(); }\n", None]


def test_rename_job_word_and_parity(spark):
    files = files_df(spark, [("src/r/a.go", "package a\n\nfunc Alpha() {}\nfunc Beta() { Alpha() }\n"),
                             ("src/r/b.go", "package a\n\nfunc Alpha() {}\n")])
    syms = IX.extract_symbols(files)
    res = TR.rename_symbols(files, syms, p=0.5, seed=42, mode="word")
    rmap = {r["old"]: r["new"] for r in res.record.collect()}
    assert len(rmap) == 1                                 # max(1, int(2 * 0.5))
    (old, new), = rmap.items()
    contents = {r["path"]: r["content"] for r in res.files.collect()}
    defining = sorted(r["path"] for r in syms.filter(F.col("symbol") == old).select("path").distinct().collect())
    import re
    for p in defining:
        assert re.search(rf"\b{old}\b", contents[p]) is None and new in contents[p]
    par = TR.rename_symbols(files, syms, p=0.5, seed=42, mode="parity")
    assert {r["path"]: r["content"] for r in par.files.collect()} == contents
    stats = {r["metric"]: r["value"] for r in TR.rename_stats(res).collect()}
    assert stats["renames"] == 1 and stats["files_changed"] == len(defining)


def test_duplicate_with_drift(spark):
    files = files_df(spark, [("src/r/pkg/a.go", '// x\nlog("INFO") 60 1024\n'),
                             ("src/r/pkg/b.txt.py", "print('error')\n"),
                             ("src/r/other/c.go", "package c\n")])
    res = TR.duplicate_with_drift(files, k=2)
    rows = {r["path"]: r for r in res.touched.collect()}
    a = rows["src/r/pkg_legacy/a.go"]
    assert a["content"] == '// LEGACY VERSION - DO NOT USE\n// x\nlog("DEBUG") 65 1000\n' and a["modified"]
    assert rows["src/r/pkg_legacy/b.txt.py"]["content"] == "print('warn')\n"
    rec = {r["original_path"]: r["modified_files"] for r in TR.duplication_record(res).collect()}
    assert set(rec) == {"src/r/pkg", "src/r/other"}
    assert rec["src/r/other"] == []
    audit = {r["path"]: r["changed_lines"] for r in TR.drift_audit(res).collect()}
    assert audit["src/r/pkg_legacy/a.go"] == 2


def test_wrappers(spark):
    files = files_df(spark, [("src/r/pkg/a.go", "package a\n\nfunc Alpha() {}\n"),
                             ("src/r/m.py", "def beta():\n    pass\n")])
    res = TR.add_wrappers(files, IX.extract_symbols(files), n=8)
    rec = {r["symbol"]: r for r in res.record.collect()}
    assert rec["Alpha"]["wrapper_file"] == "src/r/pkg/a_wrapper.go"
    assert rec["Alpha"]["call_chain"] == "caller -> src/r/pkg/a_wrapper.go -> src/r/pkg/a.go"
    gen = {r["path"]: r["content"] for r in res.touched.collect()}
    assert "func AlphaWrapper(" in gen["src/r/pkg/a_wrapper.go"]
    assert "def wrap_beta(" in gen["src/r/m_wrapper.py"]
    assert res.files.count() == 4
    assert res.files.filter(F.col("path").endswith("_wrapper.py")).count() == 1
