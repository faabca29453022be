from pyspark.sql import functions as F

from quarry.functions import rewrite as RW
from quarry.functions import text as TX


def _one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_line_count_matches_splitlines(spark):
    cases = ["", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n", "a b\x0bc\x85"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    got = [r["n"] for r in df.select(TX.line_count("c").alias("n")).collect()]
    assert got == [len(c.splitlines()) for c in cases] == [0, 1, 1, 2, 2, 2, 3]


def test_decode_drops_invalid_bytes_and_folds_newlines(spark):
    df = spark.createDataFrame([(bytearray(b"\xff\xffint f"),), (bytearray(b"x=1\r\ny=2\n"),)], "b binary")
    rows = df.select(TX.decode_text("b").alias("t")).collect()
    assert rows[0]["t"] == "int f"
    assert rows[1]["t"] == "x=1\ny=2\n"
    assert df.select(TX.size_bytes(TX.decode_text("b")).alias("n")).collect()[1]["n"] == 8


def test_scan_rules(spark):
    paths = ["r/vendor/a.go", "r/vendor/x/a.go", "r/latest/x/a.go", "r/latest/a.go",
             "r/a_test.go", "r/a.test.js", "r/test_a.py", "r/a.cc", "r/A.PY"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: (r["s"], r["lang"]) for r in
           df.select("path", TX.is_scanned("path").alias("s"), TX.detect_language("path").alias("lang")).collect()}
    assert got["r/vendor/a.go"][0] is True           # X1: no trailing slash on the dir string
    assert got["r/vendor/x/a.go"][0] is False
    assert got["r/latest/x/a.go"][0] is False        # 'latest/' contains 'test/'
    assert got["r/latest/a.go"][0] is True
    assert got["r/a_test.go"][0] is False and got["r/a.test.js"][0] is False
    assert got["r/test_a.py"][0] is True
    assert got["r/a.cc"] == (False, "cpp")           # X2
    assert got["r/A.PY"] == (False, "python")        # P4 lower-cases, P1 does not


def test_small_functions(spark):
    assert _one(spark, RW.wrapper_path, "d/zz_generated.conversion.go") == "d/zz_generated.conversion_wrapper.go"
    assert _one(spark, TX.api_name, "FooMethodV2(param1, param2, options={})") == "FooMethodV2"
    assert _one(spark, TX.api_name, "FooMethod") == ""
    assert _one(spark, TX.task_type_of, "cross_file_reasoning_01") == "cross_file_reasoning"
    assert _one(spark, TX.task_type_of, "abc") == ""
    assert _one(spark, RW.drift_constants, "60 160 60s 0.60 x60") == "65 160 60s 0.65 x60"
    assert _one(spark, TX.basename, "a/b/c.go") == "c.go"
    assert _one(spark, TX.stem, "a/b/c.tar.gz") == "c.tar"


def test_word_boundaries(spark):
    df = spark.createDataFrame([("la léla la_ la", "la")], "t string, w string")
    r = df.select(TX.count_word("t", "w", "unicode").alias("u"), TX.count_word("t", "w", "ascii").alias("a")).first()
    assert r["u"] == 2          # 'léla' is one word for Python's \b
    assert r["a"] == 3          # ASCII: 'é' is a boundary
    df2 = spark.createDataFrame([("a$b \\E x", "a$b \\E", "n$1\\")], "t string, o string, n string")
    assert df2.select(TX.replace_word("t", "o", "n", "ascii").alias("r")).first()["r"] == "n$1\\ x"


def test_line_count_of_every_break_without_a_pattern(spark):
    """Breaks are counted by byte searches, not by a pattern."""
    import itertools
    marks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", "é", "\U0001F600", "", "a\u2027"]
    texts = [f"{a}x{b}{c}" for a, b, c in itertools.product(marks, repeat=3)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string").select("c", TX.line_count("c").alias("n"))
    assert all(r.n == (None if r.c is None else len(r.c.splitlines())) for r in df.collect())
    assert "regexp" not in df._jdf.queryExecution().executedPlan().toString()
