from quarry.functions import extract as X
from quarry.operators import index as IX
from tests.conftest import files_df

GO_SRC = '''package api

import (
    "fmt"
)

// Service answers requests.
type Service struct {
    name string
}

func NewService(name string) *Service {
    return &Service{name: name}
}

func (s *Service) Serve(req string) string {
    return fmt.Sprintf("%s:%s", s.name, req)
}

func helper (x int) int { return x }
'''

PY_SRC = '''import os, sys
import re
from a.b import c

LIMIT = 3

async def g():
    pass

class A:
    z = 1

    def m(self):
        q = w = 2
        a, b = 1, 2
        k: int = 3
        self.v = 4
'''

CPP_SRC = '''#include <vector>
#include "a/b.h"

class Foo {
 public:
  int get_x();
  void Run(int n);
};

struct P { int x; };

int main(int argc, char** argv) {
  return Done(3);
}
'''


def test_python_symbols_golden():
    assert [s["symbol"] for s in X.python_symbols_of(PY_SRC)] == ["LIMIT", "A", "z", "m", "q", "w"]
    bad = "def ok(x):\n  return x\ndef broken(:\nclass K(object):\n"
    assert [s["symbol"] for s in X.python_symbols_of(bad)] == ["ok", "broken", "K"]


def test_cpp_symbols_golden():
    assert [s["symbol"] for s in X.cpp_symbols_of(CPP_SRC)] == ["Run", "main", "Done", "Foo"]


def test_extract_symbols_and_imports(spark):
    files = files_df(spark, [("src/r/pkg/api/service.go", GO_SRC), ("src/r/m.py", PY_SRC),
                             ("src/r/f.cpp", CPP_SRC), ("src/r/x.js", "function a() {}")])
    syms = IX.extract_symbols(files)
    got = {}
    for r in syms.orderBy("path", "ord").collect():
        got.setdefault(r["path"], []).append((r["symbol"], r["kind"]))
    assert got["src/r/pkg/api/service.go"] == [("NewService", "function"), ("helper", "function"),
                                               ("Service", "type"), ("Serve", "method")]
    assert [s for s, _ in got["src/r/m.py"]] == ["LIMIT", "A", "z", "m", "q", "w"]
    assert [s for s, _ in got["src/r/f.cpp"]] == ["Run", "main", "Done", "Foo"]
    assert "src/r/x.js" not in got                       # X7: no extractor for js
    imps = {}
    for r in IX.extract_imports(files).orderBy("path", "ord").collect():
        imps.setdefault(r["path"], []).append(r["module"])
    assert imps["src/r/m.py"] == ["os,", "re", "a.b"]    # X5
    assert imps["src/r/f.cpp"] == ["vector", "a/b.h"]
    assert "src/r/pkg/api/service.go" not in imps        # X4: grouped import


def test_symbol_index_and_stats(spark):
    files = files_df(spark, [("src/r/a.py", "def f():\n    pass\n"), ("src/r/b.py", "def f():\n    x = 1\n")])
    syms = IX.extract_symbols(files)
    idx = {r["symbol"]: (r["paths"], r["n_files"]) for r in IX.symbol_index(syms).collect()}
    assert idx["f"] == (["src/r/a.py", "src/r/b.py"], 2)
    stats = {r["metric"]: r["value"] for r in IX.corpus_stats(files, syms).collect()}
    assert stats == {"files": 2, "symbols": 2}


def test_a_batch_of_texts_is_analysed_by_slices():
    """Of a batch only a slice stands as Python objects; its results are those of the rows."""
    import tracemalloc

    import pyarrow as pa

    from quarry.functions import extract as X
    text = "int Alpha(int x) {\n  return x; // " + "word " * 2000 + "\n}\nstruct Pair {\n  int a;\n};\n"
    n = 40 * X.SLICE_ROWS + 3
    content = pa.array([None if i % 7 == 3 else text for i in range(n)])
    language = pa.array(["cpp" if i % 5 else "none" for i in range(n)])
    symbols, places = X.checked_udf({"cpp": X.cpp_symbols_of}).func, X.declarations_udf.func
    tracemalloc.start()
    try:
        got, at = symbols(content, language), places(content, language)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < content.nbytes / 4
    pair = [{"symbol": "Alpha", "kind": "function"}, {"symbol": "Pair", "kind": "struct"}]
    assert got.to_pylist() == [{"symbols": None if i % 7 == 3 or i % 5 == 0 else pair, "error": None} for i in range(n)]
    one = [dict(zip(("symbol", "kind", "first_line", "last_line"), d)) for d in X.declarations_of(text, "cpp")]
    assert at.to_pylist() == [[] if i % 7 == 3 else one for i in range(n)]
    assert len(symbols(content.slice(0, 0), language.slice(0, 0))) == 0


def test_batches_of_texts_end_by_bytes(spark):
    """What crosses to a Python worker at a time is bounded by bytes, not by rows of any size."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from quarry.session import BATCH_BYTES
    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "# word\n" * 20_000

    def probe(content: pa.Array) -> pa.Array:
        return pa.array([content.nbytes] * len(content), pa.int64())

    def batches(read, bound=None):
        own = spark.newSession()
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        if bound:
            own.conf.set(key, bound)
        rows = own.range(0, 200, 1, 1).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.lit("python").alias("language"),
                                              F.concat(F.lit(text), F.col("id").cast("string")).alias("content"), F.lit(None).cast("string").alias("read_error"))
        assert read(rows).columns
        return rows.select(F.arrow_udf(probe, "long")("content").alias("n")).agg(F.max("n")).first()[0]

    for read in (IX.extract_symbols, IX.declarations, lambda rows: IX.analyse(rows)[0]):
        assert batches(read) <= BATCH_BYTES + 2 * len(text)
    assert batches(IX.declarations, str(2 * BATCH_BYTES)) > BATCH_BYTES + 2 * len(text)      # a bound that is set stays


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_analysed_once(spark):
    """No filter analyses the texts a second time."""
    files = files_df(spark, [("src/r/a.go", GO_SRC), ("src/r/b.py", PY_SRC), ("src/r/c.txt", "none"), ("src/r/d.py", "")])
    for df in (IX.extract_symbols(files), IX.declarations(files)):
        assert _plan(df).count("ArrowEvalPython") == 1
    assert {r["path"] for r in IX.extract_symbols(files).collect()} == {"src/r/a.go", "src/r/b.py"}
    assert {r["path"] for r in IX.declarations(files).collect()} == {"src/r/a.go", "src/r/b.py"}


def test_uses_are_counted_within_their_files(spark):
    """no shuffle of the uses; rows that share a path are added up."""
    import re
    from collections import Counter
    texts = [("src/r/a.go", GO_SRC), ("src/r/b.py", PY_SRC), ("src/r/b.py", "import os\nos = os_1\n"), ("src/r/b.py", PY_SRC), ("src/r/c.txt", "12 + 3"),
             ("src/r/d.txt", ""), ("src/r/e.txt", "one"), ("src/r/f.txt", "b a b")]
    rows = spark.createDataFrame([*texts, ("src/r/n.txt", None), (None, "lost lost"), (None, "lost")], "path string, content string")
    want = Counter((x, p) for p, text in [*texts, (None, "lost lost lost")] for x in re.findall(r"(?a:[A-Za-z_]\w*)", text))
    got = IX.reference_index(rows)
    assert sorted((r.identifier, str(r.path), r.n) for r in got.collect()) == sorted((x, str(p), n) for (x, p), n in want.items())
    assert got.dtypes == [("identifier", "string"), ("path", "string"), ("n", "bigint")]
    assert "Exchange" not in _plan(IX.reference_index(spark.createDataFrame(dict(texts).items(), "path string, content string")))
