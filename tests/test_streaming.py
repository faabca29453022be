import os
import tempfile

from quarry.streaming.incremental import start_incremental_index


def _write(root, rel, text):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_incremental_index_picks_up_only_new_files(spark):
    d = tempfile.mkdtemp(prefix="quarry-stream-", dir="/tmp")
    src, sink, ckpt = os.path.join(d, "src"), os.path.join(d, "sink"), os.path.join(d, "ckpt")
    _write(src, "repo1/a.go", "package a\n\nfunc Alpha() {}\n")
    _write(src, "repo1/vendor/x/b.go", "package b\n\nfunc Hidden() {}\n")
    q = start_incremental_index(spark, src, sink, ckpt)
    q.awaitTermination(120)
    first = sorted((r["path"], r["symbol"]) for r in spark.read.parquet(sink).collect())
    assert first == [("src/repo1/a.go", "Alpha")]
    _write(src, "repo2/m.py", "def beta():\n    pass\n")
    q = start_incremental_index(spark, src, sink, ckpt)
    q.awaitTermination(120)
    rows = sorted((r["path"], r["symbol"]) for r in spark.read.parquet(sink).collect())
    assert rows == [("src/repo1/a.go", "Alpha"), ("src/repo2/m.py", "beta")]
