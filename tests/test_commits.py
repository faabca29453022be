"""Versioned tables: merges equal a rebuild, runs that die resume, nothing half done is seen."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import index as IX
from quarry.operators import transforms as TR
from quarry.plans import jobs as JB
from quarry.sources import commits as CM
from quarry.sources import corpus as C
from quarry.streaming.changes import SymbolTable
from tests.conftest import files_df

GO = "func {}(x int) int {{\n\treturn x\n}}\n"


def root(name):
    return tempfile.mkdtemp(prefix=f"quarry-{name}-", dir="/tmp")


def postings(df):
    return sorted((r.symbol, r.path) for r in IX.symbol_postings(df).collect())


def test_index_equals_a_rebuild_after_edits_and_deletions(spark):
    held = SymbolTable(spark, root("index"), buckets=4)
    first = {f"src/r/f{i}.go": GO.format(f"Name{i}") + GO.format(f"Shared{i % 3}") for i in range(20)}
    assert held.refresh(files_df(spark, list(first.items())), "1")
    second = {p: GO.format("Edited") if i % 4 == 0 else t for i, (p, t) in enumerate(first.items()) if i % 5}
    second["src/r/new.py"] = "def fresh():\n    pass\n"
    files = files_df(spark, list(second.items()))
    assert held.refresh(files, "2") and postings(held.symbols()) == postings(IX.extract_symbols(files))
    assert not any(s == "Name0" for s, _ in postings(held.symbols()))
    # the same batch again does nothing, an unchanged snapshot changes nothing, an empty one withdraws all
    assert not held.refresh(files_df(spark, [("src/r/other.go", GO.format("Other"))]), "2")
    held.refresh(files, "3")
    assert postings(held.symbols()) == postings(IX.extract_symbols(files))
    held.refresh(files.limit(0), "4")
    assert held.symbols().count() == 0 and held.table.read().count() == 0


def test_a_merge_rewrites_only_touched_buckets(spark):
    t = CM.KeyedTable(spark, root("keyed"), "path string, n int", buckets=8)
    t.merge(spark.createDataFrame([], "path string"), spark.createDataFrame([(f"k{i}", i) for i in range(50)], "path string, n int"), "a")
    before = t._state()["buckets"]
    t.merge(spark.createDataFrame([("k7",)], "path string"), spark.createDataFrame([("k7", 70), ("k7", 71)], "path string, n int"), "b")
    after = t._state()["buckets"]
    assert len([b for b in before if before[b] != after.get(b)]) == 1
    assert sorted(tuple(r) for r in t.read().collect() if r.path == "k7") == [("k7", 70), ("k7", 71)] and t.read().count() == 51


def test_data_without_a_commit_is_not_seen_and_one_writer_wins(spark, monkeypatch):
    t = CM.KeyedTable(spark, root("keyed"), "path string, n int", buckets=2)
    rows = spark.createDataFrame([("a", 1)], "path string, n int")
    monkeypatch.setattr(CM.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        t.merge(rows.select("path"), rows, "1")
    monkeypatch.undo()
    assert t.read().count() == 0
    assert t.merge(rows.select("path"), rows, "1") and t.read().count() == 1
    with pytest.raises(CM.Conflict):
        t.log.commit(1, {"number": 1})
    assert t.log.last() == 1 and not [f for f in os.listdir(t.log.root + "/_commits") if "draft" in f and not f.endswith(".crc")]


def test_stream_of_changes(spark):
    feed, out = root("feed"), root("stream")
    cols = [*C.FILES_COLUMNS, "deleted", "seq"]

    def drop(rows, name):
        df = files_df(spark, [(p, t or "") for p, t, _, _ in rows])
        more = spark.createDataFrame([(p, d, s) for p, _, d, s in rows], "path string, deleted boolean, seq long")
        df = df.dropDuplicates(["path", "content"]).join(more, "path").filter("true")
        df.select(*cols).coalesce(1).write.parquet(f"{feed}/{name}")
        for f in os.listdir(f"{feed}/{name}"):
            if f.endswith(".parquet"):
                os.rename(f"{feed}/{name}/{f}", f"{feed}/{name}.parquet")
    schema = files_df(spark, [("src/r/a.go", "")]).withColumns({"deleted": F.lit(False), "seq": F.lit(1).cast("long")}).select(*cols).schema
    held = SymbolTable(spark, out + "/index", buckets=4)

    def go():
        q = held.follow(spark.readStream.schema(schema).parquet(feed + "/*.parquet"), out + "/checkpoint")
        q.awaitTermination()
        return postings(held.symbols())
    drop([("src/r/a.go", GO.format("Alpha"), False, 1), ("src/r/b.go", GO.format("Beta"), False, 2)], "one")
    assert go() == [("Alpha", "src/r/a.go"), ("Beta", "src/r/b.go")]
    drop([("src/r/a.go", GO.format("Gamma"), False, 3), ("src/r/b.go", None, True, 4)], "two")
    assert go() == [("Gamma", "src/r/a.go")]
    assert go() == [("Gamma", "src/r/a.go")]


def test_a_run_that_dies_resumes(spark, monkeypatch):
    files = C.code_files(C.load_table(spark, "/root/testdata/sf0.001", "documents"))
    s = JB.Settings(rename_mode="word", boundary="ascii")
    at, made = root("steps"), []
    whole = JB.apply_all(files, s)
    wrap, extract = TR.add_wrappers, IX.extract_symbols
    monkeypatch.setattr(TR, "add_wrappers", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        JB.apply_all(files, s, at)
    assert CM.CommitLog(spark, at).last() == 3       # index, rename, migrate
    monkeypatch.setattr(TR, "add_wrappers", wrap)
    monkeypatch.setattr(IX, "extract_symbols", lambda *a: made.append(1) or extract(*a))
    again = JB.apply_all(files, s, at)
    assert not made                                  # no earlier step runs again
    table = lambda df: sorted(map(str, df.collect()))
    assert table(again["files"].select("path", "sha")) == table(whole["files"].select("path", "sha"))
    assert table(again["summary"]) == table(whole["summary"])
    assert {k: table(v) for k, v in again["records"].items()} == {k: table(v) for k, v in whole["records"].items()}
    with pytest.raises(ValueError):
        JB.apply_all(files, JB.Settings(seed=7), at)
