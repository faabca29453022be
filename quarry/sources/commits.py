"""Versioned tables with a commit log.

A change writes its data files into a folder of their own first and becomes
visible with one small commit file, ``_commits/<number>.json``, that is put in
place by a rename which fails if the name is taken.  A job that dies before
leaves only files that no commit names; two writers of one version can't both
win.  Everything goes through Hadoop's file systems, so the log lives wherever
Spark writes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _file(self, n: int):
        return self._path(f"{self.root}/_commits/{n:010d}.json")

    def last(self) -> int:
        """Number of the latest commit, 0 without one."""
        folder = self._path(f"{self.root}/_commits")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(x[:10]) for x in names if x.endswith(".json") and x[:10].isdigit()), default=0)

    def read(self, n: int) -> dict:
        row = self.spark.read.text(self._file(n).toString(), wholetext=True).first()
        return json.loads(row["value"])

    def commit(self, n: int, content: dict) -> None:
        """Put commit ``n`` in place, all of it or nothing."""
        draft = self._path(f"{self.root}/_commits/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(draft, self._file(n), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if self._fs.exists(self._file(n)):
                raise Conflict(f"commit {n} of {self.root} is taken") from e
            raise


class KeyedTable:
    """A table with one group of rows per key that is changed by keys.

    Rows lie in ``buckets`` by a hash of the key; a merge rewrites the buckets
    it touches and takes the folders of the others over into its commit, so its
    cost follows the change, not the table.  A merge names its batch: one that
    is committed already (a restarted stream sends its last batch again) does
    nothing."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "path", buckets: int = 32):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.log = CommitLog(spark, root)

    def _state(self) -> dict:
        n = self.log.last()
        return self.log.read(n) if n else {"number": 0, "buckets": {}, "batches": {}}

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """The latest version."""
        return self._folders(sorted(self._state()["buckets"].values()))

    def merge(self, keys: DataFrame, rows: DataFrame, batch: str, stream: str = "") -> bool:
        """Replace what stands under ``keys`` by ``rows`` (of these keys; keys
        without rows are retracted).  False if the batch is in already."""
        state = self._state()
        if state["batches"].get(stream) == batch:
            return False
        from quarry.session import cut_lineage
        gone = cut_lineage(keys.select(self.key).unionByName(rows.select(self.key)).distinct().withColumn("bucket", self._bucket()))
        touched = [r["bucket"] for r in gone.select("bucket").distinct().collect()]       # at most ``buckets`` numbers
        kept = self._folders([state["buckets"][str(b)] for b in touched if str(b) in state["buckets"]])
        kept = kept.join(gone.select(self.key), self.key, "left_anti")
        new = kept.unionByName(rows.select(*kept.columns)).withColumn("bucket", self._bucket())
        number = state["number"] + 1
        folder = f"{self.log.root}/data/{number:010d}-{uuid.uuid4().hex}"
        new.write.partitionBy("bucket").parquet(folder)
        buckets = {b: f for b, f in state["buckets"].items() if int(b) not in touched}
        made = self.log._path(folder)
        for s in self.log._fs.listStatus(made):
            name = s.getPath().getName()
            if name.startswith("bucket="):
                buckets[name[7:]] = f"{folder}/{name}"
        self.log.commit(number, {"number": number, "buckets": buckets, "batches": {**state["batches"], stream: batch}})
        return True


class Steps:
    """A chain of steps, each committed with its tables: a run that is started
    again goes on after the last committed step."""

    def __init__(self, spark: SparkSession, root: str, settings: dict):
        self.spark, self.log, self.settings = spark, CommitLog(spark, root), settings
        self.done: list[dict] = [self.log.read(n) for n in range(1, self.log.last() + 1)]
        if any(d["settings"] != settings for d in self.done):
            raise ValueError(f"{root} holds steps of other settings")
        self.at = 0

    def run(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a step: those committed, or made, written and committed now."""
        self.at += 1
        if self.at > len(self.done):
            folder, tables = f"{self.log.root}/data/{self.at:03d}-{name}-{uuid.uuid4().hex}", {}
            for table, df in make().items():
                df.write.parquet(f"{folder}/{table}")
                tables[table] = [f"{folder}/{table}", df.schema.json()]
            self.log.commit(self.at, {"step": name, "settings": self.settings, "tables": tables})
            self.done.append(self.log.read(self.at))
        step = self.done[self.at - 1]
        if step["step"] != name:
            raise ValueError(f"step {self.at} of {self.log.root} is {step['step']}, not {name}")
        from pyspark.sql.types import StructType
        return {t: self.spark.read.schema(StructType.fromJson(json.loads(s))).parquet(f) for t, (f, s) in step["tables"].items()}
