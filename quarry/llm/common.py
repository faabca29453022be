"""Helpers shared by the operators of this subpackage.

Scratch tables are Parquet below the shared folder the cluster names in
``spark.checkpoint.dir``; every executor can read them again after another
executor is lost.  Nothing is written to a machine-local folder on a cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.session import ensure_checkpoint_dir

#: Rows per Arrow batch: rows are whole texts, so batches stay small.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with the batch bound set."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


class Scratch:
    """Tables of one job in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a table and return the table: its lineage ends here."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def positions(df: DataFrame, key: str, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``pos``, a row's place from 0 among the rows of its ``key``
    in the given order, and ``total``, the rows of its key.  One range shuffle
    on key and order, so a key of any size is spread over tasks; a task's rows
    of a key are then shifted by those of earlier tasks, from one count per
    (task, key).  ``key`` must not be null; give a table, as its ranges are
    found by reading it once more."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc(key), *order]
    rows = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("row_", F.monotonically_increasing_id())
    # the upper bits of that number are the task's, the lower ones count its rows
    rows = scratch.save(rows, name).withColumn("task_", F.shiftright("row_", 33))
    runs = rows.groupBy("task_", key).agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    of_key = W.partitionBy(key)
    runs = runs.select("task_", key, (F.sum("n_").over(of_key.orderBy("task_")) - F.col("n_") - F.col("first_")).alias("shift_"),
                       F.sum("n_").over(of_key).alias("total"))
    return rows.join(runs, ["task_", key]).withColumn("pos", F.col("row_") + F.col("shift_")).drop("task_", "row_", "shift_")


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the
    smallest node reachable.  Alternating large-star and small-star steps
    (each a partial ``min`` per node and an equi-join, so a hub is pre-aggregated
    and its join partition can be split); every round's edges are a table.
    Null ends are ignored; an empty edge table gives an empty result.  The node
    type is kept, any ordered type will do."""
    cur = edges.select("a", "b").where("a <> b")
    last, k = None, 0
    while True:
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, f"{name}-large{k}")
        # small star: every edge already points to a smaller node
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = scratch.save(small.select("e.a", "e.b").where("a <> b").distinct(), f"{name}-small{k}")
        mark = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if k:
            scratch.drop(f"{name}-small{k - 1}")
        scratch.drop(f"{name}-large{k}")
        if (mark.n, mark.s) == last:
            break
        last, cur, k = (mark.n, mark.s), small, k + 1
    return small.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def unused(name: str, df: DataFrame) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_key(text: str = "text") -> Column:
    """Hash that tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


# ---------------------------------------------------------------- words of a batch, without a loop over words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit Murmur3 hash (fixed values: its constants)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words (runs without space, tab, LF, VT, FF, CR) of one batch of
    texts: 64-bit hashes, byte bounds and the text each belongs to.  A word's
    hash is its polynomial over the bytes, from running sums, then mixed."""

    def __init__(self, texts: pa.Array, lower: bool):
        off, data = text_buffers(texts)
        # one separator byte after each text, so that words never cross texts
        n = len(off) - 1
        sizes = np.diff(off)
        keep = np.arange(len(data)) + np.repeat(np.arange(n), sizes)
        raw = np.full(len(data) + n, 0x20, dtype=np.uint8)
        raw[keep] = data
        self.start_of_text = off[:-1] + np.arange(n)
        self.raw = raw
        space = _SPACE[raw]
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.doc = np.searchsorted(self.start_of_text, self.start, side="right") - 1
        body = (_LOWER[raw] if lower else raw).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(body * _powers(_BASE, len(raw)), dtype=np.uint64)))
            h = (run[self.end] - run[self.start]) * _powers(_BASE_INV, len(raw) + 1)[self.start]
            self.hash = mix64(h + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, 64-bit hash) of every ``k``-word shingle; a text with fewer
        words gives its whole word sequence as one, one without words none."""
        h, doc = self.hash, self.doc
        count = np.bincount(doc, minlength=n_docs)
        first = np.concatenate(([0], np.cumsum(count)))
        out_doc, out = [], []
        with np.errstate(over="ignore"):
            if len(h) >= k:
                roll = np.zeros(len(h) - k + 1, dtype=np.uint64)
                for i in range(k):
                    roll = mix64(roll + h[i:len(h) - k + 1 + i] * np.uint64(2 * i + 3))
                same = doc[:len(h) - k + 1] == doc[k - 1:]
                out_doc.append(doc[:len(h) - k + 1][same])
                out.append(roll[same])
            for d in np.flatnonzero((count > 0) & (count < k)):
                v = np.uint64(count[d])
                for x in h[first[d]:first[d + 1]]:
                    v = mix64(np.array([v * np.uint64(31) + x], dtype=np.uint64))[0]
                out_doc.append(np.array([d]))
                out.append(np.array([v], dtype=np.uint64))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(out_doc).astype(np.int64), np.concatenate(out)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets from 0 and the UTF-8 bytes of an Arrow string array; null is empty."""
    big = texts.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(big.buffers()[1], dtype=np.int64)[big.offset:big.offset + len(big) + 1]
    data = big.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return off - off[0], data
