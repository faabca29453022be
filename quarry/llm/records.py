"""Token-id output as length-delimited binary records.

A shard is a sequence of frames in ascending doc_id order:

    length   8 bytes, little-endian, of the payload
    check    4 bytes, masked CRC-32 of the length
    payload  doc_id (8 bytes, signed), flags (1: doc_id is null; 2: 32-bit ids),
             3 zero bytes, then the ids, 16 or 32 bits each, little-endian
    check    4 bytes, masked CRC-32 of the payload
    end      1 byte, 0x0A

A masked checksum is the CRC-32 turned right by 15 bits plus 0xa282ead8, so
that checksums of data holding checksums stay sound.  Ids take 16 bits in
files of vocabularies below 65,536.  The offset index is a table apart
(shard, doc_id, frame_offset, frame_bytes, start, n_tokens), so a shuffled
reader can fetch single frames.

Texts are dealt by ranges of doc_id and sorted, then encoded inside the
sorted partitions; frames go out through Spark's text writer (the end byte is
its line end), so shards are committed by task and survive lost executors on
any file system that Spark writes.  Whole shards are read back with Spark's
binary reader, every checksum verified.

Defined results: null text counts as empty; a null doc_id sorts first; rows of
equal doc_id are ordered by a hash of the text and all written; an empty table
gives no frames and an empty index; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, text_key
from quarry.llm.encoder import encoder, regroup

_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qB3x")
END = b"\n"


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    """One record; ``ids`` are little-endian unsigned 32-bit."""
    if not wide:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    payload = _META.pack(doc_id or 0, (doc_id is None) + 2 * wide) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload)), END))


def frames(shard: bytes) -> Iterator[tuple[int, int, int | None, bytes]]:
    """(offset, bytes, doc_id, 32-bit ids) of each record; every check verified."""
    at, view = 0, memoryview(shard)
    while at < len(view):
        length, check = _HEAD.unpack_from(view, at)
        if masked(bytes(view[at:at + 8])) != check:
            raise ValueError(f"frame length at byte {at} fails its check")
        payload = bytes(view[at + 12:at + 12 + length])
        stored, = struct.unpack_from("<I", view, at + 12 + length)
        if masked(payload) != stored or bytes(view[at + 16 + length:at + 17 + length]) != END:
            raise ValueError(f"frame at byte {at} fails its check")
        doc_id, flags = _META.unpack_from(payload)
        ids = payload[_META.size:]
        if not flags & 2:
            ids = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
        yield at, length + 17, None if flags & 1 else doc_id, ids
        at += length + 17


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, wide: bool = False) -> None:
    """Write one shard per range of doc_id below ``path``."""
    tail = np.array([end_id], dtype="<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(it):
            flat, at = encoder(tokenizer).flat(b.column("text"))
            out = [frame(d, flat[at[i]:at[i + 1]].tobytes() + tail, wide)[:-len(END)] for i, d in enumerate(b.column("doc_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("tie"))
    # the hash splits a doc_id that very many rows share
    ordered = slim.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    records = map_batches(ordered.select("doc_id", "text"), batches, "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the shards: shard, frame_offset, frame_bytes, doc_id,
    ids and shard_start (ids of the shard before it)."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "frame_offset", "frame_bytes", "doc_id", "ids", "shard_start"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for b in it:
            for shard, content in zip(b.column("path").to_pylist(), b.column("content")):
                rows, start = [], 0
                for at, size, doc_id, ids in frames(content.as_py()):
                    rows.append((shard.rpartition("/")[2], at, size, doc_id, ids, start))
                    start += len(ids) // 4
                    if len(rows) == 1024:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return map_batches(files, batches, "shard string, frame_offset long, frame_bytes long, doc_id long, ids binary, shard_start long")


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Build the offset index from the shards; returns it.  ``start`` is the
    number of ids before a record over all shards; it comes from one sum a
    shard, in order of the shards, which are ranges of doc_id."""
    records = read(spark, path)
    rows = records.select("shard", "frame_offset", "frame_bytes", "doc_id", "shard_start",
                          (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    rows.write.parquet(f"{index_path}-parts")
    rows = spark.read.parquet(f"{index_path}-parts")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("shard", (F.sum("total").over(W.orderBy("shard")) - F.col("total")).alias("before"))
    index = rows.join(F.broadcast(before), "shard").select(
        "shard", "doc_id", "frame_offset", "frame_bytes", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
    index.write.parquet(index_path)
    return spark.read.parquet(index_path)
