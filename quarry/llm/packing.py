"""Sum-of-squares online packing of documents into sequences.

A level array counts the open sequences by fill level.  A document (what is
left of it after whole windows of its own) goes into the level that makes the
sum of squared counts least: opening at 0, or lifting a sequence from level h
to h + s, changes it by 2 (N[h+s] - N[h]) + 2.  Each partition of the input
packs its own documents with its own array in one narrow pass, so nothing is
shuffled and no task sees more than its partition.

To end with hardly any padding, a partition holds back its latest documents
while their ids are as many as the room open below the windows' brims; at the
end these are cut to fill the open sequences to the brim, and what remains
makes whole windows and a tail of powers of two.  The ids held back and the
level array are bounded by the open room.

Defined results: null and empty texts have the end id only; repeated rows are
packed each; extra columns are ignored; an empty table gives an empty result.
A piece is (doc_id, start, length, ids, doc_tokens, sequence_id, offset).
sequence_id is the partition's number times 2**32 plus a number within it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches
from quarry.llm.encoder import encoder, regroup

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online packer of one partition; ``add`` and ``finish`` yield pieces
    (key, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)   # open sequences by level; 0 and the brim count none
        self.open: dict[int, list[int]] = {}                 # level -> sequences
        self.sequences = 0
        self.room = 0
        self.held: deque = deque()
        self.held_ids = 0

    def _new(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def choose(self, size: int) -> int:
        """The level whose lifting by ``size`` makes the sum of squares least; 0 opens a sequence."""
        n, top = self.levels, self.window - size
        change = 2 * (n[size:] - n[:top + 1]) + 2
        change[0] = 2 * n[size] + 1 if size < self.window else 0
        if top:
            change[top] = 1 - 2 * n[top]
        change[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))  # of equals the fullest

    def _place(self, key, start: int, size: int) -> tuple:
        level = self.choose(size)
        if level:
            sequence = self.open[level].pop()
            self.levels[level] -= 1
            self.room -= size
        else:
            sequence = self._new()
            self.room += self.window - size
        if level + size < self.window:
            self.open.setdefault(level + size, []).append(sequence)
            self.levels[level + size] += 1
        return key, start, size, sequence, level

    def add(self, key, size: int) -> Iterator[tuple]:
        start = 0
        while size - start >= self.window:
            yield key, start, self.window, self._new(), 0
            start += self.window
        if size > start:
            self.held.append((key, start, size - start))
            self.held_ids += size - start
        while self.held and self.held_ids - self.held[0][2] >= self.room + self.window:
            key, start, size = self.held.popleft()
            self.held_ids -= size
            yield self._place(key, start, size)

    def finish(self) -> Iterator[tuple]:
        """Fills the open sequences with the documents held back, cut freely."""
        gaps = [(s, level, self.window - level) for level in sorted(self.open, reverse=True) for s in self.open[level]]
        left = self.held_ids - self.room
        while left >= self.window:
            gaps.append((self._new(), 0, self.window))
            left -= self.window
        while left > 0:                                        # the tail, as powers of two
            part = 1 << (left.bit_length() - 1)
            gaps.append((self._new(), 0, part))
            left -= part
        gaps.reverse()
        sequence, offset, free = gaps.pop() if gaps else (0, 0, 0)
        for key, start, size in self.held:
            while size:
                if not free:
                    sequence, offset, free = gaps.pop()
                part = min(size, free)
                yield key, start, part, sequence, offset
                start, size, offset, free = start + part, size - part, offset + part, free - part


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of every document with their ids; one narrow pass."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        packer, tail = Packer(window), np.array([end_id], dtype="<u4").tobytes()
        waiting: dict[int, list] = {}        # documents not yet wholly placed: id, ids, ids left
        row = 0

        def made(pieces) -> pa.RecordBatch:
            cols = [[] for _ in range(7)]
            for key, start, size, sequence, offset in pieces:
                doc = waiting[key]
                doc[2] -= size
                for c, v in zip(cols, (doc[0], start, size, doc[1][4 * start:4 * (start + size)], len(doc[1]) // 4, first + sequence, offset)):
                    c.append(v)
                if not doc[2]:
                    del waiting[key]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                              names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in regroup(it):
            pieces = []
            flat, at = encoder(tokenizer).flat(b.column("text"))
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                ids = flat[at[i]:at[i + 1]].tobytes() + tail
                waiting[row] = [d, ids, len(ids) // 4]
                pieces += packer.add(row, len(ids) // 4)
                row += 1
            yield made(pieces)
        yield made(packer.finish())
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, SCHEMA)
