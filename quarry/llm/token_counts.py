"""Edit-aware token counts.

For each document a tree over its pieces (pre-tokens that start with white
space) is kept: pages of pieces at the bottom, each piece with its length and
token count, and above them a segment tree of the pages' sums.  An edit walks
down by character position, takes the touched pieces with one untouched piece
on either side as boundary context, encodes only that region anew, and updates
the sums on the way up.  Pieces begin at white space after other text, where
no pre-token reaches across, so the rest of the document keeps its counts.

Documents and edits meet in one shuffle on doc_id and stream through each
task in order of (doc_id, seq); a task holds one document at a time, however
many edits there are.

Defined results: null text counts as empty; an edit (start, n_delete, insert)
is clipped to the text as it then is, nulls count as 0 and empty; edits of
equal seq are applied in order of (start, n_delete, insert); edits without a
document and with a null doc_id are ignored; rows of one doc_id are one
document, the text with the least hash counts; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches, text_key
from quarry.llm.encoder import Encoder, encoder

PAGE = 64
SCHEMA = "doc_id long, n_tokens_before long, n_edits long, n_tokens long, n_chars_encoded long"


class Sums:
    """Segment tree of (characters, tokens) of the pages."""

    def __init__(self, values: list[tuple[int, int]]):
        self.size = 1
        while self.size < max(1, len(values)):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (c, t) in enumerate(values):
            self.chars[self.size + i], self.tokens[self.size + i] = c, t
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    def _pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def set(self, at: int, chars: int, tokens: int) -> None:
        i = self.size + at
        self.chars[i], self.tokens[i] = chars, tokens
        while i > 1:
            i //= 2
            self._pull(i)

    def find(self, position: int) -> tuple[int, int]:
        """(page, characters before it) of a character position."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position >= before + self.chars[i]:
                before += self.chars[i]
                i += 1
        return i - self.size, before


class Document:
    """A text, its pieces in pages, and the tree of the pages' sums."""

    def __init__(self, text: str, enc: Encoder):
        self.enc, self.text, self.encoded = enc, text, 0
        self.pages = self._paged(self._pieces(text)) or [[]]
        self.sums = Sums([self._sum(p) for p in self.pages])

    def _pieces(self, text: str) -> list[tuple[int, int]]:
        pieces = self.enc.pieces(text)
        self.encoded += len(text)
        return list(zip(map(len, pieces), self.enc.lengths(pieces)))

    @staticmethod
    def _paged(pieces: list) -> list[list]:
        return [pieces[i:i + PAGE] for i in range(0, len(pieces), PAGE)]

    @staticmethod
    def _sum(page: list) -> tuple[int, int]:
        return sum(c for c, _ in page), sum(t for _, t in page)

    @property
    def n_tokens(self) -> int:
        return self.sums.tokens[1]

    def _locate(self, position: int) -> tuple[int, int, int]:
        """(page, piece, first character of the piece) that hold a position."""
        page, before = self.sums.find(max(0, min(position, len(self.text) - 1)))
        page = min(page, len(self.pages) - 1)
        for i, (chars, _) in enumerate(self.pages[page]):
            if position < before + chars or i == len(self.pages[page]) - 1:
                return page, i, before
            before += chars
        return page, 0, before

    def _next(self, page: int, piece: int, step: int) -> tuple[int, int] | None:
        piece += step
        while not 0 <= piece < len(self.pages[page]):
            page += step
            if not 0 <= page < len(self.pages):
                return None
            piece = 0 if step > 0 else len(self.pages[page]) - 1
        return page, piece

    def edit(self, start: int, n_delete: int, insert: str) -> None:
        start = max(0, min(start, len(self.text)))
        end = min(len(self.text), start + max(0, n_delete))
        if start == end and not insert:
            return
        if not self.text:
            first, last, lo, hi = (0, 0), (0, -1), 0, 0
        else:
            p, i, lo = self._locate(max(0, start - 1))
            first = (p, i)
            if left := self._next(p, i, -1):
                first, lo = left, lo - self.pages[left[0]][left[1]][0]
            p, i, hi = self._locate(max(start, end - 1) if end < len(self.text) else len(self.text) - 1)
            hi += self.pages[p][i][0]
            last = (p, i)
            # two on the right: the piece after the edit's end may be the one it touches
            for _ in range(2):
                if right := self._next(*last, 1):
                    last, hi = right, hi + self.pages[right[0]][right[1]][0]
        self.text, region = (self.text[:start] + insert + self.text[end:],
                             self.text[lo:start] + insert + self.text[end:hi])
        pieces = self._pieces(region)
        merged = self.pages[first[0]][:first[1]] + pieces + self.pages[last[0]][last[1] + 1:]
        if first[0] == last[0] and 0 < len(merged) <= 2 * PAGE:
            self.pages[first[0]] = merged
            self.sums.set(first[0], *self._sum(merged))
        else:                                   # pages come or go: their tree is laid out anew, the pieces are not
            self.pages[first[0]:last[0] + 1] = self._paged(merged)
            self.pages = self.pages or [[]]
            self.sums = Sums([self._sum(p) for p in self.pages])


def recount(docs: DataFrame, edits: DataFrame, tokenizer: str) -> DataFrame:
    """Counts of every document before and after its ``edits`` (doc_id, seq,
    start, n_delete, insert), and how many characters were encoded for them."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_tokens_before", "n_edits", "n_tokens", "n_chars_encoded"]
        doc = key = None
        before = n = 0

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], names=names)

        def row() -> tuple:
            return key, before, n, doc.n_tokens, doc.encoded
        for b in it:
            out = []
            for d, is_doc, text, start, n_delete in zip(*(b.column(c).to_pylist() for c in ("doc_id", "is_doc", "text", "start", "n_delete"))):
                if is_doc:
                    if doc is not None and (d is None or d != key):
                        out.append(row())
                    elif doc is not None:
                        continue                 # another row of the same document
                    doc, key, n = Document(text or "", encoder(tokenizer)), d, 0
                    before, doc.encoded = doc.n_tokens, 0
                elif doc is not None and d is not None and d == key:
                    doc.edit(start or 0, n_delete or 0, text or "")
                    n += 1
            yield batch(out)
        if doc is not None:
            yield batch([row()])

    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("is_doc"), text_key().alias("seq"), "text",
                        F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("n_delete"))
    change = edits.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(False).alias("is_doc"), F.col("seq").cast("long").alias("seq"),
        F.col("insert").alias("text"), F.col("start").cast("long").alias("start"), F.col("n_delete").cast("long").alias("n_delete"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = whole.union(change).repartition(n, "doc_id").sortWithinPartitions("doc_id", F.desc("is_doc"), "seq", "start", "n_delete", "text")
    return map_batches(both.select("doc_id", "is_doc", "text", "start", "n_delete"), batches, SCHEMA)
