"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Whether two neighbouring tokens merge can depend on what follows, but only
through a chain of merges of ever lower rank, each taking the token on its
right away from the one before.  ``sufficient_lookahead`` follows these chains
over the whole merge list and gives the number of symbols after a token beyond
which nothing can change it.  The transducer holds a window of symbols, merges
it, emits the tokens that lie at least the lookahead before the window's end,
and goes on with the rest: its memory does not grow with the pre-token.  The
decoder is a state machine over ids that emits text as soon as the bytes of a
character are complete.

Defined results: null text counts as empty and has no ids; special tokens in a
text are found as the file says; truncation and padding of the file are not
used; repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches
from quarry.llm.encoder import Encoder, byte_symbols, regroup

#: Pre-token pattern of byte-level files that name none (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Symbols a transducer reads before it merges its window, beyond the lookahead.
READ = 2048
#: Symbols up to which a plain scan finds the next merge faster than a heap.
FEW = 64
#: Stands for no merge, and the bits of a merge that name its token.
NEVER, RESULT = 1 << 62, (1 << 32) - 1


def sufficient_lookahead(merges: list[tuple[int, int, int]], size: dict[int, int]) -> int:
    """Symbols of right context that decide a token, for merges (left, right,
    result) in rank order and the symbol count of each token."""
    reach: dict[int, int] = {}       # token -> longest chain that begins by taking it to the right, so far
    made: dict[int, list[int]] = {}  # token -> right parts it was made with
    longest = 0

    def through(token: int) -> int:
        best, todo, seen = 0, [token], set()
        while todo:
            t = todo.pop()
            if t not in seen:
                seen.add(t)
                best = max(best, reach.get(t, 0))
                todo += made.get(t, ())
        return best

    for left, right, result in merges:
        chain = size[right] + through(right)
        longest = max(longest, chain)
        reach[left] = max(reach.get(left, 0), chain)
        made.setdefault(result, []).append(right)
    return longest


class Transducer:
    """Tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.symbol = byte_symbols()
        merges = []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        # rank in the upper bits, the token made in the lower ones
        self.order = {(a, b): rank << 32 | c for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        self.inner = [vocab[self.symbol[b]] for b in range(256)]
        self.last = [vocab[self.symbol[b] + self.suffix] for b in range(256)]
        size = {i: len(t.removesuffix(self.suffix)) or len(t) for t, i in vocab.items()}
        self.size = size
        self.lookahead = sufficient_lookahead(merges, size)
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        self.folds = any(s["type"] == "Lowercase" for s in steps)
        splits = [s for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"] if splits else BYTE_LEVEL)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = {i: t for t, i in vocab.items()} | {i: t for t, i in special.items()}
        self.joined = spec["decoder"] is None
        self._spelled = None

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all tokens, where each id's begin, how many it has); of
        files without a decoder the token's string after a space."""
        if self._spelled is None:
            bytes_of = {c: b for b, c in self.symbol.items()}
            each = [b""] * (max(self.strings) + 1)
            for i, t in self.strings.items():
                each[i] = " ".encode() + t.encode() if self.joined else t.encode() if any(c not in bytes_of for c in t) else bytes(bytes_of[c] for c in t)
            size = np.array([len(x) for x in each], dtype=np.int64)
            self._spelled = np.frombuffer(b"".join(each), np.uint8), np.cumsum(size) - size, size
        return self._spelled

    def merge(self, tokens: list[int]) -> list[int]:
        """All merges of a window, lowest rank first, left to right."""
        return self._merge_few(tokens) if len(tokens) <= FEW else self._merge_many(tokens)

    def _merge_few(self, tokens: list[int]) -> list[int]:
        order = self.order.get
        pairs = [order(p, NEVER) for p in zip(tokens, tokens[1:])]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            tokens[i:i + 2] = [best & RESULT]
            del pairs[i]
            if i:
                pairs[i - 1] = order((tokens[i - 1], tokens[i]), NEVER)
            if i < len(pairs):
                pairs[i] = order((tokens[i], tokens[i + 1]), NEVER)
        return tokens

    def _merge_many(self, tokens: list[int]) -> list[int]:
        """The same with a heap of the merges that stand and links to the
        neighbours: n log n steps for n symbols."""
        order, n = self.order.get, len(tokens)
        tokens, after, before = list(tokens), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (m := order((a, b))) is not None]
        heapq.heapify(heap)

        def meet(i: int, j: int) -> None:
            m = order((tokens[i], tokens[j]))
            if m is not None:
                heapq.heappush(heap, (m, i, tokens[i], tokens[j]))
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != a or j >= n or tokens[j] != b:
                continue                     # one of the two has been taken by another merge
            tokens[i], tokens[j] = m & RESULT, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                meet(i, after[i])
            if before[i] >= 0:
                meet(before[i], i)
        return [t for t in tokens if t is not None]

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one pre-token's bytes, each as soon as it is stable."""
        window: list[int] = []
        previous = None
        for b in data:
            if previous is not None:
                window.append(self.inner[previous])
                if len(window) >= self.lookahead + READ:
                    end, limit, i = 0, len(window) - self.lookahead, 0
                    tokens = self.merge(window)
                    while i < len(tokens) and end + self.size[tokens[i]] <= limit:
                        end += self.size[tokens[i]]
                        yield tokens[i]
                        i += 1
                    window = window[end:]
            previous = b
        if previous is not None:
            window.append(self.last[previous])
            yield from self.merge(window)

    def encode(self, text: str) -> Iterator[int]:
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield self.special[part]
                continue
            if self.folds:
                # every character is lowered by itself: a capital sigma never becomes the final one
                part = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", part)).replace("Σ", "σ").lower()
            for m in self.pattern.finditer(part):
                if m.group():
                    yield from self.stream(m.group().encode("utf-8"))


class TransducingEncoder(Encoder):
    """The piece cache, filled by the transducer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self._prepare(json.load(f))
        self.transducer = Transducer(path)

    def _letters(self, data: bytes) -> list[int]:
        t = self.transducer
        return t.merge([*map(t.inner.__getitem__, data[:-1]), t.last[data[-1]]]) if len(data) <= FEW else list(t.stream(data))

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array("I", self.transducer.encode(p)).tobytes() for p in pieces]


class Decoder:
    """``feed`` ids, in blocks of any size; ``close`` at the end."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        self.first = True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        """The characters that the bytes so far complete."""
        data, begin, length = self.t.spelled()
        ids = ids[ids < len(length)]
        n = length[ids].astype(np.int64)
        end = np.cumsum(n)
        out = data[np.repeat(begin[ids] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()
        if self.t.joined and out and self.first:
            out, self.first = out[1:], False         # tokens are joined by spaces: none before the first
        return self.utf8.decode(out)

    def close(self) -> str:
        return self.utf8.decode(b"", True)


_WORKERS: dict[str, TransducingEncoder] = {}


def worker(path: str) -> TransducingEncoder:
    if path not in _WORKERS:
        _WORKERS[path] = TransducingEncoder(path)
    return _WORKERS[path]


def decode_ids(transducer: Transducer, ids: bytes, block: int = 65_536) -> str:
    decoder, out = Decoder(transducer), []
    numbers = np.frombuffer(ids, "<u4")
    for i in range(0, len(numbers), block):
        out.append(decoder.feed(numbers[i:i + block]))
    return "".join(out) + decoder.close()


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit) of every row; narrow."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regroup(it):
            flat, at = worker(tokenizer).flat(b.column("text"))
            ids = [flat[at[i]:at[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batches, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the text the ids stand for, of every row; narrow."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [decode_ids(worker(tokenizer).transducer, x or b"") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(text, pa.string())], names=["doc_id", "ids", "text"])
    return map_batches(encoded.select("doc_id", "ids"), batches, "doc_id long, ids binary, text string")
