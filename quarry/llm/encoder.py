"""Token ids of many texts from a tokenizer file, with a bounded cache.

A text is cut where no pre-token, normalisation or special token of the file
can reach across, so the pieces' ids joined are the text's ids.  Each distinct
piece goes through the tokenizers library once while it stays in the cache.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points the library's patterns take as white space (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
_SPACED = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_SOLID = re.compile(f"[^{WHITE}]+")
_ODD = re.compile("[\x1c-\x1f]")

#: Pieces kept, and the longest that is kept: about 100 MB at most.
CACHE_PIECES, CACHE_CHARS = 500_000, 48
#: Ids kept for them, and bytes of text taken together.
POOL_IDS, TOGETHER = 8_000_000, 1 << 22
#: A run of these after a letter is always a pre-token apart (no apostrophe, nothing of a special token).
_TAIL = "!,.;:?#*$%&"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files:
    the printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = byte_symbols()


def regroup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``TOGETHER`` bytes: the more texts
    together, the more pieces they share."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TOGETHER:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def latin(word: str) -> bool:
    """Whether a word is letters of the Latin blocks without the dotted capital
    i: one pre-token, which stays as it is when normalised and is lowered letter
    by letter."""
    return word.isalpha() and (word.isascii() or max(word) <= "\u024f" and "\u0130" not in word)


def solid_pieces(text: str) -> list[str]:
    """Runs without white space."""
    # str.split also cuts at four control characters that the patterns keep
    return _SOLID.findall(text) if _ODD.search(text) else text.split()


def spaced_pieces(text: str) -> list[str]:
    """White space with the run that follows it."""
    return _SPACED.findall(text)


class Encoder:
    """``ids(texts)``: little-endian unsigned 32-bit ids of each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self._prepare(spec)

    def _prepare(self, spec: dict) -> None:
        # a file that drops white space can be cut on both sides of it
        self.drops_space = spec["normalizer"] is not None
        self.pieces = solid_pieces if self.drops_space else spaced_pieces
        self.cache: dict[str, bytes] = {}
        self._empty_table()

    def _encode(self, pieces: list[str]) -> list[bytes]:
        other, out = [], {}
        for p in pieces:
            if latin(p[1:] if p[0] == " " and not self.drops_space else p):
                out[p] = array("I", self._letters((p.lower() if self.drops_space else p).encode())).tobytes()
            else:
                other.append(p)
        for p, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            out[p] = array("I", e.ids).tobytes()
        return [out[p] for p in pieces]

    def _split(self, piece: str) -> tuple[str, str]:
        """(word, punctuation after it) with the piece's ids in that order."""
        word = piece.rstrip(_TAIL)
        # letters of the Latin blocks stay one letter when normalised and lowered, but for the dotted capital i
        if not word or not word[-1].isalpha() or word[-1] > "\u024f" or word[-1] == "\u0130":
            return piece, ""
        if self.drops_space and word.isascii() and word.isalpha():
            return word.lower(), piece[len(word):]
        return word, piece[len(word):]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the cache."""
        known = self.cache
        cut = {p: self._split(p) for p in pieces}
        parts = {x for own in cut.values() for x in own if x}.difference(known)
        if parts:
            parts = sorted(parts)
            known.update(zip(parts, self._encode(parts)))
        known[""] = b""
        for p, (word, tail) in cut.items():
            if p not in known:
                known[p] = known[word] + known[tail]

    def lengths(self, pieces: list[str]) -> list[int]:
        """Number of ids of each piece."""
        known = self.cache
        if len(known) > CACHE_PIECES:
            known.clear()
        missing = set(pieces).difference(known)
        if missing:
            self.learn(missing)
        return [len(known[p]) // 4 for p in pieces]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        flat, at = self.flat(pa.array(texts, pa.large_string()))
        return [flat[at[i]:at[i + 1]].tobytes() for i in range(len(texts))]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, bounds of each text's ids).

        Arrow cuts the texts and numbers their distinct pieces; the ids of each
        distinct piece come from a table and are gathered for all its places."""
        texts = texts.cast(pa.large_string()).fill_null("")
        size = np.diff(np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)) if len(texts) else np.zeros(0, np.int64)
        parts, bounds, lo = [], [np.zeros(1, np.int64)], 0
        done = 0
        while lo < len(texts):       # some texts at a time, one longer text alone
            hi, total = lo + 1, size[lo]
            while hi < len(texts) and total + size[hi] <= TOGETHER:
                total += size[hi]
                hi += 1
            flat, at = self._flat(texts.slice(lo, hi - lo))
            parts.append(flat)
            bounds.append(at[1:] + done)
            done += len(flat)
            lo = hi
        return (np.concatenate(parts) if parts else np.zeros(0, "<u4")), np.concatenate(bounds)

    def _flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            # white space beyond ASCII stays inside a piece, which is encoded whole
            lists = pc.ascii_split_whitespace(texts)
        else:
            # cuts before single spaces and line feeds that stand between other characters
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        words = np.diff(np.asarray(lists.offsets))
        coded = lists.flatten().dictionary_encode()
        code = np.asarray(coded.indices)
        first = np.cumsum(words) - words
        if len(self.table) > CACHE_PIECES or len(self.joined[0]) > POOL_IDS:
            self._empty_table()
        stem, tail = self._entries(coded.dictionary)
        entry = np.empty((len(code), 2), np.int64)
        entry[:, 0], entry[:, 1] = stem[code], tail[code]
        if not self.drops_space:
            # the first piece of a text has no space before it
            own = self._lookup(["\0" + x for x in coded.dictionary.take(pa.array(code[first])).to_numpy(zero_copy_only=False).tolist()])
            entry[first, 0], entry[first, 1] = own, 0
        odd = np.flatnonzero(np.bincount(np.repeat(np.arange(len(words)), words), entry[:, 0] < 0, len(words))) if len(entry) else []
        entry = np.maximum(entry, 0).ravel()
        pool, begin, length = self._pool()
        n = length[entry]
        end = np.cumsum(n)
        flat = pool[np.repeat(begin[entry] - end + n, n) + np.arange(end[-1] if len(end) else 0)]
        at = np.concatenate((np.zeros(1, np.int64), end[2 * np.cumsum(words) - 1] if len(end) else np.zeros(len(words), np.int64)))
        self._forget_long()
        if not len(odd):
            return flat, at
        rows = [flat[at[i]:at[i + 1]] for i in range(len(words))]
        for i, ids in zip(odd, self._by_pieces(texts.take(pa.array(odd)).to_pylist())):
            rows[i] = np.frombuffer(ids, "<u4")
        return np.concatenate(rows), np.concatenate((np.zeros(1, np.int64), np.cumsum([len(r) for r in rows])))

    def _entries(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Table entries of each distinct piece: the piece without the
        punctuation after it, and that punctuation (0: none)."""
        bare = pc.ascii_rtrim(pieces, characters=_TAIL)
        whole, cut = (np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8) for x in (pieces, bare))
        left = np.diff(cut)
        data = np.frombuffer(bare.buffers()[2] or b"", np.uint8)
        last = data[np.maximum(cut[1:] - 1, 0)] if len(data) else np.zeros(len(bare), np.uint8)
        lead = data[np.maximum(cut[1:] - 2, 0)] if len(data) else last
        # letters of the Latin blocks, which stay one letter when normalised and lowered (but for the dotted capital i)
        latin = (lead >= 0xC3) & (lead <= 0xC8) & (left > 1) & (last >= 0x80) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))) & ~((lead == 0xC4) & (last == 0xB0))
        letter = (left > 0) & (((last | 0x20) >= ord("a")) & ((last | 0x20) <= ord("z")) & (last < 0x80) | latin)
        cuts = letter & (left < np.diff(whole))
        stems = pc.if_else(pa.array(letter), bare, pieces)
        if self.drops_space:
            stems = pc.if_else(pc.ascii_is_alpha(stems), pc.ascii_lower(stems), stems)
        coded = stems.dictionary_encode()
        stem = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        tail = np.zeros(len(pieces), np.int64)
        where = np.flatnonzero(cuts)
        if len(where):
            raw = np.frombuffer(pieces.buffers()[2], np.uint8)
            size = np.diff(whole)[where] - left[where]
            ends = np.cumsum(size)
            chars = raw[np.repeat(whole[where] + left[where] - ends + size, size) + np.arange(ends[-1])]
            tails = pa.LargeStringArray.from_buffers(len(where), pa.py_buffer(np.concatenate((np.zeros(1, np.int64), ends))), pa.py_buffer(chars)).dictionary_encode()
            tail[where] = self._lookup(["\0" + x for x in tails.dictionary.to_pylist()])[np.asarray(tails.indices)]
        return stem, tail

    # ---- the table: key -> entry; a key is what stands between two cuts, or \0 and a piece that has no space before it

    def _empty_table(self) -> None:
        self.table: dict[str, int] = {"": 0 if self.drops_space else -1, "\0": 0}
        self.new_ids = array("I")             # ids of new entries, joined to the pool when read
        self.lengths_of: list[int] = [0]
        self.joined = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.long: list[str] = []

    def _lookup(self, keys: list[str]) -> np.ndarray:
        known = self.table
        out = list(map(known.get, keys))
        if None in out:
            at = [i for i, e in enumerate(out) if e is None]
            self._add(list(dict.fromkeys([keys[i] for i in at])))
            for i in at:
                out[i] = known[keys[i]]
        return np.array(out, dtype=np.int64)

    def _add(self, keys: list[str]) -> None:
        table, lengths, ids, rest = self.table, self.lengths_of, self.new_ids, []
        for k in keys:
            if latin(k):
                own = self._letters((k.lower() if self.drops_space else " " + k).encode())
                table[k] = len(lengths)
                ids.extend(own)
                lengths.append(len(own))
                if len(k) > CACHE_CHARS:
                    self.long.append(k)
            else:
                rest.append(k)
        wanted = []
        for k in rest:
            p = k[1:] if k[:1] == "\0" else k if self.drops_space or k[:1] == "\n" else " " + k
            if not self.drops_space:
                solid = (p if k[:1] == "\0" else p.removeprefix(" ")).removeprefix("\n")
                if not solid or solid != solid.strip():      # white space at a cut
                    table[k] = -1
                    continue
            wanted.append((k, p))
        for (k, _), own in zip(wanted, self._encode([p for _, p in wanted])):
            table[k] = len(lengths)
            ids.frombytes(own)
            lengths.append(len(own) // 4)
            if len(k) > CACHE_CHARS:
                self.long.append(k)

    def _letters(self, data: bytes) -> list[int]:
        """Ids of a pre-token of letters, as the file leaves them: only the merges of its bytes are left to do."""
        return [t.id for t in self.model.tokenize(data.decode("latin-1").translate(_SYMBOLS))]

    def _pool(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all entries, where each begins, how many each has)"""
        pool, begin, length = self.joined
        if len(length) < len(self.lengths_of):
            new = np.array(self.lengths_of[len(length):], dtype=np.int64)
            begin = np.concatenate((begin, len(pool) + np.cumsum(new) - new))
            pool = np.concatenate((pool, np.array(self.new_ids, dtype="<u4")))
            self.joined, self.new_ids = (pool, begin, np.concatenate((length, new))), array("I")
        return self.joined

    def _forget_long(self) -> None:
        for k in self.long:
            del self.table[k]
        self.long = []

    def _by_pieces(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.pieces(t or "") for t in texts]
        known = self.cache
        if len(known) > CACHE_PIECES:
            known.clear()
        missing = set().union(*cut).difference(known)
        if missing:
            self.learn(missing)
        out = [b"".join(map(known.__getitem__, own)) for own in cut]
        for p in missing:
            if len(p) > CACHE_CHARS:
                for x in {p, *self._split(p)}:
                    known.pop(x, None)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The Python worker's encoder of this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
